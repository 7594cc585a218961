"""Command line: csv2tsv reads CSV from standard input and writes TSV; cat shows a Parquet table's rows."""

from __future__ import annotations

import csv
import sys


def csv2tsv(source=sys.stdin, sink=sys.stdout) -> None:
    for row in csv.reader(source):
        if any(c in field for field in row for c in "\t\r\n"):
            raise ValueError(f"a tab or line end inside a field: {row!r}")
        sink.write("\t".join(row) + "\n")


def main(args: list[str]) -> int:
    if args[:1] == ["csv2tsv"]:
        csv2tsv()
    elif args[:1] == ["cat"] and len(args) > 1:
        import pyarrow.dataset as ds

        for batch in ds.dataset(args[1]).to_batches():
            for row in batch.to_pylist():
                print(row)
    else:
        print("usage: python -m relspark.cli csv2tsv | cat PATH", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
