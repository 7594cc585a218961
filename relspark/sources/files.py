"""Readers and writers of delimited and JSON files with declared schemas."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("tsv", "csv", "json", "jsonl", "parquet")


class HeaderError(ValueError):
    """A file's first line is not the header that was asked for."""


def format_of(path: str) -> str:
    """A path's format by its extension."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in FORMATS:
        raise ValueError(f"{path}: no format for .{ext}")
    return ext


def _fields(line: str, fmt: str, sep: str) -> list[str]:
    if fmt == "tsv":
        return line.rstrip("\r\n").split("\t")
    import csv

    return next(csv.reader([line], delimiter=sep), [])


def check_header(spark: SparkSession, path: str, header: list[str] | str, fmt: str, sep: str = ",") -> None:
    """Compare the first line of every file with a list of names, or with a line."""
    want = _fields(header, fmt, sep) if isinstance(header, str) else list(header)
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(sc._jsc.hadoopConfiguration())
    # one line of each file is read, by the tasks that read the file names
    found = [s.getPath().toString() for s in files.globStatus(at) or []]
    names = [x for f in found for x in _files_of(spark, f)]
    if not names:
        raise FileNotFoundError(path)
    for name in names:
        first = spark.read.text(name).first()
        line = _fields(first[0] if first else "", fmt, sep)
        if line != want:
            raise HeaderError(f"{name}: header {line}, not {want}")


def _files_of(spark: SparkSession, path: str) -> list[str]:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if files.getFileStatus(at).isFile():
        return [path]
    return sorted(s.getPath().toString() for s in files.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def read(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    fmt: str | None = None,
    header: bool | str | list[str] = False,
    sep: str | None = None,
    map: Callable[[DataFrame], DataFrame] | None = None,
    filter: Column | str | None = None,
    flat_map: Callable[[DataFrame], DataFrame] | None = None,
    strict: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Rows of a file or folder; each file's header is none (False), skipped (True) or must match (names).

    tsv: tabs split, nothing is quoted, empty fields are empty texts.  csv: `"` quotes, `""` stands for one.
    A csv field that holds a line end needs multi_line, which makes one task of each file.
    json: one array; jsonl: a value a line.  Integers are strict base 10 when `strict`, else null where they are not.
    map then filter, or flat_map, are applied to what was read.
    """
    if flat_map and (map or filter is not None):
        raise ValueError("flat_map goes with neither map nor filter")
    fmt = fmt or format_of(path)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if isinstance(header, (str, list)):
        check_header(spark, path, header, fmt, sep or ",")
    if fmt == "parquet":
        df = spark.read.schema(schema).parquet(path)
    elif fmt in ("json", "jsonl"):
        df = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", fmt == "json").json(path)
    else:
        texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        if fmt == "tsv":
            df = _lines(spark, path, texts.names, sep or "\t", bool(header))
        else:
            reader = spark.read.schema(texts).option("header", bool(header)).option("enforceSchema", True).option("mode", "FAILFAST").option("nullValue", "\x00").option("emptyValue", "")
            df = reader.option("sep", sep or ",").option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path).fillna("")
        df = df.select(*(_typed(F.col(f.name), f, strict).alias(f.name) for f in schema.fields))
    if map:
        df = map(df)
    if filter is not None:
        df = df.filter(filter)
    return flat_map(df) if flat_map else df


def _lines(spark: SparkSession, path: str, names: list[str], sep: str, header: bool) -> DataFrame:
    """Lines cut at every separator, whatever is in them; an empty line is a row of one empty field."""
    rows = spark.read.text(path)
    if header:
        # a file's first line is where its first block begins
        rows = rows.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("__at"))
        first = rows.filter("file_block_start = 0").groupBy("file_path").agg(F.min("__at").alias("__first"))
        rows = rows.join(F.broadcast(first), "file_path").filter("__at != __first").select("value")  # a row for each file
    # a line end may be \r\n
    cells = F.split(F.regexp_replace("value", "\r$", ""), f"\\Q{sep}\\E", -1)
    wrong = F.raise_error(F.concat(F.lit(f"{path}: a line without {len(names)} fields: "), F.col("value")))
    fields = F.when(F.size("__cells") == len(names), F.col("__cells")).otherwise(wrong.cast("array<string>"))
    return rows.select("value", cells.alias("__cells")).select(fields.alias("__cells")).select(*(F.get("__cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


def _typed(value: Column, field: T.StructField, strict: bool) -> Column:
    if isinstance(field.dataType, T.StringType):
        return value
    if isinstance(field.dataType, T.BinaryType):
        return F.encode(value, "UTF-8")
    typed = value.try_cast(field.dataType)
    if isinstance(field.dataType, T.IntegralType):
        typed = F.when(value.rlike("^-?[0-9]{1,18}$"), typed)
    if not strict:
        return typed
    wrong = F.raise_error(F.concat(F.lit(f"{field.name}: not a {field.dataType.simpleString()}: "), value))
    return F.when(typed.isNull(), wrong.cast(field.dataType)).otherwise(typed)


def relation(spark: SparkSession, path: str, schema: str | T.StructType, **how) -> DataFrame:
    """What read() gives, as a set."""
    return read(spark, path, schema, **how).distinct()


def literal(spark: SparkSession, columns: str | T.StructType, rows: Iterable) -> DataFrame:
    """A relation of the rows given."""
    return spark.createDataFrame(list(rows), columns).distinct()


def write(df: DataFrame, path: str, fmt: str | None = None, header: bool = False, exists: str = "error", sep: str | None = None) -> None:
    """exists: error, replace, append or ignore.  csv quotes a field only if it holds the separator, a quote or a line end."""
    fmt = fmt or format_of(path)
    mode = {"error": "errorifexists", "replace": "overwrite"}.get(exists, exists)
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "jsonl":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif fmt == "tsv":
        bad = F.lit(False)
        for c in df.columns:
            bad = bad | F.coalesce(F.col(c).cast("string").rlike("[\t\r\n]"), F.lit(False))
        lines = F.when(bad, F.raise_error(F.lit("a tab or line end inside a field"))).otherwise(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)))
        out = df.select(lines.alias("value"))
        if header:
            # the header goes in front of each file's rows
            names = "\t".join(df.columns)
            out = out.withColumn("__first", F.monotonically_increasing_id() % (1 << 33) == 0)
            out = out.select(F.explode(F.when(F.col("__first"), F.array(F.lit(names), F.col("value"))).otherwise(F.array("value"))).alias("value"))
        out.write.mode(mode).text(path)
    elif fmt == "csv":
        df.write.mode(mode).option("sep", sep or ",").option("header", header).option("escape", '"').option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:  # one array in one file: for results of a size that one task may write
        df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]"))).write.mode(mode).text(path)


def json_term(text: str):
    """A JSON text as a term: arrays are lists, objects dicts."""
    return json.loads(text)
