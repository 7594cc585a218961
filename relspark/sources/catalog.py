"""A persistent collection of named relations: Parquet tables and a manifest that is replaced as a whole.

Changes are made to a working copy of the manifest and seen by others at commit; revert drops them.  A relation's
content is a set expression over physical tables, evaluated when read: the name of a table, ("+", ...) or ("-", a, b).
"""

from __future__ import annotations

import copy
import hashlib
import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rewrite import clean

VERSION = 1


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        self._committed = self._load()
        self._now = copy.deepcopy(self._committed)

    # manifest

    def _load(self) -> dict:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        versions = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not versions:
            return {"version": VERSION, "number": 0, "relations": {}}
        text = self.spark.sparkContext.wholeTextFiles(f"{self.path}/manifest-{versions[-1]}.json").first()[1]
        found = json.loads(text)
        if found["version"] != VERSION:
            raise ValueError(f"{self.path}: format {found['version']}, not {VERSION}")
        return found

    def commit(self) -> None:
        """Write the next manifest under a name of its own, then rename it: readers see all changes or none."""
        self._now["number"] = self._committed["number"] + 1
        final = f"{self.path}/manifest-{self._now['number']}.json"
        if self._fs.exists(self._path(final)):
            raise RuntimeError("another writer has committed meanwhile")
        temporary = f"{self.path}/next-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(temporary))
        out.write(bytearray(json.dumps(self._now).encode()))
        out.close()
        if not self._fs.rename(self._path(temporary), self._path(final)):
            raise RuntimeError("another writer has committed meanwhile")
        self._committed = copy.deepcopy(self._now)

    def revert(self) -> None:
        self._now = copy.deepcopy(self._committed)

    def vacuum(self) -> list[str]:
        """Delete tables that neither the committed nor the working manifest reads, and old manifests."""
        kept = [r for m in (self._committed, self._now) for r in m["relations"].values()]
        used = {t for r in kept for t in _tables(r["content"])} | {t for r in kept if r.get("copies") for t in r["copies"]["tables"].values()}
        gone = []
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            old = name.startswith("manifest-") and name != f"manifest-{self._committed['number']}.json"
            if old or name.startswith("next-") or name.startswith("t-") and name not in used:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return gone

    # relations

    def names(self) -> list[str]:
        return sorted(self._now["relations"])

    def __contains__(self, name: str) -> bool:
        return name in self._now["relations"]

    def _entry(self, name: str) -> dict:
        if name not in self:
            raise KeyError(f"no relation {name}")
        return self._now["relations"][name]

    def create(self, name: str, schema: str | T.StructType) -> None:
        """An empty relation."""
        if name in self:
            raise ValueError(f"{name} exists")
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if len({f.name for f in schema}) != len(schema):
            raise ValueError("attribute names must be unique")
        self._now["relations"][name] = {"schema": json.loads(schema.json()), "content": [], "indexes": [], "source": None}

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self._entry(name)["schema"])

    def relation(self, name: str, retrieval: str = "disk") -> DataFrame:
        """A relation's rows.  retrieval: disk reads them from files each time; bytes and scm hold them in the
        executors' memory once read, serialized or as objects, and beyond memory on disk."""
        entry = self._entry(name)
        rows = self._evaluate(_tupled(entry["content"]), self.schema(name))
        if retrieval == "disk":
            return rows
        return rows.persist({"bytes": StorageLevel.MEMORY_AND_DISK, "scm": StorageLevel.MEMORY_AND_DISK_DESER}[retrieval])

    def _evaluate(self, e, schema: T.StructType) -> DataFrame:
        if e == ():
            return self.spark.createDataFrame([], schema)
        if isinstance(e, str):
            return self.spark.read.schema(T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])).parquet(f"{self.path}/{e}").toDF(*schema.names)
        kind, *parts = e
        frames = [self._evaluate(p, schema) for p in parts]
        if kind == "-":
            return frames[0].subtract(frames[1])
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out.distinct()

    def insert(self, name: str, rows: DataFrame) -> None:
        """Add rows as one more table; the relation stays a set."""
        entry = self._entry(name)
        table = self._write(rows, self.schema(name))
        entry["content"] = _listed(clean(("+", _tupled(entry["content"]), table)))

    def _write(self, rows: DataFrame, schema: T.StructType) -> str:
        if [f.dataType for f in rows.schema] != [f.dataType for f in schema]:
            raise TypeError(f"rows of {rows.schema.simpleString()}, not {schema.simpleString()}")
        table = f"t-{uuid.uuid4().hex}"
        rows.toDF(*(f"c{i}" for i in range(len(schema)))).distinct().write.parquet(f"{self.path}/{table}")
        return table

    def assign(self, name: str, expression) -> None:
        """Replace a relation's content by a set expression over relations of the same types: a name, ("+", ...),
        ("-", a, b) or ()."""
        types = [f.dataType for f in self.schema(name)]

        def content(e):
            if isinstance(e, str):
                if [f.dataType for f in self.schema(e)] != types:
                    raise TypeError(f"{e} is not of {name}'s type")
                return _tupled(self._entry(e)["content"])
            return () if e == () else (e[0], *(content(p) for p in e[1:]))

        self._entry(name)["content"] = _listed(clean(content(expression)))

    def compact(self, name: str) -> None:
        """Make one table of a relation's content, sorted by its first index or its columns."""
        entry, schema = self._entry(name), self.schema(name)
        if not entry["content"] or isinstance(entry["content"], str):
            return
        order = entry["indexes"][0] if entry["indexes"] else schema.names
        rows = self.relation(name).repartitionByRange(*order).sortWithinPartitions(*order)
        table = f"t-{uuid.uuid4().hex}"
        rows.toDF(*(f"c{i}" for i in range(len(schema)))).write.parquet(f"{self.path}/{table}")
        entry["content"] = table

    def rename(self, name: str, to: str) -> None:
        if to in self:
            raise ValueError(f"{to} exists")
        self._now["relations"][to] = self._entry(name)
        del self._now["relations"][name]

    def rename_attributes(self, name: str, names: list[str]) -> None:
        schema = self.schema(name)
        if len(names) != len(schema) or len(set(names)) != len(names):
            raise ValueError(f"{len(schema)} unique names are needed")
        old = dict(zip(schema.names, names))
        entry = self._entry(name)
        entry["schema"] = json.loads(T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema)]).json())
        entry["indexes"] = [[old[c] for c in i] for i in entry["indexes"]]

    def copy(self, name: str, to: str) -> None:
        if to in self:
            raise ValueError(f"{to} exists")
        self._now["relations"][to] = copy.deepcopy(self._entry(name))

    def delete(self, name: str) -> None:
        self._entry(name)
        del self._now["relations"][name]

    def add_index(self, name: str, columns: list[str]) -> None:
        """A layout hint: compact() sorts by the first one, so that ranges of it skip row groups."""
        if unknown := set(columns) - set(self.schema(name).names):
            raise ValueError(f"{name} has no {', '.join(sorted(unknown))}")
        if list(columns) not in self._entry(name)["indexes"]:
            self._entry(name)["indexes"].append(list(columns))

    def remove_index(self, name: str, columns: list[str]) -> None:
        self._entry(name)["indexes"].remove(list(columns))

    def build_indexes(self, name: str) -> None:
        """A copy of the relation in the order of each of its indexes, whose columns the others follow, so that a range
        of the first column reads few row groups.  Copies go stale when the content changes, and are made anew here."""
        entry, schema = self._entry(name), self.schema(name)
        copies = {}
        for columns in entry["indexes"]:
            whole = [*columns, *(c for c in schema.names if c not in columns)]
            table = f"t-{uuid.uuid4().hex}"
            rows = self.relation(name).repartitionByRange(*whole).sortWithinPartitions(*whole)
            rows.toDF(*(f"c{i}" for i in range(len(schema)))).write.parquet(f"{self.path}/{table}")
            copies[json.dumps(columns)] = table
        entry["copies"] = {"of": entry["content"], "tables": copies}

    def _indexed(self, name: str, columns: list[str]) -> DataFrame:
        entry = self._entry(name)
        if list(columns) not in entry["indexes"]:
            raise KeyError(f"{name} has no index on {', '.join(columns)}")
        copies = entry.get("copies")
        if copies and copies["of"] == entry["content"] and (table := copies["tables"].get(json.dumps(list(columns)))):
            return self._evaluate(table, self.schema(name))
        return self.relation(name)

    def ordered(self, name: str, columns: list[str]) -> DataFrame:
        """A relation in the order of one of its indexes."""
        return self._indexed(name, columns).orderBy(*columns)

    def between(self, name: str, columns: list[str], low, high) -> DataFrame:
        """Rows whose first column of an index lies from low to high."""
        first = F.col(columns[0])
        return self._indexed(name, columns).filter((first >= low) & (first <= high))

    def index_dict(self, name: str, columns: list[str]) -> DataFrame:
        """A relation by one of its indexes: each value of its first column with the sorted rows of the others."""
        if list(columns) not in self._entry(name)["indexes"]:
            raise KeyError(f"{name} has no index on {', '.join(columns)}")
        first, *rest = columns
        others = [*rest, *(c for c in self.schema(name).names if c not in columns)]
        return self.relation(name).groupBy(first).agg(F.sort_array(F.collect_list(F.struct(*others))).alias("rows"))

    def texts(self, name: str) -> DataFrame:
        """(text, id): the relation's texts with ids that keep their order."""
        from ..operators.relational import row_position

        parts = [self.relation(name).select(F.col(f.name).alias("text")) for f in self.schema(name) if isinstance(f.dataType, T.StringType)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return row_position(out.distinct(), ["text"], into="id")

    # sources

    def materialize(self, name: str, source: str, build, policy: str = "always", ask=None) -> bool:
        """Build a relation from a source file or folder by build(spark, source).  An existing one is stale if the
        source's size or time or the code of build has changed: `always` builds it anew, `never` keeps it, and
        `interactive` does as ask(name, what changed) says.  Whether it was built."""
        status = self._fs.getFileStatus(self._path(source)) if "://" not in source else self._path(source).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(self._path(source))
        stamp = [source, status.getLen(), status.getModificationTime(), _code(build)]
        if name in self:
            old = self._entry(name)["source"] or [None] * 4
            changed = [what for what, a, b in zip(("path", "size", "time", "code"), old, stamp) if a != b]
            if policy == "never" or not changed or policy == "interactive" and not ask(name, changed):
                return False
        rows = build(self.spark, source)
        if name in self:
            self.delete(name)
        self.create(name, rows.schema)
        self.insert(name, rows)
        self._entry(name)["source"] = stamp
        return True

    def export(self, name: str, path: str) -> None:
        self.relation(name).write.parquet(path)

    def import_(self, name: str, path: str) -> None:
        rows = self.spark.read.parquet(path)
        self.create(name, rows.schema)
        self.insert(name, rows)


def _code(build) -> str:
    """A digest of a function's code and constants, those of functions inside it too."""

    def parts(code):
        yield code.co_code
        for c in code.co_consts:
            yield from parts(c) if hasattr(c, "co_code") else [repr(c).encode()]
        yield repr((code.co_names, code.co_varnames)).encode()

    return hashlib.sha256(b"\0".join(parts(build.__code__))).hexdigest() if hasattr(build, "__code__") else ""


def _tables(content) -> set[str]:
    return {content} if isinstance(content, str) else {t for p in content[1:] for t in _tables(p)} if content else set()


def _tupled(content):
    return content if isinstance(content, str) else tuple(p if i == 0 else _tupled(p) for i, p in enumerate(content))


def _listed(content):
    return content if isinstance(content, str) else [p if i == 0 else _listed(p) for i, p in enumerate(content)]
