"""MinHash near-duplicates by a multi-index Hamming join (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .neardup import SETS, Signature, distinct_sets, linked, set_hash, set_rows
from .store import keep, small_batches

#: 32 slots in 8 chunks of 4 with one error each: every pair within distance 15 shares a key, and those are looked at.
#: At a similarity of exactly 0.8 the distance is binomial(32, 0.2), and 16 or more has a chance of 1e-4.
FOUR_WORDS = Signature(wide=32, chunk=4, chunk_errors=1, shingle=4, percent=80)
FIVE_WORDS = Signature(wide=32, chunk=4, chunk_errors=1, shingle=5, percent=80)


def _sketches(sig: Signature):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sig.hashes()
        for batch in batches:
            n, h1, h2, s = [], [], [], []
            for values in distinct_sets(batch["text"], sig.shingle):
                n.append(len(values))
                one, two = set_hash(values)
                h1.append(one)
                h2.append(two)
                s.append(sig.of(values, hashes) if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(s, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return rows


def near_duplicates(docs: DataFrame, sig: Signature = FOUR_WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but space and tab..CR, A-Z lower-cased; a text's set is its distinct shingles of
    sig.shingle words, or the whole sequence if shorter.  Texts link when 100 * |both| >= sig.percent * |either|;
    component_id is the smallest doc_id reachable.  Equal sets are collapsed to one class before any candidate is
    made, candidates are decided on the full sets.  A null or empty text has no shingles and links with nothing.
    A null doc_id is a document of its own with a null component, one row for each.  Rows that repeat a doc_id are
    texts of one document: it links with all that any of them links with, and n_shingles is the largest of theirs.
    Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    base = docs.mapInArrow(_sketches(sig), "doc_id long, n_shingles long, h1 long, h2 long, sig binary")
    base = keep(base.withColumn("uid", F.monotonically_increasing_id()), "sketches")
    full = base.filter("n_shingles > 0 and doc_id is not null")
    of = ["n_shingles", "h1", "h2"]
    same = full.groupBy(*of).agg(F.min("uid").alias("id"), F.min("doc_id").alias("owner"))
    member = keep(full.select("doc_id", *of).join(same, of).select("doc_id", "n_shingles", "id", "owner"), "members")
    classes = full.withColumnRenamed("uid", "id").join(same.select("id", "owner"), "id").select("id", "doc_id", "owner", "h1", "h2", F.col("n_shingles").alias("n"), "sig")
    classes = keep(classes, "classes")

    def sets_of(ids: DataFrame) -> DataFrame:
        want = classes.drop("owner").join(ids, "id")
        # texts stream past the classes: they are not sorted
        return docs.join(want.hint("shuffle_hash"), "doc_id").select("id", "n", "sig", "h1", "h2", "text").mapInArrow(set_rows(sig), SETS)

    comp = linked(classes, sets_of, sig)
    by_doc = member.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("id").alias("id"), F.max("id").alias("high"), F.min("owner").alias("owner"))
    several = keep(by_doc.filter("id < high").select("doc_id", F.col("id").alias("b")).join(member.select("doc_id", F.col("id").alias("a")), "doc_id").select("a", "b"), "several")
    if not several.isEmpty():
        # the texts of a document belong together
        comp = keep(components(several.unionByName(comp.select(F.col("id").alias("a"), F.col("comp").alias("b")))), "comp")
    lowest = comp.join(classes.select("id", "owner"), "id").groupBy("comp").agg(F.min("owner").alias("component_id"))
    out = by_doc.join(comp.join(lowest, "comp").select("id", "component_id"), "id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "owner").alias("component_id"))
    none = base.filter("n_shingles = 0 and doc_id is not null").select("doc_id").join(by_doc.select("doc_id"), "doc_id", "left_anti").distinct()
    null = base.filter("doc_id is null").select("doc_id", "n_shingles")
    bare = none.select("doc_id", F.lit(0).cast("long").alias("n_shingles")).unionByName(null).withColumn("component_id", F.col("doc_id"))
    out = out.unionByName(bare)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, sig: Signature = FIVE_WORDS) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id.

    A null doc_id stays; rows that repeat a doc_id stay or go together; a null or empty text stays.  All columns are
    kept as they are; an empty table stays empty.
    """
    gone = near_duplicates(docs, sig).filter("not kept").select("doc_id")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)
