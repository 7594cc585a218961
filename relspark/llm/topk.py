"""Exact top-k search by tiled matrix products (operator 6)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches

TILE_QUERIES = 1024
TILE_ROWS = 8192
_PACK = "dim int, n int, ids binary, vectors binary"


def _pack(rows_each: int):
    """Vectors to tiles: one row for up to rows_each vectors of one length, as little-endian longs and doubles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def made(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.stack(vectors).astype("<f8").tobytes()])], ["dim", "n", "ids", "vectors"])

        for batch in batches:
            for i, v in zip(batch["id"].to_pylist(), batch["v"]):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                ids, vectors = held.setdefault(len(x), ([], []))
                ids.append(i)
                vectors.append(x)
                if len(ids) == rows_each:
                    yield made(len(x))
        for dim in list(held):
            yield made(dim)

    return rows


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers; where the product is beyond a double, x is a whole number."""
    return np.array([[int(y) if np.isfinite(y) else int(v) * scale for v, y in zip(row, np.floor(scale * row))] for row in x], object).reshape(x.shape)


def _products(q: np.ndarray, c: np.ndarray, scale: int) -> np.ndarray:
    """Exact inner products of floor(scale * x): in doubles while every partial sum stays below 2**53, in longs while
    it stays below 2**62, else in Python integers, held at the ends of a long."""
    with np.errstate(over="ignore"):
        a, b = np.floor(scale * q), np.floor(scale * c)
        bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(q.shape[1], 1)
        if bound < 2**53:
            return (a @ b.T).astype(np.int64)
        if bound < 2**62:
            return a.astype(np.int64) @ b.astype(np.int64).T
        exact = _integers(q, scale) @ _integers(c, scale).T
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact.ravel().tolist()], np.int64).reshape(exact.shape)


def _best(k: int, scale: int):
    """Of each pair of tiles, every query's k best; lists of tiles that one task sees are merged before they leave."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[tuple[bytes, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                qid, cid = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q = np.frombuffer(row["q_vectors"], "<f8").reshape(len(qid), row["dim"])
                c = np.frombuffer(row["vectors"], "<f8").reshape(len(cid), row["dim"])
                scores = _products(q, c, scale)
                for i, query in enumerate(qid.tolist()):
                    s = scores[i]
                    take = np.arange(len(s))
                    if len(s) > k + 1:  # all that reach the (k + 1)-th score, so that ties and the query itself do no harm
                        take = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1])
                    take = take[cid[take] != query]
                    take = take[np.lexsort((cid[take], -s[take]))[:k]]
                    mine = [(-int(s[j]), int(cid[j])) for j in take]
                    key = (row["tile"], i)
                    old = top.get(key)
                    top[key] = [query, mine if old is None else heapq.nsmallest(k, old[1] + mine)]
            if len(top) > 200_000:
                yield made(top)
                top = {}
        yield made(top)

    def made(top: dict) -> pa.RecordBatch:
        flat = [(tile, i, query, v, -s) for (tile, i), (query, found) in top.items() for s, v in found]
        cols = list(zip(*flat)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["tile", "i", "query_id", "vec_id", "score"])

    return rows


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row of queries its k best rows of vectors: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x); the score is the integer inner product, ties go to the smaller id, and rows
    with the query's own id are no candidates.  Null ids, and vectors that are null or hold a null or non-finite
    component, take no part; vectors of different length are not compared.  A repeated query row gives repeated
    results; a repeated candidate counts once for each row.  Scores beyond a long are held at its ends (of scores so
    held the smaller ids come first).  Other columns, whatever their names, are ignored; an empty table on either side
    gives no rows.

    Both sides are packed into tiles without a shuffle; only tiles are paired.  Candidate tiles are dealt into as many
    groups as the session has shuffle partitions, and the query tiles go to each, so no task meets all of either.
    """
    small_batches(vectors.sparkSession)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def tiles(df: DataFrame, rows_each: int) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return df.filter("id is not null and v is not null").filter(~bad).mapInArrow(_pack(rows_each), _PACK)

    groups = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = tiles(queries, TILE_QUERIES).select(F.monotonically_increasing_id().alias("tile"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    q = q.withColumn("q_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    c = tiles(vectors, TILE_ROWS).withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    pairs = c.hint("merge").join(q, (F.col("dim") == F.col("q_dim")) & (F.col("group") == F.col("q_group"))).select("tile", "q_ids", "q_vectors", "dim", "ids", "vectors")
    lists = pairs.mapInArrow(_best(k, scale), "tile long, i int, query_id long, vec_id long, score long")
    order = Window.partitionBy("tile", "i").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
