"""Exact similarity components through signatures and chunk keys.

The caller gives one row per distinct shingle set (a class) with a signature of `wide` 16-bit minwise slots, cut into
chunks.  Two signatures that differ in at most `threshold` slots differ, by the pigeonhole principle, in at most
`chunk_errors` slots of some chunk, so dropping every choice of `chunk_errors` slots from every chunk and hashing what
is left gives them a common key.  That is the only place where chance has a say: a pair that is similar enough but
whose signatures are further apart need not be found.

Candidates that share a key and lie within the threshold are decided by their full sets of 64-bit shingle hashes.
No step emits the pairs of a group:

1. every class is tried against two of its keys' smallest classes, the smallest and the nearest: copies and near
   copies of a text, however many, mostly fall into one component here;
2. keys that still hold several components are gone through in tiles: the members outside the key's largest
   component against all members, in blocks of bounded size.  Signatures and histograms of the sets (whose distance
   bounds that of the sets from below) tell which members of a tile have a candidate at all; the full sets of these
   are then brought to the tile, every candidate is decided there, and the links go out as a spanning forest;
3. a key of more than GROUP members in several components, such as one that a common passage makes, is not gone
   through as a whole: two sets that are similar enough share one of their rarest shingles (as many as may differ, and
   one), so its members meet by these instead, again in tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import drop, keep
from .text import chunks, mix

_U = np.uint64
#: A block of a tile has about so many members, and about so many shingles, at most.
BLOCK = 2048
SHINGLES = 1 << 18
#: Keys of several components with more members than this are split by rare shingles.
GROUP = 8192
SETS = "id long, n long, sig binary, hist binary, set binary"


@dataclass(frozen=True)
class Signature:
    """wide: slots.  bins: of the histograms.  shingle: words.  Keys: see the module's text."""

    wide: int = 32
    chunk: int = 4
    chunk_errors: int = 1
    bins: int = 256
    shingle: int = 5
    percent: int = 80
    far: int | None = None

    @property
    def wide_errors(self) -> int:
        """All pairs within this distance share a key."""
        return (self.wide // self.chunk) * (self.chunk_errors + 1) - 1

    @property
    def threshold(self) -> int:
        """The most slots in which candidates differ: wide_errors, unless `far` asks for more."""
        return self.wide_errors if self.far is None else self.far

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(7)
        return rng.integers(0, 2**32, self.wide, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, self.wide, dtype=np.uint32)

    def of(self, values: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> bytes:
        """The signature of a set of 64-bit values."""
        a, b = hashes
        x = (values ^ (values >> _U(32))).astype(np.uint32)
        low = None
        for i in range(0, len(x), 2048):
            y = x[i : i + 2048, None] * a
            y += b
            y = y.min(axis=0)
            low = y if low is None else np.minimum(low, y)
        low = low ^ (low >> np.uint32(16)) * np.uint32(0x9E37)
        return low.astype("<u2").tobytes()

    def histogram(self, values: np.ndarray) -> bytes:
        """How many values fall into each bin, 255 standing for more."""
        return np.minimum(np.bincount((values & _U(self.bins - 1)).astype(np.int64), minlength=self.bins), 255).astype(np.uint8).tobytes()

    def keys(self, wide: np.ndarray) -> np.ndarray:
        """wide: (n, wide).  Returns (n, keys)."""
        out = []
        for c in range(self.wide // self.chunk):
            for gone, left in enumerate(combinations(range(self.chunk), self.chunk - self.chunk_errors)):
                h = np.full(len(wide), (c * 1009 + gone + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
                for s in left:
                    h = mix(h ^ wide[:, c * self.chunk + s].astype(np.uint64)) + _U(s + 1)
                out.append(h)
        return np.stack(out, axis=1)

    def slots(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, self.wide)

    def similar(self, n: np.ndarray, m: np.ndarray, both: np.ndarray) -> np.ndarray:
        return (both > 0) & (100 * both >= self.percent * (n + m - both))

    def may_be(self, n: np.ndarray, m: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Whether sets of n and m that differ in `distance` or more values may be similar enough."""
        return distance * (100 + self.percent) <= (100 - self.percent) * (n + m)


def distinct_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, _, words in chunks(column):
        values, begin = words.shingles(k)
        for i in range(len(begin) - 1):
            yield np.unique(values[begin[i] : begin[i + 1]])


def set_hash(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed longs."""
    two = np.array([values.sum(dtype=np.uint64), mix(values + _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64)
    return tuple(int(x) for x in two.view(np.int64))


def _key_rows(sig: Signature):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = sig.keys(sig.slots(batch["sig"]))
                ids = np.repeat(batch["id"].to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    return rows


def set_rows(sig: Signature) -> Callable:
    """(id, n, sig, h1, h2, text) to SETS; texts of other sets, of rows that repeat an id, are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(distinct_sets(batch["text"], sig.shingle))
            own = list(zip(batch["h1"].to_pylist(), batch["h2"].to_pylist()))
            ok = [i for i, v in enumerate(sets) if set_hash(v) == own[i]]
            part = batch.take(pa.array(ok, pa.int64()))
            yield pa.RecordBatch.from_arrays([part["id"], part["n"], part["sig"], pa.array([sig.histogram(sets[i]) for i in ok], pa.binary()), pa.array([sets[i].tobytes() for i in ok], pa.binary())], ["id", "n", "sig", "hist", "set"])

    return rows


def _near(sig: Signature):
    """Of pairs with both signatures, those within the threshold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = (sig.slots(batch["sig"]) != sig.slots(batch["sig2"])).sum(1)
                a, b = batch["n"].to_numpy(), batch["n2"].to_numpy()
                ok = (far <= sig.threshold) & sig.may_be(a, b, np.abs(a - b))
                yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(ok)), batch["b"].filter(pa.array(ok)), pa.array(far[ok], pa.int32())], ["a", "b", "far"])

    return rows


def _same(sig: Signature):
    """Of pairs with both sets, those that are linked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True)) for x, y in zip(batch["set"].to_pylist(), batch["set2"].to_pylist())]
            ok = pa.array(sig.similar(batch["n"].to_numpy(), batch["n2"].to_numpy(), np.array(both, np.int64)))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(ok), batch["b"].filter(ok)], ["a", "b"])

    return rows


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted partition; holds one batch and one group."""
    rest: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        cols = [now[c].to_numpy(zero_copy_only=False) if now[c].type == pa.bool_() else now[c].to_numpy() for c in by]
        cut = np.zeros(now.num_rows - 1, bool)
        for c in cols:
            cut |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(cut) + 1).tolist(), now.num_rows]
        for i, j in zip(edges, edges[1:]):
            key = tuple(int(c[i]) for c in cols)
            if key != last and rest:
                yield pa.concat_tables(rest).combine_chunks()
                rest = []
            last = key
            rest.append(now.slice(i, j - i))
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def _candidates(sig: Signature, group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(row of a left member, rows of right ones) of a tile, each pair for the first of its common keys only."""
    left, stray = group["is_left"].to_numpy(), group["stray"].to_numpy()
    if left.all() or not left.any():
        return
    w, hist = sig.slots(group["sig"]), np.frombuffer(b"".join(group["hist"].to_pylist()), np.uint8).reshape(-1, sig.bins).astype(np.int16)
    ids, comp, n = (group[c].to_numpy() for c in ("id", "comp", "n"))
    keys, here, rare = sig.keys(w).view(np.int64), group["key"][0].as_py(), group["rare"][0].as_py()
    to = np.flatnonzero(~left)
    for x in np.flatnonzero(left):
        # of two strays, which both are left members somewhere, the larger id is the left one
        ok = to[(comp[to] != comp[x]) & (~stray[to] | (ids[to] < ids[x])) & sig.may_be(n[to], n[x], np.abs(n[to] - n[x]))]
        far = (w[ok] != w[x]).sum(1)
        near = far <= sig.threshold
        ok, far = ok[near], far[near]
        ok = ok[np.argsort(far, kind="stable")]
        ok = ok[sig.may_be(n[ok], n[x], np.abs(hist[ok] - hist[x]).sum(1))]
        if len(ok) and not rare:
            ok = ok[keys[x][(keys[ok] == keys[x]).argmax(axis=1)] == here]
        if len(ok):
            yield int(x), ok


def _wanted(sig: Signature):
    """The members of each tile that have a candidate."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "rare", "i", "j"]):
            want = np.zeros(group.num_rows, bool)
            for x, ok in _candidates(sig, group):
                want[x] = True
                want[ok] = True
            if want.any():
                yield from group.filter(pa.array(want)).select(["key", "i", "j", "rare", "is_left", "stray", "id", "comp"]).to_batches()

    return rows


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, set) to a row for each shingle."""
    for batch in batches:
        for id_, n, raw in zip(batch["id"].to_pylist(), batch["n"].to_pylist(), batch["set"].to_pylist()):
            values = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), id_)), pa.array(np.full(len(values), n)), pa.array(values)], ["id", "n", "key"])


def _rarest(sig: Signature):
    """Of rows sorted by id and rarity, each id's first ones: of sets of n that are similar enough at least
    percent * n shingles are common, so one of any n - percent * n + 1 is."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = batch["id"].to_numpy(), batch["n"].to_numpy()
            head = np.append(True, ids[1:] != ids[:-1])
            place = np.arange(len(ids)) - np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))
            if last == ids[0]:
                place[: int(np.argmax(head[1:])) + 1 if head[1:].any() else len(ids)] += seen
            last, seen = ids[-1], int(place[-1]) + 1
            yield batch.filter(pa.array(place <= n - -(-sig.percent * n // 100))).select(["key", "id"])

    return rows


def _by_rare_shingles(hot: DataFrame, sets: DataFrame, sig: Signature) -> tuple[DataFrame, DataFrame]:
    """(key, id): the rarest shingles of the classes of hot (id), as keys; and the table that they are made from."""
    rows = sets.join(hot.select("id").distinct(), "id", "left_semi").select("id", "n", "set").dropDuplicates(["id"]).mapInArrow(_shingles_of, "id long, n long, key long")
    rows = keep(rows, "shingles")
    held = rows.groupBy("key").agg(F.count("*").alias("held"))
    return rows.join(held, "key").repartition("id").sortWithinPartitions("id", "held", "key").mapInArrow(_rarest(sig), "key long, id long"), rows


def _decided(sig: Signature):
    """The links of each tile, as a spanning forest over components."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "rare", "i", "j"]):
            ids, comp, n = (group[c].to_numpy() for c in ("id", "comp", "n"))
            sets = [np.frombuffer(x, _U) for x in group["set"].to_pylist()]
            # the tile's hashes by small numbers, so that one look-up for each value counts what a set shares with all
            number = np.unique(np.concatenate(sets), return_inverse=True)[1]
            begin = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            seen = np.zeros(len(number) + 1, bool)
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while parent.setdefault(c, c) != c:
                    parent[c] = c = parent[parent[c]]
                return c

            out_a, out_b = [], []
            for x, ok in _candidates(sig, group):
                ok = np.array([y for y in ok.tolist() if root(int(comp[y])) != root(int(comp[x]))], np.int64)
                if not len(ok):
                    continue
                mine = number[begin[x] : begin[x + 1]]
                seen[mine] = True
                size = begin[ok + 1] - begin[ok]
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                at = np.arange(size.sum()) + np.repeat(begin[ok] - first, size)
                both = np.add.reduceat(seen[number[at]].astype(np.int64), first)
                seen[mine] = False
                for y in ok[sig.similar(n[ok], n[x], both)].tolist():
                    a, b = root(int(comp[x])), root(int(comp[y]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out_a.append(int(ids[x]))
                        out_b.append(int(ids[y]))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows


def linked(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], sig: Signature) -> DataFrame:
    """classes: (id, n, sig), kept.  Returns (id, comp) of classes with links, kept.

    sets_of: (ids) -> SETS of these classes, where set holds the sorted 64-bit shingle hashes.  A class may come more
    than once.  Nulls: n and sig are set for every row.  An empty table gives no rows.
    """
    keys = classes.select("id", "sig").mapInArrow(_key_rows(sig), "key long, id long")
    several = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("leader")).filter("members > 1")
    shared = keep(keys.join(several, "key").select("key", "id", "leader"), "keys")
    sets = keep(sets_of(shared.select("id").distinct()), "sets")
    other = sets.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("sig2"), F.col("set").alias("set2"))

    first = shared.filter("id > leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    first = first.join(sets.select(F.col("id").alias("a"), "n", "sig"), "a").join(other.drop("set2"), "b").mapInArrow(_near(sig), "a long, b long, far int")
    first = first.groupBy("a").agg(F.min("b").alias("b"), F.min_by("b", F.col("far") * F.lit(2.0**40) + F.pmod(F.xxhash64("a", "b"), F.lit(2**40))).alias("c"))
    first = first.select("a", F.explode(F.array_distinct(F.array("b", "c"))).alias("b"))
    first = first.join(sets.select(F.col("id").alias("a"), "n", "set"), "a").join(other.drop("sig2"), "b")
    comp = keep(components(first.mapInArrow(_same(sig), "a long, b long")), "comp")

    size = comp.groupBy("comp").agg(F.count("*").alias("held"))
    label = comp.join(size, "comp")

    def in_several(members: DataFrame) -> DataFrame:
        """(key, id, comp, n, stray) of the keys whose members are in several components."""
        rows = members.select("key", "id").join(label, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"), F.coalesce("held", F.lit(1)).alias("held"))
        info = rows.groupBy("key").agg(F.max(F.struct("held", "comp")).alias("most"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).filter("low < high")
        rows = rows.join(info.select("key", "members", F.col("most.comp").alias("main")), "key").join(sets.select("id", "n"), "id")
        return rows.select("key", "id", "comp", "n", "members", (F.col("comp") != F.col("main")).alias("stray"))

    mixed = keep(in_several(shared), "mixed")
    hot = mixed.filter(F.col("members") > GROUP)
    if not hot.isEmpty():
        split, shingles = _by_rare_shingles(hot, sets, sig)
        split = in_several(split)
        both = keep(mixed.filter(F.col("members") <= GROUP).withColumn("rare", F.lit(False)).unionByName(split.withColumn("rare", F.lit(True))), "mixed")
        for used in (mixed, shingles):
            drop(used)
        mixed = mixed_kept = both
    else:
        mixed, mixed_kept = mixed.withColumn("rare", F.lit(False)), mixed

    def blocks(some) -> F.Column:
        return F.ceil(F.greatest(F.count_if(some) / BLOCK, F.sum(F.when(some, F.col("n"))) / SHINGLES))

    # a key and a shingle may be the same number
    shape = mixed.groupBy("key", "rare").agg(blocks(F.lit(True)).alias("right"), blocks(F.col("stray")).alias("left"))
    rows = mixed.drop("n", "members").join(shape, ["key", "rare"]).withColumn("at", F.xxhash64("id"))
    as_right = F.transform(F.sequence(F.lit(0).cast("long"), F.col("left") - 1), lambda i: F.struct(i.alias("i"), F.pmod("at", "right").alias("j"), F.lit(False).alias("is_left")))
    as_left = F.transform(F.sequence(F.lit(0).cast("long"), F.col("right") - 1), lambda j: F.struct(F.pmod("at", "left").alias("i"), j.alias("j"), F.lit(True).alias("is_left")))
    none = F.array().cast("array<struct<i:bigint,j:bigint,is_left:boolean>>")
    tiled = rows.select("key", "rare", "id", "comp", "stray", F.explode(F.concat(as_right, F.when(F.col("stray"), as_left).otherwise(none))).alias("t"))
    tile = ["key", "rare", "i", "j"]
    # a tile's work is that of its pairs, not of its bytes: as many tasks as the session has for any shuffle
    n_tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiled = tiled.join(sets.select("id", "n", "sig", "hist"), "id").select("key", "rare", "t.i", "t.j", "t.is_left", "stray", "id", "comp", "n", "sig", "hist")
    want = tiled.repartition(n_tasks, *tile).sortWithinPartitions(*tile).mapInArrow(_wanted(sig), "key long, i long, j long, rare boolean, is_left boolean, stray boolean, id long, comp long")
    want = keep(want, "wanted")
    pairs = want.join(sets, "id").repartition(n_tasks, *tile).sortWithinPartitions(*tile).mapInArrow(_decided(sig), "a long, b long")
    more = keep(pairs, "links")
    for used in (shared, sets, mixed_kept, want):
        drop(used)
    if more.isEmpty():
        return comp
    # one edge for each class and its component so far, and the new links between them
    known = comp.select(F.col("id").alias("a"), F.col("comp").alias("b"))
    out = keep(components(known.unionByName(more)), "comp")
    drop(comp)
    drop(more)
    return out
