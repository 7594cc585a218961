"""Decontamination against a plain version that looks at every item in every passage."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import prose

from relspark.llm import decontam


def cut(text):
    """Words without case and ASCII punctuation."""
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def plain(rows, items, overlap=0.8):
    """The rule as the module's text states it, without an index: (doc_id, item_id)."""
    parts = []
    for i, t in items:
        w = cut(t)
        if w:
            a = len(cut(t[: decontam._answer_start(t)]))
            parts.append((i, w, w[:a], w[a:]))
    step = max(64, max(len(p[1]) for p in parts))
    index = decontam.build(sorted(items))
    heavy = dict(zip(index.ids, index.heavy))
    share = lambda x, w: len(grams(x, k) & grams(w, k)) / len(grams(x, k)) if (k := min(5, len(x))) else 1.0
    out = set()
    for d, t in rows:
        w = cut(t)
        if not w:
            continue
        steps = max(1, -(-len(w) // step))
        for i, whole, q, a in parts:
            if len(set(whole) & set(w)) < 0.2 * len(set(whole)):
                continue
            anywhere = (share(q, w), share(a, w))
            half = 2 * len(set(a) & set(w)) >= len(set(a))
            for s in range(steps):
                window = w[s * step : (s + 2) * step]
                part = share(q if heavy[i] else a, window) >= overlap and anywhere[1 if heavy[i] else 0] >= overlap
                if part or share(whole, window) >= overlap and half:
                    out.add((d, i))
    return out


@pytest.mark.parametrize("block", [2, 64])
def test_documents_against_all_items(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows, items = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == plain(rows, items) and got


def test_copies_with_changed_words(spark):
    """Items in documents of the same words, whole or with words changed, moved or lost."""
    rng = np.random.default_rng(8)
    items = [(i, f"{prose(i, 25, 300)} ?\n{prose(1000 + i, 7, 300)}") for i in range(200)]
    rows = []
    for d in range(120):
        w = items[int(rng.integers(0, 200))][1].split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = f"w{rng.integers(0, 300)}"
        if d % 3 == 0:
            w = w[int(rng.integers(0, 6)) :]
        rows.append((d, f"{prose(3000 + d, int(rng.integers(0, 200)), 300)} {' '.join(w)} {prose(4000 + d, 80, 300)}"))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain(rows, items)
    assert got == want and 40 < len(want) < 120


def test_pivots_lose_nothing(monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 8)
    monkeypatch.setattr(decontam, "SUMS", 100)
    items = [(i, prose(i, 25, 60)) for i in range(50)]
    index = decontam.build(items)
    rng = np.random.default_rng(4)
    queries = [np.sort(rng.choice(len(index.vocabulary), int(rng.integers(5, 58)), replace=False)) for _ in range(60)]
    begin = np.concatenate([[0], np.cumsum([len(q) for q in queries])])
    looked = dict(decontam._pivots(index, np.concatenate(queries), begin))
    hits = 0
    for k, q in enumerate(queries):
        full = Counter()
        for t in q.tolist():
            for i, x in zip(*index.postings[t]):
                full[int(i)] += float(x)
        want = {i for i, s in full.items() if s >= index.thresholds[i]}
        hits += len(want)
        assert {i for i, _ in index.retrieve(q.tolist(), looked.get(k, set()))} >= want if want else True
    assert hits


def test_a_large_benchmark_is_small_in_memory():
    import pickle

    index = decontam.build([(i, f"{prose(i, 30, 20_000)} ?\n{prose(i + 50_000, 6, 20_000)}") for i in range(5_000)])
    assert len(pickle.dumps(index)) < 60_000_000


def test_odd_rows(spark):
    items = [(1, f"{prose(1, 20)}\n{prose(2, 5)}"), (1, f"{prose(1, 20)}\n{prose(2, 5)}"), (None, f"{prose(3, 20)}\n{prose(4, 5)}"), (2, None), (3, "!!"), (4, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit(1))
    rows = [(7, items[0][1]), (7, items[0][1]), (None, items[2][1]), (8, None), (9, f"{prose(5, 200_000)} {items[0][1]}"), (10, "only one here")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = Counter((r.doc_id, r.item_id) for r in decontam.contaminated(d, bench).collect())
    assert set(got) == {(7, 1), (None, None), (9, 1), (10, 4)} and got[7, 1] == 4
    rows.append((7, "clean text of the same id"))
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    for chars in (10**9, 60):  # one shard or several
        left = decontam.drop_contaminated(d, bench, shard_chars=chars)
        assert left.columns == d.columns and sorted((r.doc_id, r.text) for r in left.collect() if r.text) == [(7, "clean text of the same id")]
        assert {r.doc_id for r in left.collect()} == {7, 8}
    assert decontam.drop_contaminated(d, bench.limit(0)).count() == d.count() and decontam.drop_contaminated(d.limit(0), bench).count() == 0
