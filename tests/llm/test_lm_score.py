"""Language-model scores against brute force over the words themselves."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import prose, words

from relspark.llm import lm_score, queries


def brute(rows, target, leave_out):
    """rows: (id, text).  target: rows that are in it.  Losses of each row, its own counts left out of what it is in."""
    grams = []
    for _, t in rows:
        w = words(t)
        before = ["", *w][: len(w)]
        grams.append((Counter(w), Counter(zip(before, w)), Counter(before)))
    total = [[Counter(), Counter(), Counter()] for _ in range(2)]
    for i, g in enumerate(grams):
        for m in range(2):
            if m or target[i]:
                for out, x in zip(total[m], g):
                    out.update(x)
    tokens = [t[0].total() for t in total]
    scale = tokens[0] / tokens[1]
    vocabulary = len(total[0][0] | total[1][0])
    out = []
    for i, (_, t) in enumerate(rows):
        w = words(t)
        losses = []
        for m, by in ((0, 1.0), (1, scale)):
            own = grams[i] if leave_out and (m or target[i]) else [Counter()] * 3
            c = lambda k, x: by * (total[m][k][x] - own[k][x])  # noqa: B023,E731
            mass = by * (tokens[m] - own[0].total())
            p = lambda v, x: (c(1, (v, x)) + 20 * (c(0, x) + 0.5) / (mass + 0.5 * vocabulary)) / (c(2, v) + 20)  # noqa: B023,E731
            losses.append(sum(-np.log(p(v, x)) for v, x in zip(["", *w], w)) / len(w) if w else None)
        out.append((len(w), *losses))
    return out


@pytest.mark.parametrize("leave_out", [True, False])
@pytest.mark.parametrize("held", [60, 600_000])
def test_scores_within_a_corpus(spark, monkeypatch, leave_out, held):
    monkeypatch.setattr(lm_score, "HELD", held)
    rows = [*((i, prose(i, 80, 50)) for i in range(20)), *((100 + i, prose(i, 80, 5000)) for i in range(20)), (5, prose(5, 80, 50)), (300, None), (301, ""), (302, "A b a B a b"), (None, "w1 w2 w3"), (303, prose(9, 5000, 900))]
    target = [i is not None and i < 10 for i, _ in rows]
    d = spark.createDataFrame([(k, i, t, g or None) for k, ((i, t), g) in enumerate(zip(rows, target))], "k long, doc_id long, text string, score boolean").repartition(3)
    got = lm_score.score_within(d, "score", id_col="k", leave_out=leave_out).collect()
    want = brute(rows, target, leave_out)
    assert len(got) == len(rows)
    for r in got:
        n, t, b = want[r.k]
        assert r.n_tokens == n and (r.score is None) == (n == 0)
        if n:
            assert (r.target_loss, r.background_loss) == pytest.approx((t, b), abs=1e-9)
            assert r.score == pytest.approx(t - b)
    assert lm_score.score_within(d, "score").filter("doc_id is null").count() == 1
    assert lm_score.score_within(d.limit(0), "score").count() == 0


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    want = {i: x for (i, _), x in zip(docs, brute(docs, [i in good for i, _ in docs], True))}
    got = queries.QUERIES["op2_lm_score"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n, t, b = want[r.doc_id]
        assert r.n_tokens == n and (r.score is None if not n else r.score == pytest.approx(t - b, abs=1e-6))


def test_a_very_long_text(spark):
    d = spark.createDataFrame([(1, prose(1, 400_000, 3000)), (2, prose(2, 50, 3000)), (3, "x" * 3_000_000)], "doc_id long, text string").withColumn("good", F.col("doc_id") == 2)
    got = {r.doc_id: r for r in lm_score.score_within(d, "good").collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {1: 400_000, 2: 50, 3: 1} and all(np.isfinite(r.score) for r in got.values())


def test_texts_are_not_sorted_by_the_labels_join(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(3, "again"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(1, 1), (50, 1), (None, 1)], "doc_id long, quality int")
    marked = queries._good(docs, labels)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Broadcast" not in plan
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], bool(r["good"])) for r in marked.collect())
    want = [(False, i, f"text {i}", i % 2 == 1 and i < 10) for i in range(20)] + [(False, 3, "again", True), (True, 0, "no id", False)]
    assert got == sorted(want)


def test_a_block_is_sent_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 400))) for i in range(40)]
    rows = pa.RecordBatch.from_pylist([{"id": i, "text": t, "mark": 7} for i, t in data])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    blocks = list(lm_score._pack(iter([rows])))
    out = list(lm_score._sent(8)(iter(blocks)))
    assert len(blocks) == 1 and max(b.num_rows for b in out) <= 64
    p = [x for b in out for x in b["p"].to_pylist()]
    assert len(p) == len(set(p)) == 256 + 64
