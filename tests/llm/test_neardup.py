"""Near-duplicates and passages against brute force over whole tables, and the cases that nobody plans for."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_operators import brute_components, prose, words

from relspark.llm import minhash, neardup, passages, store


def exact_components(rows, k=4, percent=80):
    """Exact Jaccard of all pairs that share a shingle, by an inverted index; rows of one id belong together."""
    sets = []
    for i, t in rows:
        w = words(t)
        if w:
            sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    holders = defaultdict(list)
    for at, (i, s) in enumerate(sets):
        both = Counter(j for x in s for j in holders[x])
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = root(i), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(at)
    size = defaultdict(int)
    for i, s in sets:
        size[i] = max(size[i], len(s))
    return {i: (size[i], root(i)) for i in parent}


def check(spark, rows, **options):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(d, **options).collect()
    want = exact_components(rows)
    assert len(got) == len(want)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_all_documents_against_exact_jaccard(spark):
    """Every link of every pair of the table, sets of over 512 shingles among them."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert sum(len(words(t)) > 600 for _, t in rows) > 20
    check(spark, rows)


def test_a_large_group_of_near_copies(spark):
    """2,000 copies with some words changed, of one short and one long text: linked and unlinked ones in the same keys."""
    rng = np.random.default_rng(9)
    rows = []
    for n, copies in ((60, 1700), (900, 300)):
        base = prose(n, n).split()
        for i in range(copies):
            t = list(base)
            for j in rng.integers(0, n, rng.integers(0, max(2, n // 16))):
                t[j] = f"x{i}y{j}"
            rows.append((len(rows), " ".join(t)))
    check(spark, rows)


def test_tiles_put_out_a_forest(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "SHINGLES", 600)
    rows = [(i, " ".join([*prose(3, 40).split(), *prose(100 + i, i % 9).split()])) for i in range(120)]
    check(spark, rows)


def test_large_keys_are_split_by_rare_shingles(spark, monkeypatch):
    """A passage that is most of many documents makes keys of many components; links among them are still all found."""
    monkeypatch.setattr(neardup, "GROUP", 6)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    common = prose(1, 60, 10**6).split()
    rows = []
    for i in range(300):
        own = prose(1000 + int(rng.integers(0, 120)), int(rng.integers(8, 30)), 10**6).split()
        t = [*common, *own]
        if i % 3 == 0:
            t[int(rng.integers(0, len(t)))] = f"y{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:40])]
    check(spark, rows)
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400).collect()]
    check(spark, docs)


def test_repeated_ids_and_repeated_rows(spark):
    a, b, c = prose(1, 30), prose(2, 50), prose(3, 40)
    rows = [(5, a), (5, b), (9, b), (8, a), (7, c), (7, c), (6, None), (6, c), (4, ""), (4, None), (3, "one"), (3, "one")]
    check(spark, rows)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, comp int")
    left = minhash.drop_near_duplicates(d)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [3, 3, 4, 4, 5, 5, 6, 6]


def test_very_long_texts(spark):
    long = prose(1, 120_000, 50_000)
    near = " ".join([*long.split()[:110_000], *prose(2, 9_000, 50_000).split()])
    rows = [(1, long), (2, near), (3, prose(3, 100_000, 50_000)), (4, "x" * 600_000), (5, "x" * 600_000)]
    check(spark, rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in passages.cut_repeated(d).collect()}
    assert {i for i, r in got.items() if r.removed_runs} == {2} and got[2].removed_words > 109_900


def test_brute_components_agree():
    rows = [(i, prose(i % 7, 20 + i % 3)) for i in range(20)] + [(30, None)]
    sets, comp = brute_components(rows)
    assert exact_components(rows) == {i: (len(sets[i]), comp[i]) for i in sets}


def test_passages_between_short_lines(spark):
    """A list, a verse: lines of one or two words between others do not save a repeated passage."""
    w = prose(5, 58, 10**6).split()
    cut = lambda sizes: "\n".join(" ".join(w[sum(sizes[:i]) : sum(sizes[: i + 1])]) for i in range(len(sizes)))
    rows = [(1, f"{prose(21, 30, 10**6)}\n{cut([18, 2, 18, 2, 18])}"), (2, f"{prose(22, 30, 10**6)}\n{cut([18, 2, 18, 2, 18])}\n{prose(23, 30, 10**6)}"), (3, cut([2] * 29)), (4, " ".join(w))]
    got = {r.doc_id: r for r in passages.cut_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.removed_runs} == {2, 3, 4}
    assert all(got[i].removed_words >= 40 for i in (2, 3, 4))
    assert all(x in got[2].text for x in (prose(22, 30, 10**6), prose(23, 30, 10**6)))


def test_passages_broken_otherwise(spark):
    """The same 70 words on one line, wrapped at 9 words, and wrapped at another offset."""
    w = prose(6, 70, 10**6).split()
    wrap = lambda at, n: "\n".join(" ".join(w[max(i, 0) : i + n]) for i in range(at - n, len(w), n) if i + n > 0)
    rows = [(i, f"{prose(40 + i, 40, 10**6)}\n{t}\n{prose(60 + i, 40, 10**6)}") for i, t in enumerate([" ".join(w), wrap(0, 9), wrap(4, 9)])]
    got = {r.doc_id: r for r in passages.cut_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].removed_runs == 0
    for i in (1, 2):
        assert got[i].removed_words >= 50
        assert sorted(x for x in got[i].text.split("\n") if len(x.split()) == 40) == sorted([prose(40 + i, 40, 10**6), prose(60 + i, 40, 10**6)])


def test_paragraphs_against_brute_force(spark):
    """Near copies of paragraphs: each goes that an earlier document's links with, over exact five-word shingles."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        lines = []
        for p in range(3):
            t = prose(1000 + int(rng.integers(0, 25)), 40, 10**6).split()
            for j in rng.integers(0, 40, rng.integers(0, 3)):
                t[j] = f"z{i}p{p}j{j}"
            lines.append(" ".join(t))
        rows.append((i, "\n".join(lines)))
    lines = [(i, words(x)) for i, t in rows for x in t.split("\n")]
    sets = [(i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)}) for i, w in lines]
    group = list(range(len(sets)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if 100 * both >= 80 * len(sets[a][1] | sets[b][1]):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    first = {}
    for a, (i, _) in enumerate(sets):
        first[root(a)] = min(first.get(root(a), i), i)
    want = {(i, " ".join(w)) for a, (i, w) in enumerate(lines) if first[root(a)] != i}
    got = {r.doc_id: r for r in passages.cut_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(t not in got[i].text for i, t in want)
    kept = Counter(" ".join(words(x)) for r in got.values() for x in r.text.split("\n"))
    assert sum(kept.values()) > 10


def test_passages_of_repeated_ids(spark):
    a, b = prose(1, 60, 10**6), prose(2, 60, 10**6)
    rows = [(1, f"é {a}"), (1, b), (2, f"𝔘𝔘𝔘 {b}"), (2, f"ü {a} end"), (3, None), (3, a), (None, a)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("t", F.lit("x"))
    got = passages.cut_repeated(d).collect()
    assert len(got) == len(rows) and [r.found for r in got] == [1] * len(rows)
    left = Counter((r.doc_id, r.text) for r in got)
    assert left[(1, f"é {a}")] == left[(1, b)] == left[(None, a)] == left[(3, None)] == left[(3, "")] == 1
    assert all(r.removed_words >= 50 for r in got if r.doc_id == 2)


def test_joins_of_small_partitions_are_hashed_in_kept_tables(spark):
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}
    left = spark.range(2000).select((F.col("id") % 100).alias("k"), "id")
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    before = {k: spark.conf.get(k) for k in (*confs, store._HASHED)}

    def plan_of_last():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        plans = [found.apply(i).physicalPlanDescription() for i in range(found.size())]
        return [p for p in plans if "Join" in p][-1].split("Initial Plan")[0]

    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        kept = store.keep(left.join(right, "k"), "joined")
        assert "ShuffledHashJoin" in plan_of_last() and "SortMergeJoin" not in plan_of_last()
        assert sorted(map(tuple, kept.collect())) == sorted((i % 100, i, i % 100 * 2) for i in range(2000) if i % 100 < 50)
        assert spark.conf.get(store._HASHED) == before[store._HASHED]
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
        store.keep(left.join(right, "k"), "joined")
        assert "SortMergeJoin" in plan_of_last()
    finally:
        for k in confs:
            spark.conf.set(k, before[k])
