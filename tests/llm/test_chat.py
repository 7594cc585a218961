"""Windows of conversations that lie in several parts are those of conversations in one."""

import pytest
from pyspark.sql import functions as F

from relspark.llm import chat


def plain(turns, budget, history, target="assistant"):
    """Windows of one conversation, turn by turn: (own turns, repeated turns), by their numbers."""
    share = budget // 4
    tokens = [len(t) // 4 + 1 for _, t in turns]
    sums = [sum(tokens[: i + 1]) for i in range(len(turns))]
    window, start, cell, was_long = [], 0, None, None
    for i, n in enumerate(tokens):
        if n > share:
            new = True
            start = sums[i]
            now = None
        else:
            now = (sums[i] - n - start) // share
            new = was_long or was_long is None or now != cell
        window.append((window[-1] if window else -1) + new)
        cell, was_long = now, n > share
    system = turns[0][0] == "system"
    out = {}
    for i, w in enumerate(window):
        out.setdefault(w, ([], []))[0].append(i)
    for w, (own, repeats) in out.items():
        first = own[0]
        for i in range(max(0, first - history), first):
            if not (system and i == 0) and sums[first] - tokens[first] - sums[i] + tokens[i] <= share:
                repeats.append(i)
        if system and w:
            repeats.insert(0, 0)
    return out


def formatted(turns, numbers):
    return "".join(f"<|im_start|>{turns[i][0]}\n{turns[i][1]}<|im_end|>\n" for i in numbers)


@pytest.mark.parametrize(("long", "most"), [(10**6, 10**6), (350, 10**6), (2, 10**6), (0, 0)])
def test_one_conversation_in_many_parts(spark, monkeypatch, long, most):
    """A conversation of half of all rows; others that begin and end in the same parts; null ids."""
    monkeypatch.setattr(chat, "LONG", long)
    monkeypatch.setattr(chat, "MOST", most)
    import random

    rng = random.Random(3)
    talk = lambda k, n, system: [("system" if system and i == 0 else "user" if i % 2 else "assistant", f"{k}:{i} " + "x" * rng.choice([0, 3, 20, 60, 200, 900])) for i in range(n)]
    talks = {5: talk(5, 1200, True), 4: talk(4, 300, False), 6: talk(6, 3, True), None: talk(0, 400, False), 7: talk(7, 1, False), 8: [("user", "x" * 900)] * 1 + talk(8, 40, True)[1:]}
    rows = [(k, i, r, t) for k, turns in talks.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            for budget, history in ((200, 2), (400, 5), (400, 0)):
                got = {(r.conv_id, r.window): r for r in chat.windows(d, budget=budget, history=history).collect()}
                want = {(k, w): (turns, *x) for k, turns in talks.items() for w, x in plain(turns, budget, history).items()}
                assert set(got) == set(want)
                for key, (turns, own, repeats) in want.items():
                    assert (got[key].n_turns, got[key].n_repeated) == (len(own), len(repeats)), key
                    assert got[key].formatted == formatted(turns, [*repeats, *own])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_conversation_lies_in_several_parts(spark):
    d = spark.range(0, 5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"), F.lit(1).cast("long").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert chat._dealt(d).select("part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    none = chat.windows(d.limit(0))
    assert none.count() == 0
