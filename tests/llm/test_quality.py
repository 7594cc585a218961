"""Quality scores against statistics and rules worked out text by text."""

import math

import pytest
from pyspark.sql import functions as F
from test_operators import words

from relspark.llm import quality


def plain_statistics(text):
    """The statistics as quality.measure states them, over a text's characters."""
    text = text or ""
    raw = text.encode()
    w = words(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    chars, n = len(text), len(w)
    per = lambda x, of: x / of if of else 0.0
    upper = sum(65 <= b <= 90 for b in raw)
    latin = sum(c in range(0xC0, 0xDF) and c != 0xD7 for c in map(ord, text))
    out = {
        "chars": chars, "words": n, "letters": per(upper + sum(97 <= b <= 122 or b >= 0xC3 for b in raw), chars), "capitals": per(upper + latin, chars),
        "digits": per(sum(48 <= b <= 57 for b in raw), chars), "new_words": per(len(set(w)), n), "line_words": per(n, len(lines)), "word_chars": per(chars, n),
        "stops": per(text.count("."), n), "commas": per(text.count(","), n), "new_lines": per(len({tuple(words(x)) for x in lines}), len(lines)),
    }
    return out | {name: per(text.count(sign), n) for name, sign in quality.SIGNS.items()}


def test_statistics_against_plain(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    odd = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "ÀÉß × ÿ A1"), (-5, "a\n\na\nb | | {"), (-6, "x" * 300_000), (-7, "日本 漢字.")]
    rows = [*((r.doc_id, r.text) for r in rows), *odd]
    got = quality.with_statistics(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "__s.*").collect()
    text = dict(rows)
    for r in got:
        assert {k: r[k] for k in quality.NAMES} == pytest.approx(plain_statistics(text[r.doc_id])), r.doc_id


def test_scores_against_plain(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(d, labels)
    assert 5 < len(model.rules) < 200 and all(1 <= len(rule) <= 3 for rule, _ in model.rules)
    for r in quality.score(d.select("doc_id", "text"), model).collect():
        s = plain_statistics(r.text)
        total = model.intercept + sum(weight for rule, weight in model.rules if all(s[name] > cut if above else s[name] <= cut for name, above, cut in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6) and r.predicted == int(r.score >= 0.7)


def test_rows_of_any_kind(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 2), (9, 1)], "doc_id long, quality int")
    d = spark.createDataFrame([(1, "good text here"), (1, "good text here"), (2, None), (None, "x"), (3, "")], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("quality", F.lit(0))
    model = quality.train(d, labels)
    got = quality.score(d, model)
    assert got.columns == ["doc_id", "text", "quality", "score", "predicted"] and got.count() == 5 and got.filter("score between 0 and 1").count() == 5
    assert quality.score(d.limit(0), model).count() == 0 and quality.train(d.limit(0), labels).rules == []
