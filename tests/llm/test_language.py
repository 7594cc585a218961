"""Language identification against a plain version: words by script, trigram scores, candidates, Viterbi."""

import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import prose

from relspark.llm import langid


def is_mark(c):
    return unicodedata.category(c)[0] == "M"


def plain_words(text):
    """(start, end, script) of words: letters and the marks on them, cut where the script changes."""
    out, open_word = [], False
    for i, c in enumerate(text):
        if c.isalpha():
            script = langid.script_of(c)
            if open_word and (not script or not out[-1][2] or script == out[-1][2]):
                out[-1][1] = i + 1
                out[-1][2] = script or out[-1][2]
            else:
                out.append([i, i + 1, script])
            open_word = True
        elif is_mark(c) and open_word:
            out[-1][1] = i + 1
        else:
            open_word = False
    return [tuple(x) for x in out]


def bucket(a, b, c):
    x = (a << 42) | (b << 21) | c
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return (x ^ (x >> 31)) % langid.BUCKETS


def trigrams(text, begin, end):
    codes = [0, *map(ord, text[begin:end]), 0]
    return [bucket(*codes[i : i + 3]) for i in range(len(codes) - 2)]


TEXTS = ["Hello世界 x, naïve", "́̂ ̂", "été ́a", "ʰab Привет, мир!", "ខ្មែរ ᠮᠣᠩᠭᠣᠯ ᏣᎳᎩ ᚠᚢ ｶﾀｶﾅ", "", "12 !?", "КирилLatin αβγLatin", "한국어 日本語のテキスト", "a" * 3000, "x\n\ny\tz"]


@pytest.mark.parametrize("text", TEXTS)
def test_words_against_plain(text):
    r = langid._read([text])
    assert list(zip(r.begin.tolist(), r.end.tolist())) == [(a, b) for a, b, _ in plain_words(text.lower())]
    want = [t for a, b, _ in plain_words(text.lower()) for t in trigrams(text.lower(), a, b)]
    assert r.buckets.tolist() == want


def test_scripts():
    kinds, scripts = langid._letters_and_scripts()
    assert len({int(scripts[ord(c)]) for c in "aжλあ漢한ខᠠᎠᚠกאعⴰአಅⲁ"}) == 17 and scripts.max() < langid.N_SCRIPTS - 1
    assert scripts[ord("ｶ")] == scripts[ord("あ")] and scripts[ord("ａ")] == scripts[ord("a")] and scripts[ord("é")] == scripts[ord("a")]
    assert kinds[0x301] == 2 and kinds[ord("1")] == 0


def test_scores_and_labels_against_plain(spark):
    """Counts, candidates and the best labelling, each worked out again without arrays."""
    learn = [("x", prose(i, 40, 60)) for i in range(6)] + [("y", prose(50 + i, 40, 60).replace("w", "v")) for i in range(6)] + [("z", "привет мир как дела " * 9)]
    model = langid.train(spark.createDataFrame(learn, "lang string, text string"))
    assert model.langs == ["x", "y", "z"]
    tri, script = defaultdict(Counter), defaultdict(Counter)
    for lang, t in learn:
        for a, b, s in plain_words(t):
            tri[lang].update(trigrams(t, a, b))
            script[lang][s] += b - a
    used = len(set().union(*tri.values()))
    texts = [f"{prose(99, 30, 60)} {prose(98, 30, 60).replace('w', 'v')} мир", "w1 w2", "дела w3 v4 v5 v6 v7", "漢字 w1", *TEXTS]

    def score(word, text, lang):
        a, b, s = word
        can = [n for n in model.langs if script[n][s] / script[n].total() >= 0.01]
        out = sum(math.log((tri[lang][t] + 0.1) / (tri[lang].total() + 0.1 * (used + 1))) for t in trigrams(text, a, b))
        return out - (1e4 if can and lang not in can else 0)

    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        text = texts[r.doc_id].lower()
        ws = plain_words(text)
        if not ws:
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
            continue
        table = [[score(w, text, n) for n in model.langs] for w in ws]
        best = list(table[0])
        for row in table[1:]:
            best = [max(best[j], max(best) - model.penalty) + row[j] for j in range(3)]
        labels = [model.langs.index(next(s.lang for s in r.spans if s.start <= a and b <= s.end)) for a, b, _ in ws]
        value = sum(table[i][j] for i, j in enumerate(labels)) - model.penalty * sum(a != b for a, b in zip(labels, labels[1:]))
        assert value == pytest.approx(max(best), rel=1e-4, abs=1e-2)
        mass = Counter()
        for (a, b, _), j in zip(ws, labels):
            mass[model.langs[j]] += b - a
        assert mass[r.lang_pred] == max(mass.values()) and r.score == pytest.approx(mass[r.lang_pred] / mass.total())


def test_many_languages_and_long_texts():
    rng = np.random.default_rng(3)
    lens = [3, 0, 300, 900, 1, 256, 257]
    first = np.concatenate([[0], np.cumsum(lens)])
    s = rng.normal(size=(sum(lens), 300)) * 4
    labels = langid.viterbi(s, first, 5.0)
    assert labels.max() > 256
    for a, b in zip(first[:-1], first[1:]):
        if a < b:
            v = s[a].copy()
            for i in range(a + 1, b):
                v = np.maximum(v, v.max() - 5) + s[i]
            assert v.max() == pytest.approx(sum(s[i, labels[i]] for i in range(a, b)) - 5 * sum(labels[i] != labels[i - 1] for i in range(a + 1, b)))


def test_rows_of_any_kind(spark):
    d = spark.createDataFrame([("x", "abc"), ("y", "xyz"), (None, "q"), ("x", None)], "lang string, text string")
    model = langid.train(d)
    rows = [(1, "abc " * 200_000), (1, "xyz"), (1, "xyz"), (None, None), (2, "̈̈")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(1)).withColumn("spans", F.lit(2))
    got = langid.identify(odd, model).collect()
    assert [r.lang_pred for r in got] == ["x", "y", "y", "und", "und"] and got[0].spans[-1].end == 799_999
    assert langid.identify(odd.limit(0), model).count() == 0 and langid.train(d.limit(0)).langs == []
