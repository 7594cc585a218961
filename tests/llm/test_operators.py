"""Each operator against brute force or a round trip on small tables, with nulls, empties, ties and clashing names."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.llm import chat, decontam, html_extract, langid, lm_score, minhash, passages, queries, quality, sentencepiece_tok, topk
from relspark.llm.components import components
from relspark.llm.text import Words, chunks

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n, lexicon=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, lexicon, n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120).split()
    near = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(3, 60, 4)]
    rows = [(i, t) for i, t in enumerate([" ".join(base), *near, *[" ".join(base)] * 5, None, "", " \n\t ", "One", "one", "one two three", *[prose(s, 90) for s in range(2, 20)]])]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


def test_words_hash_like_strings():
    import pyarrow as pa

    texts = ["A b\tc", None, "", "é  É", "a B c d", "ab", "a b"]
    seen = {}
    for lo, hi, w in chunks(pa.array(texts)):
        for i in range(lo, hi):
            for h, x in zip(w.hashes[w.first[i - lo] : w.first[i - lo + 1]].tolist(), words(texts[i])):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen) == len({x for t in texts for x in words(t)})
    assert len(Words(np.zeros(0, np.uint8), np.array([0])).hashes) == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(80)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(x, root(x)) for x in parent}


def brute_components(rows, k=4, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = {x: min(a, b) if c in (a, b) else c for x, c in comp.items()}
    return sets, comp


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, comp = brute_components(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs.withColumn("comp", F.lit(1)).withColumn("id", F.lit("x"))).collect()}
    assert set(got) == set(comp)
    for i, r in got.items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), comp[i], comp[i] == i)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() < docs.count()
    odd = minhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.kept) for r in odd) == [(False, True), (True, True)]


def test_all_pairs_within_distance_share_a_key():
    sig = minhash.FOUR_WORDS
    rng = np.random.default_rng(5)
    a = rng.integers(0, 65536, (200, sig.wide)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.permutation(sig.wide)[: sig.wide_errors]] ^= 1
    assert (sig.keys(a) == sig.keys(b)).any(axis=1).all()


def test_passages(spark):
    shared, other = prose(77, 60), prose(78, 60)
    rows = [
        (1, f"{prose(11, 30)}\n{shared}\nend one"), (2, f"{prose(12, 25)} {shared} {prose(13, 25)}"), (3, shared), (4, None), (5, ""), (6, prose(14, 200)),
        (7, f"{other}\n{other}"), (8, "short line\nshort line"), (9, "short line"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash")).withColumn("words", F.lit(0))
    got = {r.doc_id: r for r in passages.cut_repeated(d).collect()}
    assert len(got) == 9 and {i for i, r in got.items() if r.removed_runs} == {2, 3}
    assert got[3].text == "" and got[4].text is None and got[7].text == rows[6][1] and got[1].text == rows[0][1]
    assert got[2].removed_words >= 40 and all(x.text in shared for x in got[2].removed) and got[2].text.startswith(prose(12, 25))
    assert passages.cut_repeated(d.limit(0)).count() == 0
    assert passages.bands(0.8, 3, 0.999) * np.log(1 - 0.8**3) <= np.log(0.001)


def test_repeats_of_a_short_period(spark):
    """A stretch that repeats one to three words goes from the later text, whatever its length and what is around it."""
    for period in ("ta", "ta ra", "ta ra wo"):
        stretch = lambda n: " ".join([period] * n)
        own = lambda c: " ".join(f"{c}{i}" for i in range(30))
        d = spark.createDataFrame([(1, f"{own('a')} {stretch(200)} {own('b')}"), (2, f"{own('c')} {stretch(90)} {own('d')}")], "doc_id long, text string")
        got = {r.doc_id: r for r in passages.cut_repeated(d).collect()}
        assert got[1].removed_runs == 0
        assert got[2].removed_words >= 90 * len(period.split()) - 50
        assert all(w in got[2].text.split() for w in f"{own('c')} {own('d')}".split())


def test_no_long_repeats_are_left(spark, sf):
    def repeats(rows):
        owner, n = {}, 0
        for i, t in sorted(rows):
            for line in (t or "").split("\n"):
                w = words(line)
                for k in range(len(w) - 59):
                    n += owner.setdefault(tuple(w[k : k + 60]), i) != i
        return n

    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert repeats([(r.doc_id, r.text) for r in d.collect()]) > 0
    assert repeats([(r.doc_id, r.text) for r in passages.cut_repeated(d).collect()]) == 0


def test_html(spark):
    page = "<header>Site</header><nav><a href=x>Menu</a></nav>{}<h1>Title &amp; more</h1><p>First  para<br>goes on.<p>A <a href=y>link</a> &lt;here&gt;</div><!-- no --><div class='comments'><p>Reader says</p></div>{}<aside>Side</aside><footer>Foot</footer><script>if (a<b) {{'</p>'}}</script>"
    article, plain = page.format("<article><div>", "</article>"), page.format("<div><div>", "</div>")
    want = "Title & more\nFirst para goes on.\nA link <here>"
    rows = [(1, "u", article), (2, "u", plain), (3, None, None), (4, "u", ""), (5, "u", "<div class=x"), (6, "u", "<p>&nbsp;</p>"), (6, "u", "just text")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert [r.text for r in got] == [want, want, "", "", "", "", "just text"]
    assert all(r.n_chars == len(r.text) for r in got)


def test_html_on_the_pages_table(spark, sf):
    import html as h

    for r in html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", inside)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_lm_scores(spark):
    good, bad = [prose(i, 80, 50) for i in range(20)], [prose(i, 80, 5000) for i in range(20)]
    d = spark.createDataFrame([*enumerate(good), *((100 + i, t) for i, t in enumerate(bad)), (300, None), (301, "")], "doc_id long, text string")
    model = lm_score.fit(d.filter("doc_id < 10"), d, bits=16)
    assert model[0, 0].sum() == 800 and model.shape == (2, 3, 65536)
    counts = {r.bucket: r.n for r in lm_score.count(d, 16).collect()}
    assert sum(n for b, n in counts.items() if b < 65536) == 3200
    r = {x.doc_id: x for x in lm_score.score(d, model).collect()}
    assert max(r[i].score for i in range(10, 20)) < min(r[100 + i].score for i in range(20))
    assert r[300].score is None and r[301].n_tokens == 0 and r[5].score == pytest.approx(r[5].target_loss - r[5].background_loss)
    assert lm_score.score(d.limit(0), lm_score.fit(d.limit(0), d.limit(0), bits=8)).count() == 0


def test_lm_scores_count_whole_ngrams(spark, monkeypatch):
    """Against brute force over the words themselves; in buckets far fewer than the pairs the scores would differ."""
    monkeypatch.setattr(lm_score, "HELD", 500)
    rows = [*((i, prose(i, 80, 50)) for i in range(20)), *((100 + i, prose(i, 80, 5000)) for i in range(20)), (5, prose(5, 80, 50)), (300, None), (301, ""), (302, "A b a B a b")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    more = spark.createDataFrame([(400, "never seen w1 w2")], "doc_id long, text string")
    counts = []
    for texts in ([t for i, t in rows if i < 10], [t for _, t in rows]):
        c = [Counter(), Counter(), Counter()]
        for w in map(words, texts):
            before = ["", *w][: len(w)]
            for out, x in zip(c, (w, zip(before, w), before)):
                out.update(x)
        counts.append(c)
    scale = counts[0][0].total() / counts[1][0].total()
    vocabulary = len(counts[0][0] | counts[1][0])

    def loss(w, m):
        (one, two, context), by = counts[m], (1, scale)[m]
        p = lambda v, x: (by * two[v, x] + 20 * (by * one[x] + 0.5) / (by * one.total() + 0.5 * vocabulary)) / (by * context[v] + 20)
        return sum(-np.log(p(v, x)) for v, x in zip(["", *w], w)) / len(w)

    model = lm_score.fit(d.filter("doc_id < 10"), d)
    got = [*lm_score.score(d, model).collect(), *lm_score.score(more, model).collect()]
    text = {**dict(rows), 400: "never seen w1 w2"}
    assert len(got) == len(rows) + 1
    for r in got:
        w = words(text[r.doc_id])
        assert r.n_tokens == len(w) and (r.score is None) == (not w)
        if w:
            assert (r.target_loss, r.background_loss) == pytest.approx((loss(w, 0), loss(w, 1)), abs=1e-9)
            assert r.score == pytest.approx(r.target_loss - r.background_loss)
    assert lm_score.score(d.limit(0), lm_score.fit(d.limit(0), d.limit(0))).count() == 0


def test_quality(spark, sf):
    rows = [(r.doc_id, r.held_out, r.score, r.predicted) for r in queries.quality_scores(spark, sf).collect()]
    assert all(0 <= s <= 1 and p == int(s >= 0.7) for _, _, s, p in rows) and any(h for _, h, _, _ in rows)
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    out = quality.score(d, quality.train(d, labels.filter(~fold))).join(labels, "doc_id").filter(fold)
    right = [r.predicted == r.quality for r in out.collect()]
    assert sum(right) / len(right) > 0.93
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    assert [0 <= r.score <= 1 for r in quality.score(odd, quality.train(d, labels)).collect()] == [True] * 3
    none = quality.train(d, labels.limit(0))
    assert none.rules == [] and quality.score(odd, none).count() == 3


def test_viterbi_equals_one_pass():
    rng = np.random.default_rng(1)
    lens = [0, 1, 5, 256, 257, 700]
    first = np.concatenate([[0], np.cumsum(lens)])
    s = rng.normal(size=(sum(lens), 3)) * 3
    labels = langid.viterbi(s, first, 4.0)
    for a, b in zip(first[:-1], first[1:]):
        if a < b:
            v = s[a].copy()
            for i in range(a + 1, b):
                v = np.maximum(v, v.max() - 4) + s[i]
            assert v.max() == pytest.approx(sum(s[i, labels[i]] for i in range(a, b)) - 4 * sum(labels[i] != labels[i - 1] for i in range(a + 1, b)))


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = langid.train(d.filter(~held))
    r = langid.identify(d, model).join(d.select("doc_id", "lang", held.alias("h")), "doc_id").filter("h").collect()
    assert sum(x.lang == x.lang_pred for x in r) / len(r) > 0.98
    texts = {x.lang: x.text for x in d.filter("n_chars between 400 and 900 and source != 'src0'").collect()}
    mixed = f"{texts['en']}\n{texts['de']}"
    odd = spark.createDataFrame([(1, None), (2, "12 !?"), (3, ""), (4, mixed), (5, "Привет")], "doc_id long, text string").withColumn("score", F.lit(0))
    got = {x.doc_id: x for x in langid.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[5].lang_pred in model.langs
    assert {s.lang for s in got[4].spans} >= {"en", "de"} and got[4].spans[-1].end <= len(mixed)
    assert langid.identify(odd, langid.train(d.limit(0))).filter("lang_pred != 'und'").count() == 0


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [nan] * 8), (303, [inf] * 8), (None, [1.0] * 8), (304, [1.0]), (50, [9.0] * 8), (7, [3.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = Counter()
    for q, x in ok:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x))[:5]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    got = Counter(tuple(r) for r in topk.top_k(d, d.filter("vec_id % 50 = 0")).collect())
    assert got == want
    assert topk.top_k(d.limit(0), d).count() == 0
    big = spark.createDataFrame([(0, [2.0**30, 1.0]), (1, [2.0**10, 3.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(big, big.filter("vec_id = 0"), 2).collect()] == [(0, 1, 1, 256 * 256 * (2**40 + 3)), (0, 2, 2, 256 * 256 * (2**30 + 2))]


def test_decontamination(spark):
    items = [(i, f"{prose(500 + i, 30)} ?\n{prose(700 + i, 8)}") for i in range(40)] + [(90, None), (91, ""), (92, "tiny item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = dict(items)
    half = " ".join(text[3].split()[:15])
    rows = [(1, f"{prose(1, 300)} {text[0].upper()}, {prose(2, 300)}"), (2, f"{prose(3, 100)} {half}"), (3, text[5].replace("\n", " ! ")), (4, None), (5, ""), (6, prose(6, 2000)), (7, f"a {text[7]} b {text[8]}"), (8, "so a Tiny, item")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    want = {(1, 0), (3, 5), (7, 7), (7, 8), (8, 92)}
    for chars in (10**9, 3000):  # one shard or several
        got = decontam.contaminated(d, bench, shard_chars=chars).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and all(r.overlap == 1 and r.answer_overlap == 1 for r in got)
    assert decontam.contaminated(d, bench.limit(0)).count() == 0 and decontam.contaminated(d.limit(0), bench).count() == 0
    assert {r.doc_id for r in decontam.drop_contaminated(d, bench).collect()} == {2, 4, 5, 6}


def test_decontamination_decides_by_question_and_answer(spark):
    question, answer = prose(900, 30), prose(901, 12)
    long, short = prose(902, 60), prose(903, 6)
    bench = spark.createDataFrame([(0, f"{question} ?\n{answer}"), (1, f"{long} ?\n{short}"), (2, f"{prose(904, 12)} ?\n{prose(905, 40)}")], "item_id long, text string")
    first, second = prose(904, 12), prose(905, 40)
    far = prose(906, 600, 10**6)
    changed = " ".join(["other", *short.split()[1:]])
    rows = [
        (1, f"{question} {far} {answer}"), (2, f"{answer} {far} {question}"), (3, f"{question} {far}"), (4, f"{far} {answer}"), (5, f"{long} {far}"),
        (6, f"{long} {short}"), (7, f"{long} {changed}"), (8, f"{second} {far} {first}"), (9, f"{second} {far}"),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (6, 1), (7, 1), (8, 2)}
    assert got[1, 0].question_overlap == got[1, 0].answer_overlap == got[8, 2].question_overlap == 1 and got[1, 0].overlap < 0.8


def test_wand_finds_what_full_scoring_finds():
    items = [(i, prose(i, 25, 60)) for i in range(50)]
    index = decontam.build(items)
    rng = np.random.default_rng(4)
    for _ in range(30):
        terms = sorted(rng.choice(len(index.vocabulary), 30, replace=False).tolist())
        index.thresholds[:] = rng.uniform(5, 25, len(items))
        index.block_least[:] = [index.thresholds[b * decontam.BLOCK : (b + 1) * decontam.BLOCK].min() for b in range(len(index.block_least))]
        full = Counter()
        for t in terms:
            for i, x in zip(*index.postings[t]):
                full[int(i)] += float(x)
        want = {i for i, s in full.items() if s >= index.thresholds[i]}
        assert {i for i, _ in index.retrieve(terms, set(range(len(index.block_least))))} == want


def test_sentencepiece(spark):
    model = sentencepiece_tok.read_model(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    texts = [*sentencepiece_tok.PROBES, "▁ a▁b", "x" * 5000, prose(1, 500), "á é ﬁ 𝔘", None]
    assert sentencepiece_tok.differences(model, [t for t in texts if t is not None]) == []
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = sentencepiece_tok.encode(d, model)
    got = {r.doc_id: r for r in rows.collect()}
    assert all(got[i].round_trip and got[i].n_tokens == len(got[i].ids) for i, t in enumerate(texts) if t is not None)
    assert got[len(texts) - 1].ids is None and got[0].ids == []
    back = {r.doc_id: r.text for r in sentencepiece_tok.decode(rows, model).collect()}
    assert all(back[i] == (t if t is None else t.replace("▁", " ")) for i, t in enumerate(texts))
    table, tok = sentencepiece_tok.Pieces(sentencepiece_tok.parse(model)), sentencepiece_tok.build(sentencepiece_tok.parse(model))
    ids = [tok.encode(t, add_special_tokens=False).ids for t in texts if t]
    assert [x.decode() for x in table.decode(ids)] == tok.decode_batch(ids)


def test_sentencepiece_unigram():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), ("▁", -3.0, 1), ("▁a", -2.0, 1), ("b", -3.0, 1), ("ab", -2.5, 1), ("a", -4.0, 1)]
    m = sentencepiece_tok.Model(pieces, sentencepiece_tok.UNIGRAM, True, b"", True, False, True)
    t = sentencepiece_tok.build(m)
    assert [pieces[i][0] for i in t.encode("ab aé", add_special_tokens=False).ids] == ["▁a", "b", "▁a", "<0xC3>", "<0xA9>"]
    assert t.decode(t.encode("ab <s>", add_special_tokens=False).ids) == "ab <s>"


@pytest.mark.parametrize("budget", [64, 400, 4096])
def test_chat(spark, sf, budget):
    odd = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (-2, 0, "system", "be %25 \\"), (-2, 1, "u%\n<|s", "a<\\|b<\\\\|"), (-2, 2, "assistant", None), (-2, 3, "assistant", "<|é𝔘" * 900), (-2, 4, "user", "q"), (-2, 5, "assistant", ""), (-3, 0, None, None), (-4, 1, "assistant", "same"), (-4, 1, "assistant", "same"), (-4, None, "user", "first"), (None, 0, "assistant", "x\n")]
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    w = chat.windows(c.withColumn("window", F.lit(0)), budget=budget)
    turns = {}
    for r in sorted(c.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or "")):
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.read_back(w).collect()}
    assert set(got) == set(turns)
    for k, t in turns.items():
        whole, loss = "".join(f"{a}\n{b}\n" for a, b in t), "".join(b for a, b in t if a == "assistant")
        want = (len(t), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == want
    for r in w.collect():
        system = len(turns[r.conv_id]) and turns[r.conv_id][0][0] == "system" and r.window > 0
        assert not r.over or r.n_turns == 1 or system
        assert r.formatted.count(chat.START) == r.n_turns + r.n_repeated
        assert not system or r.formatted.startswith("<|im_start|>system\n")
    assert chat.windows(c.limit(0)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    before = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == before.columns and d.count() <= before.count()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    text = {r.doc_id: r.text for r in d.collect()}
    model = sentencepiece_tok.read_model(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    tok = sentencepiece_tok.build(sentencepiece_tok.parse(model))
    assert set(got) == set(text) and all(got[i].ids == tok.encode(t, add_special_tokens=False).ids for i, t in text.items())
    assert decontam.contaminated(d, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
