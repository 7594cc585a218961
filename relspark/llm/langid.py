"""Language identification with spans (operator 5).

Letters are told apart by script ranges (runs of code points whose Unicode names begin with the same script), which
narrow each word's candidate languages to those written in it; a word ends where the script changes.  A word's score in a language is the sum of its letters' trigram log likelihoods; Viterbi over the words, with a penalty
for every switch, labels the spans of a mixed text.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches
from .text import mix

_U = np.uint64
BUCKETS = 1 << 18
CHUNK_CHARS = 1 << 19
SEGMENT = 256

# Words that follow or go before the script in the Unicode name of a letter, and what has no script.
_GENERIC = frozenset("LETTER SMALL CAPITAL SYLLABLE SYLLABLES VOWEL CONSONANT SIGN IDEOGRAPH UNIFIED COMPATIBILITY CHARACTER DIGRAPH LIGATURE FINAL ITERATION VOICED SEMI-VOICED PROLONGED INDEPENDENT DEPENDENT HIEROGLYPH CHOSEONG JUNGSEONG JONGSEONG SYMBOL".split())
_WIDTHS = frozenset("HALFWIDTH FULLWIDTH".split())
_COMMON = frozenset("MODIFIER MATHEMATICAL DOUBLE-STRUCK SCRIPT BLACK-LETTER MICRO FEMININE MASCULINE KELVIN ANGSTROM OHM EULER PLANCK TURNED ROTATED INFORMATION ALEF BET GIMEL DALET SUPERSCRIPT SUBSCRIPT".split())
_SAME = {"HIRAGANA": "KANA", "KATAKANA": "KANA", "KATAKANA-HIRAGANA": "KANA"}

_tables: list[np.ndarray] = []


def script_of(letter: str) -> str:
    """The script in a letter's Unicode name; "" if it has none of its own."""
    words = unicodedata.name(letter, "").split()
    if words and words[0] in _WIDTHS:
        words = words[1:]
    if not words or words[0] in _COMMON:
        return ""
    end = next((i for i, w in enumerate(words) if i and w.split("-")[0] in _GENERIC), len(words))
    name = " ".join(words[:end]) if end < len(words) else words[0].split("-")[0]
    return _SAME.get(name, _SAME.get(words[0], name))


def _letters_and_scripts() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for letters, 2 for marks, 0 for all else; and the number of the script, 0 if there is none."""
    if not _tables:
        kinds = np.fromiter((1 if chr(c).isalpha() else 2 if unicodedata.category(chr(c))[0] == "M" else 0 for c in range(0x110000)), np.uint8, 0x110000)
        numbers: dict[str, int] = {"": 0}
        scripts = np.zeros(0x110000, np.int64)
        for c in np.flatnonzero(kinds == 1).tolist():
            scripts[c] = numbers.setdefault(script_of(chr(c)), len(numbers))
        _tables.extend((kinds, np.minimum(scripts, N_SCRIPTS - 1).astype(np.uint16)))
    return _tables[0], _tables[1]


#: More than there are scripts.
N_SCRIPTS = 512


@dataclass
class Letters:
    """Of some texts: per letter its trigram's bucket and script; per word its letters [start, end) and place."""

    buckets: np.ndarray
    scripts: np.ndarray
    word: np.ndarray  # first letter of each word, and the number of letters
    script: np.ndarray  # of each word
    begin: np.ndarray  # code points
    end: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words


def _read(texts: list[str | None]) -> Letters:
    kinds, scripts = _letters_and_scripts()
    lower = [t.lower() if t else "" for t in texts]
    # a few capitals change length when lowered; those texts are lowered letter by letter where that keeps it
    lower = [x if len(x) == len(t or "") else "".join(y if len(y := c.lower()) == 1 else c for c in t) for t, x in zip(texts, lower)]
    sizes = np.array([len(x) + 1 for x in lower])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    code = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[code]
    is_letter = kind == 1
    at = np.flatnonzero(is_letter)
    here = scripts[code[at]]
    if (kind == 2).any() or not here.all():
        # marks belong to the letter before them; those that follow no letter belong to no word
        inside = kind > 0
        place = np.arange(len(code), dtype=np.int32)
        run = np.maximum.accumulate(np.where(inside & ~np.append(False, inside[:-1]), place, 0))
        inside &= np.maximum.accumulate(np.where(is_letter, place, -1)) >= run
        # marks, and letters without a script, are written in that of the letter before
        own = np.where(is_letter, scripts[code], 0)
        before = np.maximum.accumulate(np.where(own > 0, place, -1))
        at = np.flatnonzero(inside)
        here = np.where(before >= run, own[np.maximum(before, 0)], 0)[at]
    head = np.append(True, (np.diff(at) > 1) | (here[1:] != here[:-1]) & (here[1:] > 0) & (here[:-1] > 0)) if len(at) else np.zeros(0, bool)
    tail = np.append(head[1:], True) if len(at) else head
    sym = code[at].astype(np.uint64)
    left = np.where(head, _U(0), np.concatenate([np.zeros(1, np.uint64), sym[:-1]])[: len(sym)])
    right = np.where(tail, _U(0), np.concatenate([sym[1:], np.zeros(1, np.uint64)])[: len(sym)])
    buckets = (mix((left << _U(42)) | (sym << _U(21)) | right) % _U(BUCKETS)).astype(np.int64)
    word = np.flatnonzero(head)
    begin = at[word]
    end = at[np.append(word[1:], len(at)) - 1] + 1 if len(word) else begin
    first = np.searchsorted(begin, offsets)
    text = np.searchsorted(offsets, begin, side="right") - 1
    by_word = np.maximum.reduceat(here, word) if len(word) else here
    return Letters(buckets, here, np.append(word, len(at)), by_word, begin - offsets[text], end - offsets[text], first)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") < CHUNK_CHARS):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


@dataclass
class Model:
    """langs in order; logp: (BUCKETS, langs) float32; written: (scripts, langs), whether a language is written in it."""

    langs: list[str]
    logp: np.ndarray
    written: np.ndarray
    penalty: float = 8.0


def train(docs: DataFrame, penalty: float = 8.0, alpha: float = 0.1, least_share: float = 0.01) -> Model:
    """Counts every trigram of every row with a text and a lang; repeated rows count each.  What reaches the driver is
    bounded by BUCKETS counts for each language, whatever the number of rows.  Without such rows nothing is learnt."""
    small_batches(docs.sparkSession)
    docs = docs.filter("lang is not null and text is not null").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
            for lo, hi in _parts(texts):
                x = _read(texts[lo:hi])
                size = np.diff(x.word[x.first])
                names = sorted(set(langs[lo:hi]))
                code = np.repeat(np.array([names.index(n) for n in langs[lo:hi]], np.int64), size)
                for i, n in enumerate(names):
                    of = code == i
                    have = total.setdefault(n, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                    have[:BUCKETS] += np.bincount(x.buckets[of], minlength=BUCKETS)
                    have[BUCKETS:] += np.bincount(x.scripts[of], minlength=N_SCRIPTS)
        for n, have in total.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(at)), pa.array(at.astype(np.int32)), pa.array(have[at])], ["lang", "bucket", "n"])

    sums = docs.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums["lang"].to_pylist()))
    counts = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    if langs:
        column = np.searchsorted(np.array(langs), sums["lang"].to_numpy(zero_copy_only=False).astype(str))
        counts[sums["bucket"].to_numpy(), column] = sums["n"].to_numpy()
    tri, script = counts[:BUCKETS], counts[BUCKETS:]
    used = max(1, int((tri.sum(1) > 0).sum()))
    logp = np.log((tri + alpha) / (tri.sum(0) + alpha * (used + 1)))
    return Model(langs, logp.astype(np.float32), script / np.maximum(script.sum(0), 1) >= least_share, penalty)


def _scores(model: Model, x: Letters) -> np.ndarray:
    """(words, languages)."""
    words = len(x.word) - 1
    out = np.zeros((words, len(model.langs)), np.float64)
    if words:
        # at most CHUNK_CHARS letters at once, or one text
        per = np.add.reduceat(model.logp[x.buckets].astype(np.float64), x.word[:-1], axis=0)
        out[:] = per
        can = model.written[x.script]
        can |= ~can.any(axis=1, keepdims=True)  # a script that no language is written in narrows nothing
        out[~can] -= 1e4
    return out


def _room(long: int, size: int) -> int:
    """How many texts step together, so that what is remembered of `size` bytes a step stays within 4 MB."""
    return max(1, min(256, 4_000_000 // max(long * size, 1)))


def _short(scores: np.ndarray, starts: np.ndarray, lens: np.ndarray, penalty: float, labels: np.ndarray) -> None:
    """Viterbi over texts of SEGMENT words at most, many at once."""
    n_langs = scores.shape[1]
    order = np.argsort(lens, kind="stable")
    lo = 0
    while lo < len(order):
        # lengths ascend; the last of the block is its longest
        hi = min(len(order), lo + 256)
        hi = lo + min(hi - lo, _room(int(lens[order[hi - 1]]), 5 * n_langs))
        seg = order[lo:hi]
        lo, long = hi, int(lens[order[hi - 1]])
        v = np.zeros((len(seg), n_langs))
        moved = np.zeros((long, len(seg), n_langs), bool)
        origin = np.zeros((long, len(seg)), np.int32)
        for t in range(long):
            k = int(np.argmax(lens[seg] > t))
            if t:
                origin[t, k:] = v[k:].argmax(axis=1)
                least = (v[k:].max(axis=1) - penalty)[:, None]
                moved[t, k:] = v[k:] < least
                v[k:] = np.maximum(v[k:], least)
            v[k:] += scores[starts[seg[k:]] + t]
        state = v.argmax(axis=1)
        for t in range(long - 1, -1, -1):
            live = np.flatnonzero(lens[seg] > t)
            labels[starts[seg[live]] + t] = state[live]
            if t:
                state[live] = np.where(moved[t, live, state[live]], origin[t, live], state[live])


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word: maximal sum of scores less a penalty for each switch inside a text.

    Texts of over SEGMENT words are cut into segments, each solved for every language it may be entered with; the
    segments of a text are then strung together, which gives the same labels as one pass.
    """
    labels = np.zeros(len(scores), np.int64)
    lens = np.diff(first)
    few = np.flatnonzero((lens > 0) & (lens <= SEGMENT))
    _short(scores, first[few], lens[few], penalty, labels)
    # texts of so many segments together that the segments' tables stay within 8 MB, or one text
    most = max(1, 1_000_000 // scores.shape[1] ** 2) if scores.shape[1] else 1
    group, size = [], 0
    for i in np.flatnonzero(lens > SEGMENT).tolist():
        n = -(-int(lens[i]) // SEGMENT)
        if group and size + n > most:
            _long(scores, group, penalty, labels)
            group, size = [], 0
        group.append((int(first[i]), int(first[i + 1])))
        size += n
    if group:
        _long(scores, group, penalty, labels)
    return labels


def _long(scores: np.ndarray, texts: list[tuple[int, int]], penalty: float, labels: np.ndarray) -> None:
    """Viterbi over longer texts, the segments of all stepping together."""
    n_langs = scores.shape[1]
    starts = np.concatenate([np.arange(a, b, SEGMENT) for a, b in texts])
    ends = np.concatenate([np.minimum(np.arange(a, b, SEGMENT) + SEGMENT, b) for a, b in texts])
    lens = ends - starts
    n = len(starts)
    through = np.empty((n, n_langs, n_langs))  # entered with, left with
    enter = np.where(np.eye(n_langs, dtype=bool), 0.0, -penalty)
    back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(lens, kind="stable")
    room = _room(SEGMENT, 5 * n_langs * n_langs)
    for lo in range(0, n, room):
        seg = order[lo : lo + room]  # lengths ascend
        long = int(lens[seg[-1]])
        v = np.broadcast_to(enter, (len(seg), n_langs, n_langs)).copy()
        moved = np.zeros((long, len(seg), n_langs, n_langs), bool)
        origin = np.zeros((long, len(seg), n_langs), np.int32)
        for t in range(long):
            k = int(np.argmax(lens[seg] > t))
            if t:
                origin[t, k:] = v[k:].argmax(axis=2)
                least = (v[k:].max(axis=2) - penalty)[:, :, None]
                moved[t, k:] = v[k:] < least
                v[k:] = np.maximum(v[k:], least)
            v[k:] += scores[starts[seg[k:]] + t][:, None, :]
        through[seg] = v
        back.append((seg, moved, origin))
    entered, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    i = 0
    for a, b in texts:
        count = -(-(b - a) // SEGMENT)
        value = through[i].max(axis=0)
        came = [through[i].argmax(axis=0)]
        for j in range(i + 1, i + count):
            total = value[:, None] + through[j]
            came.append(total.argmax(axis=0))
            value = total.max(axis=0)
        state = int(value.argmax())
        for j in range(count - 1, -1, -1):
            left[i + j] = state
            state = int(came[j][state])
            entered[i + j] = state
        i += count
    for seg, moved, origin in back:
        state = left[seg].copy()
        for t in range(moved.shape[0] - 1, -1, -1):
            live = np.flatnonzero(lens[seg] > t)
            labels[starts[seg[live]] + t] = state[live]
            if t and len(live):
                e = entered[seg[live]]
                jump = moved[t, live, e, state[live]]
                state[live] = np.where(jump, origin[t, live, e], state[live])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id_col, lang_pred, score, spans): the language of most letters, its share of the letters, and the spans
    (array of start, end in code points, lang), which cover the words in order.

    A text without letters (marks are none), or a null one, is `und` with score 0 and no spans; so is any, if nothing
    was learnt.  Of languages with equally many letters the first by name is taken.  Rows that repeat an id are texts
    of their own; a text of any length is read whole; columns of other names are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array(model.langs)
        for batch in batches:
            texts = batch["text"].to_pylist()
            pred, score, spans = [], [], []
            for lo, hi in _parts(texts):
                x = _read(texts[lo:hi])
                size = np.diff(x.word)
                labels = viterbi(_scores(model, x), x.first, model.penalty) if len(langs) else np.zeros(len(size), np.int64)
                for a, b in zip(x.first[:-1].tolist(), x.first[1:].tolist()):
                    if a == b or not len(langs):
                        pred.append("und"), score.append(0.0), spans.append([])
                        continue
                    mass = np.bincount(labels[a:b], weights=size[a:b], minlength=len(langs))
                    best = int(mass.argmax())
                    pred.append(str(langs[best]))
                    score.append(float(mass[best] / mass.sum()))
                    cut = np.append(a, np.flatnonzero(np.diff(labels[a:b])) + a + 1)
                    to = np.append(cut[1:], b)
                    spans.append([{"start": int(x.begin[i]), "end": int(x.end[j - 1]), "lang": str(langs[labels[i]])} for i, j in zip(cut, to)])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)], [id_col, "lang_pred", "score", "spans"])

    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>").fields])
    return docs.select(id_col, "text").mapInArrow(rows, schema)
