"""Benchmark decontamination with a BM25 index and block-max WAND (operator 7).

The test items are indexed, and every passage of every document is a query that retrieves all items whose BM25 score
reaches the item's threshold.  The threshold is proven: no passage that holds at least `overlap` of an item's five-word shingles,
or of those of its heavier part (question or answer, by the least score), scores less.  Retrieved items are verified by
question and answer: a document holds an item if it holds `overlap` of the shingles of both, of the heavier part in
one passage and of the other anywhere, or `overlap` of the whole in one passage and half the answer's words anywhere
(so a changed word in a short answer does not hide a copy).  A question without its answer is not a leak.

Passages are windows of two steps, a step being at least the longest item's length, so every stretch of an item's
length lies inside one of them.  As in WAND, an item's commonest words cannot make a pivot: those that together score
no more than half its threshold are left out of the first look, which follows the postings of the other words only and
asks each item for the rest of its threshold.  The blocks of the items that this leaves are searched by block-max WAND
over all words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches
from .text import _WEIGHTS, Words, chunks, mix

_U = np.uint64
#: Items of a block.
BLOCK = 64
#: Sums of the first look that are held at a time.
SUMS = 2_000_000
#: Items are indexed in shards of about so many characters: what a worker holds is bounded, and a larger benchmark
#: takes more passes over the documents.
SHARD_CHARS = 4_000_000


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    out = np.zeros(n if k else 0, np.uint64)
    for j in range(k):
        out += hashes[j : n + j] * _WEIGHTS[j]
    return mix(out + _U(k))


@dataclass
class Index:
    ids: list
    vocabulary: np.ndarray  # sorted word hashes
    postings: list[tuple[np.ndarray, np.ndarray]]  # by term: items ascending, impacts
    block_max: list[tuple[np.ndarray, np.ndarray]]  # by term: blocks that hold it, their greatest impacts
    pivots: tuple[np.ndarray, np.ndarray, np.ndarray]  # where each term's begin; items, impacts
    needed: np.ndarray  # by item: of its threshold what its pivots must bring
    thresholds: np.ndarray  # by item
    block_least: np.ndarray  # least threshold of each block
    whole: list[np.ndarray]  # shingle hashes
    question: list[np.ndarray]
    answer: list[np.ndarray]
    answer_words: list[np.ndarray]
    heavy: list[bool]  # whether the question scores more than the answer
    width: list[tuple[int, int, int]]  # words to a shingle, by item: of the whole, of the question, of the answer
    step: int
    size: int  # items of a block

    def retrieve(self, terms: list[int], blocks: set[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items in the blocks that reach their thresholds, for a query of distinct terms."""
        found = []
        cursor = {t: 0 for t in terms}
        most = {t: float(self.block_max[t][1].max()) for t in terms}
        n = len(self.ids)

        def forward(t: int, item: int) -> None:
            items = self.postings[t][0]
            cursor[t] += int(np.searchsorted(items[cursor[t] :], item))

        def greatest(t: int, block: int) -> float:
            at_blocks, impacts = self.block_max[t]
            i = int(np.searchsorted(at_blocks, block))
            return float(impacts[i]) if i < len(at_blocks) and at_blocks[i] == block else 0.0

        at = lambda t: int(self.postings[t][0][cursor[t]]) if cursor[t] < len(self.postings[t][0]) else n
        least = min((float(self.block_least[b]) for b in blocks), default=math.inf)
        live = list(terms)
        while live:
            live = sorted((t for t in live if at(t) < n), key=at)
            total, pivot = 0.0, n
            for t in live:
                total += most[t]
                if total >= least:
                    pivot = at(t)
                    break
            if pivot == n:
                break
            block = pivot // self.size
            upto = [t for t in live if at(t) <= pivot]
            # the block's own maxima: of all terms that may occur in it
            if block not in blocks or sum(greatest(t, block) for t in live if at(t) < (block + 1) * self.size) < self.block_least[block]:
                for t in live:
                    if at(t) < (block + 1) * self.size:
                        forward(t, (block + 1) * self.size)
                continue
            if at(live[0]) == pivot:
                score = sum(float(self.postings[t][1][cursor[t]]) for t in live if at(t) == pivot)
                if score >= self.thresholds[pivot]:
                    found.append((pivot, score))
                for t in live:
                    if at(t) == pivot:
                        cursor[t] += 1
            else:
                for t in upto:
                    forward(t, pivot)
        return found


def _answer_start(text: str) -> int:
    """Where an item's answer begins, in characters: its last line, or else its last sentence; 0 if it has one part."""
    text = text.rstrip()
    cut = text.rfind("\n")
    if cut < 0:
        cut = max(text[:-1].rfind(c + " ") + 1 for c in ".?!")
    return max(cut, 0)


def build(items: list[tuple[object, str]], overlap: float = 0.8, shingle: int = 5, k1: float = 1.2, b: float = 0.75) -> Index | None:
    """Items without words are left out; None if none is left."""
    tokens, cuts, ids = [], [], []
    for i, text in items:
        raw = (text or "").encode()
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), punctuation=True)
        if len(words.hashes):
            ids.append(i)
            tokens.append(words.hashes)
            cuts.append(int(np.searchsorted(words.starts, len(text[: _answer_start(text)].encode()))))
    if not ids:
        return None
    vocabulary = np.unique(np.concatenate(tokens))
    mean = sum(map(len, tokens)) / len(tokens)
    by_term: list[list[tuple[int, int]]] = [[] for _ in vocabulary]
    for i, h in enumerate(tokens):
        terms, tf = np.unique(np.searchsorted(vocabulary, h), return_counts=True)
        for t, f in zip(terms.tolist(), tf.tolist()):
            by_term[t].append((i, f))
    n_blocks = (len(ids) + BLOCK - 1) // BLOCK
    postings, block_max, own, own_terms = [], [], [[] for _ in ids], [[] for _ in ids]
    for t, found in enumerate(by_term):
        idf = math.log(1 + (len(ids) - len(found) + 0.5) / (len(found) + 0.5))
        impacts = np.array([idf * f * (k1 + 1) / (f + k1 * (1 - b + b * len(tokens[i]) / mean)) for i, f in found], np.float32)
        at = np.array([i for i, _ in found])
        postings.append((at, impacts))
        head = np.flatnonzero(np.append(True, np.diff(at // BLOCK) > 0))
        block_max.append((at[head] // BLOCK, np.maximum.reduceat(impacts, head)))
        for i, x in zip(at.tolist(), impacts.tolist()):
            own[i].append(x)
            own_terms[i].append(t)
    thresholds, heavy = np.zeros(len(ids)), []

    def least_score(i: int, part: np.ndarray) -> float:
        # of n - k + 1 shingles the lost ones cost no more words than they are: without the dearest of those, the least score
        if not len(part):
            return 0.0
        x = np.array(own[i])[np.isin(np.unique(tokens[i]), part)].tolist()
        lost = math.floor((1 - overlap) * (len(part) - min(shingle, len(part)) + 1) + 1e-9)
        return sum(sorted(x)[: max(len(x) - lost, 1)]) * (1 - 1e-5)

    for i, (h, c) in enumerate(zip(tokens, cuts)):
        question, answer = least_score(i, h[:c]), least_score(i, h[c:])
        heavy.append(question > answer)
        thresholds[i] = min(least_score(i, h), max(question, answer))
    needed, pivots = np.zeros(len(ids)), []
    for i, (terms, x) in enumerate(zip(own_terms, map(np.array, own))):
        order = np.argsort(x, kind="stable")
        n = int(np.searchsorted(np.cumsum(x[order]), thresholds[i] / 2, side="right"))
        needed[i] = (thresholds[i] - x[order[:n]].sum()) * (1 - 1e-5)
        pivots.extend((terms[j], i, x[j]) for j in order[n:].tolist())
    pivots.sort()
    of, items_of, impacts_of = (np.array(c) for c in zip(*pivots))
    pivots = (np.searchsorted(of, np.arange(len(vocabulary) + 1)), items_of, impacts_of)
    least = np.array([thresholds[j * BLOCK : (j + 1) * BLOCK].min() for j in range(n_blocks)])
    whole = [np.unique(_shingles(h, shingle)) for h in tokens]
    parts = [(np.unique(_shingles(h[:c], shingle)), np.unique(_shingles(h[c:], shingle))) for h, c in zip(tokens, cuts)]
    return Index(ids, vocabulary, postings, block_max, pivots, needed, thresholds, least, whole, [p[0] for p in parts], [p[1] for p in parts], [np.unique(h[c:]) for h, c in zip(tokens, cuts)], heavy, [(min(shingle, len(h)), min(shingle, c), min(shingle, len(h) - c)) for h, c in zip(tokens, cuts)], max(64, max(map(len, tokens))), BLOCK)


def _share(part: np.ndarray, seen: np.ndarray) -> float:
    return float(np.isin(part, seen).mean()) if len(part) else 1.0


def _share_of_sorted(part: np.ndarray, seen: np.ndarray) -> float:
    if not len(part) or not len(seen):
        return float(not len(part))
    return float((seen[np.minimum(np.searchsorted(seen, part), len(seen) - 1)] == part).mean())


def _half_of_words(answer: np.ndarray, hashes: np.ndarray) -> bool:
    return 2 * np.isin(answer, hashes).sum() >= len(answer)


def _pivots(index: Index, terms: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, set[int]]]:
    """(query, blocks to look at) of queries with the terms [begin, next begin): of items whose pivots bring enough."""
    of, items, impacts = index.pivots
    n = len(index.ids)
    each = max(1, SUMS // n)
    for lo in range(0, len(begin) - 1, each):
        hi = min(lo + each, len(begin) - 1)
        part = terms[begin[lo] : begin[hi]]
        query = np.repeat(np.arange(hi - lo), np.diff(begin[lo : hi + 1]))
        size = of[part + 1] - of[part]
        if not size.any():
            continue
        at = np.arange(size.sum()) + np.repeat(of[part] - np.cumsum(size) + size, size)
        sums = np.bincount(np.repeat(query, size) * n + items[at], weights=impacts[at], minlength=(hi - lo) * n).reshape(-1, n)
        rows, hits = np.nonzero(sums >= index.needed)
        for q in np.unique(rows).tolist():
            yield lo + q, set((hits[rows == q] // index.size).tolist())


def search(index: Index, words: Words, overlap: float, slots: np.ndarray) -> Iterator[tuple[int, int, float, float, float, float]]:
    """(text, item, score, overlap, question overlap, answer overlap) for every passage that holds an item, or its
    heavier part while the text holds the other."""
    slot = slots[(words.hashes & _U(len(slots) - 1)).astype(np.int64)]
    term = np.where(index.vocabulary[np.minimum(slot, len(index.vocabulary) - 1)] == words.hashes, slot, -1)
    miss = np.flatnonzero((slot < 0) | (term < 0))
    # the slot table holds one term a slot; the others are looked up
    shared = miss[slot[miss] == -2] if len(miss) else miss
    if len(shared):
        at = np.minimum(np.searchsorted(index.vocabulary, words.hashes[shared]), len(index.vocabulary) - 1)
        term[shared] = np.where(index.vocabulary[at] == words.hashes[shared], at, -1)
    size = np.diff(words.first)
    steps = np.maximum((size + index.step - 1) // index.step, 1)
    head = np.concatenate([[0], np.cumsum(steps)])  # first step of each text
    text = np.repeat(np.arange(len(size)), size)
    step = head[text] + (np.arange(len(term)) - words.first[text]) // index.step
    known = np.flatnonzero(term >= 0)
    if not len(known):
        return
    # passage p holds steps p and p + 1 of a text
    n_terms = len(index.vocabulary)
    step, t = step[known], term[known]
    later = step > head[text[known]]
    key = np.unique(np.concatenate([step * n_terms + t, (step[later] - 1) * n_terms + t[later]]))
    passage, t = key // n_terms, key % n_terms
    begin = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    texts: dict[int, np.ndarray] = {}  # of the text at hand, its shingles by width
    at_hand = -1
    for p, blocks in _pivots(index, t, np.append(begin, len(t))):
        terms = t[begin[p] : begin[p + 1] if p + 1 < len(begin) else None].tolist()
        found = index.retrieve(terms, blocks)
        if not found:
            continue
        at = int(passage[begin[p]])
        doc = int(np.searchsorted(head, at, side="right")) - 1
        lo = int(words.first[doc]) + (at - int(head[doc])) * index.step
        hashes = words.hashes[lo : min(lo + 2 * index.step, int(words.first[doc + 1]))]
        seen = {k: _shingles(hashes, k) for k in {k for i, _ in found for k in index.width[i]}}
        if doc != at_hand:
            texts, at_hand = {}, doc

        def anywhere(part: np.ndarray, k: int) -> float:
            if k not in texts:
                texts[k] = np.unique(_shingles(words.hashes[words.first[doc] : words.first[doc + 1]], k))  # noqa: B023
            return _share_of_sorted(part, texts[k])  # noqa: B023

        for i, score in found:
            widths = index.width[i]
            share, question, answer = (_share(part[i], seen[k]) for part, k in zip((index.whole, index.question, index.answer), widths))
            if share < overlap and (question if index.heavy[i] else answer) < overlap:
                continue
            if index.heavy[i]:
                answer = anywhere(index.answer[i], widths[2])
            else:
                question = anywhere(index.question[i], widths[1])
            if min(question, answer) >= overlap or share >= overlap and _half_of_words(index.answer_words[i], words.hashes[words.first[doc] : words.first[doc + 1]]):
                yield doc, i, score, share, question, answer


def _slots(vocabulary: np.ndarray) -> np.ndarray:
    bits = max(16, int(len(vocabulary) * 8).bit_length())
    at = (vocabulary & _U((1 << bits) - 1)).astype(np.int64)
    out = np.full(1 << bits, -1, np.int64)
    out[at] = np.arange(len(vocabulary))
    out[np.flatnonzero(np.bincount(at, minlength=1 << bits) > 1)] = -2
    return out


_FOUND = "score double, overlap double, question_overlap double, answer_overlap double, passages long"


def contaminated(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, shingle: int = 5, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap, passages): documents that hold an
    item's question and answer (see above); the figures are of the passage that holds most of the item, but the overlap
    of the lighter of question and answer is of the whole document.

    Words are compared without case (A-Z) and ASCII punctuation.  Items and texts that are null or have no words take
    no part; items shorter than a shingle are one shingle.  Repeated rows of docs give repeated results.  The
    documents are scanned once for each shard of the benchmark, and nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], *T._parse_datatype_string(_FOUND).fields])
    out = None
    for index in _indexes(benchmark, overlap, shingle, shard_chars):
        found = docs.select("doc_id", "text").mapInArrow(_search_rows(spark.sparkContext.broadcast(index), overlap, benchmark.schema["item_id"].dataType), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _indexes(benchmark: DataFrame, overlap: float, shingle: int, shard_chars: int) -> Iterator[Index]:
    """An index of each shard of the benchmark, of a bounded size."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_chars))
    for shard in range(shards):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard) if shards > 1 else benchmark
        index = build([(r[0], r[1]) for r in part.select("item_id", "text").orderBy("item_id", "text").collect()], overlap, shingle)
        if index is not None:
            yield index


def _search_rows(shared, overlap: float, item_type: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_type)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        slots = _slots(index.vocabulary)
        for batch in batches:
            best: dict[tuple[int, int], list] = {}
            for lo, _, words in chunks(batch["text"], punctuation=True):
                for doc, item, *figures in search(index, words, overlap, slots):
                    have = best.setdefault((lo + doc, item), [*figures, 0])
                    have[4] += 1
                    if figures[1] > have[1]:
                        have[:4] = figures
            docs = batch["doc_id"].take(pa.array([d for d, _ in best], pa.int64()))
            cols = list(zip(*best.values())) or [()] * 5
            yield pa.RecordBatch.from_arrays([docs, pa.array([index.ids[i] for _, i in best], kind), *(pa.array(c, pa.float64()) for c in cols[:4]), pa.array(cols[4], pa.int64())], ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap", "passages"])

    return rows


def _clean_rows(shared, overlap: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        slots = _slots(index.vocabulary)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for lo, _, words in chunks(batch["text"], punctuation=True):
                for doc, *_ in search(index, words, overlap, slots):
                    clean[lo + doc] = False
            yield batch.filter(pa.array(clean))

    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, shingle: int = 5, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """docs without the rows that hold a benchmark item, by the rule of contaminated().

    Each row is decided by its own text where it is read, and nothing is shuffled: rows without a doc_id are no
    exception, and rows that repeat one are decided one by one.  Null and empty texts stay.  All columns come back,
    whatever their names; an empty table on either side takes nothing away.  Shards of the benchmark follow one another
    over the rows that are left.
    """
    small_batches(docs.sparkSession)
    for index in _indexes(benchmark, overlap, shingle, shard_chars):
        docs = docs.mapInArrow(_clean_rows(docs.sparkSession.sparkContext.broadcast(index), overlap), docs.schema)
    return docs
