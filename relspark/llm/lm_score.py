"""Cross-entropy difference of two n-gram models (operator 2).

A target and a background model, matched in vocabulary, order, smoothing and mass, are counted over all documents;
a document's score is the mean over its tokens of the target loss less the background loss, so low scores are
target-like.  Words (as such and as contexts) and pairs are keyed by 64-bit hashes and counted whole, so what is
counted grows with the corpus:

1. texts are packed into blocks, one row for each, which stay together from here on;
2. each block sends its distinct keys with their counts, in ranges of keys, one row for each range;
3. each range is summed over all blocks, and every block gets back the totals of the keys it sent;
4. each block scores its texts from its own totals.

A key of a third of all tokens is one entry of each block, and no table of counts meets in one place.  Only if `bits`
is given to fit() are words and pairs hashed into 2**bits buckets for each order instead, which the driver collects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import _groups
from .store import keep, small_batches
from .text import CHUNK_BYTES, Words, chunks, flat, mix

_U = np.uint64
BITS = 20
#: Words of a block, and of a range of keys, about (by bytes of text).
HELD = 900_000
_WORD_BYTES = 6
#: What a text is for.
TARGET, BACKGROUND, SCORED = 1, 2, 4


def _hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word, of the word before it (a text's first: of its start), and of the pair."""
    start = _U(0x243F6A8885A308D3)
    before = np.concatenate([np.full(1, start), words.hashes[:-1]]) if len(words.hashes) else words.hashes
    first = words.first[:-1][np.diff(words.first) > 0]
    before[first] = start
    return words.hashes, before, mix(before * _U(3) + words.hashes)


def _grams(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the hashes."""
    own, context, pair = ((x & _U((1 << bits) - 1)).astype(np.int64) for x in _hashes(words))
    return own, context, pair


def count(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(bucket, n): words below 2**bits, pairs from there, contexts from twice that.  Counts are combined in the
    worker, then summed; every token of every text is counted, of repeated rows each.  Null and empty texts have none;
    other columns are ignored; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    size = 1 << bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * size, np.int64)
        for batch in batches:
            for _, _, words in chunks(batch["text"]):
                for i, x in enumerate(_grams(words, bits)[k] for k in (0, 2, 1)):
                    total[i * size : (i + 1) * size] += np.bincount(x, minlength=size)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 65536):
            part = at[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["bucket", "n"])

    return docs.select("text").mapInArrow(rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _collect(counts: DataFrame, bits: int) -> np.ndarray:
    """(3, 2**bits)."""
    out = np.zeros(3 << bits)
    found = counts.toArrow()
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(3, -1)


@dataclass
class Model:
    target: DataFrame  # texts
    background: DataFrame


_BLOCKS = "block long, marks binary, lens binary, size long, data binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, mark) to blocks: the texts' bytes one after the other, packed; a null text is empty."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: list[tuple[pa.Array, bytes, np.ndarray, bytes]] = []
    size = 0
    codec = pa.Codec("zstd", 1)

    def made() -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        lens = np.concatenate([h[2] for h in held]).astype("<i8").tobytes()
        data = codec.compress(b"".join(h[3] for h in held), asbytes=True)
        return pa.RecordBatch.from_arrays([ids, pa.array([number]), pa.array([b"".join(h[1] for h in held)]), pa.array([lens]), pa.array([size]), pa.array([data])], ["ids", "block", "marks", "lens", "size", "data"])

    for batch in batches:
        marks = batch["mark"].to_numpy().astype(np.uint8)
        data, offsets = flat(batch["text"])
        at, n = 0, batch.num_rows
        while at < n:
            room = max(HELD * _WORD_BYTES - size, 0)
            end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + room, side="right")) - 1))
            held.append((batch["id"].slice(at, end - at), marks[at:end].tobytes(), np.diff(offsets[at : end + 1]), data[offsets[at] : offsets[end]].tobytes()))
            size += int(offsets[end] - offsets[at])
            at = end
            if size >= HELD * _WORD_BYTES or sum(len(h[1]) for h in held) > 50_000:
                yield made()
                held, size, number = [], 0, number + 1
    if held:
        yield made()


def _unpack(row: dict) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], list[np.ndarray]]:
    """The marks of a block's texts; for runs of whole texts of about CHUNK_BYTES the first row and where each text's
    words begin; and the hashes of all words, contexts and pairs."""
    marks, lens = np.frombuffer(row["marks"], np.uint8), np.frombuffer(row["lens"], "<i8")
    data = np.frombuffer(pa.Codec("zstd").decompress(row["data"], row["size"], asbytes=True), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(lens)])
    out, hashes, at, n = [], [(np.zeros(0, _U),) * 3], 0, len(lens)
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1))
        words = Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        out.append((at, words.first))
        hashes.append(_hashes(words))
        at = end
    return marks, out, [np.concatenate(x) for x in zip(*hashes)]


def _distinct(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct words and pairs, and which of them each token's word, context and pair are.  Empties hashes."""
    pairs, third = np.unique(mix(hashes.pop()), return_inverse=True)
    context = hashes.pop()
    n = len(context)
    both = np.concatenate([hashes.pop(), context])
    del context
    words, at = np.unique(both, return_inverse=True)
    return words, pairs, at[:n], at[n:], third


def _ranges(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of 2**bits ranges of hashes begins, and their places in the sorted values."""
    starts = np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits) if bits else np.zeros(1, np.uint64)
    return starts, np.append(np.searchsorted(value, starts), len(value))


def _squeeze(value: np.ndarray, start: np.uint64) -> tuple[int, bytes]:
    """Sorted values as differences of as many bytes as the largest needs."""
    step = np.diff(value, prepend=start).astype("<u8")
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return width, step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _expand(raw: bytes, width: int, start: np.uint64) -> np.ndarray:
    step = np.zeros((len(raw) // width, 8), np.uint8)
    step[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) + start


def _planes(x: np.ndarray) -> bytes:
    """Numbers by place of their bytes, as the high ones are zeros mostly and shuffles compress."""
    return np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(raw: bytes, several: int, n: int) -> np.ndarray:
    """(several, n)."""
    size = len(raw) // (several * n)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f"<u{size}").reshape(several, n)


def _word_bits(bits: int) -> int:
    """Words are far fewer than pairs.  Their ranges are numbered after those of the pairs."""
    return max(bits - 2, 0)


_SENT = "p int, block long, scored boolean, width int, key binary, n binary"


def _sent(bits: int):
    """Each block's distinct keys and their counts, a row for each range: of pairs in the target and in the background,
    of words as words and as contexts in either."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                marks, parts, hashes = _unpack(row)
                words, pairs, own, context, pair = _distinct(hashes)
                mark = np.concatenate([*(np.repeat(marks[lo : lo + len(first) - 1], np.diff(first)) for lo, first in parts), np.zeros(0, np.uint8)])
                some = [np.flatnonzero(mark & m) for m in (TARGET, BACKGROUND)]
                count = lambda at, value: [np.bincount(at[x], minlength=len(value)).astype("<u4") for x in some]  # noqa: B023,E731
                scored = bool((marks & SCORED).any())
                out: list[tuple] = []
                for value, b, first, counts in ((pairs, bits, 0, count(pair, pairs)), (words, _word_bits(bits), 1 << bits, [*count(own, words), *count(context, words)])):
                    starts, at = _ranges(value, b)
                    for p in np.flatnonzero(np.diff(at)).tolist():
                        i, j = int(at[p]), int(at[p + 1])
                        out.append((first + p, row["block"], scored, *_squeeze(value[i:j], starts[p]), _planes(np.stack([c[i:j] for c in counts]))))
                kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
                # a block's keys are some 10 MB: a batch of all of them would be held by the worker and the executor at once
                for i in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 64]), kinds)], ["p", "block", "scored", "width", "key", "n"])

    return rows


_TOTALS = "block long, p int, n binary, words long, tokens_t long, tokens_b long"


def _summed(bits: int):
    """Each range's totals, for each block in the order of its keys; and its numbers of words and tokens."""
    names = ["block", "p", "n", "words", "tokens_t", "tokens_b"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["p"]):
            p = group["p"][0].as_py()
            several = 4 if p >= 1 << bits else 2
            own = p - (1 << bits) if several == 4 else p
            start = _U(own << (64 - (_word_bits(bits) if several == 4 else bits))) if own else _U(0)
            keys = [_expand(x, w, start) for x, w in zip(group["key"].to_pylist(), group["width"].to_pylist())]
            counts = [_from_planes(x, several, len(k)) for x, k in zip(group["n"].to_pylist(), keys)]
            value, at = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.stack([np.bincount(at, weights=np.concatenate([c[k] for c in counts]), minlength=len(value)) for k in range(several)])
            # small numbers mostly: four bytes while they do
            totals = totals.astype("<u8" if totals.max() >= 2**32 else "<u4")
            sums = (int((totals[0] + totals[1] > 0).sum()), int(totals[0].sum()), int(totals[1].sum())) if several == 4 else (None,) * 3
            out: list[tuple] = [(None, p, None, *sums)]
            ends = np.cumsum([len(x) for x in keys])
            blocks = group["block"].to_pylist()
            for i in np.flatnonzero(group["scored"].to_numpy()).tolist():
                out.append((blocks[i], p, _planes(totals[:, at[ends[i] - len(keys[i]) : ends[i]]]), None, None, None))
                if len(out) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows


def _totals(rows: dict[int, bytes], value: np.ndarray, bits: int, first: int, several: int) -> np.ndarray:
    """(several, keys): a block's totals in the order of its keys."""
    _, at = _ranges(value, bits)
    out = np.zeros((several, len(value)))
    for p in np.flatnonzero(np.diff(at)).tolist():
        i, j = int(at[p]), int(at[p + 1])
        out[:, i:j] = _from_planes(rows[first + p], several, j - i)
    return out


def _own(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How often each token's key occurs in its own text; keys: below n."""
    _, at, count = np.unique(text * n + keys, return_inverse=True, return_counts=True)
    return count[at].astype(np.float64)


def _scored(id_col: str, bits: int, tokens: tuple[int, int], vocabulary: int, prior: float, strength: float, leave_out: bool):
    scale = tokens[0] / tokens[1] if tokens[1] else 1.0

    def of(row: dict, ids: pa.Array, back: dict[int, bytes]) -> pa.RecordBatch:
        marks, parts, hashes = _unpack(row)
        words, pairs, *tokens_at = _distinct(hashes)
        by_pair = _totals(back, pairs, bits, 0, 2)
        by_word = _totals(back, words, _word_bits(bits), 1 << bits, 4)
        n, losses = np.zeros(len(marks), np.int64), np.zeros((2, len(marks)))
        begin = 0
        for lo, first in parts:
            size = np.diff(first)
            own, context, pair = (x[begin : begin + int(first[-1])] for x in tokens_at)
            begin += int(first[-1])
            n[lo : lo + len(size)] = size
            some = np.flatnonzero(size)
            if not len(some):
                continue
            text = np.repeat(np.arange(len(size)), size)
            mine = [_own(x, text, len(value)) for x, value in ((own, words), (context, words), (pair, pairs))] if leave_out else [0.0] * 3
            for m, (mark, by) in enumerate(((TARGET, 1.0), (BACKGROUND, scale))):
                member = ((marks[lo : lo + len(size)] & mark) > 0)[text] if leave_out else 0.0
                c_word, c_context, c_pair = ((total - x * member) * by for total, x in zip((by_word[m][own], by_word[2 + m][context], by_pair[m][pair]), mine))
                mass = (tokens[m] - size[text] * member) * by
                one = (c_word + prior) / (mass + prior * vocabulary)
                p = (c_pair + strength * one) / (c_context + strength)
                losses[m, lo + some] = np.add.reduceat(-np.log(p), first[some]) / size[some]
        wanted = pa.array((marks & SCORED) > 0)
        none = n == 0
        t, b, d = (pa.array(x, mask=none) for x in (losses[0], losses[1], losses[0] - losses[1]))
        return pa.RecordBatch.from_arrays([ids, pa.array(n), t, b, d], [id_col, "n_tokens", "target_loss", "background_loss", "score"]).filter(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["block"]):
            # the block's own row has the least p
            own = group.slice(0, 1)
            row = own.select(["marks", "lens", "size", "data"]).to_pylist()[0]
            if (np.frombuffer(row["marks"], np.uint8) & SCORED).any():
                back = group.slice(1)
                yield of(row, own["ids"].combine_chunks().flatten(), dict(zip(back["p"].to_pylist(), back["n"].to_pylist())))

    return rows


def _score(texts: DataFrame, id_col: str, prior: float, strength: float, leave_out: bool) -> DataFrame:
    """texts: (id, text, mark)."""
    spark = texts.sparkSession
    small_batches(spark)
    kind = texts.schema["id"].dataType.simpleString()
    blocks = keep(texts.select("id", "text", F.col("mark").cast("int")).mapInArrow(_pack, f"ids array<{kind}>, {_BLOCKS}"), "blocks")
    schema = f"`{id_col}` {kind}, n_tokens long, target_loss double, background_loss double, score double"
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(0, min(24, int(np.ceil(np.log2(max(size / (HELD * _WORD_BYTES), 1))))))
    sent = blocks.mapInArrow(_sent(bits), _SENT)
    totals = keep(sent.repartition("p").sortWithinPartitions("p").mapInArrow(_summed(bits), _TOTALS), "totals")
    words, t, b = (x or 0 for x in totals.agg(F.sum("words"), F.sum("tokens_t"), F.sum("tokens_b")).first())
    back = blocks.withColumn("p", F.lit(-1)).unionByName(totals.filter("block is not null").select("block", "p", "n"), allowMissingColumns=True)
    return back.repartition("block").sortWithinPartitions("block", "p").mapInArrow(_scored(id_col, bits, (t, b), words, prior, strength, leave_out), schema)


def fit(target: DataFrame, background: DataFrame, bits: int | None = None) -> Model | np.ndarray:
    """The texts of the target and of the background, which score() counts, the latter scaled to the target's number
    of tokens so that smoothing weighs alike in both.  With bits, an array (2, 3, 2**bits) of hash buckets."""
    if bits is None:
        return Model(target.select("text"), background.select("text"))
    t, b = _collect(count(target, bits), bits), _collect(count(background, bits), bits)
    tokens = b[0].sum()
    return np.stack([t, b * (t[0].sum() / tokens if tokens else 1.0)])


def score_within(docs: DataFrame, target: str, id_col: str = "doc_id", prior: float = 0.5, strength: float = 20.0, leave_out: bool = True) -> DataFrame:
    """score() of docs by a background model of all of them and a target model of those where the column `target` is
    true.  No text is scored by its own counts: they are taken out of both models first (unless leave_out is False).

    A null in `target` is false.  A null or empty text has no tokens and null losses and score.  Repeated rows are
    texts of their own, each scored, and each counts for the others; null ids are kept.  A text of any length is whole
    in one block.  Other columns, whatever their names, are ignored.  An empty table gives no rows.
    """
    mark = F.when(F.col(target), TARGET).otherwise(0) + F.lit(BACKGROUND | SCORED)
    return _score(docs.select(F.col(id_col).alias("id"), "text", mark.alias("mark")), id_col, prior, strength, leave_out)


def score(docs: DataFrame, model: Model | np.ndarray, id_col: str = "doc_id", prior: float = 0.5, strength: float = 20.0) -> DataFrame:
    """(id_col, n_tokens, target_loss, background_loss, score): nats for each token, score their difference.

    p(w|v) = (c(v,w) + strength * p(w)) / (c(v) + strength), p(w) = (c(w) + prior) / (tokens + prior * words).
    A null or empty text has no tokens and null losses and score.  Repeated rows are scored each; null ids are kept.
    Other columns, whatever their names, are ignored.  An empty table gives no rows.
    """
    if isinstance(model, Model):
        kind = docs.schema[id_col].dataType.simpleString()
        texts = docs.select(F.col(id_col).alias("id"), "text", F.lit(SCORED).alias("mark"))
        for more, mark in ((model.target, TARGET), (model.background, BACKGROUND)):
            texts = texts.unionByName(more.select(F.lit(None).cast(kind).alias("id"), "text", F.lit(mark).alias("mark")))
        return _score(texts, id_col, prior, strength, False)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = int(np.log2(model.shape[2]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        tokens = counts[:, 0].sum(axis=1, dtype=np.float64)
        for batch in batches:
            n, losses = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows))
            for lo, hi, words in chunks(batch["text"]):
                own, context, pair = _grams(words, bits)
                size = np.diff(words.first)
                n[lo:hi] = size
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                for m in range(2):
                    one = (counts[m, 0][own] + prior) / (tokens[m] + prior * counts.shape[2])
                    p = (counts[m, 1][pair] + strength * one) / (np.maximum(counts[m, 2][context], counts[m, 1][pair]) + strength)
                    losses[m, lo + some] = np.add.reduceat(-np.log(p), words.first[some]) / size[some]
            none = pa.array(n == 0)
            t, b, d = (pa.array(x, mask=none.to_numpy(zero_copy_only=False)) for x in (losses[0], losses[1], losses[0] - losses[1]))
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(n), t, b, d], [id_col, "n_tokens", "target_loss", "background_loss", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(rows, f"`{id_col}` {kind}, n_tokens long, target_loss double, background_loss double, score double")
