"""Substring dedup: passages that repeat across documents (operator 4).

Two kinds of unit are looked at:

* paragraphs (lines) of at least `min_words` words go through MinHash banding; colliding paragraphs are decided by
  the exact Jaccard similarity of their five-word shingle sets and clustered by connected components;
* passages inside paragraphs that differ, or that are broken into lines otherwise: the words of a text, whatever its
  line breaks, are cut at places chosen by the words around them, so the same passage is cut alike wherever it stands;
  equal pieces across documents belong together.  A stretch that repeats one to three words is cut into equal pieces,
  so it repeats any such stretch of these words, whatever their lengths.

Of each cluster the units of the smallest doc_id stay; elsewhere they go, when they make up a run of `min_words`
words or more.  A text's own repetitions stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .neardup import SETS, Signature, linked, set_hash, set_rows
from .store import drop, keep, small_batches
from .text import CHUNK_BYTES, Words, chunks, mix

_U = np.uint64
#: Shorter runs are left alone: set phrases, headings, licence lines, test items.  What the cuts cover of a passage inside
#: differing text is some 15 words less than the passage, so this stands for passages of 45 to 50 words and more.
MIN_WORDS = 30
#: Words on either side of a cut that decide it.
CALM = 3
#: Recurrences in a piece where words recur every CALM words or sooner.
PERIODS = 8


def bands(similarity: float = 0.8, rows: int = 3, recall: float = 0.999) -> int:
    """The number of bands of `rows` slots that finds a pair of this similarity with this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def signature(similarity: float = 0.8, rows: int = 3, recall: float = 0.999, shingle: int = 5) -> Signature:
    """Bands are chunks without errors; 18 slots of 32 differing has a chance below 1e-5 at 0.8."""
    n = bands(similarity, rows, recall) * rows
    mean = n * (1 - similarity)
    far = math.ceil(mean + 4.5 * math.sqrt(mean * similarity))
    return Signature(wide=n, chunk=rows, chunk_errors=0, bins=64, far=far, shingle=shingle, percent=round(100 * similarity))


def _line_starts(words: Words) -> np.ndarray:
    """Whether each word is the first of its line or text."""
    breaks = np.flatnonzero(words.data == 0x0A)
    first = np.zeros(len(words.starts), bool)
    at = np.searchsorted(words.starts, breaks)
    first[at[at < len(first)]] = True
    first[words.first[:-1][words.first[:-1] < len(first)]] = True
    return first


def _spans(words: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(first)
    return begin, np.append(begin[1:], len(first))


def _paragraphs(sig: Signature, min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sig.hashes()
        for batch in batches:
            ids, of = batch["doc_id"].to_numpy(zero_copy_only=False), batch["t"].to_numpy()
            for lo, _, words in chunks(batch["text"]):
                begin, end = _spans(words, _line_starts(words))
                long = end - begin >= max(min_words, sig.shingle)
                begin, end = begin[long], end[long]
                doc = np.searchsorted(words.first, begin, side="right") - 1
                k = sig.shingle
                shingle = words.runs(k)
                cols: list[list] = [[] for _ in range(4)]
                for i, j in zip(begin.tolist(), end.tolist()):
                    values = np.unique(shingle[i : j - k + 1])
                    one, two = set_hash(values)
                    for c, x in zip(cols, (len(values), one, two, sig.of(values, hashes))):
                        c.append(x)
                base = words.offsets[doc]
                arrays = [ids[lo + doc], of[lo + doc], words.starts[begin] - base, words.ends[end - 1] - base, end - begin]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in arrays), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "t", "start", "end", "words", "n", "h1", "h2", "sig"])

    return rows


_PARAGRAPHS = "doc_id long, t long, start long, end long, words long, n long, h1 long, h2 long, sig binary"


_SPAN = ("id", "start", "end", "n", "sig", "h1", "h2")


def _texts_of_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, spans) -> each span's columns and its text, about CHUNK_BYTES at a time."""
    kinds = dict(zip(_SPAN, (pa.int64(),) * 4 + (pa.binary(),) + (pa.int64(),) * 2)) | {"text": pa.string()}
    held: dict[str, list] = {c: [] for c in kinds}
    size = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[c], kind) for c, kind in kinds.items()], list(kinds))

    for batch in batches:
        for i in range(batch.num_rows):
            raw = (batch["text"][i].as_py() or "").encode()
            for s in batch["spans"][i].as_py():
                for c in _SPAN:
                    held[c].append(s[c])
                held["text"].append(raw[s["start"] : s["end"]].decode())
                size += s["end"] - s["start"]
            if size > CHUNK_BYTES:
                yield made()
                held, size = {c: [] for c in kinds}, 0
    if held["id"]:
        yield made()


def _cuts(words: Words, line: np.ndarray) -> np.ndarray:
    """Whether to cut before each word: where the hash of it and the word before is below those of CALM words to
    either side in its text (line: the first words of texts).  Pieces inside a text have more than CALM words, and
    long stretches without a cut are rare.

    Words that recur every CALM words or sooner have equal minima near one another, none of them below the others:
    there every PERIODS-th is a cut, from the first on, so the pieces of such a stretch are all the same."""
    value = mix(np.roll(words.hashes, 1) * _U(3) + words.hashes * _U(5))
    value[line] = np.iinfo(np.uint64).max
    number = np.cumsum(line)
    least, below = ~line, ~line
    for d in range(1, CALM + 1):
        same = number[d:] == number[:-d]
        for out, less in ((least, np.less_equal), (below, np.less)):
            out[d:] &= same & less(value[d:], value[:-d])
            out[:d] = False
            out[:-d] &= same & less(value[:-d], value[d:])
            out[-d:] = False
    tied = np.flatnonzero(least & ~below)
    if len(tied):
        rank = np.arange(len(tied))
        head = np.append(True, (np.diff(tied) > CALM) | (np.diff(value[tied].view(np.int64)) != 0))
        below[tied[(rank - np.maximum.accumulate(np.where(head, rank, 0))) % PERIODS == 0]] = True
    return below


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of texts with the hash of their words.  Of a block of pieces, a value's smallest doc_id competes with
    those of other blocks (route: the value), while its other documents are known to repeat it (route: the document)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        ids, of = batch["doc_id"].to_numpy(zero_copy_only=False), batch["t"].to_numpy()
        for lo, _, words in chunks(batch["text"]):
            if not len(words.hashes):
                continue
            head = np.zeros(len(words.hashes), bool)
            head[words.first[:-1][np.diff(words.first) > 0]] = True
            begin, end = _spans(words, head | _cuts(words, head))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hashes) * _roll(len(words.hashes)), dtype=np.uint64)])
            value = mix((sums[end] - sums[begin]) * _unroll(len(words.hashes))[begin] + (end - begin).astype(np.uint64))
            doc = np.searchsorted(words.first, begin, side="right") - 1
            base = words.offsets[doc]
            # equal pieces in a row are one row
            head = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))
            last = np.append(head[1:], len(value)) - 1
            value, doc, base, begin, end = value[head], doc[head], base[head], begin[head], end[last]
            yield value.view(np.int64), ids[lo + doc].astype(np.int64), of[lo + doc], words.starts[begin] - base, words.ends[end - 1] - base, end - begin

    def made() -> pa.RecordBatch:
        value, doc, t, start, end, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, value))
        value, doc, t, start, end, n = (x[order] for x in (value, doc, t, start, end, n))
        head = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        known = doc != np.repeat(doc[head], np.diff(np.append(head, len(value))))
        route = np.where(known, mix(doc.view(np.uint64)).view(np.int64), value)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (route, known, value, doc, t, start, end, n)], ["route", "known", "value", "doc_id", "t", "start", "end", "words"])

    # a block is combined at a time, so memory does not follow the partition's size
    for batch in batches:
        for part in cut(batch):
            held.append(part)
            size += len(part[0])
            if size > 250_000:
                yield made()
                held, size = [], 0
    if held:
        yield made()


_PIECES = "route long, known boolean, value long, doc_id long, t long, start long, end long, words long"
_BASE = 0xD1342543DE82EF95


def _roll(n: int) -> np.ndarray:
    from .text import _power

    return _power(_BASE, n)[:n]


def _unroll(n: int) -> np.ndarray:
    from .text import _power

    return _power(pow(_BASE, -1, 1 << 64), n)[:n]


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by known, value and doc_id, those known and those whose value began with another doc_id; holds
    one batch."""
    last_value, owner = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        value, doc = batch["value"].to_numpy(), batch["doc_id"].to_numpy()
        head = np.append(True, value[1:] != value[:-1])
        at = np.maximum.accumulate(np.where(head, np.arange(len(value)), 0))
        own = doc[at]
        if last_value is not None and value[0] == last_value:
            own[at == 0] = owner
        last_value, owner = value[-1], own[-1]
        known = batch["known"].to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(known | (doc != own))).select(["doc_id", "t", "start", "end", "words"])


def _cut(min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words, spans, runs = [], [], [], []
            for text, found in zip(batch["text"].to_pylist(), batch["__found"].to_pylist()):
                raw = text.encode() if text else b""
                gone: list[tuple[int, int]] = []
                n = 0
                for s in sorted((f["start"], f["end"]) for f in found or []):
                    if gone and (s[0] <= gone[-1][1] or not raw[gone[-1][1] : s[0]].strip(b" \t\n\v\f\r")):
                        gone[-1] = (gone[-1][0], max(s[1], gone[-1][1]))
                    else:
                        gone.append(s)
                gone = [(a, b, c) for a, b in gone if (c := len(raw[a:b].split(None))) >= min_words]
                parts, at, lost = [], 0, []
                for a, b, c in gone:
                    parts.append(raw[at:a].rstrip(b" \t"))
                    lost.append({"start": len(raw[:a].decode()), "text": raw[a:b].decode()})
                    at, n = b, n + c
                if gone:
                    parts.append(raw[at:])
                    lines = b"\n".join(p for p in parts).decode().split("\n")
                    text = "\n".join(x for x in lines if x.strip())
                texts.append(text)
                words.append(n)
                runs.append(len(gone))
                spans.append(lost)
            out = batch.drop_columns(["__found"])
            out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(runs, pa.int64()), pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string())])))], [*out.schema.names, "__runs", "__words", "__removed"])

    return rows


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, sig: Signature | None = None) -> DataFrame:
    """(doc_id, t, start, end, words): byte spans of units that an earlier document has as well; t is hash(text).

    Rows without doc_id or text have none.  Rows that repeat a doc_id count as one document, whose texts t tells
    apart.  Long texts are whole units of work, never cut; an empty table gives no rows; columns of
    other names are ignored.
    """
    sig = sig or signature()
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.hash("text").cast("long").alias("t"), "text").filter("doc_id is not null and text is not null")
    lines = keep(docs.mapInArrow(_paragraphs(sig, min_words), _PARAGRAPHS).withColumn("uid", F.monotonically_increasing_id()), "lines")
    same = lines.groupBy("n", "h1", "h2").agg(F.min("uid").alias("id"), F.min("doc_id").alias("owner"), F.count("*").alias("copies"))
    classes = keep(same.join(lines.select(F.col("uid").alias("id"), "doc_id", "t", "start", "end", "sig"), "id"), "classes")

    def sets_of(ids: DataFrame) -> DataFrame:
        want = classes.join(ids, "id", "left_semi").groupBy("doc_id", "t").agg(F.collect_list(F.struct(*_SPAN)).alias("spans"))
        last = set_rows(sig)
        # texts stream past the spans: they are not sorted
        return docs.join(want.hint("shuffle_hash"), ["doc_id", "t"]).select("text", "spans").mapInArrow(lambda batches: last(_texts_of_spans(batches)), SETS)

    comp = linked(classes, sets_of, sig)
    group = classes.join(comp, "id", "left").select("n", "h1", "h2", "owner", "copies", F.coalesce("comp", "id").alias("comp"))
    best = group.groupBy("comp").agg(F.min("owner").alias("first"), F.sum("copies").alias("copies"))
    group = group.drop("copies", "owner").join(best.filter("copies > 1"), "comp")
    near = keep(lines.join(group, ["n", "h1", "h2"]).filter("doc_id != first").select("doc_id", "t", "start", "end", "words"), "near")
    for used in (lines, classes, comp):
        drop(used)

    pieces = docs.mapInArrow(_pieces, _PIECES).repartition("route").sortWithinPartitions("known", "value", "doc_id")
    return near.unionByName(pieces.mapInArrow(_later, "doc_id long, t long, start long, end long, words long"))


def cut_repeated(docs: DataFrame, min_words: int = MIN_WORDS, sig: Signature | None = None) -> DataFrame:
    """docs with repeated passages cut from text, and three more columns: removed_runs, removed_words (long) and
    removed (array of start, in characters of the old text, and text).

    Null and empty texts, and rows without doc_id, come back as they are.  Rows that repeat a doc_id count as one
    document and come back one for one.  All columns of docs are kept; those named like the new ones are replaced.  An
    empty table stays empty.
    """
    docs = docs.drop("removed_runs", "removed_words", "removed")
    found = repeated_spans(docs, min_words, sig).groupBy("doc_id", "t")
    # a text with fewer repeated words than one run needs has nothing to cut
    found = found.agg(F.sum("words").alias("__n"), F.collect_list(F.struct("start", "end")).alias("__found")).filter(F.col("__n") >= min_words)
    found = found.select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t"), "__found")
    both = docs.join(found.hint("shuffle_hash"), (F.col("doc_id") == F.col("__doc")) & (F.hash("text").cast("long") == F.col("__t")), "left").select(*docs.columns, "__found")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("__runs long, __words long, __removed array<struct<start:bigint,text:string>>").fields])
    out = both.mapInArrow(_cut(min_words), schema)
    return out.withColumnsRenamed({"__runs": "removed_runs", "__words": "removed_words", "__removed": "removed"})
