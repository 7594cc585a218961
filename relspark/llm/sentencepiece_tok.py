"""SentencePiece models on the tokenizers library (operator 9).

The model's protobuf is parsed here; normaliser, metaspace marker, pieces with scores (unigram) or merges ranked by
score (BPE) and byte fallback are rebuilt, and batches are encoded on several threads.  Every worker compares its
tokenizer with the sentencepiece library on probe texts before use.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .store import small_batches

MARK = "▁"
# Piece types and model types of the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Models beyond this size are refused: the bytes go to every worker.
MAX_MODEL_BYTES = 64 << 20

PROBES = ("", " ", "Hello world", "  two  spaces ", "tab\tline\nend\r\n", "naïve été straße", "你好 Ελλάδα", "<s> </s> <unk> <0x0A>", "\U0001f600 emoji", "aaaa aaaaaaa", "123 4567.89!!", "the thentnd erthwhst")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def parse(data: bytes) -> Model:
    """A model from its protobuf."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.kind = v
                elif k == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.add_dummy_prefix = bool(v)
                elif k == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif k == 5:
                    m.escape_whitespaces = bool(v)
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces to a third, the joined piece's score deciding, then its id."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
            if a is not None and b is not None:
                found.append((-m.pieces[i][1], i, a, b))
    found.sort()
    return [(m.pieces[a][0], m.pieces[b][0]) for _, _, a, b in found]


def build(m: Model):
    """A tokenizers.Tokenizer that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    from tokenizers import AddedToken

    unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
    if m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, _merges(m), unk_token=m.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=m.byte_fallback)
    elif m.kind == UNIGRAM:
        # only ordinary pieces may be found in text: the others get a name or a score that never wins
        vocab = [(p, s) if kind in (NORMAL, USER_DEFINED) else (p, -1e9) if kind == BYTE else (f"\0{p}", -1e9) for p, s, kind in m.pieces]
        model = models.Unigram(vocab, unk_id=unknown, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    space = MARK if m.escape_whitespaces else " "
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(space))
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if all(MARK not in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)):
        # no piece goes on past a word's end, so words can be encoded one by one, and looked up when seen before
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    own = [p for p, _, kind in m.pieces if kind == USER_DEFINED]
    if own:
        t.add_tokens([AddedToken(p, normalized=True) for p in own])
    undo = [decoders.Replace(MARK, " ")] if m.escape_whitespaces else []
    undo += [decoders.ByteFallback()] if m.byte_fallback else []
    undo.append(decoders.Fuse())
    if m.add_dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(undo)
    return t


def differences(data: bytes, texts: list[str], tokenizer=None) -> list[str]:
    """Those texts whose ids differ from the sentencepiece library's."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts, num_threads=1)
    ours = (tokenizer or build(parse(data))).encode_batch(texts, add_special_tokens=False)
    return [x for x, a, b in zip(texts, theirs, ours) if a != b.ids]


_MARK_BYTES = MARK.encode()


class Pieces:
    """The bytes of every piece in one buffer: decodes a batch of ids with array operations."""

    def __init__(self, m: Model):
        raw = []
        for piece, _, kind in m.pieces:
            if kind == BYTE:
                raw.append(bytes([int(piece[3:5], 16)]))
            elif kind == UNKNOWN:
                raw.append(" \u2047 ".encode())
            elif kind == CONTROL:
                raw.append(b"")
            else:
                raw.append(piece.encode().replace(_MARK_BYTES, b" ") if m.escape_whitespaces else piece.encode())
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.buffer = np.frombuffer(b"".join(raw), np.uint8)
        self.prefix = m.add_dummy_prefix

    def decode(self, ids: list) -> list[bytes]:
        """UTF-8 of each sequence of ids, without the leading space that encoding added."""
        flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in ids)])
        size = self.size[flat]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[flat] - (ends - size), size)
        out = self.buffer[at].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        texts = [out[a:b] for a, b in zip(cuts, cuts[1:])]
        return [x[1:] if self.prefix and x[:1] == b" " else x for x in texts]


_ready: dict[bytes, tuple] = {}


def _tokenizer(data: bytes, threads: int) -> tuple:
    """The tokenizer, compared with the library, and the table of pieces; made once in a worker."""
    key = hashlib.sha256(data).digest()
    if key not in _ready:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        t = build(parse(data))
        if bad := differences(data, list(PROBES), t):
            raise RuntimeError(f"the rebuilt tokenizer differs from the model on {bad!r}")
        _ready[key] = (t, Pieces(parse(data)))
    return _ready[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path}: a model of over {MAX_MODEL_BYTES} bytes")
    return data


def encode(docs: DataFrame, model: bytes, threads: int = 2, batch_chars: int = 200_000) -> DataFrame:
    """docs with ids (array of int), n_tokens (long) and round_trip (boolean: decoding gives the text again, the
    marker character itself counting as a space) added; columns of these names are replaced.

    A null text has null ids, no tokens and a null round_trip; an empty one has empty ids.  Texts are encoded whole,
    whatever their length; repeated rows come back each; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens", "round_trip")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, table = _tokenizer(model, threads)
        for batch in batches:
            column = batch["text"]
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            flat, counts, same = [], [], []
            at = 0
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and (end == at or size < batch_chars):
                    size += int(sizes[end])
                    end += 1
                texts = [x or "" for x in column.slice(at, end - at).to_pylist()]
                # numbers, not objects, are what is held until the batch is done
                found = [np.array(e.ids, np.int32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                same += [x.encode().replace(_MARK_BYTES, b" ") == y for x, y in zip(texts, table.decode(found))]
                counts += map(len, found)
                flat.append(np.concatenate(found))
                at = end
            null = column.is_null()
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32(), mask=np.append(null.to_numpy(zero_copy_only=False), False))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
            trip = pa.array(same, pa.bool_(), mask=null.to_numpy(zero_copy_only=False)) if len(null) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(counts, pa.int64()), trip], [*batch.schema.names, "ids", "n_tokens", "round_trip"])

    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("ids array<int>, n_tokens long, round_trip boolean").fields])
    return docs.mapInArrow(rows, schema)


def decode(rows: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """rows with text (string) from ids; null ids give a null text, empty ones an empty text.  A column of that name is
    replaced; repeated rows come back each, ids of any number are one text, an empty table stays empty."""
    rows = rows.drop("text")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _ = _tokenizer(model, threads)
        for batch in batches:
            ids = batch["ids"].to_pylist()
            out = t.decode_batch([i or [] for i in ids], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if i is None else x for i, x in zip(ids, out)], pa.string())], [*batch.schema.names, "text"])

    return rows.mapInArrow(texts, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))
