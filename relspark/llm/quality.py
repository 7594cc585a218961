"""Quality classifier: a sparse ensemble of rules over text statistics (operator 3).

Statistics are counted over the bytes of whole Arrow columns.  On a bounded sample of labelled rows small boosted trees are grown; every path
from a root is a rule, a conjunction of thresholds; a lasso logistic regression keeps few of the rules; and these
become one column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches
from .text import Words, chunks, mix

#: The most labelled rows that are fitted, those of least hash; scoring has no bound.
MAX_LABELLED = 20_000
#: Signs whose counts are statistics.
SIGNS = {"bar": "|", "bang": "!", "star": "*", "hash": "#", "dollar": "$", "percent": "%", "amp": "&", "at": "@", "lt": "<", "brace": "{", "slash": "/", "equals": "=", "underscore": "_"}


NAMES = ("chars", "words", "letters", "capitals", "digits", "new_words", "new_lines", "line_words", "word_chars", "stops", "commas", *SIGNS)


def measure(words: Words) -> dict[str, np.ndarray]:
    """The statistics of some texts, by name; shares are 0 for an empty text.

    Bytes are looked at, not code points: beyond ASCII, what begins with byte C3 or above counts as a letter, and
    the capitals are those of Latin-1.
    """
    data, offsets = words.data, words.offsets

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)

    def per(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.divide(x, of, out=np.zeros(len(x)), where=of > 0)

    chars, n_words = count((data & 0xC0) != 0x80), np.diff(words.first).astype(np.float64)
    upper = (data >= 65) & (data <= 90)
    wide = np.zeros(len(data), bool)
    wide[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    # lines that hold words: where each begins, and a hash of its words in order
    line = np.searchsorted(np.flatnonzero(data == 0x0A), words.starts)
    first = np.zeros(len(words.starts), bool)
    first[:1] = True
    first[1:] = line[1:] != line[:-1]
    first[words.first[:-1][n_words > 0]] = True
    begin = np.flatnonzero(first)
    place = (np.arange(len(first)) - np.repeat(begin, np.diff(np.append(begin, len(first))))).astype(np.uint64)
    lines = np.add.reduceat(mix(words.hashes + place * np.uint64(0x9E3779B97F4A7C15)), begin) if len(begin) else np.zeros(0, np.uint64)
    line_of = np.searchsorted(begin, words.first)
    n_lines = np.diff(line_of).astype(np.float64)
    new_words = np.array([len(np.unique(words.hashes[i:j])) for i, j in zip(words.first[:-1], words.first[1:])], np.float64)
    new_lines = np.array([len(np.unique(lines[i:j])) for i, j in zip(line_of[:-1], line_of[1:])], np.float64)
    out = {
        "chars": chars,
        "words": n_words,
        "letters": per(count(upper | ((data >= 97) & (data <= 122)) | (data >= 0xC3)), chars),
        "capitals": per(count(upper | wide), chars),
        "digits": per(count((data >= 48) & (data <= 57)), chars),
        "new_words": per(new_words, n_words),
        "new_lines": per(new_lines, n_lines),
        "line_words": per(n_words, n_lines),
        "word_chars": per(chars, n_words),
        "stops": per(count(data == ord(".")), n_words),
        "commas": per(count(data == ord(",")), n_words),
    }
    for name, sign in SIGNS.items():
        out[name] = per(count(data == ord(sign)), n_words)
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with __s, a struct of the statistics of text; a null text counts as empty."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(words) for _, _, words in chunks(batch["text"])]
            columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0)) for k in NAMES]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, list(NAMES))], [*batch.schema.names, "__s"])

    struct = T.StructType([T.StructField(k, T.DoubleType()) for k in NAMES])
    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField("__s", struct)]))


Rule = tuple[tuple[str, bool, float], ...]  # statistic, whether above, threshold


@dataclass
class Model:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, columns: dict[str, Column]) -> Column:
        """The probability of label 1 as a column expression over statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = None
            for name, above, cut in rule:
                one = columns[name] > cut if above else columns[name] <= cut
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, above, cut in rule:
        v = x[:, names.index(name)]
        ok &= v > cut if above else v <= cut
    return ok


def _tree(x: np.ndarray, names: list[str], cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """One boosted tree: the paths to all its nodes, and its step for each row."""
    rules: list[Rule] = []
    step = np.zeros(len(x))
    bins = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]

    def grow(rows: np.ndarray, path: Rule, left: int) -> None:
        step[rows] = grad[rows].sum() / (hess[rows].sum() + 1.0)
        if not left or len(rows) < 2 * least:
            return
        best = (1e-6, -1, 0)
        whole = grad[rows].sum() ** 2 / (hess[rows].sum() + 1.0)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            size = len(c) + 1
            b = bins[j][rows]
            g, h, k = (np.cumsum(np.bincount(b, weights=w, minlength=size))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = g**2 / (h + 1.0) + (grad[rows].sum() - g) ** 2 / (hess[rows].sum() - h + 1.0) - whole
            gain[(k < least) | (len(rows) - k < least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), j, int(gain.argmax()))
        _, j, i = best
        if j < 0:
            return
        low = bins[j][rows] <= i
        for above, part in ((False, rows[low]), (True, rows[~low])):
            rule = (*path, (names[j], above, float(cuts[j][i])))
            rules.append(rule)
            grow(part, rule, left - 1)

    grow(np.arange(len(x)), (), depth)
    return rules, step


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an l1 penalty, by accelerated proximal steps."""
    n, p = z.shape
    mean = z.mean(0)
    scale = np.maximum(z.std(0), 1e-3)
    z = (z - mean) / scale
    w = v = np.zeros(p)
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    size = 4.0 / max(np.linalg.norm(z, 2) ** 2 / n + 1, 1e-9)
    t = 1.0
    for _ in range(rounds):
        p_hat = 1 / (1 + np.exp(-np.clip(z @ v + c, -40, 40)))
        g = z.T @ (p_hat - y) / n
        new = v - size * g
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        new_b = c - size * float((p_hat - y).mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        if np.abs(new - w).max(initial=0) < 1e-7 and abs(new_b - b) < 1e-7:
            w, b = new, new_b
            break
        w, b, t = new, new_b, t2
    return b - float((w / scale) @ mean), w / scale


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 20, depth: int = 3, least: int = 10, penalty: float = 1e-3, most_cuts: int = 32) -> Model:
    """x: (rows, statistics), y: 0 or 1.  With one class or no rows the score is the (smoothed) share of 1."""
    share = (float(y.sum()) + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model(prior, [])
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        mid = (values[1:] + values[:-1]) / 2
        cuts.append(mid if len(mid) <= most_cuts else np.unique(np.quantile(mid, np.linspace(0, 1, most_cuts))))
    raw = np.full(len(y), prior)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        found, step = _tree(x, names, cuts, y - p, p * (1 - p), depth, min(least, max(1, len(y) // 10)))
        if not found:
            break
        rules.update(dict.fromkeys(tuple(sorted(r)) for r in found))
        raw = raw + 0.3 * step
    rules = list(rules)
    if not rules:
        return Model(prior, [])
    z = np.stack([_holds(r, x, names) for r in rules], axis=1).astype(np.float64)
    intercept, weights = _lasso(z, y.astype(np.float64), penalty)
    return Model(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, **how) -> Model:
    """From rows of docs with a label quality of 0 or 1: at most `most` labels, those of least xxhash64(doc_id)."""
    some = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    # limit bounds what is broadcast: 16 bytes for each of `most` rows
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    seen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    names = list(NAMES)
    rows = with_statistics(seen).select("doc_id", "quality", "__s.*").toPandas().sort_values(["doc_id", "quality", *names], ignore_index=True)
    return fit(rows[names].to_numpy(np.float64), rows["quality"].to_numpy(np.float64), names, **how)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs with score (double, the probability of label 1) and predicted (int, 1 from threshold on) added.

    A null text counts as empty and is scored like any.  Columns of these two names are replaced; repeated rows stay.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    out = with_statistics(docs.select(*own)).withColumn("score", model.score({k: F.col(f"__s.{k}") for k in NAMES})).drop("__s")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
