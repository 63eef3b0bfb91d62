"""Factorization machine over hashed words and structure statistics of whole texts.

score = sigmoid(w0 + sum w_i + 1/2 sum_f [(sum v_if)^2 - sum v_if^2]) over a document's distinct features:
the sum-of-squares identity makes the pairwise part linear in the number of features. Words are hashed
into 2^20 terms. Of these the machine gets those that tell the classes apart in the training rows, alone
(G test) or in a pair whose joint effect is not the sum of the single ones (`pairs_that_tell`).
Structure statistics enter as one-hot bins. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fmix, held_out, powers, prefix_hash, row_slices, text_view

TERM_BITS = 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LINE = np.ones(256, bool)
_LINE[10] = False
_CLASSES = {
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "symbol": [*b"#$%&*<>=@^_~{}[]\\/+`"],
    "bar": [*b"|"],
    "shout": [*b"!?"],
    "stop": [*b".,;:"],
    "space": [32, 9, 10, 11, 12, 13],
    "line": [10],
}
BINS = 16
STATISTICS = [*_CLASSES, "word_length", "distinct_words", "repeated_lines", "length"]
FEATURES = (1 << TERM_BITS) + BINS * len(STATISTICS)


def _spans(data: np.ndarray, offsets: np.ndarray, inside_table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, and length of each run of bytes that the table marks; the first run of each row."""
    n, rows = len(data), len(offsets) - 1
    inside = inside_table[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.diff(offsets) > 0
    begins[offsets[:-1][full]] = inside[offsets[:-1][full]]
    ends[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    _, down = powers(max(n, 1))
    first = np.searchsorted(a, offsets)
    return fmix((h[b] - h[a]) * down[a]), np.repeat(np.arange(rows), np.diff(first)), b - a, first


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])


def features(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, distinct and sorted. keep: new number of each feature, -1 to drop it."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    low = LOWER[data]
    h = prefix_hash(low)
    words, word_row, word_length, first = _spans(low, offsets, _LETTER, h)
    lines, line_row, _, first_line = _spans(low, offsets, _LINE, h)
    terms = (words >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    n_words = np.diff(first)
    base, bins = 1 << TERM_BITS, []
    counts = np.bincount(data, minlength=256) if len(data) else np.zeros(256)
    for name, members in _CLASSES.items():
        share = np.zeros(rows)
        if counts[members].any():
            mark = np.zeros(256, np.uint8)
            mark[members] = 1
            share = _sums(mark[data], offsets) / np.maximum(sizes, 1)
        bins.append(np.minimum(np.floor(np.sqrt(share) * 2 * BINS), BINS - 1))
    bins.append(np.minimum(_sums(word_length, first) / np.maximum(n_words, 1), BINS - 1))
    distinct = np.bincount(np.unique((word_row << TERM_BITS) | terms) >> TERM_BITS, minlength=rows)
    bins.append(np.minimum(distinct / np.maximum(n_words, 1) * BINS, BINS - 1))
    pairs = np.unique((line_row << 40) | (lines >> np.uint64(24)).astype(np.int64))
    n_lines = np.diff(first_line)
    bins.append(np.minimum((n_lines - np.bincount(pairs >> 40, minlength=rows)) / np.maximum(n_lines, 1) * BINS, BINS - 1))
    bins.append(np.minimum(np.log2(sizes + 1), BINS - 1))
    row = np.concatenate([word_row, *[np.arange(rows)] * len(bins)])
    feature = np.concatenate([terms, *(base + k * BINS + b.astype(np.int64) for k, b in enumerate(bins))])
    if keep is not None:
        feature = keep[feature]
        row, feature = row[feature >= 0], feature[feature >= 0]
    key = np.unique((row << 32) | feature)
    return key >> 32, key & 0xFFFFFFFF


@dataclass
class Model:
    bias: float
    keep: np.ndarray  # int32 over FEATURES
    weight: np.ndarray
    factor: np.ndarray  # kept features x factors

    def margin(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        out = self.bias + np.bincount(row, self.weight[feature], rows)
        for f in range(self.factor.shape[1]):
            v = self.factor[feature, f]
            out += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, feature = features(data, offsets, self.keep)
        return 1 / (1 + np.exp(-np.clip(self.margin(row, feature, len(offsets) - 1), -40, 40)))


#: G statistics from which a feature (p < 0.001) or one of many millions of pairs (p < 1e-10) counts.
ALONE, TOGETHER = 10.83, 42.0


def tell_alone(labels: np.ndarray, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Features whose 2 x 2 table with the class has a G statistic over the threshold; words in three rows at least."""
    n, positive = len(labels), labels.sum()
    known, place = np.unique(feature, return_inverse=True)
    hit, seen = np.bincount(place, labels[row], len(known)), np.bincount(place, minlength=len(known)).astype(float)
    g = np.zeros(len(known))
    for count, mean in ((hit, seen * positive / n), (seen - hit, seen * (n - positive) / n), (positive - hit, (n - seen) * positive / n), (n - seen - (positive - hit), (n - seen) * (n - positive) / n)):
        g += 2 * np.where(count > 0, count * np.log(np.maximum(count, 1e-9) / np.maximum(mean, 1e-9)), 0)
    g[(seen < 3) & (known < 1 << TERM_BITS)] = 0
    return known[g > ALONE]


def pairs_that_tell(labels: np.ndarray, row: np.ndarray, feature: np.ndarray, support: float = 0.01) -> np.ndarray:
    """Features of pairs whose rows' labels differ from what the two features' single effects, added on the
    logistic scale, lead to expect. Tested are all pairs with `support` of the rows in common and enough of
    them to reach the threshold at all: m rows give at most 2 m log(1 / share of the rarer class)."""
    n, share = len(labels), labels.mean()
    least = max(TOGETHER / (2 * np.log(1 / min(share, 1 - share))), support * n)
    seen = np.bincount(feature, minlength=FEATURES)
    able = np.flatnonzero(seen >= least)
    number = np.full(FEATURES, -1, np.int64)
    number[able] = np.arange(len(able))
    words = -(-n // 64)
    held = np.zeros((len(able), words * 8), np.uint8)  # a bit for each row
    at, bit = number[feature], row[number[feature] >= 0]
    np.bitwise_or.at(held, (at[at >= 0], bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    positive = np.zeros(words * 8, np.uint8)
    hit = np.flatnonzero(labels > 0)
    np.bitwise_or.at(positive, hit >> 3, (1 << (hit & 7)).astype(np.uint8))
    held, positive = held.view(np.uint64), positive.view(np.uint64)
    odds = lambda p: np.log(p / (1 - p))
    effect = odds((np.bitwise_count(held & positive).sum(axis=1, dtype=np.int64) + share) / (seen[able] + 1)) - odds(share)
    tells = np.zeros(len(able), bool)
    for i in range(len(able) - 1):
        both = held[i + 1 :] & held[i]
        m = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        j = np.flatnonzero(m >= least)
        if not len(j):
            continue
        m, o = m[j], np.bitwise_count(both[j] & positive).sum(axis=1, dtype=np.int64)
        e = m / (1 + np.exp(-np.clip(odds(share) + effect[i] + effect[i + 1 + j], -30, 30)))
        g = 2 * (o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)) + (m - o) * np.log(np.maximum(m - o, 1e-9) / np.maximum(m - e, 1e-9)))
        found = j[g > TOGETHER]
        if len(found):
            tells[i] = tells[i + 1 + found] = True
    return able[tells]


def train(labels: np.ndarray, row: np.ndarray, feature: np.ndarray, factors: int = 8, epochs: int = 60, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit by AdaGrad on the logistic loss. Without rows of both classes the score is the prior."""
    n, positive = len(labels), int(labels.sum())
    keep = np.full(FEATURES, -1, np.int64)
    bias = float(np.log((positive + 1) / (n - positive + 1)))
    if not 0 < positive < n:
        return Model(bias, keep, np.zeros(0), np.zeros((0, factors)))
    chosen = np.union1d(tell_alone(labels, row, feature), pairs_that_tell(labels, row, feature))
    keep[chosen] = np.arange(len(chosen))
    row, feature = row[keep[feature] >= 0], keep[feature[keep[feature] >= 0]]
    rng = np.random.default_rng(seed)
    weight, factor = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), factors))
    sum_w, sum_v, sum_b = np.full(len(chosen), 1e-6), np.full(factor.shape, 1e-6), 1e-6
    first = np.searchsorted(row, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            docs = order[lo : lo + 256]
            sizes = first[docs + 1] - first[docs]
            at = np.repeat(first[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            r, x = np.repeat(np.arange(len(docs)), sizes), feature[at]
            v = factor[x]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            both = np.zeros((len(v) + 1, 2 * factors))
            np.cumsum(np.hstack([v, v * v]), axis=0, out=both[1:])
            totals, squares = np.hsplit(np.diff(both[ends], axis=0), 2)
            margin = bias + np.bincount(r, weight[x], len(docs)) + 0.5 * (totals**2 - squares).sum(1)
            error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[docs]
            grad_w = np.bincount(x, error[r], len(chosen)) / len(docs) + decay * weight
            pull = error[r][:, None] * (totals[r] - v)
            grad_v = np.stack([np.bincount(x, pull[:, f], len(chosen)) for f in range(factors)], axis=1) / len(docs) + decay * factor
            grad_b = error.mean()
            sum_w += grad_w**2
            sum_v += grad_v**2
            sum_b += grad_b**2
            weight -= rate * grad_w / np.sqrt(sum_w)
            factor -= 0.2 * rate * grad_v / np.sqrt(sum_v)
            bias -= rate * grad_b / np.sqrt(sum_b)
    return Model(bias, keep, weight, factor)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_view(batch.column(2))
        for lo, hi in row_slices(offsets):
            row, feature = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            packed = [feature[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["doc_id", "label", "features"])


def fit(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, sample: int = 12_000, decay: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most `sample` labelled rows that aren't held out: those with the smallest hash of
    their id. A document that is labelled several times counts with its largest label."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(~held_out(F.col("doc_id"), modulus, rest))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(_featurise, "doc_id long, label int, features binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    parts, truth = [np.frombuffer(r["features"], np.int32) for r in rows], np.array([float(r["label"] > 0) for r in rows])
    row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    feature = np.concatenate([np.zeros(0, np.int32), *parts])
    del rows, parts
    return train(truth, row, feature, decay=decay)


def _score(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        data, offsets = text_view(batch.column(2))
        for lo, hi in row_slices(offsets):
            score = model.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )


def _keep(batches: Iterator[pa.RecordBatch], model, threshold: float, at: int) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        data, offsets = text_view(batch.column(at))
        for lo, hi in row_slices(offsets):
            good = pa.array(model.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) >= threshold)
            yield batch.slice(lo, hi - lo).filter(good)


def keep_rows(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, whose text scores at least `threshold`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: _keep(b, shared, threshold, at), docs.schema)


def scores(docs: DataFrame, model: Model, modulus: int, rest: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Reads nothing but the text (null:
    empty) and the id, which decides held_out only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers and at most as many weights: of fixed size
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), modulus, rest).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lambda b: _score(b, shared, threshold), "doc_id long, held_out boolean, score double, predicted int")
