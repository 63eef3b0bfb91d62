"""Language identification by prediction by partial matching.

Per language, a byte context tree of variable order (0 to 3) with escape probabilities (method C, without
exclusion: a context that was seen N times with D different next bytes codes a byte that it has seen n times
with n / (N + D), and escapes to the next shorter context with D / (N + D); below order 0 all 256 bytes are
alike) gives every byte its code length. Longer contexts that were seen once are cut off the tree. A text's
language is the one whose frozen statistics code all of its bytes in the fewest bits.

Trees are sorted arrays of contexts and of bytes in contexts, so they are as large as what was learnt. A
slice of texts is scored by its distinct four-byte strings: the code length of each is found once a language.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, held_out, row_slices, text_view

MODULUS, REST = 3, 1
ORDER = 3
START = 0x20  # what stands before a text


def contexts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every byte with the ORDER bytes before it as one number (uint32); A-Z count as a-z."""
    low = LOWER[data].astype(np.uint32)
    out, begin = low.copy(), np.repeat(offsets[:-1], np.diff(offsets))
    at = np.arange(len(low)) - begin  # place in the text
    for k in range(1, ORDER + 1):
        before = np.full(len(low), START, np.uint32)
        before[k:] = low[: max(len(low) - k, 0)]
        before[at < k] = START
        out |= before << np.uint32(8 * k)
    return out


class Tree:
    """A language's context tree, from the numbers of `contexts` and how often each was seen."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels = []  # order 0 first: contexts, bits of their escapes; bytes in contexts, their bits
        for order in range(ORDER + 1):
            found, place = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(place, counts, len(found)) if len(found) else np.zeros(0)
            known, place = np.unique(found >> 8, return_inverse=True)
            total, kinds = np.bincount(place, n, len(known)), np.bincount(place, minlength=len(known))
            kept = total > (1 if order > 1 else 0)
            bits = np.log2((total + kinds)[place] / n) if len(n) else n
            inside = kept[place] if len(n) else np.zeros(0, bool)
            self.levels.append((known[kept], np.log2((total + kinds) / kinds)[kept] if len(known) else np.zeros(0), found[inside], bits[inside]))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each number after the others."""
        out, rest = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            known, escape, found, bits = self.levels[order]
            if not len(known):
                continue
            mine = grams[rest] & ((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(found, mine), len(found) - 1)
            seen = found[at] == mine
            out[rest[seen]] += bits[at[seen]]
            rest, mine = rest[~seen], mine[~seen] >> 8
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            out[rest] += np.where(known[at] == mine, escape[at], 0.0)
        out[rest] += 8.0
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_view(batch.column(1))
        langs = np.array(batch.column(0).to_pylist(), object)
        for lo, hi in row_slices(offsets):
            grams, part = contexts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), langs[lo:hi]
            sizes = np.diff(offsets[lo : hi + 1])
            for lang in sorted(set(part)):
                found, n = np.unique(grams[np.repeat(part == lang, sizes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def train(docs: DataFrame, sample_per_lang: int = 1000) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """lang -> (four-byte strings, counts), from about `sample_per_lang` documents of each language
    (chosen by a hash of the id; all of them where there are fewer) that aren't held out."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), MODULUS, REST))
    per_lang = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row per language
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = learn.select("lang", "text", share.alias("share")).join(F.broadcast(per_lang), "lang").where(F.col("share") * F.col("n") < sample_per_lang)
    rows = picked.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return {lang: (x["gram"].to_numpy(np.int64), x["n"].to_numpy(np.float64)) for lang, x in rows.sort_values(["lang", "gram"]).groupby("lang")}


#: The last model's trees, kept between the batches of a Python worker.
_trees: dict[str, tuple[list[str], list[Tree]]] = {}


def score_texts(trees: list[Tree], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the tree with the fewest bits, and its share when each tree counts as 2 to the power of minus
    its mean bits a byte. Sums run over a text's own bytes, so they don't depend on its neighbours."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    bits = np.zeros((len(trees), len(sizes)))
    if len(full):
        grams, place = np.unique(contexts(data, offsets), return_inverse=True)
        grams = grams.astype(np.int64)
        for k, tree in enumerate(trees):
            bits[k, full] = np.add.reduceat(tree.bits(grams)[place], offsets[:-1][full])
    mean = bits / np.maximum(sizes, 1)
    return bits.argmin(0), 1 / np.exp2(mean.min(0) - mean).sum(0)


def _predict(batches: Iterator[pa.RecordBatch], stats, key: str) -> Iterator[pa.RecordBatch]:
    if key not in _trees:
        _trees.clear()
        _trees[key] = list(stats.value), [Tree(*v) for v in stats.value.values()]
    langs, trees = _trees[key]
    names = np.array([*langs, "und"], object)
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    for batch in batches:
        data, offsets = text_view(batch.column(2))
        for lo, hi in row_slices(offsets):
            part, cut = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            best, score = score_texts(trees, part, cut) if langs else (np.zeros(hi - lo, int), np.zeros(hi - lo))
            total = np.zeros(len(part) + 1, np.int64)
            np.cumsum(letter[part], dtype=np.int64, out=total[1:])
            for i in np.flatnonzero(np.diff(total[cut]) == 0):  # no ASCII letter: look for others
                if not langs or not any(map(str.isalpha, part[cut[i] : cut[i + 1]].tobytes().decode("utf-8", "replace").replace("\ufffd", ""))):
                    best[i], score[i] = len(langs), 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"]
            )


def identify(docs: DataFrame, sample_per_lang: int = 1000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (share of the best language among all,
    by the geometric mean of its bytes' probabilities).

    Null texts and texts without letters are `und` with score 0; without any language to learn from all
    are. Ties go to the first language in alphabetical order. Repeated rows are predicted each; an empty
    table gives no rows. lang is read in training only.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    stats = docs.sparkSession.sparkContext.broadcast(train(source, sample_per_lang))  # statistics of a bounded sample
    key = uuid.uuid4().hex
    return source.select("doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "text").mapInArrow(
        lambda b: _predict(b, stats, key), "doc_id long, held_out boolean, lang_pred string, score double"
    )
