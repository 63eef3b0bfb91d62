"""Spelling variants: words that differ by one edit, found by two-dimensional range reporting.

Words of one length are points: their place in forward order and their place in the order of the reversed words. A word that has another
character at position i lies, forwards, in the interval of the prefix before i and, backwards, in that of the suffix after i; one with a character
more does so among the words that are one longer. A wavelet tree over the points reports the intersection, and only what lies in it.

A vocabulary of any size: words that differ at a position in [lo, hi) share all before lo and after hi, so each word goes to a group for each such range
of positions, at first two halves, and asks in a group for the positions of its range only. Groups of more than `GROUP` rows are split by halving
the range again; groups of one position hold no more words than the alphabet allows. So every pair is found once, at one position, and no group
grows with the vocabulary.

Null texts have no words; a null doc_id counts as an empty one. Equal rows count each. Very long texts are read in parts of whole words, and very long
words are compared whole. Columns other than doc_id and text are left aside. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

LEAST_LENGTH, LEAST_COUNT, FACTOR, DAMAGE = 6, 5, 5, 199
#: Rows of one group at most, but for groups of a single position.
GROUP = 50_000
#: Rows that one pair of orders and its wavelet trees hold; a group more at most.
CHUNK = 200_000
#: Different words that a task counts before it passes them on.
HELD = 200_000
_RUN = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")  # a damaged run only gets shorter
_LAST = "Ā"  # sorts after all characters of words


def _runs(text: bytes) -> Iterator[list[str]]:
    """The lower-cased runs of a text that can give words, some at a time."""
    plain = text.lower().decode()  # of bytes, so A to Z only
    if len(plain) < 1 << 20:
        yield _RUN.findall(plain)
    else:
        found = (m.group() for m in _RUN.finditer(plain))
        while part := list(islice(found, 1 << 16)):
            yield part


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if text.is_valid:
                head = f"{doc}:".encode()
                for runs in _runs(text.as_py()):
                    for run, n in Counter(runs).items():
                        h = zlib.crc32(head + run.encode())
                        if h % DAMAGE == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                            if len(run) < LEAST_LENGTH:
                                continue
                        total[run] += n
                if len(total) > HELD:
                    yield out()
                    total.clear()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of docs (doc_id, text), some damaged as their document and themselves decide, that are frequent enough."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}")


class Wavelet:
    """A sequence of different numbers below its length, as bits from the highest on, each level parted by its bit."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in range(max(len(values) - 1, 1).bit_length() - 1, -1, -1):
            ones = (values >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - ones)])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def report(self, x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and value of every value in [y1, y2) at a place in [x1, x2), for all queries at once."""
        query = np.flatnonzero((x1 < x2) & (y1 < y2))
        lo, hi, value = x1[query], x2[query], np.zeros(len(query), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            query, value = np.concatenate([query, query]), np.concatenate([value, value + (1 << bit)])
            lo, hi = np.concatenate([a, zeros[-1] + lo - a]), np.concatenate([b, zeros[-1] + hi - b])
            keep = (lo < hi) & (value < y2[query]) & (value + (1 << bit) > y1[query])
            query, value, lo, hi = query[keep], value[keep], lo[keep], hi[keep]
        return query, value


class Points:
    """The words of one length: forward order, reverse order, and the wavelet tree between the two."""

    def __init__(self, words: list[str]):
        self.forward = sorted(words)
        turned = sorted((w[::-1], k) for k, w in enumerate(self.forward))
        self.reverse, self.word = [t for t, _ in turned], np.array([k for _, k in turned], np.int64)
        place = np.empty(len(words), np.int64)
        place[self.word] = np.arange(len(words))
        self.tree = Wavelet(place)


def _asked(rows: list[tuple[str, int, int]], points: Points, longer: bool) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Row, position and intervals of all questions that rows (word, lo, hi) put to `points`, of their own length or one more."""
    row, at, ranges = [], [], []
    forward, reverse = points.forward, points.reverse
    for k, (word, lo, hi) in enumerate(rows):
        turned, n = word[::-1], len(word)
        for i in range(lo, hi + (longer and hi == n)):
            head, tail = word[:i], turned[: n - i - (not longer)]
            x1 = bisect_left(forward, head)
            x2 = bisect_left(forward, head + _LAST, x1)
            if x2 - x1 > (not longer):  # among its own length a word finds itself
                y1 = bisect_left(reverse, tail)
                y2 = bisect_left(reverse, tail + _LAST, y1)
                if y2 - y1 > (not longer):
                    row.append(k)
                    at.append(i)
                    ranges.append((x1, x2, y1, y2))
    return row, at, ranges


def _pairs(words: list[str], lengths: list[int], lows: list[int], highs: list[int]) -> Iterator[tuple[str, list[str]]]:
    """word, near words found here, for rows of groups; each pair comes once each way over all tasks."""
    of: dict[int, set[str]] = {}
    asking: dict[int, list[tuple[str, int, int]]] = {}
    for word, length, lo, hi in zip(words, lengths, lows, highs):
        of.setdefault(len(word), set()).add(word)
        if len(word) == length:
            asking.setdefault(length, []).append((word, lo, hi))
    points = {n: Points(list(ws)) for n, ws in of.items()}
    near: dict[str, list[str]] = {}
    for length, rows in asking.items():
        for longer in (False, True):
            other = points.get(length + longer)
            if other is None:
                continue
            row, at, ranges = _asked(rows, other, longer)
            if not row:
                continue
            query, value = other.tree.report(*np.array(ranges, np.int64).T)
            for q, k in zip(query.tolist(), other.word[value].tolist()):
                word, i, found = rows[row[q]][0], at[q], other.forward[k]
                if longer:
                    if i == 0 or found[i] != word[i - 1]:  # of a run, the first place that it can be put at
                        near.setdefault(word, []).append(found)
                        near.setdefault(found, []).append(word)
                elif found != word:
                    near.setdefault(word, []).append(found)
    yield from near.items()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, word, n, length, lo, hi) in order of g: word, number of near words, the best of them and its n."""

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        count = Counter(r[0] for r in rows)
        rows = [r for r in rows if count[r[0]] > 1]
        if rows:
            n = {r[1]: r[2] for r in rows}
            found = [(w, len(ws), *min((-n[x], x) for x in ws)) for w, ws in _pairs(*([r[k] for r in rows] for k in (1, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "less", "form"])

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("g", "word", "n", "length", "lo", "hi")))
        if len(held) >= CHUNK:
            last = held[-1][0]
            done = [r for r in held if r[0] != last]
            yield from out(done)
            held = [r for r in held if r[0] == last]
    yield from out(held)


def _key(length: Column, lo: Column, hi: Column) -> Column:
    """The group of the words that share all before lo and all behind hi, at the given length or one longer."""
    return F.xxhash64(length, lo, hi, F.expr("left(word, lo)"), F.expr("right(word, length - hi)"))


def _halved(rows: DataFrame) -> DataFrame:
    """Rows (word, n, length, lo, hi) with each range in two, and their group."""
    middle = F.expr("(lo + hi) div 2").cast("int")
    parts = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
    two = rows.select("word", "n", "length", F.explode(parts).alias("p")).select("word", "n", "length", "p.lo", "p.hi").where("lo < hi")
    return two.withColumn("g", _key(F.col("length"), F.col("lo"), F.col("hi")))


def groups(words: DataFrame) -> DataFrame:
    """g, word, n, length, lo, hi: every word in the groups of its own length and of those one shorter."""
    size = F.length("word")
    own = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length")).where(f"length >= {LEAST_LENGTH}")
    rows, done = stage(_halved(own.select("word", "n", "length", F.lit(0).alias("lo"), F.col("length").alias("hi"))), "spelling-groups"), None
    while True:
        large = rows.where("hi - lo > 1").groupBy("g").agg(F.count(F.lit(1)).alias("rows")).where(f"rows > {GROUP}").select("g")
        if not large.head(1):
            return rows if done is None else done.unionByName(rows)
        large = stage(large, "spelling-large")
        fine = rows.join(large, "g", "left_anti").select(rows.columns)
        done = fine if done is None else done.unionByName(fine)
        rows = stage(_halved(rows.join(large, "g", "left_semi").select("word", "n", "length", "lo", "hi")), "spelling-groups")


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n): a word's form is its near word of largest n (ties: smallest) if that is
    FACTOR times as frequent; the root is where following forms ends."""
    words = stage(words.select("word", "n"), "spelling-words")
    rows = groups(words).select("g", "word", "n", "length", "lo", "hi").repartition("g").sortWithinPartitions("g")
    found = rows.mapInArrow(_near, "word string, n_near long, less long, form string")
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("less"), F.lit(None).cast("string").alias("form")).unionByName(found.withColumn("n", F.lit(None).cast("long")))
    best = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.when(F.col("form").isNotNull(), F.struct("less", "form"))).alias("b"))
    strong = -F.col("b.less") >= FACTOR * F.col("n")
    best = stage(best.select("word", "n", "n_near", F.when(strong, F.col("b.form")).alias("form"), F.when(strong, -F.col("b.less")).alias("form_n")), "spelling-forms")
    steps = best.where("form is not null").select("word", F.col("form").alias("to"))
    # counts grow by FACTOR with each step, so there are few
    most = best.agg(F.max("n")).first()[0] or 0
    chain = int(math.log(max(most, 1), FACTOR))
    for _ in range(max(chain - 1, 0).bit_length()):
        steps = stage(steps.alias("a").join(steps.alias("b"), F.col("a.to") == F.col("b.word"), "left").select("a.word", F.coalesce("b.to", "a.to").alias("to")), "spelling-roots")
    return best.join(steps, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def spelling(docs: DataFrame) -> DataFrame:
    """The variants among the words of docs (doc_id, text)."""
    return variants(vocabulary(docs))
