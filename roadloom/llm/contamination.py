"""Benchmark decontamination by suffix arrays of the documents.

Documents are cut into shards of whole texts. Words become 64-bit hashes; the shard's suffixes are sorted word by word, by doubling ranks,
together with the benchmark's, and never read past their document's end. Every benchmark suffix is then looked up in the shard's
suffix array by binary search, which gives all places that share its first ten words (or a shorter item's whole text), and from
there the longest verbatim match. A document is contaminated if it has any such place.

A benchmark is sent to tasks in blocks of about `BLOCK_WORDS` words, counted before; each block is a pass over all documents, so a
larger benchmark costs more passes and no more memory. Items longer than `PIECE_WORDS` words go in pieces that overlap by nine words.

Null texts have no words and match nothing, as do empty ones. A null item_id has an empty name. Repeated rows and ids each count as rows of
their own; an item that is there twice is one item. Very long texts make a shard of their own. Other columns, whatever their names, are left
aside by `matches` and kept by `clean`. Without documents or items nothing matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fmix, fresh, powers, prefix_hash, row_slices, stage, text_view

WINDOW = 10
#: Words of the benchmark that tasks hold at a time.
BLOCK_WORDS = 1_000_000
#: Longest piece of an item.
PIECE_WORDS = 4_096
#: Bytes of text in a shard, if it isn't a single text.
SHARD_BYTES = 4 << 20
#: Matches that are measured at a time.
PAIRS = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = True
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows of text, and each row's first word (one more than rows)."""
    data = LOWER[data]
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.diff(offsets) > 0
    begins, ends = offsets[:-1][filled], offsets[1:][filled] - 1
    first[begins], last[ends] = inside[begins], inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = prefix_hash(data)
    return fmix((h[stops] - h[starts]) * powers(len(data))[1][starts]) if len(starts) else np.zeros(0, np.uint64), np.searchsorted(starts, offsets)


class Items:
    """A block of the benchmark: its words, pieces and windows."""

    def __init__(self, rows: list[tuple[str, int, str]]):
        """rows: the item's name, the piece's first word, the piece's words with spaces between."""
        texts = [r[2].encode() for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.words, first = word_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
        self.names = sorted({r[0] for r in rows})
        place = {name: k for k, name in enumerate(self.names)}
        size = np.diff(first)
        self.item = np.repeat(np.array([place[r[0]] for r in rows], np.int64), size)
        self.at = np.arange(len(self.words)) - np.repeat(first[:-1], size) + np.repeat(np.array([r[1] for r in rows], np.int64), size)
        self.end = np.repeat(first[1:], size)
        whole = np.repeat(np.minimum(size, WINDOW), size)
        #: By number of words, the positions of the windows with so many.
        self.windows = {int(k): np.flatnonzero((whole == k) & (np.arange(len(self.words)) + k <= self.end)) for k in np.unique(whole)}


class Shard:
    """The suffix array of some documents' words, ranked together with a block of the benchmark."""

    def __init__(self, words: np.ndarray, first: np.ndarray, items: Items):
        self.n, self.items = len(words), items
        both = np.concatenate([words, items.words])
        self.end = np.concatenate([np.repeat(first[1:], np.diff(first)), self.n + items.end])
        self.index = np.arange(len(both))
        self.ranks = {1: np.unique(both, return_inverse=True)[1]}
        deepest = max([WINDOW, *items.windows])
        for depth in range(2, deepest + 1):
            if depth in items.windows or depth in (2, 4, 8):
                half = 1 << (depth - 1).bit_length() - 1
                self.ranks[depth] = self._deeper(half, depth - half)
        self.order = np.argsort(self.ranks[max(self.ranks)][: self.n], kind="stable")

    def _deeper(self, a: int, b: int) -> np.ndarray:
        """Ranks by a + b words; what ends before comes first."""
        if b not in self.ranks:
            half = 1 << (b - 1).bit_length() - 1
            self.ranks[b] = self._deeper(half, b - half)
        there = np.flatnonzero(self.index + a < self.end)
        rest = np.zeros(len(self.index), np.int64)
        rest[there] = self.ranks[b][there + a] + 1
        return np.unique(self.ranks[a] * (len(self.index) + 2) + rest, return_inverse=True)[1]

    def places(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """size, windows' positions in the block, and the range of the suffix array that begins with each, by binary search."""
        for size, windows in self.items.windows.items():
            ranks = self.ranks[size]
            ordered = ranks[self.order]  # rises: the suffix array is sorted by more words
            wanted = ranks[self.n + windows]
            lo, hi = np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")
            found = hi > lo
            yield size, windows[found], lo[found], hi[found]

    def hits(self) -> np.ndarray:
        """Which words lie in a place that a window occurs at."""
        change = np.zeros(self.n + 1, np.int64)
        for size, _, lo, hi in self.places():
            lo, hi = np.unique(lo), np.unique(hi)  # equal windows have equal ranges
            at = self.order[_ranges(lo, hi - lo)]
            change[at] += 1
            np.subtract.at(change, at + size, 1)
        return np.cumsum(change[:-1]) > 0

    def longest(self, row: np.ndarray) -> np.ndarray:
        """row, item, start, item_start, words: the longest match of each item in each document (ties: the first), sorted."""
        best = np.zeros((0, 5), np.int64)
        for size, windows, lo, hi in self.places():
            ends = np.cumsum(hi - lo)
            done = 0
            while done < len(windows):
                stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
                for part in range(lo[done], hi[done], PAIRS) if stop == done + 1 else [None]:
                    a, b = (lo[done:stop], hi[done:stop]) if part is None else (np.array([part]), np.array([min(part + PAIRS, hi[done])]))
                    here, there = self.order[_ranges(a, b - a)], np.repeat(windows[done:stop], b - a)
                    found = np.column_stack([row[here], self.items.item[there], here, self.items.at[there], self._common(here, self.n + there, size)])
                    best = _best(np.concatenate([best, found]))
                done = stop
        return best

    def _common(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """How many words two suffixes share that share `size`."""
        length, going = np.full(len(a), size), np.arange(len(a))
        words = self.ranks[1]
        while len(going):
            x, y = a[going] + length[going], b[going] + length[going]
            going, x, y = (z[(x < self.end[a[going]]) & (y < self.end[b[going]])] for z in (going, x, y))
            going = going[words[x] == words[y]]
            length[going] += 1
        return length


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum())) if len(start) else np.zeros(0, np.int64)


def _best(found: np.ndarray) -> np.ndarray:
    order = np.lexsort((found[:, 3], found[:, 2], -found[:, 4], found[:, 1], found[:, 0]))
    found = found[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])
    return found[keep]


def _pieces(benchmark: DataFrame) -> DataFrame:
    """name, start, text, words: the items' words, in pieces."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(_PATTERN), F.lit(0))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), words.alias("w")).where("size(w) > 0")
    cut = rows.select("name", "w", F.explode(F.expr(f"sequence(0, size(w) - 1, {PIECE_WORDS})")).alias("start"))
    cut = cut.where(f"start = 0 or size(w) - start >= {WINDOW}")
    piece = F.slice("w", F.col("start") + 1, PIECE_WORDS + WINDOW - 1)
    return cut.select("name", F.col("start").cast("long").alias("start"), F.array_join(piece, " ").alias("text"), F.size(piece).alias("words"))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, int, str]]]:
    """The benchmark's pieces, about BLOCK_WORDS words at a time."""
    pieces = _pieces(benchmark)
    total = pieces.agg(F.sum("words")).first()[0] or 0
    if total > BLOCK_WORDS:
        pieces = stage(pieces, "benchmark")
    blocks = math.ceil(total / BLOCK_WORDS)
    for k in range(blocks):
        yield [tuple(r) for r in pieces.where(F.pmod(F.xxhash64("name", "start"), F.lit(blocks)) == k).select("name", "start", "text").collect()]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SHARD_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())]))
_MATCHES = "n_words long, spans array<struct<start: long, end: long>>, found array<struct<item_id: string, start: long, item_start: long, words: long>>"


def _searched(texts: pa.ChunkedArray, items: Items) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Shard]]:
    """For slices of rows: first and last row, the rows' first words, which words are hit, and the shard."""
    data, offsets = text_view(texts)
    for lo, hi in row_slices(offsets, SHARD_BYTES):
        part = offsets[lo : hi + 1]
        words, first = word_hashes(data[part[0] : part[-1]], part - part[0])
        shard = Shard(words, first, items)
        yield lo, hi, first, shard.hits(), shard


def _one_pass(docs: DataFrame, rows: list[tuple[str, int, str]], text: str) -> DataFrame:
    """`docs` with n_words, spans and found in place of its text, for one block of the benchmark."""
    keep = [c for c in docs.columns if c != text]
    block = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block.value)
        for table in _shards(batches):
            counts, spans, found = [], [], []
            for lo, hi, first, hit, shard in _searched(table.column(text), items):
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                longest = shard.longest(row) if hit.any() else np.zeros((0, 5), np.int64)
                edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                # a span ends with its document
                edge = np.zeros(len(hit) + 1, bool)
                edge[first[1:-1]] = True
                starts = np.flatnonzero((edges == 1) | (edge & np.concatenate([hit, [False]])))
                ends = np.flatnonzero((edges == -1) | (edge & np.concatenate([[False], hit])))
                of = row[starts] if len(starts) else starts
                spans += _lists(hi - lo, of, [{"start": int(s), "end": int(e)} for s, e in zip(starts - first[of], ends - first[of])])
                found += _lists(hi - lo, longest[:, 0], [{"item_id": items.names[i], "start": int(s - first[r]), "item_start": int(t), "words": int(n)} for r, i, s, t, n in longest.tolist()])
                counts += np.diff(first).tolist()
            columns = [table.column(c).combine_chunks() if table.num_rows else table.column(c) for c in keep]
            yield from pa.Table.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(found, _FOUND)], [*keep, "n_words", "spans", "found"]).to_batches()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), _MATCHES])
    return docs.mapInArrow(run, schema)


def _lists(n: int, of: np.ndarray, values: list[dict]) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    for k, v in zip(of.tolist(), values):
        out[k].append(v)
    return out


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (maximal runs of hit words, from and to), found (for each item that occurs, its longest verbatim match: where
    in the document, where in the item, how many words) of every row of docs (doc_id, text)."""
    docs, blocks = docs.select("doc_id", F.col("text").cast("string").alias("text")), _blocks(benchmark)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return _one_pass(docs, first, "text")
    docs = stage(docs.withColumn("row", F.monotonically_increasing_id()), "documents")
    passes = [stage(_one_pass(docs, rows, "text"), "matches") for rows in (first, second, *blocks)]
    out = passes[0]
    for p in passes[1:]:
        out = out.union(p)
    rows = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("found")).alias("found"))
    merged = """aggregate(spans, cast(array() as array<struct<start: bigint, end: bigint>>), (acc, x) -> if(size(acc) > 0 and x.start <= acc[size(acc) - 1].end,
        concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start, 'end', greatest(acc[size(acc) - 1].end, x.end)))), concat(acc, array(x))))"""
    best = "filter(found, x -> not exists(found, y -> y.item_id = x.item_id and (y.words > x.words or y.words = x.words and (y.start < x.start or y.start = x.start and y.item_start < x.item_start))))"
    return rows.select("doc_id", "n_words", F.expr(merged).alias("spans"), F.array_sort(F.array_distinct(F.expr(best))).alias("found"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, in which no window of the benchmark occurs."""
    for rows in _blocks(benchmark):
        block = docs.sparkSession.sparkContext.broadcast(rows)
        (name,) = fresh(docs, "plain_text")

        def run(batches: Iterator[pa.RecordBatch], block=block, name=name) -> Iterator[pa.RecordBatch]:
            items = Items(block.value)
            for table in _shards(batches):
                keep = np.ones(table.num_rows, bool)
                for lo, hi, first, hit, _ in _searched(table.column(name), items):
                    total = np.concatenate([[0], np.cumsum(hit)])
                    keep[lo:hi] = total[first[1:]] == total[first[:-1]]
                yield from table.filter(pa.array(keep)).drop_columns([name]).to_batches()

        docs = stage(docs.withColumn(name, F.col(text).cast("string")).mapInArrow(run, docs.schema), "clean")
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"])))
    out = matches(docs, benchmark).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)")).withColumn("names", names)
    return out.select("doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
