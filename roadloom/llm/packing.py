"""Best-fit packing of documents into sequences under several capacities.

A piece has a demand vector: tokens, documents (1) and attention cost (length squared). Pieces of the
same length have the same vector, so the packing is decided on the histogram of lengths, which has at
most `capacity` entries whatever the size of the corpus: lengths in descending order, each going to the
group of equally filled sequences whose remaining capacities fit best (by weighted residual norm or dot
product, under every constraint). The plan says, for each length, which ranks among the pieces of that
length go to which sequence; pieces find their rank from their task's counter and a prefix sum over tasks.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Tokens, WordTable, word_blocks
from .common import stage

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, lrank long"
_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("chunk", pa.int64()), ("lrank", pa.int64())])
_PACKED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold. With the defaults for documents and attention only tokens bind."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    rule: str = "residual"  # or "dot"
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def plan(histogram: dict[int, int], capacity: Capacity) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, first sequence, pieces per sequence, offset)."""
    cap = capacity.vector()
    scale = np.array(capacity.weights) / cap**2
    left = np.zeros((64, 3), np.int64)  # what each group of equally filled sequences has left
    first, count, used, ids = np.zeros(64, np.int64), np.zeros(64, np.int64), 0, 0
    rows = []

    def add(rest, start, n):
        nonlocal left, first, count, used
        if used == len(first):
            left, first, count = np.concatenate([left, left * 0]), np.concatenate([first, first * 0]), np.concatenate([count, count * 0])
        left[used], first[used], count[used] = rest, start, n
        used += 1

    for length in sorted(histogram, reverse=True):
        need, rank, todo = np.array([length, 1, length * length], np.int64), 0, int(histogram[length])
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")

        def put(rest, start, n):
            """Fill `n` sequences from `start` on that have `rest` left; the number of them used."""
            nonlocal rank, todo
            each = int((rest // need).min())
            full = min(n, todo // each)
            offset = capacity.tokens - int(rest[0])
            if full:
                rows.append((length, rank, rank + full * each, start, each, offset))
                rank, todo = rank + full * each, todo - full * each
                add(rest - each * need, start, full)
            if full < n and todo:
                some = todo
                rows.append((length, rank, rank + some, start + full, some, offset))
                rank, todo = rank + some, 0
                add(rest - some * need, start + full, 1)
                full += 1
            return full

        while todo:
            fits = np.flatnonzero((count[:used] > 0) & (left[:used] >= need).all(axis=1))
            if not len(fits):
                each = int((cap // need).min())
                n = -(-todo // each)
                put(cap, ids, n)
                ids += n
                continue
            if capacity.rule == "dot":
                score = -(left[fits] * need * scale).sum(axis=1)
            else:
                rest = (left[fits] - need).astype(float)
                score = (rest * rest * scale).sum(axis=1)
            best = int(fits[np.argmin(score)])
            rest, start, n = left[best].copy(), int(first[best]), int(count[best])
            taken = put(rest, start, n)
            first[best], count[best] = start + taken, n - taken
        live = np.flatnonzero(count[:used] > 0)  # forget groups that nothing is left of
        if len(live) < used // 2:
            left[: len(live)], first[: len(live)], count[: len(live)] = left[live], first[live], count[live]
            used = len(live)
            count[used:] = 0
    return np.array(rows, np.int64).reshape(-1, 6)


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, most: int) -> Iterator[pa.RecordBatch]:
    assert sys.byteorder == "little"
    tokens = Tokens.of(path, "byte")
    table = WordTable({}, lambda w: array("I", tokens.single(w.encode())).tobytes())
    chunk, ranks, rows = TaskContext.get().partitionId(), Counter(), []
    end = bytes(4)

    def out(part):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = bytearray()
            for at, part in enumerate(tokens.parts(text.as_py() or "")):
                if at % 2:
                    ids += np.array([tokens.special[part]], "<u4").tobytes()
                else:
                    for block in word_blocks(part, "byte"):
                        ids += b"".join(map(table.__getitem__, block))
            ids += end
            n = len(ids) // 4
            length, start, piece = n % most or most, 0, 0
            view = memoryview(ids)
            while start < n:
                rows.append((doc_id, piece, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), chunk, ranks[length]))
                ranks[length] += 1
                start, piece, length = start + length, piece + 1, most
        for lo in range(0, len(rows), 8192):
            yield out(rows[lo : lo + 8192])
        rows = []


def _place(batches: Iterator[pa.RecordBatch], rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = (rows[:, 0] << 46) + rows[:, 1]
    for batch in batches:
        length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
        at = np.searchsorted(keys, (length << 46) + rank, side="right") - 1
        inside = rank - rows[at, 1]
        sequence, offset = rows[at, 3] + inside // rows[at, 4], rows[at, 5] + inside % rows[at, 4] * length
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], schema=_PACKED_SCHEMA)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: Capacity = Capacity()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and a closing 0, so null and empty texts are one token long. Only
    documents over the capacity are cut: the first piece is what remains of whole pieces. Repeated
    rows are packed each; an empty table gives no rows. Other columns of `docs` are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stage(source.mapInArrow(lambda b: _tokenise(b, path, capacity.tokens), _PIECES), "pieces")
    counts = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length, at most
    rows = plan(histogram, capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("length", "chunk", before.alias("before")), ["length", "chunk"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("lrank")).alias("rank")).mapInArrow(
        lambda b: _place(b, rows), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
