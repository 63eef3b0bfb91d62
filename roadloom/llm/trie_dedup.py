"""Exact dedup with Patricia-trie owners.

Plan
  1. Each input task folds its texts into a compressed radix trie, so that a text with any number
     of copies leaves the task once (`rep`), with the largest id and the number of copies.
  2. The reps move to owner partitions by (length, content hash). An owner inserts the full byte
     strings into a trie, one hash subtree at a time: rows arrive sorted by subtree through Spark's
     external sort, which spills, so an owner holds one subtree in memory and never the partition.
  3. Documents look up their rep's verdict by a join on the rep number; copies of one text are dealt
     over as many keys as there are input tasks, so a hot text has no hot key.
Texts are compared byte by byte on the trie's edges; the hash only deals them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fresh, row_slices, stage, text_view

#: Bytes of distinct text that an input task's trie holds before it is emptied.
TASK_TRIE_BYTES = 48 << 20
#: Subtrees (by hash) that an owner partition is worked through in.
SUBTREES = 64


class Node:
    __slots__ = ("edges", "value")

    def __init__(self):
        self.edges = {}
        self.value = None


class PatriciaTrie:
    """Compressed radix trie over byte strings. `find(key)` returns the terminal node of `key`."""

    def __init__(self):
        self.root = Node()
        self.bytes = 0

    def find(self, key: bytes) -> Node:
        node, at, size = self.root, 0, len(key)
        while at < size:
            edge = node.edges.get(key[at])
            if edge is None:
                leaf = Node()
                node.edges[key[at]] = [key[at:], leaf]
                self.bytes += size - at
                return leaf
            label, child = edge
            if key.startswith(label, at):
                at += len(label)
                node = child
                continue
            lo, hi = 1, min(len(label), size - at)  # label and key agree on the first byte
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if label[:mid] == key[at : at + mid]:
                    lo = mid
                else:
                    hi = mid - 1
            fork = Node()
            fork.edges[label[lo]] = [label[lo:], child]
            edge[0], edge[1] = label[:lo], fork
            node, at = fork, at + lo
        return node


_FOLDED = "kind int, doc_id long, rep long, top boolean, len long, h long, sub int, body binary, n long"
_OWNED = "rep long, keep_rep long, keep_id long, group_size long, text_sha256 string"


def _below(a, b) -> bool:
    """Order of ids with null lowest."""
    return b is not None and (a is None or a < b)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FOLDED.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
    next_rep = TaskContext.get().partitionId() << 40

    def out(trie_docs, groups):
        # group: [rep, key, largest id, copies, index of the row with the largest id]
        top = {g[4] for g in groups}
        step = 4096
        for lo in range(0, len(trie_docs), step):
            part = trie_docs[lo : lo + step]
            k = len(part)
            cols = [[0] * k, [x[0] for x in part], [x[1] for x in part], [lo + i in top for i in range(k)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)] + [pa.nulls(k, t) for t in types[4:]], names=names)
        for lo in range(0, len(groups), 256):
            part = groups[lo : lo + 256]
            hashes = [xxhash.xxh3_64_intdigest(g[1]) for g in part]
            cols = [[1] * len(part), [g[2] for g in part], [g[0] for g in part], [None] * len(part), [len(g[1]) for g in part], [h - (1 << 63) for h in hashes], [(h >> 20) % SUBTREES for h in hashes], [g[1] for g in part], [g[3] for g in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    trie, docs, groups = PatriciaTrie(), [], []
    for batch in batches:
        raw, offsets = text_view(batch.column(1))
        ids = batch.column(0).to_pylist()
        for lo, hi in row_slices(offsets, 4 << 20):
            base = int(offsets[lo])
            low = LOWER[raw[base : offsets[hi]]].tobytes()
            for i in range(lo, hi):
                key = low[offsets[i] - base : offsets[i + 1] - base]
                node = trie.find(key)
                group = node.value
                if group is None:
                    group = node.value = [next_rep, key, ids[i], 0, len(docs)]
                    groups.append(group)
                    next_rep += 1
                elif _below(group[2], ids[i]):
                    group[2], group[4] = ids[i], len(docs)
                group[3] += 1
                docs.append((ids[i], group[0]))
            if trie.bytes > TASK_TRIE_BYTES:
                yield from out(docs, groups)
                trie, docs, groups = PatriciaTrie(), [], []
    yield from out(docs, groups)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rep", pa.int64()), ("keep_rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])

    def out(groups):
        rows = [(rep, g[0], g[1], g[2], g[3]) for g in groups for rep in g[4]]
        for lo in range(0, len(rows), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 8192]), schema)], schema=schema)

    trie, groups, current = PatriciaTrie(), [], None
    for batch in batches:
        for i in range(batch.num_rows):
            rep, largest, sub, n = (batch.column(k)[i].as_py() for k in (0, 1, 2, 4))
            if sub != current:  # the next subtree: the last one is complete
                yield from out(groups)
                trie, groups, current = PatriciaTrie(), [], sub
            key = batch.column(3)[i].as_py()
            node = trie.find(key)
            group = node.value
            if group is None:
                group = node.value = [rep, largest, 0, hashlib.sha256(key).hexdigest(), []]
                groups.append(group)
            elif _below(group[1], largest) or (group[1] == largest and rep < group[0]):
                group[0], group[1] = rep, largest
            group[2] += n
            group[4].append(rep)
    yield from out(groups)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, so null and
    empty texts form one group. Of a group the row with the largest id stays; a null id is the
    lowest, and of rows that repeat the largest id exactly one stays. An empty table gives no rows.
    Other columns of `docs` are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    folded = stage(source.mapInArrow(_fold, _FOLDED), "trie")
    owned = (
        folded.where("kind = 1")
        .select("rep", "doc_id", "sub", "body", "n", "len", "h")
        .repartition("len", "h")
        .sortWithinPartitions("sub")
        .select("rep", "doc_id", "sub", "body", "n")
        .mapInArrow(_own, _OWNED)
    )
    members = folded.where("kind = 0").select("doc_id", "rep", "top")
    return members.join(owned, "rep").select("doc_id", "keep_id", "group_size", (F.col("top") & (F.col("rep") == F.col("keep_rep"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, with all columns, without the rows that `exact_dedup` drops; a row that repeats another
    one's id and text is left out too. Null counts as an empty text; a null id is the lowest. An empty table
    gives an empty one. Columns of `docs` may have any names."""
    of, by = fresh(docs, "of", "by")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))  # noqa: E731  plain equality, so that rows are dealt out once
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("text_sha256").alias(of), name(F.col("doc_id")).alias(by))
    upper = "".join(map(chr, range(65, 91)))
    folded = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), upper, upper.lower())
    marked = docs.withColumn(of, F.sha2(folded, 256)).withColumn(by, name(F.col(id_col).cast("long")))
    return marked.join(kept, [of, by], "left_semi").dropDuplicates([of, by]).select(*docs.columns)
