"""Near-duplicate detection with fast similarity sketches, banding and exact verification.

Plan
  1. One pass over the texts gives each document's set of hashed five-word shingles, an order-free
     128-bit hash of the set, and its sketch: in round i every shingle falls into a hashed bin with a
     hashed value that starts with i; rounds t to 2t-1 fill bin i-t, so every coordinate is filled, and
     rounds end as soon as all are. Equal sets become one class; only classes go on.
  2. Bands of four coordinates form buckets. Of each bucket every class is paired with one centre, the class
     that shares most places in buckets with others; of a class's centres the one whose sketch agrees most, in
     96 of 160 coordinates at least, is verified on the full sets.
  3. Buckets that still hold several components of these links are looked at again: tasks compare the sketches
     across components, and name the classes that may have a link to another component, and a spanning
     forest of the components that may be linked. Nothing is emitted by pairs.
  4. The named classes of components that hang together in that forest meet with their full sets, block by
     block, in an inverted index from shingles to classes; each task keeps the links that join components
     which it hasn't joined yet. So components are those of all links between classes that share a bucket.
With 40 bands of 4 a pair at the threshold shares no bucket with probability (1 - 0.75^4)^40 < 3e-7,
and its sketches agree in less than 96 of 160 coordinates with probability < 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import Bitmap, bits_for, collect_bitmap
from .common import LOWER, fmix, fresh, row_slices, stage, text_view, words_of
from .components import components

BANDS, ROWS_PER_BAND = 40, 4
COORDINATES = BANDS * ROWS_PER_BAND
SHINGLE_WORDS = 5
#: Classes of a bucket that one task compares with each other, or with as many of another block.
BLOCK = 2000
#: Shingles of the classes in a block (with CLASS_COST more for each class) that one task holds in its index.
BLOCK_SHINGLES, CLASS_COST = 1 << 20, 64
#: Coordinates that two sketches must share to be verified.
AGREE = 96

_rng = np.random.default_rng(5)
_ROUND_SEEDS = _rng.integers(0, 2**64, 2 * COORDINATES, np.uint64)
_PLACE = _rng.integers(0, 2**63, SHINGLE_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of a text with fewer words the whole sequence."""
    words, _, first = words_of(LOWER[data], offsets)
    n = len(words)
    if n >= SHINGLE_WORDS:
        hashes = np.zeros(n - SHINGLE_WORDS + 1, np.uint64)
        for j in range(SHINGLE_WORDS):
            hashes += words[j : n - SHINGLE_WORDS + 1 + j] * _PLACE[j]
        fmix(hashes)
    else:
        hashes = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        k = b - a
        if k >= SHINGLE_WORDS:
            out.append(np.unique(hashes[a : b - SHINGLE_WORDS + 1]))
        elif k:
            out.append(fmix((words[a:b] * _PLACE[:k]).sum(keepdims=True) + np.uint64(k)))
        else:
            out.append(hashes[:0])
    return out


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """t coordinates of each set, by rounds of hashed bin placement; rows of empty sets are empty."""
    out = np.full(len(sets) * t, _EMPTY, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate([np.zeros(0, np.uint64), *sets])
    for i in range(2 * t):
        if not len(items):
            break
        h = fmix(items ^ _ROUND_SEEDS[i])
        low = (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
        place = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, owner * t + place, low)
        open_ = (out.reshape(-1, t) == _EMPTY).any(axis=1)[owner]
        items, owner = items[open_], owner[open_]
    return out.reshape(-1, t)


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """Order-free 128-bit hash of a set of hashes."""
    return int(s.sum(dtype=np.uint64)) - 2**63, int(fmix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) - 2**63


_SKETCHED = "doc_id long, text_key long, n int, h1 long, h2 long, bands array<long>, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_view(batch.column(2))
        for lo, hi in row_slices(offsets, 2 << 20):
            sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            values = sketches(sets)
            mixed = fmix(values.copy())
            keys = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(ROWS_PER_BAND):
                keys += mixed[:, r::ROWS_PER_BAND] * _PLACE[r]
            keys = fmix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            full = np.array([len(s) > 0 for s in sets])
            both = [_set_hash(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(1).slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([b[0] for b in both], pa.int64()),
                    pa.array([b[1] for b in both], pa.int64()),
                    pa.array([k.view(np.int64).tolist() if f else None for k, f in zip(keys, full)], pa.list_(pa.int64())),
                    pa.array([v.tobytes() if f else None for v, f in zip(mixed.astype(np.uint16), full)], pa.binary()),
                ],
                names=["doc_id", "text_key", "n", "h1", "h2", "bands", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch], wanted: Bitmap) -> Iterator[pa.RecordBatch]:
    """h1, h2, full set of the texts whose class may be wanted; a class once per task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        data, offsets = text_view(batch.column(0))
        for lo, hi in row_slices(offsets, 2 << 20):
            rows = []
            for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                if len(s) and (key := _set_hash(s)) not in seen and wanted.has(key[0]):
                    seen.add(key)
                    rows.append((*key, s.tobytes()))
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["h1", "h2", "shingles"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, agreement of the rows (a, b, sketch of a, sketch of b) whose sketches allow a link."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, COORDINATES) for k in (2, 3))
        same = (x == y).sum(axis=1)
        good = pa.array(same >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(same.astype(np.int64)).filter(good)], names=["a", "b", "same"])


class Forest:
    """Joined numbers; `join` tells whether two weren't joined before."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (over := self.up.get(top, top)) != top:
            top = over
        while x != top:
            self.up[x], x = top, self.up.get(x, x)
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of consecutive rows with the same first `width` columns: their key and the rest of each row."""
    current, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != current:
                if group:
                    yield current, group
                current, group = row[:width], []
            group.append(row[width:])
    if group:
        yield current, group


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, block, cid, comp, n, sketch) sorted by (key, i, j): the classes whose sketches allow a
    link to another component (kind 0), and pairs of components that span what may be linked (kind 1)."""
    for _, group in _runs(batches, 3):
        block, cid, comp, n = (np.array([r[k] for r in group]) for k in range(4))
        sk = np.frombuffer(b"".join(r[4] for r in group), np.uint16).reshape(-1, COORDINATES)
        active, forest, spanning = np.zeros(len(cid), bool), Forest(), []
        apart = (block != block[0]).any()
        for x in range(len(cid) - 1):
            ok = comp[x + 1 :] != comp[x]
            if apart:
                ok &= block[x + 1 :] != block[x]
            ok &= (np.minimum(n[x + 1 :], n[x]) * 4) >= np.maximum(n[x + 1 :], n[x]) * 3
            rest = np.flatnonzero(ok) + x + 1
            if len(rest):
                rest = rest[(sk[rest] == sk[x]).sum(axis=1) >= AGREE]
            if len(rest):
                active[x] = active[rest] = True
                spanning += [(int(comp[x]), c) for c in np.unique(comp[rest]).tolist() if forest.join(int(comp[x]), c)]
        if spanning:
            named = np.unique(cid[active]).tolist()
            rows = [(0, c, None) for c in named] + [(1, *pair) for pair in spanning]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["kind", "a", "b"])


def _alike(both: np.ndarray | int, a: np.ndarray | int, b: int):
    return 100 * both >= 75 * (a + b - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b or null, set) sorted with the centre's own set first: links (a, b)."""
    current, centre = None, None
    for batch in batches:
        found = []
        for a, b, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            s = np.frombuffer(body.as_buffer(), np.uint64)
            if b is None:
                current, centre = a, s.copy()
                continue
            assert a == current
            small, large = (s, centre) if len(s) <= len(centre) else (centre, s)
            if len(small) * 4 < len(large) * 3:
                continue
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if _alike(both, len(s), len(centre)):
                found.append((a, b))
        x, y = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (area, i, j, asking, cid, comp, set) sorted with block i's classes, which don't ask, first: links
    between the blocks, or within the block where i = j, that join components which no link before has."""
    for (_, i, j), group in _runs(batches, 3):
        held = [(cid, comp, np.frombuffer(body, np.uint64)) for asking, cid, comp, body in group if not asking]
        asks = held if i == j else [(cid, comp, np.frombuffer(body, np.uint64)) for asking, cid, comp, body in group if asking]
        if not held or not asks:
            continue
        sizes = np.array([len(s) for _, _, s in held])
        items, owner = np.concatenate([s for _, _, s in held]), np.repeat(np.arange(len(held)), sizes)
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order]
        forest, links = Forest(), []
        for cid, comp, s in asks:
            lo, n = np.searchsorted(items, s, "left"), np.searchsorted(items, s, "right")
            n -= lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(held))
            links += [(held[k][0], cid) for k in np.flatnonzero(_alike(both, sizes, len(s))).tolist() if forest.join(held[k][1], comp)]
        if links:
            x, y = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def _full_sets(wanted: DataFrame, texts: DataFrame, classes: DataFrame, label: str, bits: int) -> DataFrame:
    """cid, shingles of the wanted classes (column cid), made anew from the texts."""
    wanted = stage(wanted.distinct().join(classes.select("cid", "h1", "h2"), "cid"), f"{label}-wanted")
    bitmap = collect_bitmap(wanted.select(F.col("h1").alias("key")), bits)
    found = texts.mapInArrow(lambda b: _sets(b, bitmap), "h1 long, h2 long, shingles binary").join(wanted, ["h1", "h2"])
    return stage(found.select("cid", "shingles").dropDuplicates(["cid"]), f"{label}-sets")


def _star_links(pairs: DataFrame, texts: DataFrame, classes: DataFrame, bits: int) -> DataFrame:
    """The pairs (centre a, member b) whose full sets are at least 75 % alike."""
    sets = _full_sets(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")), texts, classes, "star", bits)
    salts = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / 500) + 1).alias("salts"))  # a centre with many members is split
    members = pairs.join(sets.withColumnRenamed("cid", "b"), "b").join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b", "shingles")
    centres = salts.join(sets.withColumnRenamed("cid", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
    dealt = members.union(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return stage(dealt.mapInArrow(_verify, "a long, b long"), "star-links")


def _links_across(found: DataFrame, named: DataFrame, texts: DataFrame, classes: DataFrame, bits: int) -> DataFrame:
    """Verified links between components, of what `_across` has found."""
    areas = components(found.where("kind = 1").select("a", "b")).select(F.col("node").alias("comp"), F.col("component").alias("area"))
    asked = found.where("kind = 0").select(F.col("a").alias("cid")).distinct()
    members = stage(asked.join(named, "cid").join(areas, "comp").join(classes.select("cid", "n"), "cid"), "members")
    blocks = members.groupBy("area").agg((F.floor(F.sum(F.col("n") + CLASS_COST) / BLOCK_SHINGLES) + 1).cast("int").alias("blocks"))
    sets = _full_sets(members.select("cid"), texts, classes, "across", bits)
    dealt = members.join(blocks, "area").join(sets, "cid").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("area", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("asking"), "cid", "comp", "shingles")
    met = dealt.repartition("area", "i", "j").sortWithinPartitions("area", "i", "j", "asking")
    return stage(met.mapInArrow(_join, "a long, b long"), "across-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, n_links (verified links of the
    document's class that the components were built from), text_key (xxhash64 of the text).

    A-Z count as a-z; words are runs of bytes other than space and tab to carriage return. A null,
    empty or blank text has no shingles and is its own component. Documents with equal sets are linked.
    component_id is the smallest id of the component (a null id counts as the largest); a document
    stays if its id is the component's. Other columns of `docs` are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    bits = bits_for(docs)
    sketched = stage(source.mapInArrow(_sketch, _SKETCHED), "sketches")
    own = sketched.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = stage(own.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # Buckets: bands of the classes' members; copies in a bucket are one class.
    banded = sketched.where("n > 0").select("h1", "h2", F.explode("bands").alias("key"))
    groups = banded.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
    shared = collect_bitmap(groups, bits)
    kept = sketched.where("n > 0").select("h1", "h2", "bands", "sketch").mapInArrow(lambda b: _in_shared(b, shared), "h1 long, h2 long, keys array<long>, sketch binary")
    kept = kept.join(classes.select("cid", "h1", "h2", "n"), ["h1", "h2"]).select("cid", "n", "keys", "sketch").dropDuplicates(["cid"])
    crowd = stage(kept, "crowd")
    spread = crowd.select("cid", F.explode("keys").alias("key"))
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    weights = spread.join(sizes, "key").groupBy("cid").agg(F.sum("size").alias("weight"))
    centres = spread.join(weights, "cid").groupBy("key").agg(F.max(F.struct("weight", (-F.col("cid")).alias("a"))).alias("best"), F.count(F.lit(1)).alias("size"))
    star = spread.join(centres.where("size > 1").select("key", (-F.col("best.a")).alias("a")), "key").where("cid <> a").select("a", F.col("cid").alias("b")).distinct()
    sk = crowd.select("cid", "sketch")
    star = star.join(sk.select(F.col("cid").alias("a"), F.col("sketch").alias("x")), "a").join(sk.select(F.col("cid").alias("b"), F.col("sketch").alias("y")), "b")
    star = star.select("a", "b", "x", "y").mapInArrow(_agree, "a long, b long, same long")
    # Of a class's centres the one that its sketch agrees with most: one pair a class. What this leaves apart is compared below.
    star = stage(star.groupBy("b").agg(F.max(F.struct("same", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b"), "star")
    texts = source.select("text")
    links = _star_links(star, texts, classes, bits)
    first = components(links)
    # Buckets that still hold several components: all but the largest are compared with each other and with it.
    owners = crowd.select("cid").join(first.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("component", "cid").alias("comp"))
    named = spread.join(owners, "cid").select("key", "cid", "comp")
    mixed = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps"))
    mixed = mixed.where("comps > 1").select("key", F.col("most.comp").alias("main"), F.ceil((F.col("size") - F.col("most.n")) / BLOCK).cast("int").alias("rest"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("mains"))
    again = named.join(mixed, "key").join(crowd.select("cid", "n", "sketch"), "cid")
    spot = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    again = again.withColumn("block", F.when(F.col("comp") == F.col("main"), F.col("rest") + spot(F.col("mains"))).otherwise(spot(F.col("rest"))))
    again = again.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") + F.when(F.col("comp") == F.col("main"), 0).otherwise(F.col("mains")) - 1)))
    again = again.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "comp", "n", "sketch")
    found = stage(again.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_across, "kind int, a long, b long"), "across")
    every, final = links, first
    if found.head(1):
        every = links.union(_links_across(found, owners, texts, classes, bits))
        final = components(every)
    degree = every.select(F.col("a").alias("cid")).union(every.select("b")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
    # Smallest id of each component, carried back to the documents.
    placed = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(lowest, "component").join(degree, "cid", "left").select("h1", "h2", "copies", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    ids = sketched.select("doc_id", "text_key", "n", "h1", "h2")
    # Classes with more than a thousandth of all documents, at most a thousand, meet these without a shuffle.
    total = classes.agg(F.sum("copies")).first()[0] or 0
    large = F.broadcast(placed.where(F.col("copies") * 1000 > total).select("h1", "h2", F.lit(True).alias("large"), F.col("component_id").alias("c"), F.col("n_links").alias("l")))
    split = ids.where("n > 0").join(large, ["h1", "h2"], "left")
    rest = split.where("large is null").drop("large", "c", "l").join(placed.drop("copies"), ["h1", "h2"])
    linked = split.where("large").withColumnsRenamed({"c": "component_id", "l": "n_links"}).select(*rest.columns).union(rest).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links", "text_key")
    alone = ids.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "text_key")
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), "n_links", "text_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, with all columns, with one row of each component of `near_duplicates`: that with the smallest id.

    Rows without words (null, empty or blank texts) stay, but of rows that repeat another one's id and text
    one stays. A null id counts as the largest. An empty table gives an empty one. Columns of `docs` may
    have any names.
    """
    of, by = fresh(docs, "of", "by")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))  # noqa: E731  plain equality, so that rows are dealt out once
    kept = near_duplicates(docs, id_col, text_col).where("kept").select(F.col("text_key").alias(of), name(F.col("doc_id")).alias(by))
    marked = docs.withColumn(of, F.xxhash64(F.col(text_col).cast("string"))).withColumn(by, name(F.col(id_col).cast("long")))
    return marked.join(kept, [of, by], "left_semi").dropDuplicates([of, by]).select(*docs.columns)


def _in_shared(batches: Iterator[pa.RecordBatch], shared: Bitmap) -> Iterator[pa.RecordBatch]:
    """The bands that may hold several classes; texts without one are left out. A class once per task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = np.asarray(batch.column(2).values if batch.column(2).offset == 0 else batch.column(2).flatten()).reshape(-1, BANDS)
        hit = shared.has_all(keys)
        rows = []
        for i in np.flatnonzero(hit.any(axis=1)):
            key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            if key not in seen:
                seen.add(key)
                rows.append((*key, keys[i][hit[i]].tolist(), batch.column(3)[i].as_py()))
        if rows:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "keys", "sketch"])
