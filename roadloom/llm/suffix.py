"""Removal of repeated byte strings by partitioned suffix sorting with linear grouping construction.

Every 100-byte window owns an anchor: the smallest hash among its 32-byte grams (leftmost if equal).
Equal windows have equal anchors at equal places, so all windows can be judged per anchor gram:
  1. Count the anchors' grams over all documents; a bitmap tells which can repeat.
  2. Each run of windows with one anchor becomes a context (the bytes it spans). Equal contexts in a
     task collapse to the earliest; the others are removed as a whole.
  3. Equal contexts of all tasks meet (by gram and 128 bits of hashes, so that no gram is a hot key): all but
     the earliest are removed. Grams that are left with one context are done.
  4. Of a gram with several different contexts the bytes meet: shared windows are cut out, and where several
     distinct strings remain their suffixes are sorted (`suffix_array`); runs of suffixes with 100 equal
     bytes keep the earliest.
  5. Grams with more contexts than one task should sort are anchored anew by a longer gram and go through
     steps 3 and 4 again. The last gram is the window itself, whose contexts differ only if hashes clash;
     these are always told apart by their bytes.
  6. Removed intervals meet their documents.
A context has few anchors of each longer gram, so every level makes rows in proportion to what it reads.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import Bitmap, bits_for, collect_bitmap
from .common import fmix, powers, prefix_hash, release, row_slices, stage, text_view

WINDOW = 100
#: Lengths of the anchors' grams, level by level.
GRAMS = (32, 64, 88, WINDOW)
#: Different contexts of one gram that one task sorts; grams with more go to the next level.
HOT_CONTEXTS = 256
#: Contexts that a task holds to collapse equal ones.
TASK_CONTEXTS = 100_000
#: Windows of a text that are looked at in one step.
STEP = 1 << 20


def suffix_array(s: bytes) -> list[int]:
    """Suffixes of `s` in lexicographic order, by grouping.

    Phase 1 gathers suffixes with the same Lyndon prefix: groups, at first by first byte, are processed
    in descending order; the previous smaller suffixes of a group's members move to new groups right
    above their old ones, those that more members point to higher. Phase 2 walks the result and puts the
    suffix before each sorted one, and its chain of previous smaller ones, at its group's next place.
    """
    n = len(s) + 1  # the empty suffix is the sentinel and sorts first
    first = {c: k + 1 for k, c in enumerate(sorted(set(s)))}
    below = list(range(-1, len(first)))  # group -> next lower group
    above = list(range(1, len(first) + 2))  # group -> next higher group
    top = len(first)
    members: list[set[int]] = [set() for _ in range(top + 1)]
    group = [first[c] for c in s] + [0]
    for i, g in enumerate(group):
        members[g].add(i)
    previous, done = [-1] * n, [False] * (top + 1)
    order = []  # groups in descending order
    g = top
    while g != -1:
        own = sorted(members[g])
        if own:
            done[g] = True
            order.append(g)
            pointed: dict[int, int] = defaultdict(int)
            for i in own:
                p = i - 1
                while p >= 0 and done[group[p]]:
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    pointed[p] += 1
            parts: dict[tuple[int, int], list[int]] = defaultdict(list)
            for p, times in pointed.items():
                parts[times, group[p]].append(p)
            for times, old in sorted(parts, reverse=True):
                moved = parts[times, old]
                if len(moved) == len(members[old]):
                    continue
                new = len(members)
                members.append(set(moved))
                members[old].difference_update(moved)
                done.append(False)
                # `new` comes between `old` and what stood right above it
                higher = above[old]
                below.append(old)
                above.append(higher)
                below[higher] = above[old] = new
                for p in moved:
                    group[p] = new
        g = below[g]
    place, at = {}, n
    for g in order:
        at -= len(members[g])
        place[g] = at
    out = [-1] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            out[place[group[j]]] = j
            place[group[j]] += 1
            placed[j] = True
            j = previous[j]
    return out[1:]


def anchors(data: np.ndarray, offsets: np.ndarray, size: int = GRAMS[0]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with one anchor of `size` bytes: gram hash, row, first window, number of windows.

    Positions are within `data`. A text is worked through in steps, which may cut a run in two."""
    for lo, hi in row_slices(offsets, STEP):
        for start in range(int(offsets[lo]), max(int(offsets[hi]), 1), STEP):
            stop = min(start + STEP + WINDOW - 1, int(offsets[hi]))  # windows start before start + STEP
            if stop - start < WINDOW:
                continue
            h = prefix_hash(data[start:stop])
            _, down = powers(stop - start)
            grams = fmix((h[size:] - h[:-size]) * down[: stop - start - size + 1])
            best = (grams & ~np.uint64(2**24 - 1)) | np.arange(len(grams), dtype=np.uint64)
            width = 1
            while width * 2 <= WINDOW - size + 1:
                best = np.minimum(best[:-width], best[width:])
                width *= 2
            rest = WINDOW - size + 1 - width
            best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
            at = (best & np.uint64(2**24 - 1)).astype(np.int64)
            windows = np.arange(min(len(at), STEP))
            row = np.searchsorted(offsets, windows + start, side="right") - 1
            inside = windows + start + WINDOW <= offsets[row + 1]
            windows, at, row = windows[inside], at[: len(inside)][inside], row[inside]
            if not len(windows):
                continue
            new = np.ones(len(windows), bool)
            new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
            head = np.flatnonzero(new)
            yield grams[at[head]].view(np.int64), row[head], windows[head] + start, np.diff(np.append(head, len(windows)))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for gram, *_ in anchors(*text_view(batch.column(0))):
            found, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["key", "n"])


_ROWS = "kind int, key long, body binary, doc_id long, dig long, a long, b long"
_ROW_SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("body", pa.binary()), ("doc_id", pa.int64()), ("dig", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW_SCHEMA)], schema=_ROW_SCHEMA)


def _earlier(x: tuple, y: tuple) -> bool:
    """Order of (id, digest, place); null ids come last."""
    return (x[0] is None, x[0] or 0, *x[1:]) < (y[0] is None, y[0] or 0, *y[1:])


class Collapser:
    """Holds the earliest occurrence of equal contexts; later ones become removed intervals."""

    def __init__(self):
        self.held: dict[tuple[int, bytes], tuple] = {}
        self.rows: list[tuple] = []
        self.last = None

    def remove(self, where: tuple, size: int):
        if self.last and (*self.last[:2],) == where[:2] and self.last[2] <= where[2] <= self.last[3]:
            self.last[3] = max(self.last[3], where[2] + size)
            return
        self.flush()
        self.last = [*where, where[2] + size]

    def flush(self):
        if self.last:
            self.rows.append((0, None, None, *self.last))
            self.last = None

    def add(self, key: int, body: bytes, where: tuple):
        old = self.held.get((key, body))
        if old is None:
            self.held[key, body] = where
        elif old != where:  # a repeated row is no other occurrence
            if _earlier(where, old):
                self.held[key, body] = where
                where = old
            self.remove(where, len(body))

    def out(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        if all_ or len(self.held) > TASK_CONTEXTS:
            self.rows += [(1, key, body, *where, where[2] + len(body)) for (key, body), where in self.held.items()]
            self.held = {}
        if all_:
            self.flush()
        for lo in range(0, len(self.rows), 16384):
            yield _batch(self.rows[lo : lo + 16384])
        self.rows = []


def _add_runs(kept: Collapser, data: np.ndarray, offsets: np.ndarray, size: int, place, wanted: Bitmap | None = None) -> None:
    """The contexts of all rows, those of wanted grams only; place(row) gives id, digest and where the row starts."""
    for gram, row, first, n in anchors(data, offsets, size):
        hit = np.flatnonzero(wanted.has_all(gram)) if wanted else slice(None)
        for g, r, a, k in zip(gram[hit].tolist(), row[hit].tolist(), first[hit].tolist(), n[hit].tolist()):
            doc_id, digest, at = place(r)
            kept.add(g, data[a : a + k - 1 + WINDOW].tobytes(), (doc_id, digest, at + a - int(offsets[r])))


def _contexts(batches: Iterator[pa.RecordBatch], repeated: Bitmap) -> Iterator[pa.RecordBatch]:
    kept = Collapser()
    for batch in batches:
        data, offsets = text_view(batch.column(1))
        ids, digests = batch.column(0).to_pylist(), {}

        def place(r):
            if r not in digests:
                digests[r] = xxhash.xxh3_64_intdigest(data[offsets[r] : offsets[r + 1]]) - (1 << 63)
            return ids[r], digests[r], 0

        _add_runs(kept, data, offsets, GRAMS[0], place, repeated)
        yield from kept.out()
    yield from kept.out(True)


def _reanchor(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Contexts (key, body, doc_id, dig, a) cut into those of longer grams."""
    kept = Collapser()
    for batch in batches:
        data, offsets = text_view(batch.column(1))
        places = list(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))))
        _add_runs(kept, data, offsets, size, places.__getitem__)
        yield from kept.out()
    yield from kept.out(True)


_SETTLED = "kind int, key long, doc_id long, dig long, a long, b long"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, two hashes of the context, doc_id, dig, a, b) in this order: of equal contexts the first
    stays (kind 1), the others are removed (kind 0)."""
    schema = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in ("key", "doc_id", "dig", "a", "b"))])
    last = None  # key and hashes, then place, of the context that stays
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).fill_null(0).to_numpy() for k in range(6)]
        full = np.stack([*columns, ~batch.column(3).is_null().to_numpy(zero_copy_only=False)])
        if last is not None:
            full = np.concatenate([last[:, None], full], axis=1)
        new = np.ones(full.shape[1], bool)
        new[1:] = (full[:3, 1:] != full[:3, :-1]).any(axis=0)
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        again = ~new & (full[3:, head] != full[3:]).any(axis=0)  # a repeated row is no other occurrence
        skip = int(last is not None)
        last = full[:, head[-1]]
        new, out = new[skip:], (new | again)[skip:]
        taken = pa.array(out)
        key = pa.array(full[0, skip:][out], mask=~new[out])
        yield pa.RecordBatch.from_arrays([pa.array(new[out].astype(np.int32)), key, *(batch.column(k).filter(taken) for k in range(3, 7))], schema=schema)


def _filtered(batches: Iterator[pa.RecordBatch], mixed: Bitmap, idents: Bitmap | None = None, hot: Bitmap | None = None, inside: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows (key, ident, ...) whose key may be among `mixed`, whose ident may be among `idents`, and whose
    key may be among `hot` or isn't."""
    for batch in batches:
        hit = mixed.has_all(batch.column(0).to_numpy())
        if idents:
            hit &= idents.has_all(batch.column(1).to_numpy())
        if hot:
            hit &= hot.has_all(batch.column(0).to_numpy()) == inside
        yield batch.filter(pa.array(hit))


def judge(contexts: list[tuple[bytes, tuple]]) -> list[tuple[tuple, int]]:
    """Removed (place, length) among the contexts of one gram, each (bytes, place)."""
    removed, earliest = [], {}
    for body, where in contexts:  # equal contexts: the earliest counts
        old = earliest.get(body)
        if old is None:
            earliest[body] = where
        elif old != where:
            if _earlier(where, old):
                earliest[body], where = where, old
            removed.append((where, len(body)))
    if len(earliest) < 2:
        return removed
    times: dict[bytes, int] = defaultdict(int)
    for body in earliest:
        for w in {body[i : i + WINDOW] for i in range(len(body) - WINDOW + 1)}:
            times[w] += 1
    shared: dict[bytes, list[tuple]] = defaultdict(list)  # maximal strings of shared windows
    for body, where in earliest.items():
        i, last = 0, len(body) - WINDOW
        while i <= last:
            if times[body[i : i + WINDOW]] < 2:
                i += 1
                continue
            j = i
            while j < last and times[body[j + 1 : j + 1 + WINDOW]] > 1:
                j += 1
            shared[body[i : j + WINDOW]].append((*where[:2], where[2] + i))
            i = j + 1
    strings = list(shared)
    best: dict[bytes, tuple] = {}
    for body in strings:
        places = shared[body]
        for where in places[1:]:
            if _earlier(where, places[0]):
                places[0], where = where, places[0]
            removed.append((where, len(body)))
        best[body] = places[0]
    if len(strings) < 2:
        return removed
    joined, home = bytearray(), []
    for k, body in enumerate(strings):
        home += [(k, i) for i in range(len(body))] + [None]
        joined += body + b"\0"
    run: list[tuple] = []

    def close():
        if len(run) > 1:
            keep = run[0]
            for where in run[1:]:
                if _earlier(where, keep):
                    keep, where = where, keep
                removed.append((where, WINDOW))

    text, before = bytes(joined), None
    for at in suffix_array(text):
        if home[at] is None or len(strings[home[at][0]]) - home[at][1] < WINDOW:
            continue
        k, i = home[at]
        where = best[strings[k]]
        here = text[at : at + WINDOW]
        if here != before:
            close()
            run, before = [], here
        run.append((*where[:2], where[2] + i))
    close()
    return removed


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key: the removed intervals."""
    names = ["doc_id", "dig", "a", "b"]
    types = [pa.int64()] * 4
    current, group = None, []

    def out(found):
        cols = zip(*[(*where, where[2] + size) for where, size in found])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    removed = []
    for batch in batches:
        for key, body, doc_id, dig, a in zip(*(c.to_pylist() for c in batch.columns)):
            if key != current:
                removed += judge(group) if len(group) > 1 else []
                current, group = key, []
                if len(removed) >= 8192:
                    yield out(removed)
                    removed = []
            group.append((body, (doc_id, dig, a)))
    removed += judge(group) if len(group) > 1 else []
    if removed:
        yield out(removed)


_INTERVALS = "doc_id long, dig long, a long, b long"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, dig, a, b, text), a document's intervals in order before its text."""
    current, spans, seen = None, [], False
    for batch in batches:
        ids, digs, starts, ends = (batch.column(k).to_pylist() for k in range(4))
        valid = batch.column(4).is_valid().to_pylist()
        found = []
        for i, key in enumerate(zip(ids, digs)):
            if key != current:
                current, spans, seen = key, [], False
            if not valid[i]:
                if spans and starts[i] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], ends[i])
                else:
                    spans.append([starts[i], ends[i]])
                continue
            raw = memoryview(batch.column(4)[i].as_buffer())
            mine = ([[0, len(raw)]] if len(raw) >= WINDOW else []) if seen else spans  # a repeated row
            digest, at = hashlib.sha256(), 0
            for a, b in mine:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            found.append((key[0], len(raw), sum(b - a for a, b in mine), len(mine), digest.hexdigest()))
            seen = True
        if found:
            cols = [pa.array(c, t) for c, t in zip(zip(*found), [pa.int64()] * 4 + [pa.string()])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_view(batch.column(1))
        dig = [xxhash.xxh3_64_intdigest(data[a:b]) - (1 << 63) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dig, pa.int64()), batch.column(1)], names=["doc_id", "dig", "text"])


def _level(contexts: DataFrame, bound: int | None, bits: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What is removed among `contexts`: whole equal ones, and parts of different ones of one gram; and the
    contexts (key, body, doc_id, dig, a) of grams with more than `bound` different ones, if there are any."""
    slim = contexts.select("key", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"), "doc_id", "dig", "a", "b")
    met = slim.repartition("key", "h1", "h2").sortWithinPartitions("key", "h1", "h2", F.asc_nulls_last("doc_id"), "dig", "a")
    settled = stage(met.mapInArrow(_settle, _SETTLED), "settled")
    release(contexts.sparkSession)
    kept, ident = settled.where("kind = 1"), F.xxhash64("key", "doc_id", "dig", "a")
    several = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mixed = collect_bitmap(several.select("key"), bits)
    idents = collect_bitmap(kept.select("key", ident.alias("ident")).mapInArrow(lambda b: _filtered(b, mixed), "key long, ident long").select(F.col("ident").alias("key")), bits)
    hot = collect_bitmap(several.where(F.col("n") > bound).select("key"), bits) if bound is not None else None
    columns, full = ["key", "body", "doc_id", "dig", "a"], "key long, ident long, body binary, doc_id long, dig long, a long"
    bodies = contexts.select("key", ident.alias("ident"), *columns[1:])
    cold = bodies.mapInArrow(lambda b: _filtered(b, mixed, idents, hot), full).select(*columns)
    judged = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_own, _INTERVALS)
    removed = settled.where("kind = 0").select("doc_id", "dig", "a", "b")
    if hot is None or hot.empty:
        return removed, judged, None
    return removed, judged, bodies.mapInArrow(lambda b: _filtered(b, mixed, idents, hot, True), full).select(*columns)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removes each byte of a text covered by a 100-byte string that starts earlier too (smaller id, or
    same document and earlier start; null ids come last; documents with one id are ordered by a hash of
    their text, and of rows that repeat id and text one is the first). Null and empty texts have nothing
    to remove. An empty table gives no rows. Other columns of `docs` are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = bits_for(docs)
    counted = source.select("text").mapInArrow(_grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    repeated = collect_bitmap(counted.where("n > 1").select("key"), bits)
    rows = stage(source.mapInArrow(lambda b: _contexts(b, repeated), _ROWS), "contexts")
    del counted
    release(docs.sparkSession)
    intervals, gram = None, 0
    while True:
        removed, judged, hot = _level(rows.where("kind = 1"), HOT_CONTEXTS if gram + 1 < len(GRAMS) else None, bits)
        found = rows.where("kind = 0").select("doc_id", "dig", "a", "b").union(removed).union(judged)
        intervals = intervals.union(found) if intervals else found
        if hot is None:
            break
        gram += 1
        rows = stage(hot.mapInArrow(lambda b, size=GRAMS[gram]: _reanchor(b, size), _ROWS), "longer")
    texts = source.mapInArrow(_digests, "doc_id long, dig long, text string")
    parts = texts.select("doc_id", "dig", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "text").union(intervals.withColumn("text", F.lit(None).cast("string")))
    return parts.repartition("doc_id", "dig").sortWithinPartitions("doc_id", "dig", F.asc_nulls_last("a"), "b").mapInArrow(_cut, _RESULT)
