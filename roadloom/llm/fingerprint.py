"""Document fingerprints: canonical exact digests.

Canonical text: NFKC, case folding, runs of white space to one space, ends trimmed. The fingerprint is
the 128-bit xxhash of its UTF-8 bytes. Canonical texts in one hash bucket are compared byte by byte
(within a task at once; across tasks by the bucket's smallest and largest text, which a partial
aggregation finds without gathering the bucket); should two differ, the bucket's fingerprints get the
SHA-256 of their canonical text appended, so unequal canonical texts never share a fingerprint.
Only buckets that hold several documents are compared: a bitmap of fixed size, built from all
documents' hashes, tells which those can be.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stage

#: Bits of the bitmap of buckets with several documents (8 MB); more documents only make it less selective.
BITMAP_BITS = 1 << 26
#: Bytes of canonical text that a task remembers to compare copies at once.
TASK_BYTES = 32 << 20


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        folded = unicodedata.normalize("NFKC", text.casefold())
    else:
        folded = text.lower()
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(body: bytes, bits: int = 128) -> str:
    return f"{xxhash.xxh3_128_intdigest(body) >> (128 - bits):0{(bits + 3) // 4}x}"


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _bit(h: str) -> int:
    return int(h[-16:], 16) % BITMAP_BITS


def _hashes(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [digest(canonical(t.as_py() or ""), bits) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([_bit(h) for h in found], pa.int64())], names=["h", "bit"])


def _likeness(a: tuple[str, bytes], b: tuple[str, bytes]) -> float:
    return float(a[0] == b[0] and a[1] == b[1])


_ROWS = "edge int, pid long, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, body binary, body_sha256 string"
_ROW_SCHEMA = pa.schema([("edge", pa.int32()), ("pid", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("body", pa.binary()), ("body_sha256", pa.string())])


def _own(text: str, bits: int) -> tuple[str, bytes]:
    body = canonical(text)
    return digest(body, bits), body


def _pair(text: str, own: tuple[str, bytes], following: str, next_own: tuple[str, bytes], bits: int) -> tuple:
    """edited_sha256, edited_fingerprint, near_edited, near_next."""
    changed = edited(text, following)
    other = _own(changed, bits)
    return hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), other[0], _likeness(own, other), _likeness(own, next_own)


def _walk(batches: Iterator[pa.RecordBatch], bits: int, several) -> Iterator[pa.RecordBatch]:
    """Rows come in ascending order of id. A partition's first and last text are passed on (edge 1
    and 2) to meet their neighbours in other partitions."""
    pid, marked = TaskContext.get().partitionId(), np.frombuffer(several.value, np.uint8)
    held, first, rows, met, size = None, True, [], {}, 0

    def row(edge, doc_id, text, own, pair=(None, None, None, None)):
        nonlocal met, size
        body = sha = None
        if edge != 1:
            bit = _bit(own[0])
            if marked[bit >> 3] >> (bit & 7) & 1:
                known = met.get(own[0])
                if known is None or known != own[1]:
                    body = own[1]
                    if size > TASK_BYTES:
                        met, size = {}, 0
                    if known is None:
                        met[own[0]] = body
                        size += len(body)
                sha = hashlib.sha256(own[1]).hexdigest()
        rows.append((edge, pid, doc_id, text if edge else None, len(text), pair[0], own[0], *pair[1:], body, sha))

    def out(part):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _ROW_SCHEMA)], schema=_ROW_SCHEMA)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            own = _own(text, bits)
            if first:
                row(1, doc_id, text, own)
                first = False
            if held is not None:
                row(0, *held, _pair(held[1], held[2], text, own, bits))
            held = (doc_id, text, own)
            if len(rows) >= 512:
                yield out(rows)
                rows = []
    if held is not None:
        row(2, *held)
    if rows:
        yield out(rows)


def _meet(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows: doc_id, text, following text. The last rows of partitions with the next one's first."""
    for batch in batches:
        for doc_id, text, following, pid in zip(*(c.to_pylist() for c in batch.columns)):
            own, after = _own(text or "", bits), _own(following or "", bits)
            pair = _pair(text or "", own, following or "", after, bits)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((doc_id, pid, *pair), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "pid", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"])


def _bitmap(hashes: DataFrame) -> bytes:
    """Bits of the buckets that more than one document falls into. Rows to the driver: one for each
    32,768 bits, at most."""
    several = hashes.groupBy("h", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("bit").alias("b"))
    maps = several.groupBy((F.col("b").cast("long") / 32768).cast("long").alias("k")).agg(F.expr("bitmap_construct_agg(b % 32768)").alias("bits")).collect()
    out = bytearray(BITMAP_BITS // 8)
    for r in maps:
        out[r["k"] * 4096 : r["k"] * 4096 + len(r["bits"])] = r["bits"]
    return bytes(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128, partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, body_sha256 (of the canonical text, where another document may share it).

    Null counts as empty. The following document is the next in ascending order of id (ties by text,
    null ids first), after the last the first; a single document follows itself. The likeness of two
    exact digests is 1 or 0. An empty table gives no rows. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    several = spark.sparkContext.broadcast(_bitmap(source.select("text").mapInArrow(lambda b: _hashes(b, bits), "h string, bit long")))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    rows = stage(ordered.mapInArrow(lambda b: _walk(b, bits, several), _ROWS), "fingerprints")
    del ordered
    release(spark)  # the texts in order are not needed again
    # A row per partition: the partition whose first text follows.
    by_pid = Window.orderBy("pid")
    heads = rows.where("edge = 1").select("pid")
    follows = heads.select("pid", F.coalesce(F.lead("pid").over(by_pid), F.first("pid").over(by_pid)).alias("next_pid"))
    last = rows.where("edge = 2").select("pid", "doc_id", "text").join(follows, "pid")
    firsts = rows.where("edge = 1").select(F.col("pid").alias("next_pid"), F.col("text").alias("following"))
    met = last.join(firsts, "next_pid").select("doc_id", "text", "following", "pid").mapInArrow(
        lambda b: _meet(b, bits), "doc_id long, pid long, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"
    )
    kept = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "body_sha256"]
    ends = rows.where("edge = 2").select("pid", "n_chars", "fingerprint", "body_sha256").join(met, "pid").select(*kept)
    result = rows.where("edge = 0").select(*kept).unionByName(ends)
    # Buckets in which two canonical texts differ: none is to be expected of a 128-bit hash.
    clash = rows.where("body is not null").groupBy("fingerprint").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("fingerprint", F.lit(True).alias("clash"))
    if not clash.head(1):
        return result
    told = F.when(F.col("clash"), F.concat_ws("-", "fingerprint", "body_sha256")).otherwise(F.col("fingerprint"))
    return result.join(clash, "fingerprint", "left").withColumn("fingerprint", told).select(*kept)
