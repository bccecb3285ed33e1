"""Document fingerprints from content-defined chunks.

A gear hash rolls over the bytes of a text: each byte's table value enters shifted by its distance, so
32 bytes decide, and numpy sums them for all positions at once in five doublings. A chunk ends where the
hash has enough leading zeros; before the normal size more are asked for than after it, which keeps
lengths near the normal size. An edit moves only the boundaries near it. The fingerprint is the set of
chunk digests, each with its length, so the share of a text that another one contains can be measured.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the least, the normal and the longest chunk; a length fits into one byte.
LEAST, NORMAL, LONGEST = 12, 40, 200
#: Leading zeros that end a chunk before and after the normal size.
STRICT, LOOSE = 6, 4
#: Table of the gear hash, from the rule that entry b is XXH64 of the byte b with seed 2.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 2) & 0xFFFFFFFF for b in range(256)], np.uint32)

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def gear(data: bytes) -> np.ndarray:
    """The rolling hash at every byte, over it and the 31 before."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            shifted = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += shifted
    return h


def boundaries(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks of ``data`` from the boundary ``start`` on, the last at its end."""
    n = len(data)
    skip = max(0, start - 31)
    h = gear(data[skip:]) if skip else gear(data)
    loose = np.flatnonzero(h < (1 << (32 - LOOSE)))
    strict = loose[h[loose] < (1 << (32 - STRICT))]
    loose, strict = (loose + (skip + 1)).tolist(), (strict + (skip + 1)).tolist()
    ends, s, i, j = [], start, 0, 0
    while n - s > LEAST:
        i = bisect_left(strict, s + LEAST, i)
        end = strict[i] if i < len(strict) else n
        if end >= s + NORMAL:
            j = bisect_left(loose, s + NORMAL, j)
            end = min(loose[j] if j < len(loose) else n, s + LONGEST, n)
        ends.append(end)
        s = end
    if s < n:
        ends.append(n)
    return ends


def _digests(data: bytes, start: int, ends: list[int]) -> list[int]:
    """40 bits of each chunk's hash, and its length in the low byte."""
    out, digest = [], xxhash.xxh3_64_intdigest
    for end in ends:
        out.append((digest(data[start:end]) & 0xFFFFFFFFFF) << 8 | (end - start))
        start = end
    return out


class Print:
    """The fingerprint of one text: its chunks' ends and its sorted, distinct digests."""

    def __init__(self, data: bytes, like: Print | None = None, same: int = 0):
        """``like``: a fingerprint whose text has the first ``same`` bytes in common."""
        kept: list[int] = []
        if like is not None:
            kept = like.ends[: bisect_left(like.ends, same)]  # an end is decided by the bytes before it
        start = kept[-1] if kept else 0
        more = boundaries(data, start)
        self.ends = kept + more
        self.all = (like.all[: len(kept)] if kept else []) + _digests(data, start, more)
        self.set = set(self.all)

    def text(self) -> str:
        """12 hexadecimal digits for each distinct chunk, ascending; empty for an empty text."""
        codes = np.array(sorted(self.set), ">u8")
        return codes.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex() if len(codes) else ""

    def inside(self, other: Print) -> float:
        """The share of this text's distinct chunks, by length, that ``other`` has; two empty texts: 1."""
        total = sum(c & 255 for c in self.set)
        if not total:
            return float(not other.set)
        return sum(c & 255 for c in self.set & other.set) / total


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        ids, texts, buckets, ahead = (batch.column(k) for k in range(4))
        for k in range(batch.num_rows):
            yield ids[k].as_py(), texts[k].as_py() or "", buckets[k].as_py(), ahead[k].as_py()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("a", "b", "c")), ("d", pa.float64()), ("e", pa.float64())]
    )
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    out: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], names=names)

    last = None
    for doc_id, text, bucket, ahead in _rows(batches):
        data = text.encode()
        own = Print(data)
        if last is not None and last[0] == bucket:
            _, key, was, before = last
            quarter = len(was) // 4
            head = was[: len(was) - quarter]
            edited = (head + text[:quarter]).encode()
            changed = Print(edited, before, len(head.encode()))
            row = (key, len(was), hashlib.sha256(edited).hexdigest(), before.text(), changed.text(), before.inside(changed), before.inside(own))
            out.append(row)
            size += len(row[3]) + len(row[4])
            if size > 8 << 20:
                yield flush()
                out, size = [], 0
        last = None if ahead else (bucket, doc_id, text, own)
    if out:
        yield flush()


def with_next(docs: DataFrame, *, stretches: int | None = None) -> DataFrame:
    """(doc_id, text, bucket, ahead): stretches of the table in ascending doc_id, one to a partition.

    Each ends with a further row (ahead) that repeats the first row of the following stretch, the last
    one with the first row of all, so that a task knows every document's successor. Rows without doc_id
    come first, rows with the same one in the order of their texts.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    some = docs.select(key.alias("_key"), "doc_id", F.col("text").cast("string").alias("text"))
    n = stretches or max(1, docs.rdd.getNumPartitions() * 2)
    bounds = np.array(sorted(set(some.approxQuantile("_key", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else [])), np.float64)

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False).astype(np.float64), side="right"), pa.int32())

    firsts = some.select("_key").withColumn("bucket", place("_key")).groupBy("bucket").agg(F.min("_key").alias("_key")).orderBy("bucket").collect()
    used = [r.bucket for r in firsts]  # no more than there are stretches
    goes = [(r._key, used[k - 1]) for k, r in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(goes, "_key long, _before int"))
    placed = some.withColumn("bucket", place("_key")).join(heads, "_key", "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ahead"))
    extra = F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("ahead"))
    both = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, extra))
    rows = placed.select("_key", "doc_id", "text", F.explode(both).alias("at")).select("_key", "doc_id", "text", "at.*")
    dealt = rows.repartitionById(len(bounds) + 1, "bucket")
    return dealt.sortWithinPartitions("bucket", "ahead", "_key", "text").select("doc_id", "text", "bucket", "ahead")


def fingerprints(docs: DataFrame, *, stretches: int | None = None) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how much of it those and the next one hold.

    The edited text has its last quarter replaced by the first characters of the next document. Null
    texts are empty: an empty text has the fingerprint "" and its likeness to another is 1 if that is
    empty too, else 0. Repeated rows each give a row. An empty table gives no rows. Other columns are not
    looked at, whatever their names. A text of any length is read whole; a task holds one text and its successor.
    """
    return with_next(docs, stretches=stretches).mapInArrow(_pairs, SCHEMA)
