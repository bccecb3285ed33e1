"""Vector codes: each part of a vector becomes the number of the nearest entry of the part's codebook.

The nearest entry is found exactly by slicing and intersecting bitmasks. For each component the entries of a
codebook are sorted by it, and every place in that order carries a mask of the entries before it. The
distance to one entry near by, in the component in which the entries are spread most, is a radius that the
nearest entry cannot lie beyond; in every component it selects a range of the order, whose mask is the
difference of the masks at its ends. The masks of all components, intersected, hold the nearest entry and the few
others that have to be compared with it.

Codebooks are learned in rounds of assignment and means, each one Spark aggregation of whole numbers: what
a task adds up is small (a row an entry), and so are the codebooks that go back to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Whole numbers are made of a component times this.
SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Greatest component after scaling: squared distances of up to 2**9 components fit into 64 bits.
LARGEST = 1 << 26
#: Components of all codebooks together (a codebook set for each length of vector); they go to every task.
MOST_COMPONENTS = 1 << 22
#: Components that are compared at once.
HELD = 1 << 20


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end: equal parts if its length allows, else parts that differ by one."""
    at = [length * p // parts for p in range(parts + 1)]
    return list(zip(at, at[1:]))


@dataclass
class Codebook:
    """The entries of one part, (entries, components) whole numbers, at most 64 entries."""

    entries: np.ndarray

    @cached_property
    def order(self) -> np.ndarray:
        """(components, entries): the entries sorted by each component."""
        return np.argsort(self.entries.T, axis=1, kind="stable")

    @cached_property
    def masks(self) -> np.ndarray:
        """(components, entries + 1) uint64: the entries before each place of each order."""
        bits = np.uint64(1) << self.order.astype(np.uint64)
        before = np.zeros((bits.shape[0], bits.shape[1] + 1), np.uint64)
        np.bitwise_or.accumulate(bits, axis=1, out=before[:, 1:])
        return before

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each row of ``x`` the mask of the entries within ``radius`` of it in every component."""
        found = np.full(len(x), ~np.uint64(0))
        for k in range(x.shape[1]):
            values = self.entries[self.order[k], k]
            low = np.searchsorted(values, x[:, k] - radius, "left")
            high = np.searchsorted(values, x[:, k] + radius, "right")
            found &= self.masks[k][high] & ~self.masks[k][low]
        return found

    def _first_guess(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each row to an entry near by: the nearer of its two neighbours in the widest component."""
        k = int(np.argmax(self.entries.max(0) - self.entries.min(0)))
        order = self.order[k]
        place = np.searchsorted(self.entries[order, k], x[:, k])
        two = [((x - self.entries[order[np.clip(place - j, 0, len(order) - 1)]]) ** 2).sum(1) for j in (0, 1)]
        return np.minimum(*two)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row's nearest entry, ties to the lower one."""
        entry, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        if not x.shape[1]:
            return entry, np.zeros(len(x), np.int64)
        # One more than the rounded root, so that rounding never makes the radius too small.
        radius = np.sqrt(self._first_guess(x).astype(float)).astype(np.int64) + 1
        found = self.candidates(x, radius)
        for e in range(len(self.entries)):
            rows = np.flatnonzero(found >> np.uint64(e) & np.uint64(1))
            d = ((x[rows] - self.entries[e]) ** 2).sum(1)
            nearer = d < best[rows]
            best[rows[nearer]], entry[rows[nearer]] = d[nearer], e
        return entry, best


@dataclass
class Codebooks:
    """Codebooks of every part, for each length that vectors have."""

    of: dict[int, list[Codebook]]

    def digest(self, length: int) -> str:
        """Hex digest of all entries' components, by part, entry and place, in decimal and comma-joined."""
        numbers = [str(v) for book in self.of[length] for v in book.entries.ravel().tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _vectors(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers) of the vectors that take part, one length and about HELD components at a time."""
    lists = batch.column(column)
    values, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    lengths = np.diff(offsets)
    for d in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == d))
        step = max(1, HELD // max(1, d))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            x = np.floor(numbers[offsets[some][:, None] + np.arange(d)] * SCALE)
            if x.size and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST // SCALE}")
            yield some, x.astype(np.int64)


def first_codebooks(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the ``entries`` rows with the smallest vec_id of each length, ascending.

    Null ids come last, of equal ids the lesser vector first. Only these rows reach the driver. Tasks keep
    the first rows of each length and of one of 256 groups of ids before anything is shuffled.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch, 1):
                ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                v = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), v], names=["vec_id", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(whole, "vec_id long, v array<long>")
    rows = rows.select("vec_id", "v", F.size("v").alias("length"), F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("_group"))
    least = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    for group in (["length", "_group"], ["length"]):
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*least))).where(F.col("_k") <= entries)
    size, found = 0, {}
    for row in rows.orderBy("length", "_k").select("length", "v").toLocalIterator():
        size += row.length
        if size > MOST_COMPONENTS:
            raise ValueError(f"codebooks of more than {MOST_COMPONENTS} components")
        found.setdefault(row.length, []).append(row.v)
    return Codebooks({d: [Codebook(np.array(v, np.int64).reshape(len(v), d)[:, a:b]) for a, b in bounds(d, parts)] for d, v in found.items()})


def _better(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks of the means of the parts that are nearest to each entry; unused entries stay."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, x in _vectors(batch, 0):
                d = x.shape[1]
                own = books.of[d]
                if d not in sums:  # for each part: a column of counts, then one of sums for each component
                    sums[d] = [np.zeros((len(b.entries), b.entries.shape[1] + 1), np.int64) for b in own]
                for (a, b), book, total in zip(bounds(d, len(own)), own, sums[d]):
                    entry, _ = book.nearest(x[:, a:b])
                    n = len(book.entries)
                    total[:, 0] += np.bincount(entry, minlength=n)
                    for k in range(b - a):  # whole numbers below 2**53
                        total[:, k + 1] += np.bincount(entry, x[:, a + k], n).astype(np.int64)
        rows = [(d, p, e, total[e].tolist()) for d, of in sums.items() for p, total in enumerate(of) for e in np.flatnonzero(total[:, 0]).tolist()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.list_(pa.int64())])], names=["length", "part", "entry", "total"])

    rows = vectors.select("embedding").mapInArrow(totals, "length int, part int, entry int, total array<long>")
    key = ["length", "part", "entry"]
    summed = rows.select(*key, F.posexplode("total").alias("at", "x")).groupBy(*key, "at").agg(F.sum("x").alias("x"))
    found: dict[tuple[int, int, int], dict[int, int]] = {}
    for row in summed.collect():  # one row for each component of the codebooks, and one for each entry
        found.setdefault((row.length, row.part, row.entry), {})[row.at] = row.x

    def mean(d: int, part: int, e: int, old: np.ndarray) -> list[int]:
        total = found.get((d, part, e))
        return [total[k + 1] // total[0] for k in range(len(old))] if total else old.tolist()

    return Codebooks({d: [Codebook(np.array([mean(d, p, e, old) for e, old in enumerate(b.entries)], np.int64).reshape(b.entries.shape)) for p, b in enumerate(own)] for d, own in books.of.items()})


def learn(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all rows of ``vectors`` (vec_id, embedding)."""
    if not 0 < entries <= 64:
        raise ValueError("a mask holds 1 to 64 entries")
    books = first_codebooks(vectors, parts=parts, entries=entries)
    for _ in range(rounds if books.of else 0):
        books = _better(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, length, code, error) of every vector that takes part; code has a byte a part."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch, 2):
                own = books.of[x.shape[1]]
                code, error = np.zeros((len(x), len(own)), np.uint8), np.zeros(len(x), np.int64)
                for p, ((a, b), book) in enumerate(zip(bounds(x.shape[1], len(own)), own)):
                    code[:, p], d = book.nearest(x[:, a:b])
                    error += d
                take = pa.array(rows)
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(x), x.shape[1], np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=["vec_id", "label", "length", "code", "error"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(coded, f"vec_id long, label {kind}, length int, code binary, error long")


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, label) of the rows of ``vectors`` (vec_id, embedding, label and any other columns).

    Rows whose vector is null or holds null or non-finite components are left out; a component beyond
    LARGEST / SCALE in size is an error, as squared distances would not fit into 64 bits. Vectors of each
    length have codebooks of their own; a length that ``parts`` doesn't divide has parts that differ by one
    component, and an empty part has code 0. Rows without vec_id or label are kept, null labels counting as one
    label; repeated rows are vectors of their own. If there are fewer rows than entries, there are fewer entries.
    Equally near entries go to the lower number. An empty table gives an empty result.
    """
    books = learn(vectors, parts=parts, entries=entries, rounds=rounds)
    coded = cut(encode(vectors, books))  # some 40 bytes a vector
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    # One row a length of vector, which the bound on components bounds too.
    digests = vectors.sparkSession.createDataFrame([(d, books.digest(d)) for d in books.of], "length int, codebooks_sha256 string")
    whole = coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).join(F.broadcast(digests), "length")
    return whole.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256", "label")


__all__ = ["Codebook", "Codebooks", "compress", "encode", "first_codebooks", "learn"]
