"""Nearest neighbours by inner product: inverted lists scanned with an adaptive number of dimensions.

Vectors get one more component that makes their lengths equal, so the largest inner product is the least
distance, and all are turned by one random rotation, after which any leading components are a fair
sample of the distance. Lists come from k-means on a bounded sample; every vector is in the list of its
nearest centre. Within a probed list the components are read in column blocks: after each block a test
asks whether a candidate's distance so far could still end below the query's threshold, and the others
are abandoned. What is left is compared exactly on the vectors as given.

How many lists a query probes is measured: the true neighbours of some sampled queries are found by
comparing them to every row, and the least number of lists that holds enough of them is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm.common import cut

#: Bounds of the sample that lists are fitted on, in rows (or so many a list) and bytes; of the lists; of the
#: rows that give each query its first threshold, an eighth of the sample at most; of the queries whose true neighbours are found.
SAMPLE_ROWS, ROWS_A_LIST, SAMPLE_BYTES, LISTS, FIRST_ROWS, MEASURED = 20_000, 4, 128 << 20, 65_536, 4096, 64
#: Numbers of a matrix of distances that is held at once.
HELD = 8 << 20
#: Vectors of a list, and queries, that one task compares at most; queries that it compares at once.
PART, QUERIES = 2048, 256
#: Components in a column block, and how sure the test is (as a multiple of the deviation).
BLOCK, SURE = 16, 2.1


@dataclass
class Index:
    longest: float
    rotation: np.ndarray
    centres: np.ndarray  # rotated
    first_ids: np.ndarray
    first: np.ndarray  # rows as given, for the first threshold
    probes: int = 1

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.column_stack([x, more]) @ self.rotation

    def nearest_lists(self, y: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` lists nearest to each rotated row, nearest first."""
        step = max(1, HELD // len(self.centres))
        return np.concatenate([self._nearest(y[at : at + step], k) for at in range(0, max(1, len(y)), step)])

    def _nearest(self, y: np.ndarray, k: int) -> np.ndarray:
        d = (self.centres**2).sum(1) - 2 * y @ self.centres.T
        if k == 1:
            return d.argmin(1)[:, None]
        some = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        return np.take_along_axis(some, np.take_along_axis(d, some, 1).argsort(1, kind="stable"), 1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite numbers, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    step = max(1, HELD // k)
    for _ in range(rounds):
        own = np.concatenate([((centres**2).sum(1) - 2 * x[at : at + step] @ centres.T).argmin(1) for at in range(0, len(x), step)])
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


def build(rows: DataFrame, d: int, count: int, longest: float, k: int, *, seed: int = 0) -> Index:
    """Fit about as many lists as the root of ``count``, on a sample of the rows (id, v), the first by a hash of their id.

    The sample has SAMPLE_ROWS rows, more only if there are so many lists, and SAMPLE_BYTES bytes at most.
    """
    wanted = int(np.clip(round(count**0.5), 1, LISTS))
    limit = int(max(256, min(max(SAMPLE_ROWS, ROWS_A_LIST * wanted), SAMPLE_BYTES // (8 * d))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(limit).toArrow()
    x = _matrix(sample.column("v").combine_chunks(), d)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d + 1, d + 1)))[0]
    ids = sample.column("id").to_numpy()
    one = np.sort(np.unique(ids, return_index=True)[1])  # one row an id, or the k-th best would not be k ids
    one = one[: max(4 * k, min(FIRST_ROWS, len(one) // 8))]
    index = Index(longest, rotation, np.zeros((0, d + 1)), ids[one], x[one])
    index.centres = _kmeans(index.rotated(x), min(wanted, len(x)), 8, seed)
    return index


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best ids of each query, each id with its best score: higher score, then smaller id."""
    order = np.lexsort((-score, ids, query))
    again = (query[order][1:] == query[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    order = order[np.concatenate([[True], ~again])] if len(order) else order
    order = order[np.lexsort((ids[order], -score[order], query[order]))]
    q = query[order]
    first = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def scan(index: Index, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, threshold: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of the best of one part of a list for some queries.

    ``threshold``: a score that each query's k-th best is known to reach.
    """
    y, z = index.rotated(x), index.rotated(q, query=True)
    dims = y.shape[1]
    reach = (q**2).sum(1) + index.longest**2
    alive = query_ids[:, None] != ids[None, :]
    done = min(BLOCK, dims)
    part = (z[:, :done] ** 2).sum(1)[:, None] + (y[:, :done] ** 2).sum(1)[None, :] - 2 * z[:, :done] @ y[:, :done].T
    # The nearest so far, one row an id, are compared in full at once: their k-th score can only raise the threshold.
    one = np.unique(ids, return_index=True)[1]
    if len(one) > k:
        look = np.where(alive, part, np.inf)[:, one]
        near = one[np.argpartition(look, k - 1, axis=1)[:, :k]]
        exact = np.einsum("ijk,ik->ij", x[near], q)
        exact[~np.take_along_axis(alive, near, 1)] = -np.inf
        threshold = np.maximum(threshold, exact.min(1))
    limit = np.maximum(reach - 2 * threshold, 0)

    def bound(n: int) -> np.ndarray:
        return limit * (n / dims) * (1 + SURE / np.sqrt(n)) ** 2 + 1e-9 * reach

    i, j = np.nonzero(alive & (part <= bound(done)[:, None]))
    so_far = part[i, j]
    while done < dims and len(i):
        more = slice(done, done + BLOCK)
        so_far = so_far + ((z[i, more] - y[j, more]) ** 2).sum(1)
        done = min(done + BLOCK, dims)
        keep = so_far <= (bound(done) if done < dims else limit + 1e-9 * reach)[i]
        i, j, so_far = i[keep], j[keep], so_far[keep]
    score = np.einsum("ij,ij->i", q[i], x[j])
    best = _top(i, ids[j], score, k)
    return i[best], j[best], score[best]


def _assign(rows: DataFrame, index: Index, d: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = index.nearest_lists(index.rotated(_matrix(b.column(1), d)), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.int32())], names=["id", "v", "list"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, list int")


def _probing(queries: DataFrame, index: Index, d: int, k: int) -> DataFrame:
    """(query_id, q, threshold, list): one row for each list that a query probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                q, ids = _matrix(some.column(1), d), some.column(0).to_numpy(zero_copy_only=False)
                score = q @ index.first.T
                score[ids[:, None] == index.first_ids[None, :]] = -np.inf
                # A hair below, for sums that are rounded in another order.
                known = np.partition(score, -k, axis=1)[:, -k] - 1e-9 * index.longest * np.sqrt((q**2).sum(1)) if score.shape[1] >= k else np.full(len(q), -np.inf)
                known = np.where(np.isfinite(known), known, -(index.longest**2) - (q**2).sum(1))
                lists = index.nearest_lists(index.rotated(q, query=True), min(index.probes, len(index.centres)))
                every = pa.array(np.repeat(np.arange(len(q)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(every), some.column(1).take(every), pa.array(np.repeat(known, lists.shape[1])), pa.array(lists.ravel(), pa.int32())],
                    names=["query_id", "q", "threshold", "list"],
                )

    return queries.select("id", "v").mapInArrow(run, "query_id long, q array<double>, threshold double, list int")


def _of_first(queries: DataFrame, index: Index, d: int, k: int) -> DataFrame:
    """The best of the rows that gave the thresholds, for queries whose lists hold fewer than ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                q, ids = _matrix(some.column(1), d), some.column(0).to_numpy(zero_copy_only=False)
                score = q @ index.first.T
                score[ids[:, None] == index.first_ids[None, :]] = -np.inf
                n = min(k, score.shape[1])
                j = np.argpartition(-score, n - 1, axis=1)[:, :n]
                i = np.repeat(np.arange(len(q)), n)
                j = j.ravel()
                exact = np.einsum("ij,ij->i", q[i], index.first[j])
                keep = np.isfinite(score[i, j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i][keep], pa.int64()), pa.array(index.first_ids[j][keep], pa.int64()), pa.array(exact[keep])],
                    names=["query_id", "vec_id", "score"],
                )

    return queries.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def _measure(rows: DataFrame, queries: DataFrame, index: Index, d: int, k: int, recall: float) -> int:
    """Lists to probe so that the sampled queries find ``recall`` of their true neighbours."""
    some = queries.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(MEASURED).toArrow()
    if not some.num_rows:
        return 1
    q, own = _matrix(some.column("v").combine_chunks(), d), some.column("id").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            score = q @ _matrix(b.column(1), d).T
            i, j = np.nonzero(own[:, None] != ids[None, :])
            best = _top(i, ids[j], score[i, j], k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[best], pa.int64()), b.column(0).take(pa.array(j[best])), pa.array(score[i, j][best]), b.column(2).take(pa.array(j[best]))],
                names=["i", "id", "score", "list"],
            )

    true = rows.select("id", "v", "list").mapInArrow(run, "i long, id long, score double, list int")
    best = Window.partitionBy("i").orderBy(F.desc("score"), "id")
    true = true.groupBy("i", "id").agg(F.max(F.struct("score", "list")).alias("b")).select("i", "id", "b.*")
    found = true.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("i", "list").toPandas()
    if found.empty:
        return 1
    order = index.nearest_lists(index.rotated(q, query=True), len(index.centres))
    place = np.argsort(order, axis=1)
    ranks = np.sort(place[found["i"], found["list"]]) + 1
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)])


def search(vectors: DataFrame, queries: Column, *, k: int = 20, recall: float = 0.98, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``vectors`` in ``queries``.

    ``vectors`` has vec_id, embedding and any other columns. Candidates are all rows but those with the
    query's own id; nearer is the larger inner product, ties go to the smaller vec_id. Rows without id,
    and vectors that are null, empty, zero, or hold null or non-finite components take no part. An inner
    product needs vectors of one length, so the vectors of each length are searched among themselves.
    Rows that repeat a vec_id count once, with the best of their scores. A query with fewer than ``k``
    candidates gets all of them. An empty table gives no rows.
    """
    named = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("_query"))
    usable_rows = named.where(F.col("id").isNotNull() & usable(F.col("v")))
    good = cut(usable_rows.groupBy("id", "v").agg(F.max("_query").alias("_query")))  # rows that are repeated, once
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    kinds = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("s"), F.bool_or("_query").alias("asked")).where("asked")
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for kind in kinds.orderBy(F.desc("n"), "d").collect():  # a row a length
        own = good.where(F.size("v") == kind["d"])
        found = found.union(_search_one_length(own, kind["d"], kind["n"], float(kind["s"]) ** 0.5, k, recall, seed))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_one_length(good: DataFrame, d: int, count: int, longest: float, k: int, recall: float, seed: int) -> DataFrame:
    """(query_id, vec_id, score) of what is found among ``good`` (id, v, _query), ``count`` vectors of ``d`` components."""
    asked = good.where(F.col("_query"))
    index = build(good, d, count, longest, k, seed=seed)
    listed = cut(_assign(good, index, d))
    index.probes = _measure(listed, asked, index, d, k, recall)
    probing = cut(_probing(asked, index, d, k))

    # Long lists and lists that many queries probe are cut into parts; every part meets every part.
    many = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    parts = F.broadcast(many(listed, "rows_in").join(many(probing, "queries_in"), "list"))  # no more rows than LISTS

    def dealt(df: DataFrame, own: str, others: str, id_: str, mine: str, theirs: str) -> DataFrame:
        spread = df.join(parts, "list").withColumn(mine, F.pmod(F.xxhash64(id_, F.lit(seed)), F.col(own)).cast("int"))
        return spread.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("rows_in", "queries_in")

    rows = dealt(listed, "rows_in", "queries_in", "id", "rows", "queries")
    wanted = dealt(probing, "queries_in", "rows_in", "query_id", "queries", "rows")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, own = left.column("id").to_numpy(), right.column("query_id").to_numpy()
        x, q = _matrix(left.column("v").combine_chunks(), d), _matrix(right.column("q").combine_chunks(), d)
        limit, out, step = right.column("threshold").to_numpy(), [], max(1, QUERIES // -(-d // 64))
        for at in range(0, len(q), step):  # so that what is alive after a block stays small
            i, j, score = scan(index, ids, x, own[at : at + step], q[at : at + step], limit[at : at + step], k)
            out.append((own[at : at + step][i], ids[j], score))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=names)

    keys = ["list", "rows", "queries"]
    found = cut(rows.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double"))
    enough = found.groupBy(F.col("query_id").alias("id")).agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k)
    return found.union(_of_first(asked.join(enough, "id", "left_anti"), index, d, k))
