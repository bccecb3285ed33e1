"""Toxicity by a classifier chain of sparse linear models.

The chain takes label columns in order. The model of each category sees the words of a document and the
probabilities of the categories before it. For training these are out-of-fold: each labelled document's
probability comes from a model that was fitted without it, as it will be for documents to come.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_of, slices, utf8
from tessera.llm.labels import labelled_sample

#: Lower case for A-Z, the other ASCII characters that aren't letters become spaces, bytes of other letters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


#: Bytes of the word stems that are features beside whole words: rare and new forms share them.
STEMS = (4, 5, 6, 7)
#: Bound on the labelled documents that the chain is fitted on; their word hashes reach the driver.
MAX_LABELLED = 5_000


#: Bytes of text whose words a task holds at once (or one longer text).
SLICE_BYTES = 2 << 20
#: Words that are looked up at once.
STEP = 1 << 18


def words_of(text: bytes) -> np.ndarray:
    """The distinct words of a text and the stems they begin with, as 64-bit hashes."""
    words = set(text.translate(_LETTERS).split())
    stems = {w[:k] + b"*" for k in STEMS for w in words if len(w) > k}
    return np.array([xxhash.xxh64_intdigest(w) for w in words | stems], np.uint64)


class Bags:
    """The words of several documents: ``words[i]`` stands in document ``doc[i]`` of ``n``."""

    def __init__(self, bags: list[np.ndarray]):
        self.n = len(bags)
        self.words = np.concatenate(bags) if bags else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(b) for b in bags]) if bags else np.zeros(0, np.int32)

    @classmethod
    def of(cls, words: np.ndarray, sizes: np.ndarray) -> Bags:
        """``words`` of all documents in a row, as many of each as ``sizes`` says."""
        out = cls([])
        out.n, out.words, out.doc = len(sizes), words, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        return out

    def numbered(self, vocabulary: np.ndarray) -> Bags:
        """The words that the sorted ``vocabulary`` has, as positions in it."""
        out = Bags([])
        out.n = self.n
        if len(vocabulary) and len(self.words):
            places, docs = [], []
            for k in range(0, len(self.words), STEP):
                own = self.words[k : k + STEP]
                at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
                hit = vocabulary[at] == own
                places.append(at[hit].astype(np.int32))
                docs.append(self.doc[k : k + STEP][hit])
            out.words, out.doc = np.concatenate(places), np.concatenate(docs)
        else:
            out.words = np.zeros(0, np.int32)
        return out

    def take(self, mask: np.ndarray) -> Bags:
        """The documents that ``mask`` names, counted anew."""
        out = Bags([])
        keep = mask[self.doc]
        out.n, out.words = int(mask.sum()), self.words[keep]
        out.doc = (np.cumsum(mask) - 1).astype(np.int32)[self.doc[keep]]
        return out


@dataclass
class Link:
    """One model of the chain: weights of its words, of the probabilities before it, and its intercept."""

    category: str
    words: np.ndarray  # sorted hashes; while fitting, numbers of words
    weights: np.ndarray
    chained: np.ndarray
    intercept: float

    def probability(self, bags: Bags, before: np.ndarray) -> np.ndarray:
        own = bags.numbered(self.words)
        margin = np.bincount(own.doc, self.weights[own.words], bags.n) + before @ self.chained + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


@dataclass
class Chain:
    """``threshold``: above which probability of the last category a document belongs to it."""

    links: list[Link]
    threshold: float = 0.5

    def probabilities(self, bags: Bags) -> np.ndarray:
        out = np.zeros((bags.n, 0))
        for link in self.links:
            out = np.column_stack([out, link.probability(bags, out)])
        return out


def _fit_link(category: str, bags: Bags, seen: int, before: np.ndarray, y: np.ndarray, *, vocabulary: int, least: int, l2: float, steps: int) -> Link:
    """A logistic model of the words, numbered below ``seen``, that tell the classes apart best, by accelerated
    gradient descent. The link's words are numbers."""
    n = bags.n
    rate = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    ones = np.bincount(bags.words, y[bags.doc], seen)
    all_ = np.bincount(bags.words, minlength=seen)
    p = (ones + 0.5) / (max(1.0, y.sum()) + 1)
    q = (all_ - ones + 0.5) / (max(1.0, n - y.sum()) + 1)
    strength = np.where(all_ >= least, np.abs(np.log(p / q)) * np.sqrt(np.minimum(1, p + q)), -1)
    order = np.lexsort((np.arange(seen), -strength))[:vocabulary]
    chosen = np.sort(order[strength[order] > 0])
    own = bags.numbered(chosen)
    i, j, v = own.doc, own.words, len(chosen)
    w = np.zeros(v + before.shape[1] + 1)
    w[-1] = np.log(rate / (1 - rate))
    look, momentum = w.copy(), 1.0
    # The step follows a bound on the curvature: a quarter of nearly the largest squared norm of a row.
    squares = np.bincount(i, minlength=n) + (before**2).sum(1) + 1 if n else np.ones(1)
    step = 1 / (0.25 * np.quantile(squares, 0.99) + l2)
    for _ in range(steps if n else 0):
        margin = np.bincount(i, look[j], n) + before @ look[v:-1] + look[-1]
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        grad = np.concatenate([np.bincount(j, error[i], v), before.T @ error, [error.sum()]]) / n
        grad[:-1] += l2 * look[:-1]
        new = look - step * grad
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return Link(category, chosen, w[:v], w[v:-1], float(w[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut through probabilities ``p`` with the best F1 for ``y``, in the middle of the widest best gap; 0.5 without both classes."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    below = np.append(p[order][1:], 0.0)
    gap = np.where(np.isclose(f1, f1[p[order] > below].max(initial=0)), p[order] - below, -1)
    k = int(gap.argmax())
    return float((p[order][k] + below[k]) / 2)


def fit_chain(bags: Bags, targets: dict[str, np.ndarray], *, folds: np.ndarray, vocabulary: int = 500, least: int = 4, l2: float = 2e-5, steps: int = 300) -> Chain:
    """Fit the categories in the order of ``targets``; ``folds`` names each document's fold.

    ``vocabulary``: words of a link, those that tell its classes apart best; ``least``: documents that have
    to hold a word. The threshold is chosen on the out-of-fold probabilities of the last category.
    """
    options = {"vocabulary": vocabulary, "least": least, "l2": l2, "steps": steps}
    hashes, counts = np.unique(bags.words, return_counts=True)
    hashes = hashes[counts >= least]
    bags = bags.numbered(hashes)
    before, links = np.zeros((bags.n, 0)), []
    for category, y in targets.items():
        links.append(_fit_link(category, bags, len(hashes), before, y, **options))
        out = np.zeros(bags.n)
        for f in np.unique(folds):
            own, rest = folds == f, folds != f
            link = _fit_link(category, bags.take(rest), len(hashes), before[rest], y[rest], **options)
            out[own] = link.probability(bags.take(own), before[own])
        before = np.column_stack([before, out])
    for link in links:
        link.words = hashes[link.words]
    return Chain(links, best_threshold(before[:, -1], y) if links else 0.5)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], *, where: Column | None = None, limit: int = MAX_LABELLED, folds: int = 3, **options) -> Chain:
    """Fit on at most ``limit`` labelled documents, whose distinct words reach the driver as hashes."""

    @F.arrow_udf("binary")
    def bag(texts: pa.Array) -> pa.Array:
        return pa.array([words_of(t).tobytes() for t in utf8(texts)], pa.binary())

    sample = labelled_sample(docs, labels, categories, where=where, limit=limit)
    rows = sample.select("doc_id", *categories, bag("text").alias("bag")).toArrow()
    rows = rows.take(pc.sort_indices(rows.column("doc_id")))
    fold = np.array([zlib.crc32(str(i).encode()) % folds for i in rows.column("doc_id").to_pylist()], np.int64)
    y = {c: rows.column(c).to_numpy().astype(float) for c in categories}
    # The hashes stay where Arrow has put them: no object a document, no second copy.
    held = rows.column("bag").combine_chunks().cast(pa.large_binary())
    places = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, 8 * held.offset) if len(held) else np.zeros(1, np.int64)
    words = np.frombuffer(held.buffers()[2], np.uint8)[places[0] : places[-1]].view(np.uint64) if places[-1] > places[0] else np.zeros(0, np.uint64)
    return fit_chain(Bags.of(words, np.diff(places) // 8), y, folds=fold, **options)


def probabilities(text: Column, chain: Chain) -> Column:
    """Array of the probabilities of all categories; a null text counts as empty, a text of any length is read whole."""
    n = len(chain.links)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def predict(texts: pa.Array) -> pa.Array:
        some = slices(pa.record_batch({"text": texts}), 0, SLICE_BYTES)
        p = np.concatenate([np.zeros((0, n)), *(chain.probabilities(Bags([words_of(t) for t in utf8(s.column(0))])) for s in some)])
        return pa.FixedSizeListArray.from_arrays(pa.array(p.ravel(), pa.float64()), n).cast(pa.list_(pa.float64()))

    return predict(text.cast("string"))


def score(docs: DataFrame, chain: Chain, *, threshold: float | None = None) -> DataFrame:
    """``docs`` with a probability p_<category> for each category and toxic_predicted for the last one.

    A null text counts as empty; every row, repeated ones too, keeps its columns and gets its own scores.
    An empty table stays empty. ``docs`` must not have these columns yet. ``threshold``: the chain's own,
    if none is given.
    """
    names = [f"p_{link.category}" for link in chain.links]
    free_of(docs, *names, "toxic_predicted")
    at = chain.threshold if threshold is None else threshold
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), probabilities(F.col("text"), chain).alias("p"))
    return row.select("row.*", *[F.col("p")[k].alias(n) for k, n in enumerate(names)], (F.col("p")[len(names) - 1] > at).cast("int").alias("toxic_predicted"))
