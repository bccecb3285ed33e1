"""Document quality by histogram gradient-boosted trees over statistics of the text.

Statistics are computed from the bytes of the whole text in Arrow batches. The trees are grown on the
driver over quantile-binned statistics of a bounded labelled sample; they are complete binary trees, so
the whole ensemble lies in three flat arrays and numpy walks all rows down all trees level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_of, slices, utf8
from tessera.llm.labels import MAX_LABELLED, labelled_sample

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "spread_word", "longest_word", "distinct_words", "distinct_pairs",
    "repeated_word", "short_words", "bytes_a_line", "distinct_lines", "upper", "lower", "digit", "space", "non_ascii",
    "full_stop", "exclamation", "bar", "symbol", "quote", "slash", "at_hash", "entropy", "capital_words", "last_stop",
)

_CLASSES = np.zeros((256, 12))
for _c in range(256):
    _ch = chr(_c)
    for _k, _in in enumerate(
        (
            "A" <= _ch <= "Z", "a" <= _ch <= "z", "0" <= _ch <= "9", _c == 32 or 9 <= _c <= 13, _c >= 128, _ch in ".,;:", _ch == "!",
            _ch == "|", _ch in "$%&*+=<>~^_", _ch in "\"'`", _ch in "/\\", _ch in "@#",
        )
    ):
        _CLASSES[_c, _k] = _in


def statistics(text: bytes) -> list[float]:
    """The numbers a score depends on; an empty text has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    words, lines = text.split(), text.split(b"\n")
    n, w = len(text), max(1, len(words))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = (counts @ _CLASSES) / n
    p = counts[counts > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    after = words[1:]
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(set(words)) / w, len(set(zip(words, after))) / max(1, w - 1), sum(map(bytes.__eq__, words, after)) / w,
        float((lengths <= 3).mean()), np.log1p(n / len(lines)), len(set(lines)) / len(lines), *share[:5], *share[5:12],
        float(-(p * np.log2(p)).sum()), sum(map(bytes.isupper, words)) / w, float(text.rstrip()[-1:] in (b".", b"!", b"?")),
    ]


@dataclass
class Trees:
    """``depth`` levels of tests and then leaves: node k has children 2k+1 and 2k+2."""

    start: float
    depth: int
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # go right if the value is above
    leaf: np.ndarray  # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 2.0, least: int = 5) -> Trees:
    """Boosted trees for labels 0 and 1 by logistic loss; without rows every score is 0.5."""
    nodes = 2**depth - 1
    if not len(x):
        return Trees(0.0, depth, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)  # bin > b: value > edge b
    rate_1 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate_1 / (1 - rate_1)))
    margin = np.full(len(x), start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            at = node - first
            best = np.full(wide, 1e-9)
            for f in range(x.shape[1]):
                key, size = at * bins + binned[:, f], wide * bins
                gs = np.bincount(key, g, size).reshape(wide, bins).cumsum(1)
                hs = np.bincount(key, h, size).reshape(wide, bins).cumsum(1)
                ns = np.bincount(key, minlength=size).reshape(wide, bins).cumsum(1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(ns < least) | (nt - ns < least)] = 0
                gain[:, len(edges[f]) :] = 0
                b = gain.argmax(1)
                top = gain[np.arange(wide), b]
                for k in np.flatnonzero(top > best):
                    best[k], feature[first + k], threshold[first + k] = top[k], f, edges[f][b[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        at = node - nodes
        leaf = -rate * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + l2)
        margin = margin + leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(start, depth, np.array(features), np.array(thresholds), np.array(leaves))


def _texts(texts: pa.Array) -> Iterator[bytes]:
    """The texts one after the other, a few megabytes of them as Python bytes at a time."""
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0, 4 << 20):
        yield from utf8(part.column(0))


def train(docs: DataFrame, labels: DataFrame, *, where: Column | None = None, limit: int = MAX_LABELLED, **options) -> Trees:
    """Fit on at most ``limit`` labelled documents; only their statistics reach the driver.

    Without labels or without documents every score is 0.5. Null texts count as empty, texts are read whole.
    """

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in _texts(texts)], pa.list_(pa.float64()))

    sample = labelled_sample(docs, labels, ["quality"], where=where, limit=limit)
    rows = sample.select("doc_id", "quality", stats("text").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return fit(x, rows["quality"].to_numpy(float), **options)


def good(text: Column, model: Trees) -> Column:
    """The score of a text from 0 to 1; a null text counts as empty, a text of any length is read whole."""

    @F.arrow_udf("double")
    def predict(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in _texts(texts)], float).reshape(-1, len(STATISTICS))
        return pa.array(model.predict(x), pa.float64())

    return predict(text.cast("string"))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with score and predicted: 1 for good documents (score 0.5 and above), else 0.

    A null text counts as empty; every row, repeated ones too, keeps its columns and gets its own score.
    An empty table stays empty. ``docs`` must not have these two columns yet.
    """
    free_of(docs, "score", "predicted")
    return docs.withColumn("score", good(F.col("text"), model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
