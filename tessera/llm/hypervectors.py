"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 of DIMENSIONS components, made from its code point, so no
table of letters is kept. An n-gram is bound from its letters' vectors, each rotated once more than the one
after it, and multiplied; a text is the sum (the bundle) of its n-grams, a language that of its documents.
A document has the language whose prototype makes the greatest cosine with it.

Texts are read whole: words are runs of letters and the marks on them in lower case, with one space around
each. Everything is a whole number until the cosine, so sums do not depend on the order of tasks.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_of, slices

DIMENSIONS, GRAM = 1024, 3
#: Prediction for texts without letters, and for all texts if no language was learned.
UNDETERMINED = "und"
#: Bytes of text that are counted at once, code points of one text likewise, n-grams that are bound at once.
SLICE, PIECE, BOUND = 1 << 20, 1 << 19, 4096
#: Languages whose bundles a task holds before it passes them on.
HELD = 64
#: Weight of a document in its language's prototype: the n-gram counts are scaled to about this length.
WEIGHT = 1 << 12
#: Languages that a model can have: their prototypes are sent to every task (8 MB at most).
MOST_LANGUAGES = 1024


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point 2 for a letter, 1 for a mark that may stand on one, 0 for the rest."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for point in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(point))[0]
        kinds[point] = 2 if category == "L" else category == "M"
    return kinds


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """(letters, dimensions) int8: the vector of +1 and -1 of each code point."""
    words = -(-dimensions // 64)
    seeds = points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    bits = np.unpackbits(_mixed(_mixed(seeds + np.uint64(0x9E3779B97F4A7C15))).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return (bits[:, :dimensions].astype(np.int8) << 1) - 1


def runs_of(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """The letters of a text in pieces: code points in lower case, one space before, between and after words.

    Each piece begins with the last GRAM - 1 code points of the one before, so that it has all n-grams that end in
    it. The flag says whether the piece has a letter.
    """
    carry = np.array([32], np.uint32)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[points]
        end = [] if at + PIECE < len(text) else [32]
        points = np.concatenate([carry, np.where(kind > 0, points, 32), end]).astype(np.uint32)
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        points = points[keep]
        yield points, bool((kind == 2).any())
        carry = points[1 - GRAM :]


def pieces_of(texts: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(text numbers, pieces, whether each has a letter) of about PIECE code points at a time."""
    held: list[tuple[int, np.ndarray, bool]] = []
    size = 0
    for k, text in enumerate(texts):
        for run, has in runs_of(text):
            held.append((k, run, has))
            size += len(run)
            if size >= PIECE:
                owners, runs, flags = zip(*held)
                yield np.array(owners), list(runs), np.array(flags)
                held, size = [], 0
    if held:
        owners, runs, flags = zip(*held)
        yield np.array(owners), list(runs), np.array(flags)


@dataclass
class Grams:
    """The distinct n-grams of some pieces: ``letters`` (code points), ``grams`` (rows of letter numbers), and of piece k
    the numbers of its n-grams and how often each comes, in ``index`` and ``times`` from ``starts[k]`` to ``starts[k + 1]``."""

    letters: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    index: np.ndarray
    times: np.ndarray

    def vectors(self, dimensions: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first n-gram, int8 vectors) of BOUND n-grams at a time: letters rotated by their place and multiplied."""
        base = letter_vectors(self.letters, dimensions)
        turned = [np.roll(base, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        for at in range(0, len(self.grams), BOUND):
            some = self.grams[at : at + BOUND]
            bound = turned[0][some[:, 0]]
            for k in range(1, GRAM):
                bound *= turned[k][some[:, k]]
            yield at, bound


def count_grams(runs: list[np.ndarray]) -> Grams:
    letters, number = np.unique(np.concatenate([*runs, np.zeros(0, np.uint32)]), return_inverse=True)
    ends = np.cumsum([len(r) for r in runs])
    size = max(1, len(letters))
    codes, owners = [], []
    for k, (run, end) in enumerate(zip(runs, ends)):
        own = number[end - len(run) : end].astype(np.int64)
        if len(own) < GRAM:
            continue
        code = own[: len(own) - GRAM + 1].copy()
        for j in range(1, GRAM):
            code = code * size + own[j : len(own) - GRAM + 1 + j]
        distinct, times = np.unique(code, return_counts=True)
        codes.append((distinct, times))
        owners.append(k)
    every, index = np.unique(np.concatenate([*[c for c, _ in codes], np.zeros(0, np.int64)]), return_inverse=True)
    sizes = np.zeros(len(runs), np.int64)
    sizes[owners] = [len(c) for c, _ in codes]
    grams = np.stack([every // size ** (GRAM - 1 - j) % size for j in range(GRAM)], axis=1)
    times = np.concatenate([*[t for _, t in codes], np.zeros(0, np.int64)])
    return Grams(letters, grams, np.concatenate([[0], np.cumsum(sizes)]), index, times)


@dataclass
class Prototypes:
    """Languages in ascending order and the bundle of each (languages, dimensions)."""

    languages: list[str]
    bundles: np.ndarray
    dimensions: int = DIMENSIONS

    def compare(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and cosine (0 if it is negative) of each text."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        bundles, has = np.zeros((len(texts), self.dimensions)), np.zeros(len(texts), bool)
        for owners, runs, flags in pieces_of(texts):
            np.logical_or.at(has, owners, flags)
            g = count_grams(runs)
            at = g.starts[:-1].copy()
            for first, bound in g.vectors(self.dimensions):
                bound = bound.astype(np.float32)  # a piece has less than 2**24 n-grams, so its sums are exact
                for k, owner in enumerate(owners):
                    stop = at[k] + np.searchsorted(g.index[at[k] : g.starts[k + 1]], first + len(bound))
                    if stop > at[k]:
                        bundles[owner] += g.times[at[k] : stop].astype(np.float32) @ bound[g.index[at[k] : stop] - first]
                        at[k] = stop
        lengths = np.linalg.norm(self.bundles, axis=1)
        unit = self.bundles / np.where(lengths > 0, lengths, 1)[:, None]
        own = np.linalg.norm(bundles, axis=1)
        cosine = (bundles @ unit.T) / np.where(own > 0, own, 1)[:, None]
        best = cosine.argmax(1)
        found = [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has)]
        return found, np.where(has, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0).tolist()


class _Sums:
    """Bundles of languages while a task adds them up."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.of: dict[str, np.ndarray] = {}

    def add(self, names: np.ndarray, runs: list[np.ndarray]) -> None:
        g = count_grams(runs)
        piece = np.repeat(np.arange(len(runs)), np.diff(g.starts))
        length = np.sqrt(np.maximum(np.bincount(piece, g.times.astype(float) ** 2, len(runs)), 1))
        scaled = np.rint(g.times * (WEIGHT / length[piece]))
        own = {name: np.flatnonzero(names[piece] == name) for name in dict.fromkeys(names.tolist())}
        for first, bound in g.vectors(self.dimensions):
            bound = bound.astype(float)
            for name, which in own.items():
                inside = which[(g.index[which] >= first) & (g.index[which] < first + len(bound))]
                # Whole numbers far below 2**53: exact in any order.
                total = np.bincount(g.index[inside] - first, scaled[inside], len(bound)) @ bound
                self.of[name] = self.of.get(name, 0) + total.astype(np.int64)

    def taken(self) -> pa.RecordBatch:
        rows, self.of = self.of, {}
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([v.tolist() for v in rows.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])


def train(docs: DataFrame, *, where: Column | None = None, dimensions: int = DIMENSIONS) -> Prototypes:
    """Prototypes of all languages in ``docs`` (text, lang and any other columns; rows for which ``where`` holds).

    All rows with a lang count, with about the same weight whatever their length; repeated rows count each time.
    A text of more than PIECE code points counts as so many pieces. Rows without lang, and null, empty or
    letterless texts, add nothing. An empty table gives no languages. Tasks add up n-gram counts of a language over
    many texts and bind each n-gram once; Spark sums the bundles by language and component. More than MOST_LANGUAGES languages are refused with a ValueError.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(dimensions)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                names = np.array(part.column(0).to_pylist(), object)
                for owners, runs, flags in pieces_of(part.column(1).to_pylist()):
                    kept = np.flatnonzero(flags)
                    if len(kept):
                        sums.add(names[owners[kept]], [runs[k] for k in kept])
                if len(sums.of) > HELD:
                    yield sums.taken()
        yield sums.taken()

    rows = docs if where is None else docs.where(where)
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = rows.mapInArrow(bundle, "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("at", "x"))
    whole = cut(sums.groupBy("lang", "at").agg(F.sum("x").alias("x")).where("x <> 0"))
    names = [r.lang for r in whole.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    bundles = np.zeros((len(names), dimensions))
    number = {name: k for k, name in enumerate(names)}
    for r in whole.collect():
        bundles[number[r.lang], r.at] = r.x
    return Prototypes(names, bundles, dimensions)


def predict(docs: DataFrame, model: Prototypes) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), by nothing but the whole text.

    Null texts and texts without a letter are ``und`` with score 0, as are all texts if ``model`` has no language.
    Of equally near languages the first by name is taken. Every row, repeated ones too, keeps its columns;
    an empty table stays empty. ``docs`` must not have these two columns yet.
    """
    free_of(docs, "lang_pred", "score")

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def compare(texts: pa.Array) -> pa.Array:
        langs: list[str] = []
        scores: list[float] = []
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0, SLICE):
            found, score = model.compare([t or "" for t in part.column(0).to_pylist()])
            langs += found
            scores += score
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    found = docs.withColumn("_compared", compare(F.col("text").cast("string")))
    return found.select(*[docs[c] for c in docs.columns], F.col("_compared.lang_pred").alias("lang_pred"), F.col("_compared.score").alias("score"))


__all__ = ["DIMENSIONS", "Prototypes", "letter_vectors", "predict", "train"]
