"""An n-gram language model learned with Spark and kept as an Elias-Fano trie that tasks map into memory.

Words and n-grams are counted in the tasks that read the text, level by level: each level's counts, made
distinct per task and packed, are shuffled to the shards of the level, whose tasks merge them and write
the shard's file into the shared folder. An n-gram is counted only if its first and its last n-1 words
are in the level below, as it can't reach the least count otherwise.

A word's probability is interpolated: its discounted relative frequency after the longest context, plus
the share the context leaves over times its probability after the shorter context; the shortest is
add-one smoothed over the words of the corpus and one unknown.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame

from tessera.llm import trie
from tessera.llm.common import new_shared_path, slices, split_words

#: Stands for the end of a text; no word holds white space.
END = xxhash.xxh64_intdigest(b"\n")
#: N-grams of a shard, by how many there can be before they are merged; tokens that a task holds at once.
SHARD_TOKENS, RUN_TOKENS = 3_000_000, 3_000_000
#: N-grams that stand more seldom are left out of the levels above words.
LEAST = 2
#: Bins per shard in which the weight of contexts is reported.
BINS = 64


@dataclass
class Level:
    """Ranges of a level's shards: keys from ``start`` on, contexts from ``context`` on, nodes from ``node`` on."""

    start: np.ndarray
    context: np.ndarray
    node: np.ndarray
    split: np.ndarray  # contexts in more than one shard, ascending, and their whole shares
    split_share: np.ndarray


@dataclass
class Model:
    uri: str
    order: int
    word_start: np.ndarray  # first hash of each vocabulary shard
    word_node: np.ndarray  # first word id of each
    words: int = 0
    tokens: int = 0
    docs: int = 0
    levels: list[Level] = field(default_factory=list)

    def file(self, level: int, shard: int) -> dict[str, np.ndarray]:
        return _mapped(f"{self.uri}/level{level}-{shard}")

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (-1: unknown) and counts of word hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        cuts = np.searchsorted(hashes[order], self.word_start[1:])
        for shard, own in enumerate(np.split(order, cuts)):
            if len(own) and self.word_node[shard + 1] > self.word_node[shard]:
                known = self.file(1, shard)
                at = np.minimum(np.searchsorted(known["hash"], hashes[own]), len(known["hash"]) - 1)
                hit = known["hash"][at] == hashes[own]
                ids[own[hit]] = self.word_node[shard] + at[hit]
                counts[own[hit]] = known["count"][at[hit]]
        return ids, counts

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node (-1: none), discounted probability and left-over share of each context -> word.

        Negative contexts and words are unknown: their share is whole.
        """
        ranges = self.levels[level - 2]
        node, p, left = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.ones(len(word))
        some = np.flatnonzero(context >= 0)
        shards = np.searchsorted(ranges.start, context[some] * self.words + np.maximum(word[some], 0), side="right") - 1
        order = np.argsort(shards, kind="stable")
        some, shards = some[order], shards[order]
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for own, shard in zip(np.split(some, cuts), shards[np.concatenate([[0], cuts])] if len(some) else ()):
            a = self.file(level, int(shard))
            of, back = np.unique(context[own], return_inverse=True)
            local = of - ranges.context[shard]
            share = a["share"][local] / trie.WHOLE
            if len(ranges.split):
                at = np.minimum(np.searchsorted(ranges.split, of), len(ranges.split) - 1)
                share = np.where(ranges.split[at] == of, ranges.split_share[at], share)
            left[own] = (1 - np.minimum(share, 1))[back]
            first, end = trie.ef_get(a, local), trie.ef_get(a, local + 1)
            known = word[own] >= 0
            at = trie.find_successors(a["ids"], first[back], np.where(known, end[back], first[back]), word[own])
            hit = at >= 0
            node[own[hit]] = ranges.node[shard] + at[hit]
            p[own[hit]] = 10.0 ** (a["code"][at[hit]].astype(float) / -trie.STEP)
        return node, p, left


@functools.cache
def _mapped(uri: str) -> dict[str, np.ndarray]:
    return trie.map_arrays(uri)


@dataclass
class Text:
    """Tokens of several documents: word ids, counts, document of each, and which of them are first."""

    word: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def before(self, values: np.ndarray, start: int) -> np.ndarray:
        """``values`` of the token before, ``start`` for a document's first."""
        out = np.concatenate([[start], values[:-1]])
        out[self.first] = start
        return out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the number of each word of all texts, words of each text."""
    words, sizes = split_words(texts)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    return hashes, words.indices.to_numpy().astype(np.int64), sizes


def read(model: Model, texts: pa.Array) -> Text:
    hashes, codes, sizes = _words(texts)
    ids, counts = model.lookup(np.append(hashes, np.uint64(END)))
    ends = np.cumsum(sizes + 1) - 1
    codes_all = np.full(len(codes) + len(texts), len(hashes), np.int64)
    inside = np.ones(len(codes_all), bool)
    inside[ends] = False
    codes_all[inside] = codes
    return Text(ids[codes_all], counts[codes_all], np.repeat(np.arange(len(texts)), sizes + 1), np.concatenate([[0], ends[:-1] + 1]) if len(texts) else ends)


def nodes_of(model: Model, text: Text, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the levels 2 .. ``upto``: node, discounted probability and left-over share of every token."""
    context = text.before(text.word, model.words)  # a number above all words stands for a text's start
    for level in range(2, upto + 1):
        node, p, left = model.find(level, context, text.word)
        yield node, p, left
        context = text.before(node, -1)


def _runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[list[pa.RecordBatch], pa.Array]]:
    """Slices of the input of about RUN_TOKENS tokens."""
    held: list[pa.RecordBatch] = []
    size = 0

    def texts() -> pa.Array:
        return pc.fill_null(pa.concat_arrays([b.column(column) for b in held]), "")

    for batch in batches:
        for some in slices(batch, column, RUN_TOKENS):
            held.append(some)
            size += pc.sum(pc.binary_length(some.column(column))).as_py() or 0
            if size > 6 * RUN_TOKENS:
                yield held, texts()
                held, size = [], 0
    if held:
        yield held, texts()


def _emit(keys: np.ndarray, counts: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Packed counts of ascending keys by the shard they belong to."""
    cuts = np.searchsorted(keys, start[1:].astype(keys.dtype))
    shards, blobs = [], []
    for shard, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts))):
        if len(k):
            shards.append(shard)
            blobs.append(trie.pack_counts(k, c))
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


_REPORT = "shard int, nodes long, tokens long, bins array<long>, hot array<long>, hot_count array<long>, first_context long, last_context long, first_share double, last_share double"


def _report(shard: int, counts: np.ndarray, hot: int, arrays: dict[str, np.ndarray] | None = None, contexts: tuple[int, int] = (0, 0)) -> pa.Table:
    """What the driver needs to know of a shard: sizes, weights, and the shares of its outer contexts."""
    at = np.flatnonzero(counts >= hot)
    rest = counts.copy()
    rest[at] = 0
    bins = np.add.reduceat(np.append(rest, 0), np.minimum(np.arange(BINS) * len(rest) // BINS, len(rest))) if len(rest) >= BINS else np.pad(rest, (0, BINS - len(rest)))
    share = arrays["share"] / trie.WHOLE if arrays else np.zeros(1)
    row = [shard, len(counts), int(counts.sum()), bins.tolist(), at.tolist(), counts[at].tolist(), *contexts, float(share[0]), float(share[-1])]
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in _REPORT.split(", ")]
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


def _boundaries(reports: list, first: np.ndarray, words: int, shards: int, extra: tuple[int, int] | None = None) -> np.ndarray:
    """Keys at which the next level is cut, so that its shards get about the same weight.

    The weight of a context is how often it stands in the corpus; that of a hot one is spread over its
    successors, whose ids are as good as random.
    """
    places, weights = [], []  # (context as a fraction), weight up to the next
    for r in reports:
        base, n = int(first[r.shard]), r.nodes
        width = max(1.0, n / BINS)
        events = [(base + k * width, w) for k, w in enumerate(r.bins) if w]
        for at, w in zip(r.hot, r.hot_count):
            events += [(base + at, 0), (base + at, w), (base + at + 1, 0)]
        events.sort(key=lambda e: e[0])
        places += [e[0] for e in events]
        weights += [e[1] for e in events]
    if extra:
        places += [extra[0], extra[0] + 1]
        weights += [extra[1], 0]
    if not places or not sum(weights):
        return np.zeros(1, np.int64)
    total = np.concatenate([[0], np.cumsum(weights)])
    x = np.array([*places, places[-1] + 1], float)
    wanted = np.arange(1, shards) * total[-1] / shards
    cut = np.interp(wanted, total, x)
    keys = np.floor(cut).astype(np.int64) * words + ((cut % 1) * words).astype(np.int64)
    return np.unique(np.concatenate([[0], keys]))


def train(docs: DataFrame, *, order: int = 3, least: int = LEAST, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Learn from the texts of ``docs`` (a null text is empty). Without documents the model knows no word.

    Repeated rows count each time; a text of any length is read whole, RUN_TOKENS tokens or one text at a time; other columns
    than text are not looked at. A key is a context times the number of words plus a word; an OverflowError says that a
    corpus has too many of them for 63 bits. The driver keeps a few hundred numbers for each shard.
    """
    spark = docs.sparkSession
    texts = docs.select(docs.text.cast("string").alias("text"))
    n = max(8, 2 * texts.rdd.getNumPartitions())
    starts = np.array([(k << 64) // n for k in range(n)], np.uint64)
    model = Model(new_shared_path(spark, "lm"), order, starts, np.zeros(n + 1, np.int64))
    uri = model.uri

    def folder() -> None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _runs(batches):
            hashes, codes, _ = _words(some)
            hashes = np.append(hashes, np.uint64(END))
            counts = np.append(np.bincount(codes, minlength=len(hashes) - 1), len(some))
            at = np.argsort(hashes)
            yield _emit(hashes[at], counts[at], starts)

    def build_words(key: tuple, rows: pa.Table) -> pa.Table:
        hashes, counts = trie.merge_counts(rows.column("blob").to_pylist())
        folder()
        shard = key[0].as_py()
        trie.write_arrays(f"{uri}/level1-{shard}", {"hash": hashes, "count": trie.narrow(counts, "<u4", "<u8")})
        return _report(shard, counts, max(1000, int(counts.sum()) // 50))

    counted = texts.mapInArrow(count_words, "shard int, blob binary")
    reports = sorted(counted.groupBy("shard").applyInArrow(build_words, _REPORT).collect(), key=lambda r: r.shard)
    sizes = np.zeros(n, np.int64)
    sizes[[r.shard for r in reports]] = [r.nodes for r in reports]
    model.word_node = np.concatenate([[0], np.cumsum(sizes)])
    model.words, model.tokens = int(model.word_node[-1]), sum(r.tokens for r in reports)
    if not model.words:
        model.order = 1
        return model
    model.docs = int(model.lookup(np.array([END], np.uint64))[1][0])
    first, extra = model.word_node, (model.words, model.docs)
    for level in range(2, order + 1):
        shards = max(1, round(model.tokens / shard_tokens))
        start = _boundaries(reports, first, model.words, shards, extra)
        reports = _build_level(texts, model, level, start, least)
        if not reports:
            model.order = level - 1
            break
        first, extra = model.levels[-1].node, None
    return model


def _build_level(texts: DataFrame, model: Model, level: int, start: np.ndarray, least: int) -> list:
    words = model.words
    last = words if level == 2 else int(model.levels[-1].node[-1]) - 1  # the last context there is
    if (last + 1) * words >= 1 << 63:
        raise OverflowError(f"{last + 1} contexts of {words} words are too many for a key of 63 bits")

    def range_of(shard: int) -> tuple[int, int]:
        """First and last context of a shard."""
        return int(start[shard] // words), int((start[shard + 1] - 1) // words) if shard + 1 < len(start) else last

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _runs(batches):
            text = read(model, some)
            context = text.before(text.word, words)
            ok = np.ones(len(context), bool)
            for node, _, _ in nodes_of(model, text, level - 1):
                ok = node >= 0  # the last words stand on the level below
                context = text.before(node, -1)
            keep = ok & (context >= 0) & (text.word >= 0)
            keys, counts = np.unique(context[keep] * words + text.word[keep], return_counts=True)
            if len(keys):
                yield _emit(keys, counts, start)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = trie.merge_counts(rows.column("blob").to_pylist())
        keys = keys.astype(np.int64)
        low, high = range_of(shard)
        arrays = trie.build_shard(keys, counts, _counts_of(model, level - 1, low, high + 1), low, words, least)
        trie.write_arrays(f"{model.uri}/level{level}-{shard}", arrays)
        own = arrays["count"].astype(np.int64)
        return _report(shard, own, max(1000, int(own.sum()) // 50), arrays, (low, high))

    counted = texts.mapInArrow(count, "shard int, blob binary")
    reports = sorted(counted.groupBy("shard").applyInArrow(build, _REPORT).collect(), key=lambda r: r.shard)
    if not reports:
        return []
    used = [r.shard for r in reports]
    sizes = np.zeros(len(start), np.int64)
    sizes[used] = [r.nodes for r in reports]
    shares: dict[int, float] = {}
    for r in reports:
        for context, share in {r.first_context: r.first_share, r.last_context: r.last_share}.items():
            shares.setdefault(context, 0.0)
            shares[context] += share
    split = np.array(sorted(shares), np.int64)
    ranges = Level(start, start // words, np.concatenate([[0], np.cumsum(sizes)]), split, np.array([shares[c] for c in split.tolist()]))
    model.levels.append(ranges)
    for shard in set(range(len(start))) - set(used):  # no n-gram fell into these, but they can be asked for
        low, high = range_of(shard)
        none = np.zeros(0, np.int64)
        trie.write_arrays(f"{model.uri}/level{level}-{shard}", trie.build_shard(none, none, np.ones(high - low + 1), low, words, least))
    return reports


def _counts_of(model: Model, level: int, low: int, high: int) -> np.ndarray:
    """Counts of the nodes ``low`` .. ``high`` of a level; the one after all words is a text's start."""
    nodes = model.word_node if level == 1 else model.levels[level - 2].node
    parts = []
    for shard in range(max(0, int(np.searchsorted(nodes, low, side="right")) - 1), len(nodes) - 1):
        a, b = max(low, int(nodes[shard])), min(high, int(nodes[shard + 1]))
        if a < b:
            parts.append(model.file(level, shard)["count"][a - int(nodes[shard]) : b - int(nodes[shard])])
        if nodes[shard + 1] >= high:
            break
    if level == 1 and high > model.words:
        parts.append([model.docs])
    return np.concatenate(parts).astype(np.float64) if parts else np.ones(0)


def probabilities(model: Model, text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Add-one probability of every token, and its probability in context."""
    base = (text.count + 1) / (model.tokens + model.words + 1)
    p = base
    if model.order > 1:
        for _, seen, left in nodes_of(model, text, model.order):
            p = seen + left * p
    return base, p


def score(docs: DataFrame, model: Model, *extra: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, after columns ``extra``.

    A null text is empty: its only token is the end. Repeated rows each give a row.
    """
    given = docs.select("doc_id", docs.text.cast("string").alias("text"), *extra)
    own = [f for f in given.schema.fields if f.name != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    names = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _runs(batches, 1):
            text = read(model, texts)
            base, p = probabilities(model, text)
            sums = [np.bincount(text.doc, w, len(texts)) for w in (np.log10(base), np.log10(p))]
            known = np.bincount(text.doc, text.count > 0, len(texts)).astype(np.int64)
            size = np.bincount(text.doc, minlength=len(texts))
            table = pa.Table.from_batches(held).select(names)
            for name, values in (("n_tokens", size), ("n_known", known), ("train_tokens", np.full(len(texts), model.tokens)), ("base_score", sums[0]), ("score", sums[1])):
                table = table.append_column(name, pa.array(values))
            yield from table.combine_chunks().to_batches()

    return given.mapInArrow(run, f"{ddl}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
