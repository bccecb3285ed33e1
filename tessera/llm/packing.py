"""Order-preserving packing of tokenised documents into fixed windows.

Each task reads its documents as one stream of token ids and chooses where the windows end. A window
may end at a document's end for free and at a sentence's end for a small penalty; only in stretches
too long for a sentence may it end at a word's end, for a larger one, and only where a word is longer
than a window inside it.
Padding costs one per token. The least total cost is found by dynamic programming over the possible
cuts: the best predecessor of a cut is the minimum of ``cost + position`` over the cuts at most one
window back, which a monotone queue gives in constant time. What follows the last cut of a run goes on
into the next run; at the end of a task the rest is one padded window.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import slices, split_words

WINDOW = 4096
#: Padding tokens that a cut inside a document is worth: at a sentence's end, at any other word's end.
SENTENCE_PENALTY, WORD_PENALTY = 4, 32
#: A longer stretch without a sentence's end is no sentence: there, windows may end at word ends too, at the
#: first one of every WORD_STEP tokens.
SENTENCE_MOST, WORD_STEP = 512, 32
#: Tokens of one run of the dynamic programme; chunks and words that a worker keeps, about 80 MB.
RUN_TOKENS, CHUNKS, WORDS = 1 << 20, 300_000, 400_000
#: Bytes of text that are tokenised at once (or one longer text).
SLICE_BYTES = 4 << 20
#: A word with which a sentence ends: a full stop, and after it no letter or digit.
SENTENCE_END = r"[.!?][^\pL\pN]*$"

#: Fixed values of the tokenizer word_bpe_49k: its split pattern, its special tokens, its word-end suffix.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
WORD_END = "</w>"

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long"
)


class _Known:
    """Keys numbered by their place in one Arrow array, and the ids that each stands for in one growing array."""

    def __init__(self, most: int):
        self.most, self.keys = most, pa.array([], pa.large_string())
        self.ids, self.first, self.size, self.hits = np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(3))

    def find(self, keys: pa.Array) -> np.ndarray:
        """The number of each key, -1 for those not known."""
        return pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy().astype(np.int64)

    def add(self, keys: pa.Array, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of new ``keys``, whose ``ids`` come in a row, ``size`` for each key."""
        first = len(self.ids) + np.cumsum(size) - size
        codes = len(self.keys) + np.arange(len(keys))
        self.keys = pa.concat_arrays([self.keys, keys])
        more = ((self.ids, ids), (self.first, first), (self.size, size), (self.hits, np.zeros(len(keys), np.int64)))
        self.ids, self.first, self.size, self.hits = (np.concatenate(x) for x in more)
        return codes

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``codes`` in a row, and the position after each code's."""
        size = self.size[codes]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        return self.ids[np.repeat(self.first[codes] - (after - size), size) + np.arange(total)], after

    def trim(self) -> np.ndarray | None:
        """If there are more than ``most`` keys, keep the half of that which is used most; the numbers they had."""
        if len(self.keys) <= self.most:
            return None
        kept = np.sort(np.argsort(-self.hits, kind="stable")[: self.most // 2])
        self.ids, after = self.gather(kept)
        self.keys, self.size, self.hits = self.keys.take(pa.array(kept)), self.size[kept], self.hits[kept] // 2
        self.first = after - self.size
        return kept


class WordTokenizer:
    """Token ids of whole texts, from a cache of white-space chunks and one of the words inside them.

    The tokenizer drops white space and encodes every word alone, so texts that share words share work.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        import public_tokenizers
        from tokenizers import Tokenizer

        self.core = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.split = regex.compile(f"{PATTERN}| ").findall
        self.ends = np.zeros(self.core.get_vocab_size(), bool)
        for token, i in self.core.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)
        self.words, self.chunks, self.stop = _Known(WORDS), _Known(CHUNKS), np.zeros(0, bool)

    def _learn_words(self, fresh: pa.Array) -> np.ndarray:
        # The batch form leaves offsets out, which takes half the time.
        new = fresh.to_pylist()
        ids = np.array(self.core.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        after = np.flatnonzero(self.ends[ids]) + 1
        if len(after) != len(new):  # words that the tokenizer splits in another way
            each = [self.core.encode(w, add_special_tokens=False).ids for w in new]
            ids = np.array([i for e in each for i in e], np.uint32)
            after = np.cumsum([len(e) for e in each])
        return self.words.add(fresh, ids, np.diff(after, prepend=0))

    def _learn(self, new: pa.Array) -> np.ndarray:
        # All chunks are normalised and split at once; the spaces between them mark where each ends. The
        # tokenizer lower-cases character by character, so a final sigma is no exception.
        text = unicodedata.normalize("NFC", " ".join(new.to_pylist())).replace("\u03a3", "\u03c3").lower()
        flat = pa.array(self.split(text), pa.large_string())
        space = pc.equal(flat, " ").to_numpy(zero_copy_only=False)
        marks = np.flatnonzero(space)
        last = np.append(marks, len(flat)) - np.arange(len(marks) + 1)  # words up to each chunk's end
        words = flat.filter(pa.array(~space)).dictionary_encode()
        codes = self.words.find(words.dictionary)
        if (missing := codes < 0).any():
            codes[missing] = self._learn_words(words.dictionary.filter(pa.array(missing)))
        codes = codes[words.indices.to_numpy()]
        self.words.hits += np.bincount(codes, minlength=len(self.words.keys))
        ids, after = self.words.gather(codes)
        ends = np.concatenate([[0], after])[last]
        self.stop = np.concatenate([self.stop, pc.match_substring_regex(new, SENTENCE_END).to_numpy(zero_copy_only=False)])
        return self.chunks.add(new, ids, np.diff(ends, prepend=0))

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: its ids, and the positions after each chunk with whether a sentence ends there."""
        self.words.trim()
        if (kept := self.chunks.trim()) is not None:
            self.stop = self.stop[kept]
        special = pc.or_(*(pc.match_substring(texts, m) for m in SPECIAL)).to_numpy(zero_copy_only=False)
        plain = pc.if_else(special, "", texts) if special.any() else texts
        chunks, sizes = split_words(plain)
        local = chunks.dictionary.cast(pa.large_string())
        codes = self.chunks.find(local)
        if (missing := codes < 0).any():
            codes[missing] = self._learn(local.filter(pa.array(missing)))
        codes = codes[chunks.indices.to_numpy()]
        self.chunks.hits += np.bincount(codes, minlength=len(self.chunks.keys))
        ids, after = self.chunks.gather(codes)
        stops = self.stop[codes]
        out, chunk, token = [], 0, 0
        for k, n in enumerate(sizes.tolist()):
            if special[k]:
                whole = np.array(self.core.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
                at = np.flatnonzero(self.ends[whole]) + 1
                out.append((whole, at, np.zeros(len(at), bool)))
                continue
            last = int(after[chunk + n - 1]) if n else token
            out.append((ids[token:last], after[chunk : chunk + n] - token, stops[chunk : chunk + n]))
            chunk, token = chunk + n, last
        return out


@functools.cache
def tokenizer(path: str | None) -> WordTokenizer:
    """The tokenizer of this Python worker; what it knows stays for the worker's next tasks."""
    return WordTokenizer(path)


def cuts_of(length: int, after: np.ndarray, stops: np.ndarray, most: int = SENTENCE_MOST) -> tuple[np.ndarray, np.ndarray]:
    """Positions inside a document where a window may end, ascending, and their penalties.

    ``after``: word ends in tokens; ``stops``: whether a sentence ends there. Only where more than ``most``
    tokens lie between two sentence ends (or the document's ends) may it end at word ends too, one in
    every WORD_STEP tokens. The document's own end is not among them.
    """
    at = after[stops & (after > 0) & (after < length)]
    if len(at) > 1:  # chunks without tokens repeat a position
        at = at[np.concatenate([at[1:] != at[:-1], [True]])]
    edges = np.concatenate([[0], at, [length]])
    wide = np.flatnonzero(np.diff(edges) > most)
    if not len(wide):
        return at, np.full(len(at), float(SENTENCE_PENALTY))
    words = [at]
    for k in wide.tolist():
        inside = after[(after > edges[k]) & (after < edges[k + 1])]
        step = inside // WORD_STEP
        words.append(inside[np.flatnonzero(np.diff(step, prepend=-1))])
    pen = np.concatenate([np.full(len(w), float(WORD_PENALTY if n else SENTENCE_PENALTY)) for n, w in enumerate(words)])
    every = np.concatenate(words)
    order = np.argsort(every, kind="stable")
    return every[order], pen[order]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Window ends chosen among the positions ``at`` (ascending, above 0) at the least total cost.

    The last window end is the cheapest one that leaves less than a window behind it. A gap wider than a
    window is filled with cuts at its multiples first, so a way through always exists.
    """
    where = np.concatenate([[0], np.asarray(at, np.int64)])
    extra = [np.arange(where[k] + window, where[k + 1], window) for k in np.flatnonzero(np.diff(where) > window)]
    if extra:
        more = np.concatenate(extra)
        where, pen = np.concatenate([where, more]), np.concatenate([[0.0], penalty, np.full(len(more), float(window))])
        order = np.argsort(where, kind="stable")
        where, pen = where[order], pen[order]
    else:
        pen = np.concatenate([[0.0], penalty])
    # reach[i]: cost of the best way to cut i plus its position; a window from i to j adds window - (pos[j] - pos[i]).
    pos, fixed, n = where.tolist(), (pen + window).tolist(), len(where)
    reach, before = [0.0] * n, [0] * n
    queue, head = [0] * n, 0
    tail = 1
    for j in range(1, n):
        low = pos[j] - window
        while pos[queue[head]] < low:
            head += 1
        i = queue[head]
        before[j] = i
        value = reach[j] = reach[i] + fixed[j]
        while tail > head and reach[queue[tail - 1]] >= value:
            tail -= 1
        queue[tail] = j
        tail += 1
    end = pos[-1]
    cost = np.array(reach) - where
    open_ = np.flatnonzero(where > end - window)
    j = int(open_[np.lexsort((-where[open_], cost[open_]))[0]])
    out = []
    while j:
        out.append(pos[j])
        j = before[j]
    return out[::-1]


class _Run:
    """The stream of one task: pieces of documents that are not laid into windows yet."""

    def __init__(self, first_sequence: int, window: int):
        self.sequence, self.window = first_sequence, window
        self.pieces: list[tuple] = []  # doc_id, tokens of the document, start, ids, cuts, penalties
        self.total = 0

    def add(self, doc_id, tokens: int, start: int, ids: np.ndarray, at: np.ndarray, pen: np.ndarray) -> None:
        self.pieces.append((doc_id, tokens, start, ids, at, pen))
        self.total += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Rows of the windows that are complete; at the ``last`` call of all that is left."""
        if not self.total:
            return []
        at, pen, base = [], [], 0
        for _, _, _, ids, cuts, costs in self.pieces:
            at.append(base + cuts)
            pen.append(costs)
            base += len(ids)
            at.append([base])
            pen.append([0])
        ends = best_cuts(np.concatenate(at), np.concatenate(pen), self.window)
        if last and (not ends or ends[-1] < self.total):
            ends.append(self.total)
        return self._lay(ends)

    def _lay(self, ends: list[int]) -> list[tuple]:
        rows, base, begin, k = [], 0, 0, 0
        left: list[tuple] = []
        for doc_id, tokens, start, ids, cuts, costs in self.pieces:
            n, used = len(ids), 0
            while used < n and k < len(ends):
                take = min(n - used, ends[k] - (base + used))
                part = np.ascontiguousarray(ids[used : used + take], "<u4")
                rows.append((doc_id, start + used, take, zlib.crc32(part.tobytes()), tokens, self.sequence, base + used - begin, ends[k] - begin))
                used += take
                if base + used == ends[k]:
                    begin, k = ends[k], k + 1
                    self.sequence += 1
            if used < n:
                keep = cuts > used
                left.append((doc_id, tokens, start + used, ids[used:], cuts[keep] - used, costs[keep]))
            base += n
        self.pieces, self.total = left, sum(len(p[3]) for p in left)
        return rows


def pack(docs: DataFrame, *, tokenizer_path: str | None = None, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text and any other columns), in windows of at most ``window`` ids.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    sequence_tokens, the ids in its window. A document is its ids and then ``end_id``; a null or empty
    text is ``end_id`` alone; a text of any length is packed whole, and is tokenised on its own if it is
    longer than SLICE_BYTES. Repeated rows, and rows that share a doc_id, are packed as often as they come;
    a null doc_id stays null. Of equally cheap cuts the earliest predecessor counts. Other columns are
    not read. Documents keep their order within a partition of the input; no text is moved between tasks.
    An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        stream = _Run(TaskContext.get().partitionId() << 32, window)
        kinds = pa.schema([pa.field(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=kinds)

        tail = np.array([end_id], np.uint32)
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                for doc_id, (ids, after, stops) in zip(some.column(0).to_pylist(), words.encode(pc.fill_null(some.column(1), ""))):
                    ids = np.concatenate([ids, tail])
                    stream.add(doc_id, len(ids), 0, ids, *cuts_of(len(ids), after, stops, min(SENTENCE_MOST, window)))
                    if stream.total >= RUN_TOKENS and (found := stream.flush(False)):
                        yield rows(found)
        if found := stream.flush(True):
            yield rows(found)

    return docs.select("doc_id", docs.text.cast("string").alias("text")).mapInArrow(run, SCHEMA)
