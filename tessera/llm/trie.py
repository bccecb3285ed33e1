"""Compact levels of an n-gram trie: Elias-Fano pointers, word ids and quantised numbers in mapped files.

A level holds the n-grams of one length, ordered by context (the node of their first words on the level
below) and then by word id, cut into shards by ranges of that order. A shard maps arrays of one file:
pointers from each of its contexts to its first successor, a monotone sequence in Elias-Fano form; the
successors' word ids; a byte for each discounted probability, two in a shard that holds one below 10 ** -8; two bytes for each
context's share of probability that goes to its successors here; counts in four bytes, or in eight where one needs them.
"""

from __future__ import annotations

import json
import mmap
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs

#: A probability code b stands for 10 ** (-b / STEP); shares of contexts are in units of 1 / WHOLE.
STEP, WHOLE = 32.0, 65535


def narrow(values: np.ndarray, *kinds: str) -> np.ndarray:
    """``values`` (not negative) in the first of the unsigned ``kinds`` that holds them all; OverflowError if none does."""
    top = int(values.max()) if len(values) else 0
    for kind in kinds:
        if top <= np.iinfo(kind).max:
            return values.astype(kind)
    raise OverflowError(f"{top} does not fit into {kinds[-1]}")


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file with all ``arrays``, aligned for mapping. It appears at once, so a repeated task is harmless."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    start = json.dumps(head).encode()
    store, path = fs.FileSystem.from_uri(uri)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(len(start).to_bytes(8, "little") + start + b" " * (-(8 + len(start)) % 64))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 64))
    store.move(own, path)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped read-only. A remote file is copied first; the copy has no name and so
    goes when the worker ends."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.TemporaryFile() as f, store.open_input_stream(path) as remote:
            while piece := remote.read(8 << 20):
                f.write(piece)
            f.flush()
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(data[:8], "little")
    head, base = json.loads(data[8 : 8 + n]), -(-(8 + n) // 64) * 64
    return {k: np.frombuffer(data, np.dtype(kind), count, base + at) for k, (kind, count, at) in head.items()}


def ef_encode(values: np.ndarray, name: str = "") -> dict[str, np.ndarray]:
    """Elias-Fano form of a nondecreasing sequence: low bits as they are, high parts as gaps in unary."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    where = ((values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
    bits = np.zeros(-(-(n + (top >> low_bits) + 1) // 64) * 64 + 64, np.uint8)
    bits[where] = 1
    lows = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    lows = np.concatenate([lows, np.zeros(-len(lows) % 64 + 64, np.uint8)])
    return {
        f"{name}high": np.packbits(bits, bitorder="little").view(np.uint64),
        f"{name}low": np.packbits(lows, bitorder="little").view(np.uint64),
        f"{name}select": where[::64],
        f"{name}bits": np.array([low_bits], np.int64),
    }


def _select(high: np.ndarray, sample: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Position of the i-th set bit, from the sampled position of every 64th."""
    start = sample[i >> 6]
    left = i & 63
    at = start >> 6
    word = high[at] & (~np.uint64(0) << (start & 63).astype(np.uint64))
    count = np.bitwise_count(word).astype(np.int64)
    more = np.flatnonzero(left >= count)
    while len(more):
        left[more] -= count[more]
        at[more] += 1
        word[more] = high[at[more]]
        count[more] = np.bitwise_count(word[more])
        more = more[left[more] >= count[more]]
    out = at << 6
    for width in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        up = left >= c
        left = np.where(up, left - c, left)
        word = np.where(up, word >> np.uint64(width), word)
        out += width * up
    return out


def ef_get(arrays: dict[str, np.ndarray], i: np.ndarray, name: str = "") -> np.ndarray:
    """The i-th values of an encoded sequence."""
    low_bits = int(arrays[f"{name}bits"][0])
    i = i.astype(np.int64)
    high = _select(arrays[f"{name}high"], arrays[f"{name}select"], i) - i
    if not low_bits:
        return high
    low, at = arrays[f"{name}low"], i * low_bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    both = (low[word] >> shift) | np.where(shift > 0, low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return (high << low_bits) | (both & np.uint64((1 << low_bits) - 1)).astype(np.int64)


def find_successors(ids: np.ndarray, first: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Position of each word among its context's successors ids[first:end], -1 where it is none of them."""
    low, high = first.copy(), end.copy()
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        less = ids[middle] < words[active]
        low[active] = np.where(less, middle + 1, low[active])
        high[active] = np.where(less, high[active], middle)
        active = active[low[active] < high[active]]
    hit = np.flatnonzero(low < end)
    out = np.full(len(words), -1, np.int64)
    hit = hit[ids[low[hit]] == words[hit]]
    out[hit] = low[hit]
    return out


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, and their counts, all 64 bits in byte planes, compressed."""
    raw = _planes(np.diff(keys.astype(np.uint64), prepend=np.uint64(0))) + _planes(counts)
    return len(keys).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], 16 * n, codec="zstd", asbytes=True)
    keys, counts = (np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.uint64).ravel() for at in (0, 8 * n))
    return np.cumsum(keys, dtype=np.uint64), counts.astype(np.int64)


def merge_counts(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of several packed counts and their sums."""
    parts = [unpack_counts(b) for b in blobs]
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


#: What is taken off every count of an n-gram for the shorter context (absolute discounting). The same for all
#: shards and levels, so scores do not depend on how the corpus is cut.
DISCOUNT = 0.75


def build_shard(keys: np.ndarray, counts: np.ndarray, context_counts: np.ndarray, first: int, words: int, least: int) -> dict[str, np.ndarray]:
    """Arrays of a shard of the n-grams ``keys`` = context * words + word with their counts.

    ``context_counts``: how often each context from ``first`` on stands in the corpus. N-grams rarer
    than ``least`` are left out; what they and the discount leave over goes to the shorter context.
    """
    keep = counts >= least
    keys, counts = keys[keep].astype(np.int64), counts[keep]
    context = keys // words - first
    p = (counts - DISCOUNT) / context_counts[context]
    code = np.maximum(np.ceil(-np.log10(p) * STEP), 0)  # rounded down, so a context's shares stay below 1
    n = len(context_counts)
    share = np.bincount(context, 10.0 ** (code / -STEP), n)
    pointers = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=n))])
    return {
        "ids": narrow(keys % words, "<u4", "<u8"),
        "code": narrow(code, "<u1", "<u2"),
        "count": narrow(counts, "<u4", "<u8"),
        "share": np.minimum(np.round(share * WHOLE), WHOLE).astype(np.uint16),
        **ef_encode(pointers),
    }
