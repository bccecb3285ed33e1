"""The training-data operators on small tables: nulls, empty texts, ties, repeats, empty tables, extra columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, fingerprint, language, licences, mixing, neighbours, packing, quality, simhash, toxicity, trie
from tessera.llm.common import slices

DOCS = "doc_id long, text string, source string, key string"


def words(rng, n, v=400):
    return " ".join(f"w{int(rng.paretovariate(0.8)) % v}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every odd case: null ids and texts, empty, blank, repeated, very long, clashing column names."""
    rng = random.Random(1)
    long = words(rng, 12000)
    rows = [(1, "One two three four five six. Seven!", "a", "x"), (1, "One two three four five six. Seven!", "a", "x"), (2, None, "a", "x"), (3, "", None, "x"), (4, "  \n\t ", None, "x"),
            (5, "É ß Σ 'tis 12 <|endoftext|> ☃ ZWJ‍", "b", "x"), (None, "no id at all, but words", "b", "x"), (7, long, "c", "x"), (8, long, "c", "x"), (9, long[:-9] + " end", "c", "x")]
    rows += [(k, words(rng, rng.randrange(1, 200)), rng.choice("abc"), "x") for k in range(20, 60)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# SimHash


def slow_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    import xxhash

    shingles = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [b" ".join(w)]
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) > len(shingles))


def test_simhash_components_equal_brute_force(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    prints = [slow_simhash(r.text) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            group[i] = min(group[j] for j in range(len(rows)) if bin(prints[i] ^ prints[j]).count("1") <= 4)
    want = collections.Counter()
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if group[j] == group[i] and rows[j].doc_id is not None]
        want[r.doc_id, f"{prints[i]:016x}", min(ids, default=None)] += 1
    got = simhash.near_duplicates(odd).select("doc_id", simhash.hex64(F.col("fp")), "component_id").collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_miss_nothing(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {0, (1 << 64) - 1, 1 << 63}
    for b in base:
        for k in range(8):
            values.add(b ^ sum(1 << x for x in rng.sample(range(64), k % 6)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    want = {(min(a, b), max(a, b)) for x in values for y in values if x != y and bin(x ^ y).count("1") <= 4 for a, b in [(signed(x), signed(y))]}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), distance=6)


def test_connected_takes_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = dict(map(tuple, simhash.connected(edges).collect()))
    assert {roots.get(k, 0) for k in range(41)} == {0} and roots[101] == 100


def test_one_of_each(spark, odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 1 in ids and 8 not in ids and 9 not in ids and len(ids) == len(set(ids))
    assert 2 in ids and 3 not in ids and 4 not in ids  # texts without words
    assert simhash.one_of_each(none).count() == 0
    # Two texts under one doc_id are two documents; equal rows are one; other columns stay, whatever their names.
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, a, "k", "x", 1), (1, b, "k", "x", 1), (2, b, "k", "x", 1), (3, a, "k", "x", 1), (1, a, "k", "x", 1), (None, "no other text is like this one", "k", "x", 1), (None, a, "k", "x", 1), (None, "no other text is like this one", "k", "x", 1)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, root string, node string, _stay_n int")
    got = simhash.one_of_each(clash)
    assert got.columns == clash.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, a), (1, b), (None, "no other text is like this one")]))


def test_near_copies_by_similarity(spark, odd, none):
    """Planted pairs from 0.8 to 0.95, and near misses, against exact similarity of all pairs."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        text = [f"w{rng.randrange(5000)}" for _ in range(400)]
        edited = list(text)
        for at in rng.sample(range(400), 1 + k % 16):  # each changed word takes five shingles
            edited[at] = "changed"
        rows += [(100 + 2 * k, " ".join(text)), (101 + 2 * k, " ".join(edited))]
    hub = [f"h{k}" for k in range(400)]
    rows += [(400 + k, " ".join(hub[: 40 * k] + ["x"] + hub[40 * k + 4 :])) for k in range(10)]  # a chain of near copies around a bucket's least
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text")).repartition(3)
    every = df.collect()
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (r.text or "").encode().lower().split()) else set() for r in every]
    group = list(range(len(every)))
    like = {(i, j): len(s & t) / len(s | t) if s | t else 1 for i, s in enumerate(sets) for j, t in enumerate(sets[:i])}
    assert sum(0.8 <= v < 0.95 for v in like.values()) >= 20
    for _ in range(len(every)):
        before = list(group)
        for (i, j), v in like.items():
            if v >= 0.8:
                group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    want = collections.Counter()
    for i, r in enumerate(every):
        want[r.doc_id, min((every[j].doc_id for j in range(len(every)) if group[j] == group[i] and every[j].doc_id is not None), default=None)] += 1
    got = collections.Counter(tuple(r) for r in simhash.near_copies(df).collect())
    assert got == want
    import corpus_pipeline

    kept = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()]
    assert collections.Counter(i for i in kept if i is not None) == collections.Counter({c for d, c in want if d is not None})
    assert simhash.near_copies(none).count() == 0


# Packing


def test_packing_holds_every_token_once(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    core = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in odd.collect():
        ids = core.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id, tuple(ids)] += 1
    pieces = packing.pack(odd, window=512).toPandas()
    assert (pieces.length > 0).all() and (pieces.sequence_tokens <= 512).all()
    bins = pieces.sort_values("offset").groupby("sequence_id")
    for _, b in bins:
        assert (b.offset == b.length.cumsum() - b.length).all() and b.length.sum() == b.sequence_tokens.iloc[0]
    # Each document's pieces join to its ids.
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for doc_id, ids in want:
        own = pieces[pieces.doc_id.isna()] if doc_id is None else pieces[pieces.doc_id == doc_id]
        assert own.length.sum() == sum(len(i) * n for (d, i), n in want.items() if d == doc_id)
        for p in own.itertuples():
            if want[doc_id, ids] and p.doc_tokens == len(ids):
                assert crc(ids[p.start : p.start + p.length]) == p.ids_crc32
    full = bins.sequence_tokens.first()
    assert sum(0 if n & (n - 1) == 0 else 512 - n for n in full) < 0.1 * pieces.length.sum()
    assert packing.pack(none).count() == 0


def test_best_cuts_cost_the_least():
    rng = random.Random(3)
    for _ in range(30):
        at = sorted(rng.sample(range(1, 60), 12))
        pen = [rng.choice([0, 1, 5]) for _ in at]
        ends = packing.best_cuts(np.array(at), np.array(pen, float), 16)
        cost = lambda e: sum(16 - (b - a) for a, b in zip([0, *e], e)) + sum(dict(zip(at, pen)).get(x, 16) for x in e)
        reach = {0: 0.0}
        fill = sorted({*at, *(a + 16 * k for a, b in zip([0, *at], at) for k in range(1, (b - a - 1) // 16 + 1))})
        for b in fill:
            reach[b] = min((reach[a] + 16 - (b - a) for a in reach if b - a <= 16), default=math.inf) + dict(zip(at, pen)).get(b, 16)
        assert all(b - a <= 16 for a, b in zip([0, *ends], ends)) and at[-1] - (ends[-1] if ends else 0) < 16
        assert abs(cost(ends) - min(c for p, c in reach.items() if p > at[-1] - 16)) < 1e-9


def test_windows_end_at_sentence_ends():
    """Word ends are possible cuts only where no sentence can be so long."""
    after, stops = np.arange(1, 3001), np.zeros(3000, bool)
    stops[[99, 299, 1999, 2999]] = True
    at, pen = packing.cuts_of(3001, after, stops)
    assert {100, 300, 2000, 3000} <= set(at.tolist()) and (np.diff(at) > 0).all()
    assert {int(x) for x, y in zip(at, pen) if y == packing.SENTENCE_PENALTY} == {100, 300, 2000, 3000}
    others = [int(x) for x, y in zip(at, pen) if y == packing.WORD_PENALTY]
    assert others and all(300 < x < 2000 or 2000 < x < 3000 for x in others) and max(np.diff([300, *others])) <= packing.WORD_STEP * 2
    assert [x.tolist() for x in packing.cuts_of(5, np.array([0, 2, 2, 4, 5]), np.array([True] * 5))] == [[2, 4], [4.0, 4.0]]
    assert len(packing.cuts_of(1, np.zeros(0, int), np.zeros(0, bool))[0]) == 0


def test_slices_are_bounded_by_bytes():
    batch = pa.record_batch({"id": pa.array(range(6)), "text": pa.array(["a" * 5, None, "b" * 50, "", "c" * 6, "d" * 6])})
    assert [s.column(0).to_pylist() for s in slices(batch, 1, 12)] == [[0, 1], [2], [3, 4, 5]]
    assert sum(s.num_rows for s in slices(batch, 1, 1)) == 6 and list(slices(batch.slice(0, 0), 1, 9)) == []


def test_tokenizer_cache_can_start_over(monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS", 40)
    monkeypatch.setattr(packing, "WORDS", 60)
    t = packing.WordTokenizer()
    rng = random.Random(4)
    for _ in range(12):
        texts = [f"{words(rng, 30, 90)} Naïve, co-op's 3rd" for _ in range(4)]
        got = [x[0].tolist() for x in t.encode(pa.array(texts))]
        assert got == [t.core.encode(x, add_special_tokens=False).ids for x in texts]


# Mixing


def test_mixing(spark, odd, none):
    rows = mixing.mix(odd, block=4).toPandas()
    assert len(rows) == odd.count() and (rows.taken <= 3 * rows["size"]).all()
    by = rows.groupby("source", dropna=False).agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.own).all() and abs(by.target.sum() - by["size"].sum()) < 1e-6
    assert ((by.taken - by.target).abs() <= 4 * len(by)).all()  # a block for each source, in the one shard
    again = mixing.mix(odd.repartition(5), block=4).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, rows[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(none).count() == 0
    blank = odd.where("doc_id IN (2, 3, 4)")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0, 0] and mixing.spans(blank).count() == 0
    assert mixing.mixed_documents(blank).count() == 0


@pytest.mark.parametrize("shard_slots", [50, 8192])
def test_mix_takes_what_the_shards_drew(spark, odd, shard_slots):
    """taken, word by word, from the drawn slots and the documents' places in their streams."""
    sources, parts = mixing._parts(odd, (1, 2, 3), 4)
    plans = mixing.plan(sources, block=4)
    drawn = mixing.draw(plans, shard_slots=shard_slots)
    wanted = {r.source_no: (r.wanted, r.blocks, r.source_size) for r in plans.collect()}
    every = round(sum(w for w, _, _ in wanted.values()))
    counts = collections.Counter()
    for r in drawn.collect():
        n = min(shard_slots, every - r.shard * shard_slots)
        expected = n * wanted[r.source_no][0] / sum(w for w, _, _ in wanted.values())
        assert -1 < r.slots - expected < len(wanted) or r.first + r.slots == 3 * wanted[r.source_no][1]
        counts[r.source_no] += r.slots
    assert len(wanted) > 1 and (shard_slots > 999 or drawn.select("shard").distinct().count() > 5)
    times = collections.Counter()
    turns = collections.defaultdict(set)
    for r in mixing.fill(drawn, block=4).collect():
        _, blocks, size = wanted[r.source_no]
        assert 0 <= r.block < blocks and r.words == min(4, size - 4 * r.block) and r.block not in turns[r.source_no, r.slot // blocks]
        turns[r.source_no, r.slot // blocks].add(r.block)
        times[r.source_no, r.block] += 1
    assert sum(times.values()) == sum(counts.values()) and all(n <= 3 for n in times.values())
    places = {(r.source_no, r.start, r.tie, r.doc_id, r.source, r.size) for r in parts.collect()}
    want, covered = collections.Counter(), collections.Counter()
    for no, start, _, doc_id, source, size in places:
        covered.update((no, w) for w in range(start, start + size))
        if size:
            want[doc_id, source, size, sum(times[no, w // 4] for w in range(start, start + size))] += 1
    assert set(covered.values()) == {1} and len(covered) == sum(s for _, _, s in wanted.values())
    got = collections.Counter((r.doc_id, r.source, r["size"], r.taken) for r in mixing.mix(odd, block=4, shard_slots=shard_slots).where("size > 0").collect())
    assert got == want
    # The mixed shards hold the same words.
    spans = mixing.spans(odd, block=4, shard_slots=shard_slots).collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in odd.orderBy(F.length("text")).collect()}
    assert all(0 <= r.first_word and r.first_word + r.words <= size[r.doc_id] for r in spans)
    by_doc = collections.Counter()
    for r in spans:
        by_doc[r.doc_id] += r.words
    total = collections.Counter()
    for (doc_id, _, _, taken), n in want.items():
        total[doc_id] += taken * n
    assert {d: n for d, n in by_doc.items() if n} == {d: n for d, n in total.items() if n}
    slots = collections.Counter((r.shard, r.source, r.slot) for r in spans)
    filled = collections.defaultdict(list)
    for r in spans:
        filled[r.shard, r.source, r.slot].append((r.place, r.words))
    assert all(sorted(f)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(f), sorted(f)[1:])) for f in filled.values()) and len(slots) == sum(counts.values())


def test_another_draw_takes_other_words(spark, odd):
    a, b = ({(r.doc_id, r.taken) for r in mixing.mix(odd, block=4, shard_slots=n).collect()} for n in (50, 8192))
    assert a != b


def test_mixed_documents_keep_clashing_columns(spark):
    names = "doc_id long, text string, source string, times int, copy int, id long, own_id string, row string, _times int, _copy int, n int, size int"
    rows = [(k, "a b c " * (k + 1), "s" if k % 3 else "t", 5, 6, 7, "o", "r", 8, 9, 10, 11) for k in range(30)]
    rows += [(3, "", "s", 5, 6, 7, "o", "r", 8, 9, 10, 11), (3, None, None, 5, 6, 7, "o", "r", 8, 9, 10, 11)]
    df = spark.createDataFrame(rows, names)
    got = mixing.mixed_documents(df, block=4)
    assert got.columns == df.columns
    found = collections.Counter(tuple(r) for r in got.collect())
    assert set(found) <= set(rows) and all(n <= 3 for n in found.values()) and all(r[1] for r in found)


def test_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 5), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    weight, cap = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, {"a": 3000, "b": 30, "c": 30, "d": 0, None: 15}
    level = (1025 - 30 - 30 - 15) / 1
    assert got == {s: min(cap[s], level * weight[s]) for s in cap}


def test_permutation(spark):
    for n in (1, 2, 7, 64):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))


# Fingerprints


def test_fingerprints(spark, odd, none):
    rows = [r for r in odd.collect() if r.doc_id not in (None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    texts = [r.text or "" for r in sorted(rows, key=lambda r: r.doc_id)]
    for stretches in (1, 7):
        got = fingerprint.fingerprints(docs.repartition(4), stretches=stretches).orderBy("doc_id").collect()
        assert len(got) == len(texts)
        for k, (r, t) in enumerate(zip(got, texts)):
            following = texts[(k + 1) % len(texts)]
            edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
            own, other, last = (fingerprint.Print(x.encode()) for x in (t, edited, following))
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own.text(), other.text())
            assert r.near_edited == own.inside(other) and r.near_next == own.inside(last) and 0 <= r.near_edited <= 1
    assert fingerprint.fingerprints(none).count() == 0
    single = fingerprint.fingerprints(docs.where("doc_id = 5")).collect()
    assert len(single) == 1 and fingerprint.fingerprints(odd).count() == odd.count()


def test_chunks_are_local_and_bounded():
    rng = random.Random(5)
    data = words(rng, 3000).encode()
    h, slow = fingerprint.gear(data), 0
    for k, b in enumerate(data[:200]):
        slow = ((slow << 1) + int(fingerprint.GEAR[b])) & 0xFFFFFFFF
        assert h[k] == slow
    a = fingerprint.Print(data)
    sizes = np.diff([0, *a.ends])
    assert a.ends[-1] == len(data) and sizes.max() <= fingerprint.LONGEST and sizes[:-1].min() >= fingerprint.LEAST
    shifted = fingerprint.Print(b"inserted text here " + data)
    assert a.inside(shifted) > 0.97 and fingerprint.Print(b"").inside(fingerprint.Print(b"")) == 1 and fingerprint.Print(b"").inside(a) == 0
    assert fingerprint.Print(data, fingerprint.Print(data[:9000] + b"other"), 9000).all == a.all


# Chat


def test_chat_reads_back(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\[INST]\\\\", "<s> </s", "[ROLE] x [TEXT] y [/ROLE]", "", " ", "a\nb", "$1 \\$", "[INST"]
    roles = ["user", "assistant", "system", "tool [TEXT] \\ x", None]
    rows = [(c, t, roles[(c + t) % 5], hard[(c * 3 + t) % 10], "x") for c in range(12) for t in range(4)]
    rows += [(50, 0, "user", None, "x"), (50, 0, "user", None, "x"), (51, 1, "user", "q", "x"), (51, 2, "assistant", "r", "x"), (None, 0, "assistant", "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    assert got[51].valid and not got[50].valid and not got[None].valid
    assert {r.conv_id: r.first_error for r in made.collect()}[50] == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


# Licences


MIT_FILE = """The MIT License (MIT)

Copyright (c) 2019 Jane Roe and the crew

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL2_HEADER = """/*
 * A driver for something.
 *
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License version 2 as
 * published by the Free Software Foundation.
 */
int main(void) { return 0; }
"""
APACHE_START = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
"""
FILES = "file_id long, path string, text string, licence string, _id string, key int"


def test_licences_of_real_files(spark):
    """Whole files, headers and tags as they stand in repositories, and what lies beside and below them."""
    filler = "int x = 0; // counts things\n" * 50
    files = [(1, "mit/LICENSE.txt", MIT_FILE), (2, "mit/src/deep/a.c", filler), (3, "spdx/a.py", "# SPDX-License-Identifier: MIT\n" + filler), (4, "spdx/b.py", "x"),
             (5, "gpl/m.c", GPL2_HEADER + filler), (6, "apache/LICENSE", APACHE_START), (7, "apache/a.py", "x = 1"), (8, "apache/own.c", GPL2_HEADER), (9, "none/a.md", "Ask for permission to copy the museum's key."),
             (10, "mit/vendored/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n" + "The terms go on. " * 2000),
             (11, "mit/vendored/x.c", "y")]
    got = {r.file_id: (r.licence, r.origin, r.directory) for r in licences.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "statement", None) and got[2] == ("MIT", "inherited", "mit")
    assert got[3] == ("MIT", "statement", None) and got[4] == (None, "none", None)
    assert got[5] == ("GPL-2.0-only", "statement", None) and got[8] == ("GPL-2.0-only", "statement", None)
    assert got[6] == ("Apache-2.0", "statement", None) and got[7] == ("Apache-2.0", "inherited", "apache")
    assert got[9] == (None, "none", None)
    assert got[10][0] == "GPL-3.0-or-later" and got[11] == ("GPL-3.0-or-later", "inherited", "mit/vendored")


def test_licences_odd_cases(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [(1, "a/b/LICENSE", mit), (2, "a/b/c/x.py", "code\nno notice"), (3, "a/b/c/y.py", f"# {apache}\n" + "code " * 200), (4, "z/x.py", "code"), (5, None, None), (6, None, mit),
             (4, "z/x.py", "code"), (7, "a/b/c/d/e", ""), (None, "a/b/c/n", "word " * 300_000), (8, "t/LICENSE", mit), (9, "t/COPYING", apache), (10, "t/x", "x"), (3, "a/b/c/y.py", "code")]
    rows = [(*f, "taken", "taken", 7) for f in files]
    got = sorted(((r.file_id, r.licence, r.origin, r.directory) for r in licences.scan(spark.createDataFrame(rows, FILES)).collect()), key=str)
    want = [(1, "MIT", "statement", None), (2, "MIT", "inherited", "a/b"), (3, "Apache-2.0", "statement", None), (3, "Apache-2.0", "statement", None), (4, None, "none", None), (4, None, "none", None), (5, None, "none", None),
            (6, "MIT", "statement", None), (7, "MIT", "inherited", "a/b"), (None, "MIT", "inherited", "a/b"), (8, "MIT", "statement", None), (9, "Apache-2.0", "statement", None), (10, "Apache-2.0", "inherited", "t")]
    assert got == sorted(want, key=str)  # two licence files of cosine 1 in t: the first name counts
    top = spark.createDataFrame([(1, "LICENSE", mit), (2, "deep/er/x", "x")], "file_id long, path string, text string")
    assert {r.file_id: (r.licence, r.directory) for r in licences.scan(top).collect()} == {1: ("MIT", None), 2: ("MIT", "")}
    assert licences.scan(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def test_every_template_is_a_candidate_and_finds_itself(spark):
    assert all(any(a in text.lower() for a in licences.ANCHORS) for _, text in licences.TEMPLATES)
    rows = [(str(k), text) for k, (_, text) in enumerate(licences.TEMPLATES)]
    got = {int(r.key): (r.licence, r.cosine) for r in licences.match(spark.createDataFrame(rows, "key string, text string")).collect()}
    assert len(got) == len(rows) and all(got[k] == (name, 1.0) for k, (name, _) in enumerate(licences.TEMPLATES))


@pytest.mark.parametrize("name", ["op4_chat_format", "op5_licence_scan"])
def test_queries_equal_their_sql(spark, small, name):
    import glob
    import os

    import duckdb

    from tessera.llm import queries

    db = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = collections.Counter(tuple(r) for r in found.fetchall())
    df = queries.queries()[name](spark, small)
    assert sorted(columns) == sorted(df.columns)
    assert collections.Counter(tuple(r) for r in df.select(*columns).collect()) == want


# Language model


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (5, 0), (300, 40), (1000, 10**9), (5000, 3)):
        values = np.sort(rng.integers(0, top + 1, n))
        coded = trie.ef_encode(values)
        assert (trie.ef_get(coded, np.arange(n)) == values).all()
    keys = np.unique(rng.integers(0, 2**60, 1000)).astype(np.uint64)
    blobs = [trie.pack_counts(keys[::2], np.ones(len(keys[::2]))), trie.pack_counts(keys, np.ones(len(keys)))]
    merged, counts = trie.merge_counts(blobs)
    assert (merged == keys).all() and counts.sum() == len(keys) + len(keys[::2])


@pytest.mark.parametrize("shard_tokens", [3_000_000, 500])
def test_language_model(spark, odd, none, shard_tokens):
    learn = odd.where("doc_id <> 9 OR doc_id IS NULL")
    model = language.train(learn, shard_tokens=shard_tokens)
    texts = [(r.text or "").encode().lower().split() + [b"\n"] for r in learn.collect()]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for w in texts:
        x = [None, *w]
        one.update(w), two.update(zip(x, x[1:])), three.update(zip(x, x[1:], x[2:]))
    n, v = sum(one.values()), len(one)
    got = language.score(odd, model, F.lit(True).alias("key2")).collect()
    assert len(got) == odd.count() and model.tokens == n and model.words == v
    want = collections.Counter()
    for r in odd.collect():
        w = (r.text or "").encode().lower().split() + [b"\n"]
        want[r.doc_id, len(w), sum(one[x] > 0 for x in w), round(sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got)
    # The probabilities after a context add up to one over all words and the unknown one.
    for context in (b"w1", b"w2", None):
        vocabulary = list(one)
        sentence = [x for x in vocabulary if x != b"\n"]
        lines = [b" ".join([*([context] if context else []), x]) for x in sentence]
        text = language.read(model, pa.array([x.decode() for x in [*lines, context or b"", b"\x01unknown" if context is None else context + b" \x01unknown"]]))
        _, p = language.probabilities(model, text)
        at = text.first + (1 if context else 0)
        assert abs(p[at].sum() - 1) < 2e-3
    assert language.score(none, model).count() == 0
    empty = language.train(none)
    assert [r.base_score for r in language.score(odd.where("doc_id = 3"), empty).collect()] == [0.0]


# Classifiers


def test_quality_and_toxicity(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for k in range(600):
        bad, rude = k % 3 == 0, k % 5 == 0
        text = words(rng, 60) + "." if not bad else "BUY NOW!! " * 30
        rows.append((k, text + (" awful fool" if rude else ""), "s", "x"))
        marks.append((k, int(not bad), int(bad), int(rude)))
    rows += [(1000, None, "s", "x"), (1001, "", "s", "x"), (None, "x", "s", "x"), (1, rows[1][1], "s", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([*marks, (1, 1, 0, 0), (5000, 1, 0, 1), (None, 1, 1, 1)], "doc_id long, quality int, junk int, toxic int")
    learn = F.col("doc_id") % 2 == 0
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels, where=learn)).collect()}
    assert len(got) == 603 and all(got[k].predicted == int(k % 3 != 0) for k in range(1, 600, 2)) and 0 <= got[1001].score <= 1 and got[1000].score == got[1001].score
    chain = toxicity.train(docs, labels, ["junk", "toxic"], where=learn)
    assert [len(link.chained) for link in chain.links] == [0, 1]
    scored = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert all(scored[k].toxic_predicted == int(k % 5 == 0) for k in range(1, 600, 2)) and scored[1000].toxic_predicted == 0
    assert 0.05 < chain.threshold < 0.95
    # Clashing columns are refused or, in the stages, left alone; of two texts under one id the lesser is learned.
    for call in (lambda: quality.score(docs.withColumn("Score", F.lit(1)), None), lambda: toxicity.score(docs.withColumn("p_junk", F.lit(1)), chain)):
        with pytest.raises(ValueError, match="there already"):
            call()
    nothing = labels.limit(0)
    assert quality.score(docs, quality.train(docs, nothing)).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)
    assert toxicity.score(docs, toxicity.train(docs, nothing, ["junk", "toxic"])).count() == len(rows)
    assert quality.score(docs.limit(0), quality.train(docs, nothing)).count() == 0


def test_threshold_is_the_best_cut():
    rng = np.random.default_rng(3)
    for _ in range(30):
        y = (rng.random(40) < 0.3).astype(float)
        p = np.clip(np.round(y * 0.3 + rng.random(40) * 0.6, 2), 0, 1)
        at = toxicity.best_threshold(p, y)
        f1 = lambda t: 2 * ((p >= t) & (y == 1)).sum() / max(1, (p >= t).sum() + y.sum())
        assert not 0 < y.sum() < 40 or abs(f1(at) - max(f1(t) for t in np.unique(p))) < 1e-9
    assert toxicity.best_threshold(np.array([0.2, 0.7]), np.zeros(2)) == 0.5 and toxicity.best_threshold(np.zeros(0), np.zeros(0)) == 0.5


def test_chain_and_trees_by_hand(spark):
    """Scores from the fitted numbers alone, in plain Python, word by word and node by node."""
    rng = random.Random(8)
    rows = [(k, words(rng, 50) + (" awful fool" if k % 5 == 0 else "") + (" BUY NOW!!" * 9 if k % 3 == 0 else ".")) for k in range(300)] + [(900, None), (901, ""), (902, "word " * 200_000), (5, "two under one id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 3 == 0), int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, junk int, toxic int")
    chain = toxicity.train(docs, labels, ["junk", "toxic"])
    import re

    import xxhash

    def told(text):
        found = set(re.sub(rb"[^a-z\x80-\xff]", b" ", (text or "").encode().lower()).split())
        found |= {w[:k] + b"*" for w in found for k in (4, 5, 6, 7) if len(w) > k}
        hashes = {xxhash.xxh64_intdigest(w) for w in found}
        before = []
        for link in chain.links:
            margin = link.intercept + sum(w for h, w in zip(link.words.tolist(), link.weights.tolist()) if h in hashes) + sum(b * c for b, c in zip(before, link.chained.tolist()))
            before.append(1 / (1 + math.exp(-margin)))
        return before

    got = toxicity.score(docs, chain).collect()
    assert len(got) == len(rows)
    for r in got:
        want = told(r.text)
        assert abs(r.p_junk - want[0]) < 1e-9 and abs(r.p_toxic - want[1]) < 1e-9 and r.toxic_predicted == int(want[1] > chain.threshold)
    model = quality.train(docs, labels)
    for r in quality.score(docs, model).collect():
        x, margin = quality.statistics((r.text or "").encode()), model.start
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            margin += leaf[node - len(feature)]
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-9
    text = "One two  two!\nOne two\n"
    got = dict(zip(quality.STATISTICS, quality.statistics(text.encode())))
    assert abs(got["log_words"] - math.log(6)) < 1e-12 and abs(got["log_lines"] - math.log(4)) < 1e-12 and got["distinct_words"] == 3 / 5 and got["exclamation"] == 1 / len(text)
    assert got["capital_words"] == 0 and got["mean_word"] == (3 + 3 + 4 + 3 + 3) / 5 and got["last_stop"] == 0 and got["upper"] == 2 / len(text)


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with null and repeated ids, null, empty, long and tied texts, and columns named like those of the stages."""
    rng = random.Random(9)
    base = [(k, words(rng, 80) + ".", "en", rng.choice("ab"), 1) for k in range(60)]
    base += [(70, None, None, None, None), (71, "", "en", "a", 0), (None, "no id, but some words here.", "en", None, 2), (5, "another text under id five, which is its own document.", "en", "a", 3), (72, "x " * 150_000, "en", "b", 4), base[3], base[3]]
    names = ["score", "predicted", "p_toxic", "toxic_predicted", "_p", "_row", "_times", "_copy", "node", "root", "size", "start", "bag"]
    return spark.createDataFrame([(*r, *range(len(names))) for r in base], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)).repartition(3).cache()


def test_stages_keep_columns_of_any_name(spark, small, clashing, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{small}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")  # nothing is rejected
    small = str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (clashing, clashing.limit(0)):
            got = stage(spark, df, small)
            assert got.columns == df.columns, name
            found = [tuple(r) for r in got.collect()]
            assert set(found) <= {tuple(r) for r in df.collect()}, name
            if df is clashing:
                ids = [r[0] for r in found]
                assert 5 in ids and None in ids and (name not in ("toxicity", "quality") or len(ids) == df.count()), name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, clashing.limit(0), small).count() == 0
    pieces = last(spark, clashing, small).groupBy("doc_id").agg(F.sum("length")).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clashing.collect()}


def test_run_on_an_empty_table(spark, small, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# Neighbours


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 64)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((700, 12)).astype(np.float32)
    x[100:300] = x[100]  # a hot vector
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)]
    rows += [(800, None, "x"), (820, [0.0] * 12, "x"), (840, [float("nan")] * 12, "x"), (860, [None] * 12, "x"), (880, [1.0], "x"), (None, [1.0] * 12, "x"), (20, x[20].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(4)
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=10).collect()
    assert len(got) == 35 * 10
    hits = 0
    y = x.astype(float)
    for q in range(0, 700, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        score = y @ y[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(700), -np.round(score, 9)))[:10]
        hits += len({r.vec_id for r in own} & set(best.tolist()))
        assert [r.rank for r in own] == list(range(1, 11)) and np.allclose([r.score for r in own], score[[r.vec_id for r in own]])
    assert hits / 350 >= 0.95
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.search(df.where("vec_id < 3"), F.col("vec_id") == 0, k=10).count() == 2


@pytest.mark.parametrize("spread", [0.0, 0.01])
def test_neighbours_of_repeated_ids(spark, monkeypatch, spread):
    """Every id 25 times, with equal vectors and with different ones: still k ids a query."""
    monkeypatch.setattr(neighbours, "PART", 512)
    monkeypatch.setattr(neighbours, "FIRST_ROWS", 100)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 12))
    many = (x[:, None, :] + spread * rng.standard_normal((300, 25, 12))).astype(np.float32)
    rows = [(k, v.tolist()) for k in range(300) for v in many[k]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    # All lists that the measured queries need, so that only thresholds and caps can lose a neighbour.
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=10, recall=1.0).collect()
    assert collections.Counter(r.query_id for r in got) == {q: 10 for q in range(0, 300, 20)}
    hits, y = 0, many.astype(float)
    for q in range(0, 300, 20):
        score = np.einsum("kvd,wd->kvw", y, y[q]).max(axis=(1, 2))
        score[q] = -np.inf
        own = {r.vec_id for r in got if r.query_id == q}
        assert len(own) == 10
        hits += len(own & set(np.argsort(-score)[:10].tolist()))
    assert hits / 150 >= 0.95


def test_pipeline_equals_brute_force(spark, small):
    """Every stage on its own input against plain Python, and run() against the stages one by one."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.queries import TOXIC_CHAIN

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]

    def rows(df):
        assert df.columns == docs.columns
        return [tuple(r) for r in df.collect()]

    def again(kept):
        return spark.createDataFrame(kept, docs.schema)

    before = rows(docs)
    chain = toxicity.train(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), TOXIC_CHAIN)
    told = chain.probabilities(toxicity.Bags([toxicity.words_of(r[1].encode()) for r in before]))[:, -1] > chain.threshold
    clean = rows(stages["toxicity"](spark, docs, small))
    assert sorted(clean) == sorted(r for r, t in zip(before, told) if not t) and len(clean) < len(before)

    model = quality.train(again(clean), labels)
    good = rows(stages["quality"](spark, again(clean), small))
    assert sorted(good) == sorted(r for r in clean if model.predict(np.array([quality.statistics(r[1].encode())]))[0] >= 0.5)

    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (r[1] or "").encode().lower().split()) else set() for r in good]
    root = list(range(len(good)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            both = len(s & t)
            if (both >= 0.8 * (len(s) + len(t) - both)) and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(good):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    single = rows(stages["near_duplicates"](spark, again(good), small))
    assert sorted(r[0] for r in single) == sorted(least.values()) and len(single) < len(good)

    mixed = rows(stages["mixing"](spark, again(single), small))
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(again(single)).collect()}
    times = collections.Counter(r[0] for r in mixed)
    assert all(t // n <= times[i] <= -(-t // n) and times[i] <= 3 for i, (t, n) in taken.items() if n)
    assert set(mixed) <= set(single)

    core = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r[0]: core.encode(r[1], add_special_tokens=False).ids + [2] for r in single}
    pieces = stages["packing"](spark, again(mixed), small).collect()
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    assert sum(p.length for p in pieces) == sum(len(ids[r[0]]) for r in mixed)

    whole = corpus_pipeline.run(spark, small).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in whole} == {i: n * len(ids[i]) for i, n in times.items()}
