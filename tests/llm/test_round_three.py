"""Prefix trie, hyperdimensional profiles and vector codes against brute force, with every odd case."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import codes, hypervectors, prefix_trie

# Prefix trie

TURNS = "conv_id long, turn long, role string, text string, n_convs string"


def slow_trie(rows, rebuild):
    """Nodes from dictionaries of paths: (conv_id, depth, parent, members, children, leaves, saved, ends)."""
    own = collections.defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    talk = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    if rebuild:
        base = lambda c: c - int(np.fmod(c, 100))
        h = lambda c: zlib.crc32(str(c).encode()) % 6
        talk = {c: v if base(c) == c else talk.get(base(c), [])[: h(c)] + v[h(c) :] for c, v in talk.items()}
    members = collections.defaultdict(list)
    for c in sorted(talk):
        for d in range(len(talk[c]) + 1):
            members[tuple(talk[c][:d])].append(c)
    found = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(1 for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in who if len(talk[c]) == len(path))
        found.append((who[0], len(path), members[path[:-1]][0] if path else None, len(who), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def odd_conversations(rng):
    words = ["a", "bb", "", None, "é☃", "long " * 40]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words), "x") for c in [*range(0, 40), *range(100, 130), 250, 251, -3, -150, -250] for t in range(rng.randrange(1, 7))]
    rows += [(5, None, "user", "null turn", "x"), (5, 0, "user", "tie", "x"), (5, 0, "user", "tie", "x"), (None, 0, "user", "nobody's", "x")]
    # Conversations that are copies, that are a prefix of another, and long ones that share most of their turns.
    rows += [(c, t, "user", f"t{t}", "x") for c in (300, 400, 500) for t in range(150 if c < 500 else 90)] + [(c, t, "user", f"t{t}" if t < 140 else f"{c}-{t}", "x") for c in (600, 700) for t in range(160)]
    return rows


@pytest.mark.parametrize("rebuild", [False, True])
def test_trie_equals_brute_force(spark, rebuild):
    rng = random.Random(7)
    rows = odd_conversations(rng)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    turns = prefix_trie.ordered(df)
    got = prefix_trie.nodes(prefix_trie.spliced(turns) if rebuild else turns)
    want = slow_trie(rows, rebuild)
    assert trie_rows(got) == want
    small = prefix_trie.Layout(shard=16, block=16)  # many shards and blocks, bitsets for small sets
    assert trie_rows(prefix_trie.nodes(prefix_trie.spliced(turns) if rebuild else turns, small)) == want
    if not rebuild:
        told = {r.turn: (r.role, r.text) for r in prefix_trie.texts(df).collect()}
        one = got.where("conv_id = 600 AND depth = 160").first()
        assert told[one.turn] == ("user", "600-159") and got.where("depth = 0").first().turn is None


def test_trie_without_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.nodes(prefix_trie.spliced(prefix_trie.ordered(none))).count() == 0
    # 7 and 8 lose all of their turns where their group's first is absent; they are members of the root.
    rows = [(c, 0, "user", "hi", "x") for c in range(1, 60)]
    got = trie_rows(prefix_trie.nodes(prefix_trie.spliced(prefix_trie.ordered(spark.createDataFrame(rows, TURNS)))))
    assert got == slow_trie(rows, True) and got[0][1] >= 0


# Hyperdimensional profiles


def slow_vector(text, dimensions):
    """The bundle of one text, n-gram by n-gram."""
    run = "".join(c if c.isalpha() or __import__("unicodedata").category(c)[0] == "M" else " " for c in text.lower())
    run = " " + " ".join(run.split(" ")).strip() + " "
    while "  " in run:
        run = run.replace("  ", " ")
    of = {c: hypervectors.letter_vectors(np.array([ord(c)], np.uint32), dimensions)[0].astype(int) for c in set(run)}
    total = np.zeros(dimensions, int)
    for k in range(len(run) - 2):
        total += np.roll(of[run[k]], 2) * np.roll(of[run[k + 1]], 1) * of[run[k + 2]]
    return total


def test_bundles_equal_brute_force(monkeypatch):
    d = 128
    texts = ["The cat sat, on the mat!", "ÉCOLE élève œuvre", "x", "日本語 テキスト", "a" * 300 + " b9c", "नमस्ते दुनिया"]
    protos = np.stack([slow_vector("the cat", d), slow_vector("école élève", d), slow_vector("日本", d)])
    model = hypervectors.Prototypes(["en", "fr", "ja"], protos.astype(float), d)
    for piece in (1 << 19, 7):  # long texts are read in pieces
        monkeypatch.setattr(hypervectors, "PIECE", piece)
        langs, scores = model.compare([*texts, "", "12 !?", "́́"])
        for k, text in enumerate(texts):
            v = slow_vector(text, d)
            cosine = protos @ v / np.linalg.norm(protos, axis=1) / np.linalg.norm(v)
            assert langs[k] == ["en", "fr", "ja"][int(cosine.argmax())] and abs(scores[k] - np.clip(cosine.max(), 0, 1)) < 1e-9
        assert langs[len(texts) :] == ["und"] * 3 and scores[len(texts) :] == [0.0] * 3
    v = hypervectors.letter_vectors(np.arange(2000, dtype=np.uint32))
    products = v.astype(int) @ v.T.astype(int)
    assert set(np.unique(v)) == {-1, 1} and np.abs(products - np.diag(np.diag(products))).max() < 6 * hypervectors.DIMENSIONS**0.5


def test_languages_of_odd_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("key"))
    odd = spark.createDataFrame([(None, None, "en", "x"), (-1, "", "zz", "x"), (-2, "12 34 $$", "zz", "x"), (-3, "der die das und nicht " * 60000, None, "x"), (-1, "le la les", None, "x")], docs.schema)
    every = docs.unionByName(odd).repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = hypervectors.train(every, where=~F.coalesce(held, F.lit(False)))
    assert model.languages == ["de", "en", "es", "fr"]  # zz has no letters to learn from
    again = hypervectors.train(every.repartition(7), where=~F.coalesce(held, F.lit(False)))
    assert (again.bundles == model.bundles).all()  # in any order of tasks
    got = hypervectors.predict(every, model)
    assert got.columns == ["doc_id", "text", "lang", "key", "lang_pred", "score"] and got.count() == every.count()
    rows = {r.doc_id: r for r in got.where("doc_id < 0 AND text <> 'le la les' OR doc_id IS NULL").collect()}
    assert (rows[None].lang_pred, rows[-1].lang_pred, rows[-2].lang_pred) == ("und", "und", "und") and rows[-3].lang_pred == "de"
    scored = got.where(held & (F.length("text") > 40)).select("lang", "lang_pred", "score").collect()
    assert len(scored) > 20 and sum(r.lang == r.lang_pred for r in scored) >= 0.97 * len(scored) and all(0 <= r.score <= 1 for r in scored)
    empty = hypervectors.train(every.limit(0))
    assert empty.languages == [] and {r.lang_pred for r in hypervectors.predict(every, empty).collect()} == {"und"}
    assert hypervectors.predict(every.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        hypervectors.predict(every.withColumnRenamed("key", "Score"), model)


# Vector codes


def test_nearest_entries_are_exact():
    rng = np.random.default_rng(4)
    for n, d, spread in [(16, 8, 1000), (64, 3, 6), (1, 5, 10), (16, 1, 4), (7, 8, codes.LARGEST)]:
        book = codes.Codebook(rng.integers(-spread, spread + 1, (n, d)))
        book.entries[n // 2] = book.entries[0]  # equal entries: the lower one wins
        x = np.concatenate([rng.integers(-spread, spread + 1, (500, d)), book.entries])
        distance = ((x[:, None, :] - book.entries[None]) ** 2).sum(2)
        entry, best = book.nearest(x)
        assert (entry == distance.argmin(1)).all() and (best == distance.min(1)).all()
        found = book.candidates(x, np.full(len(x), spread // 3))
        inside = (np.abs(x[:, None, :] - book.entries[None]) <= spread // 3).all(2)
        assert (((found[:, None] >> np.arange(n, dtype=np.uint64)) & np.uint64(1)).astype(bool) == inside).all()


VECTORS = "vec_id long, embedding array<float>, label string, code string"


def slow_codes(rows):
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * 4096).astype(int), label) for i, v, label, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for d in {len(v) for _, v, _ in kept}:
        own = sorted((k for k in kept if len(k[1]) == d), key=lambda k: (k[0] is None, k[0] or 0, k[1].tolist()))
        cuts = [slice(d * p // 8, d * (p + 1) // 8) for p in range(8)]
        books = [[v[c].tolist() for _, v, _ in own[:16]] for c in cuts]
        near = lambda x, book: min((sum((int(a) - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
        for _ in range(6):
            for c, book in zip(cuts, books):
                groups = collections.defaultdict(list)
                for _, v, _ in own:
                    groups[near(v[c], book)[1]].append(v[c])
                for k, g in groups.items():
                    book[k] = [int(s) // len(g) for s in np.sum(g, axis=0)]
        told = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for i, v, label in own:
            best = [near(v[c], book) for c, book in zip(cuts, books)]
            out.append((i, "".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best), label, told))
    sums = collections.Counter()
    for _, _, error, label, _ in out:
        sums[label] += error
    return sorted(((i, code, error, sums[label], told, label) for i, code, error, label, told in out), key=str)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(0, 0.3, 24).tolist(), str(rng.choice(["a", "b"])), "x") for i in rng.permutation(300)]
    rows += [(3, rows[0][1], None, "x"), (3, rows[0][1], None, "x"), (None, rows[1][1], None, "x"), (-5, [0.0] * 24, "a", "x"), (900, None, "a", "x"), (901, [float("nan")] * 24, "a", "x"), (902, [None] + [0.1] * 23, "a", "x"), (903, [float("inf")] * 24, "a", "x")]
    rows += [(k, [0.5 * k, -0.25, 0.1], "short", "x") for k in range(5)] + [(950, [], "none", "x")]  # parts of unequal length, and empty ones
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256", "label"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_codes(rows)
    assert codes.compress(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, "a", "x")], VECTORS)).collect()


def test_vectors_of_a_batch():
    lists = pa.array([[1.0, 2.0], None, [0.5, None], [0.25, -0.1], [], [float("nan"), 1.0]], pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([lists], names=["v"]).slice(1)
    got = {tuple(rows.tolist()): x.tolist() for rows, x in codes._vectors(batch, 0)}
    assert got == {(3,): [[]], (2,): [[1024, -410]]}


# Near copies that share a passage


def test_shared_passages_make_no_pairs(spark):
    from tessera.llm import simhash

    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(70))
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, near = [], []
    for k in range(400):  # different texts around one passage, each a near copy of the next one now and then
        words = own(30)
        rows.append((2 * k, " ".join([*words[:15], passage, *words[15:]])))
        if k % 20 == 0:
            words[3] = "edited"
            rows.append((2 * k + 1, " ".join([*words[:15], passage, *words[15:]])))
            near.append((2 * k, 2 * k + 1))
    crowd = own(120)
    for k in range(150):  # a large group of near copies that holds the passage too
        words = list(crowd)
        words[k % 100] = f"crowd{k}"
        rows.append((5000 + k, " ".join([*words, passage])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {i: i for i, _ in rows} | {j: i for i, j in near} | {5000 + k: 5000 for k in range(150)}
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == want
    parts = {i: min(want[i], 5000) for i in want}
    found = spark.createDataFrame([(i, parts[i], t) for i, t in rows], "row long, part long, text string")
    apart = found.withColumn("part", F.when(F.col("row") < 5000, F.col("row")).otherwise(F.col("part")))
    common = simhash._common_shingles(apart, len(rows))
    pairs = {tuple(r) for r in simhash._meeting(simhash._prefixes(apart, common, 0.8), 0.8).collect()}
    assert len(pairs) <= 60 and {tuple(sorted(p)) for p in pairs} >= set(near)


# Language model: the score recomputed from plain counts


def slow_scores(train, texts, least=2):
    """log10 probability of each text, from dictionaries, with the model's discount and roundings."""
    from tessera.llm import trie

    tokens = lambda t: [*(t or "").encode().lower().split(), None]  # noqa: E731  None ends a text
    code = lambda c, total: 10.0 ** (-max(0.0, np.ceil(-np.log10((c - trie.DISCOUNT) / total) * trie.STEP)) / trie.STEP)
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        w = tokens(t)
        one.update(w)
        two.update(zip(["start", *w], w))
    two = {k: c for k, c in two.items() if c >= least}
    for t in train:
        w = tokens(t)
        before = ["start", *w]
        three.update((before[i - 1], before[i], w[i]) for i in range(1, len(w)) if (before[i - 1], before[i]) in two and (before[i], w[i]) in two)
    three = {k: c for k, c in three.items() if c >= least}
    of_one = lambda p: len(train) if p == "start" else one[p]
    p2 = {k: code(c, of_one(k[0])) for k, c in two.items()}
    p3 = {k: code(c, two[k[:2]]) for k, c in three.items()}
    share2, share3 = collections.Counter(), collections.Counter()
    for k, p in p2.items():
        share2[k[0]] += p
    for k, p in p3.items():
        share3[k[:2]] += p
    rounded = lambda x: round(x * trie.WHOLE) / trie.WHOLE
    n, v = sum(one.values()), len(one)
    found = []
    for t in texts:
        w = tokens(t)
        before = ["start", *w]
        total = 0.0
        for i, word in enumerate(w):
            p = (one[word] + 1) / (n + v + 1)
            known = before[i] == "start" or before[i] in one
            p = p2.get((before[i], word), 0.0) + (1 - rounded(share2[before[i]]) if known else 1) * p
            if i and (before[i - 1], before[i]) in two:
                p = p3.get((before[i - 1], before[i], word), 0.0) + (1 - rounded(share3[before[i - 1], before[i]])) * p
            total += np.log10(p)
        found.append(total)
    return found


@pytest.mark.parametrize("shard_tokens", [3_000_000, 700])
def test_scores_equal_brute_force(spark, shard_tokens):
    from tessera.llm import language

    rng = random.Random(12)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    docs = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(120)] + [None, "", docs_twice := "A b c a B c", docs_twice]
    asked = [*docs[:40], "unseen words w1 w2 only", None, "w1 w2 w3 w1 w2 w3"]
    model = language.train(spark.createDataFrame([(k % 60, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, score string").repartition(3), shard_tokens=shard_tokens)
    got = language.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], slow_scores(docs, asked), atol=1e-6)


def test_counts_and_codes_are_wide():
    from tessera.llm import trie

    keys, counts = np.array([3, 5, 70, 1 << 62], np.uint64), np.array([1, 5_000_000_000, 2, 1 << 40])
    assert [x.tolist() for x in trie.unpack_counts(trie.pack_counts(keys, counts))] == [keys.tolist(), counts.tolist()]
    merged = trie.merge_counts([trie.pack_counts(keys, counts)] * 3)
    assert merged[1].tolist() == (3 * counts).tolist()
    shard = trie.build_shard(np.array([0, 1, 2, 10, 11]), np.array([5_000_000_000, 2, 3, 2, 7]), np.array([90_000_000_000.0, 10]), 0, 10, 2)
    p = 10.0 ** (shard["code"].astype(float) / -trie.STEP)
    true = (np.array([5_000_000_000, 2, 3, 2, 7]) - trie.DISCOUNT) / np.array([9e10] * 3 + [10] * 2)
    assert (p <= true * (1 + 1e-12)).all() and (p > true * 10 ** (-1.01 / trie.STEP)).all() and shard["count"][0] == 5_000_000_000
    with pytest.raises(OverflowError):
        trie.narrow(np.array([300]), "<u1")


# Neighbours at the default setting, found by probing and scanning alone


@pytest.mark.parametrize("n", [600, 12_000])
def test_neighbours_are_found_by_the_scan(spark, monkeypatch, n):
    from tessera.llm import neighbours

    monkeypatch.setattr(neighbours, "_of_first", lambda queries, *_: queries.where("false").selectExpr("id AS query_id", "id AS vec_id", "0.0 AS score"))
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((40, 32))
    x = (centres[rng.integers(40, size=n)] + 0.6 * rng.standard_normal((n, 32))).astype(np.float32)
    x[7::50] = x[7]  # ties at every rank, over parts of one list
    got = collections.defaultdict(list)
    for r in neighbours.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4), F.col("vec_id") % 20 == 0, k=20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y, hits = x.astype(float), 0
    for q in range(0, n, 20):
        score = y @ y[q]
        score[q] = -np.inf
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and np.allclose([s for _, _, s in own], score[[v for _, v, _ in own]])
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(own, own[1:]))
        hits += len({v for _, v, _ in own} & set(np.lexsort((np.arange(n), -np.round(score, 9)))[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.93 and len(got) == -(-n // 20)


# Long texts, block by block


def test_blocks_change_no_fingerprint(monkeypatch):
    import xxhash

    from tessera.llm import simhash

    rng = random.Random(14)
    texts = [b"", b" \t ", b"one two", b"A b C d", b"x" * 500, b" ".join(b"w%d" % rng.randrange(50) for _ in range(300)), b"a  b\n" * 100 + b"y" * 90 + b" end\x0b"]
    for block in (1 << 20, 64, 7, 1):
        monkeypatch.setattr(simhash, "BLOCK", block)
        for text in texts:
            w = text.lower().split()
            each = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
            want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in each) > len(each))
            assert simhash.simhash(text) % (1 << 64) == want
            five = {xxhash.xxh64_intdigest(b" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))} if w else set()
            assert simhash.shingles(text).tolist() == sorted(five)


# Fingerprints, byte by byte


def slow_print(text):
    """(fingerprint, {chunk code: length}) of a text, one byte after the other."""
    import xxhash

    from tessera.llm import fingerprint as fp

    data, chunks, s, h = text.encode(), [], 0, 0
    for at, b in enumerate(data):
        h = ((h << 1) + (xxhash.xxh64_intdigest(bytes([b]), 2) & 0xFFFFFFFF)) & 0xFFFFFFFF
        size = at + 1 - s
        if len(data) - s <= fp.LEAST:
            break
        if size >= fp.LEAST and h < 1 << (32 - (fp.STRICT if size < fp.NORMAL else fp.LOOSE)) or size == fp.LONGEST:
            chunks.append(data[s : at + 1])
            s = at + 1
    if s < len(data):
        chunks.append(data[s:])
    codes = {(xxhash.xxh3_64_intdigest(c) & 0xFFFFFFFFFF) << 8 | len(c): len(c) for c in chunks}
    assert b"".join(chunks) == data
    return "".join(f"{c:012x}" for c in sorted(codes)), codes


def test_fingerprints_equal_brute_force(spark):
    from tessera.llm import fingerprint

    rng = random.Random(15)
    word = lambda: rng.choice(["alpha", "é", "b☃", "gamma", "of", "the", "x" * rng.randrange(1, 90)])
    base = " ".join(word() for _ in range(300))
    texts = ["", "short", base, base[:900] + "changed" + base[905:], base, *(" ".join(word() for _ in range(rng.randrange(1, 120))) for _ in range(30)), "y" * 1000]
    docs = spark.createDataFrame([(k, t, f"f{k}") for k, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(3)
    inside = lambda a, b: sum(n for c, n in a.items() if c in b) / sum(a.values()) if a else float(not b)
    got = fingerprint.fingerprints(docs).orderBy("doc_id").collect()
    for k, r in enumerate(got):
        following = texts[(k + 1) % len(texts)]
        edited = texts[k][: len(texts[k]) - len(texts[k]) // 4] + following[: len(texts[k]) // 4]
        (own, a), (changed, b), (_, c) = map(slow_print, (texts[k], edited, following))
        assert (r.doc_id, r.fingerprint, r.edited_fingerprint) == (k, own, changed)
        assert abs(r.near_edited - inside(a, b)) < 1e-12 and abs(r.near_next - inside(a, c)) < 1e-12
    assert len(got) == len(texts) and got[2].fingerprint == got[4].fingerprint and got[2].near_next > 0.8
