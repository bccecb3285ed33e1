"""Near-duplicates found through deletion-variant signatures: by fingerprint bits, or by shared shingles.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most four bits
have a segment in which they differ in at most one, so indexing each segment once per position with
that one bit blanked out (64 variants in all) makes the two meet under an equal key. Pairs that meet
are verified on all 64 bits inside the join, and each pair is emitted by one key only.

Copies never form pairs: fingerprints are made distinct before the variants are built, and documents
get their class back through their fingerprint.

near_copies and one_of_each find texts by the similarity of their word shingles. At a similarity of 0.8
the bits of SimHash differ so often (15 in 100) that no few segments differ by one bit only, so there the
signature is made of minima of shingle hashes instead, of which texts of similarity s share each with
probability s. The rest is alike: segments of SYMBOLS minima, of which one may differ; a key for each
position with that minimum left out; texts that meet under an equal key; and exact verification of their
shingles. With SEGMENTS_OF_MINIMA segments two texts of similarity 0.8 meet with probability 0.9994,
more alike ones more often.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices, utf8
from tessera.operators.census import number_rows

#: (lowest bit, width) of the three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
KEY_BITS = 22
#: Shingles that are looked at at once, and bytes of texts that are held as Python bytes at once.
STEP, SLICE = 4096, 4 << 20


#: Bytes of a text whose words are held at once.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(text: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, block by block; a shorter text is one shingle, one without words none.

    Words are split on bytes: A-Z only are lowered, ASCII white space only parts them.
    """
    digest = xxhash.xxh64_intdigest
    carry: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        # A block ends where a word does.
        cut_ = _SPACE.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = cut_.start() if cut_ else len(text)
        words = carry + text[at:end].lower().split()
        at = end
        n = len(words) - shingle + 1
        if n < 1:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        yield np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n)
        some, carry = True, words[n:]
    if carry and not some:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text, as a signed 64-bit integer; 0 if it has no words. Holds a block of a long text."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in _hashes(text, shingle, seed):
        for k in range(0, len(hashes), STEP):
            ones += np.unpackbits(hashes[k : k + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return _signed(int.from_bytes(np.packbits(ones * 2 > n).tobytes())) if n else 0


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, *, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty and has fingerprint 0."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        parts = slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0, SLICE)
        return pa.array([simhash(t, shingle, seed) for part in parts for t in utf8(part.column(0))], pa.int64())

    return docs.select("doc_id", fp(F.col("text").cast("string")).alias("fp"))


def _segment(bits: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << width) - 1))


def _variants(fps: DataFrame) -> DataFrame:
    """(fp, key): one key for each bit position, of the bit's segment with that bit blanked out."""
    keys = []
    for low, width in SEGMENTS:
        segment = _segment(F.col("fp"), low, width).cast("int")
        for bit in range(width):
            blank = segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            keys.append(blank.bitwiseOR(F.lit((low + bit) << KEY_BITS)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame, *, distance: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in ``fps`` that differ in at most ``distance`` bits.

    ``distance`` can be 0 to 5: with three segments a sixth bit could leave two in each.
    """
    if not 0 <= distance < 2 * len(SEGMENTS):
        raise ValueError(f"distance must be below {2 * len(SEGMENTS)}")
    v = _variants(fps)
    a, b = v.select(F.col("key"), F.col("fp").alias("a")), v.select(F.col("key"), F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    # The pair belongs to the first segment with at most one differing bit, and there to the key that
    # blanks that bit (the segment's lowest position if the segments are equal).
    chosen = F.lit(None).cast("int")
    for low, width in reversed(SEGMENTS):
        part = _segment(x, low, width)
        own = F.when(part == 0, F.lit(low)).otherwise(F.bit_count(part - 1) + low)
        chosen = F.when(F.bit_count(part) <= 1, own).otherwise(chosen)
    near = (F.bit_count(x) <= distance) & (_blank_of(a.key) == chosen)
    return a.join(b, (a.key == b.key) & (F.col("a") < F.col("b")) & near).select("a", "b")


def _blank_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS).bitwiseAND(F.lit(63))


def connected(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, root), root the least node.

    Alternates the two star contractions until a round changes nothing; every round is checkpointed.
    """
    stars = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        stars = cut(_small_star(_large_star(stars)))
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before or now[0] == 0:
            return stars.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("v", "u").union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v's neighbour u
    least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
    return both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("v").agg(F.min("u").alias("m"))
    moved = e.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.union(least.select("v", F.col("m").alias("u"))).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text and any other columns).

    component_id is the least doc_id that can be reached over links, the document's own included.
    Null and empty texts share fingerprint 0 and so one component. Rows that repeat a doc_id stay rows
    of their own. A row without doc_id gets the least id of its component, null if there is none.
    An empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, shingle=shingle, seed=seed))  # 16 bytes a document
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Nodes begin with the least doc_id of their fingerprint, so a component's least node names its least doc_id
    # and nothing has to be gathered by component.
    none = F.lit((1 << 63) - 1)
    node = distinct.select("fp", F.struct(F.coalesce("least", none).alias("id"), F.col("fp").alias("of")).alias("node"))
    a, b = (node.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}")) for c in "ab")
    pairs = links(distinct.select("fp"), distance=distance).join(a, "a").join(b, "b")
    roots = connected(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    found = roots.select(F.col("node.of").alias("fp"), F.nullif(F.col("root.id"), none).alias("root"), F.lit(True).alias("_in"))
    # Kept, so that the last join has exchanges of its own and Spark can split a fingerprint with many copies.
    classes = cut(distinct.join(found, "fp", "left").select("fp", F.when(F.col("_in"), F.col("root")).otherwise(F.col("least")).alias("component_id")))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


SHINGLE, SIMILARITY = 5, 0.8
SEGMENTS_OF_MINIMA, SYMBOLS = 7, 6
_rng = np.random.default_rng(42)
_FLIP, _TIMES, _MARK = (_rng.integers(0, 1 << 64, SEGMENTS_OF_MINIMA * SYMBOLS, dtype=np.uint64) for _ in range(3))
_TIMES |= np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a shorter text is one shingle, one without words none."""
    return np.unique(np.concatenate([*_hashes(text, shingle, 0), np.zeros(0, np.uint64)]))


def variants(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """Signed 64-bit keys, one for each minimum of each segment left out, and a byte of each minimum; none of an empty set."""
    if not len(hashes):
        return [], []
    least = np.full(len(_FLIP), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, ((hashes[at : at + STEP, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    mixed = ((least ^ (least >> np.uint64(29))) * _TIMES).reshape(SEGMENTS_OF_MINIMA, SYMBOLS)
    rest = mixed.sum(axis=1, keepdims=True) - mixed  # of a segment without one of its minima
    keys = (rest.ravel() ^ _MARK) * _TIMES
    return (keys ^ (keys >> np.uint64(32))).view(np.int64).tolist(), (mixed.ravel() >> np.uint64(56)).astype(np.uint8).view(np.int8).tolist()


def enough_alike(a: Column, b: Column, least: float) -> Column:
    """Whether two texts' bytes of minima agree as often as those of texts that are ``least`` similar do, but for four deviations.

    One in 30,000 pairs at that similarity is lost by this, fewer above it; most pairs that only share a
    passage never leave the join.
    """
    m = len(_FLIP)
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    return agree >= int(m * least - 4 * (m * least * (1 - least)) ** 0.5)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; 1 if both are empty."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def _marked(docs: DataFrame) -> DataFrame:
    """(id, text_key, set_key, n, keys, sign) of every row: digests of its text and of its set of shingles, the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 2, SLICE)):
            sets, sizes, found, signs = [], [], [], []
            for text in utf8(b.column(2)):
                hashes = shingles(text)
                sets.append(xxhash.xxh128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                keys, sign = variants(hashes)
                found.append(keys)
                signs.append(sign)
            arrays = [b.column(0), b.column(1), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "text_key", "set_key", "n", "keys", "sign"])

    return _keyed(docs).mapInArrow(run, "id long, text_key binary, set_key binary, n long, keys array<long>, sign array<byte>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))


def _near(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b), distinct classes, whose texts are at least ``least`` similar."""

    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        known = lru_cache(256)(shingles)
        return pa.array([similarity(known(i), known(j)) >= least for i, j in zip(utf8(x), utf8(y))], pa.bool_())

    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").where(near("text_a", "text_b")).select("a", "b")


def _near_classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Every row as (id, text_key, set_key), and the root (id, text_key, n) of each set_key's component."""
    none = F.lit((1 << 63) - 1)
    marked = cut(_marked(docs))  # some 400 bytes a document
    # A class is named by its least doc_id and that row's text; the size of its set is the same in all of its rows.
    own = F.struct(F.coalesce("id", none).alias("id"), F.col("text_key").alias("text_key"), "n")
    classes = cut(marked.groupBy("set_key").agg(F.min(own).alias("node"), F.first("keys").alias("keys"), F.first("sign").alias("sign")))
    member = classes.select("node", F.explode("keys").alias("bucket"))
    leads = member.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    members = cut(member.join(leads, "bucket").where("node <> lead"))
    wanted = members.select("node").union(members.select(F.col("lead").alias("node"))).distinct()
    same = ["_id", "text_key"]
    of = wanted.select("node", F.col("node.id").alias("_id"), F.col("node.text_key").alias("text_key"))
    rows = _keyed(docs).withColumn("_id", F.coalesce("id", none)).drop("id")
    # A row that repeats an id with the same text comes again here; all that is made of it is made distinct.
    texts = cut(rows.join(of, same).select("node", "text"))

    # Kept, so that the joins with it have exchanges of their own and Spark can split a class with many copies.
    roots = _connected_in_buckets(members, classes.select("node", "sign"), texts, least)
    named = cut(classes.select("set_key", "node").join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("root")))
    return marked.select("id", "text_key", "set_key"), named


def _could(a: Column, b: Column, least: float) -> Column:
    """Whether classes of these sizes can be ``least`` similar: similarity can't exceed the ratio of the sizes."""
    return F.least(a["n"], b["n"]) >= F.lit(least) * F.greatest(a["n"], b["n"]) - 1e-9


#: Members that are compared with a copy of their lead's text, in one group.
COMPANY = 512


def _near_leads(tried: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``tried`` (a: lead, b: member, each member once) that are near; a text is moved once, a lead's once for COMPANY members."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, known = None, np.zeros(0, np.uint64)
        for batch in (part for b in batches for part in slices(b, 4, 4 << 20)):
            near = []
            for k, (group, salt, member, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "member", "text")))):
                hashes = shingles((text or "").encode())
                if not member:
                    lead, known = (group, salt), hashes
                elif lead == (group, salt) and similarity(known, hashes) >= least:
                    near.append(k)
            yield pa.RecordBatch.from_struct_array(pa.StructArray.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).take(pa.array(near, pa.int64())))

    sizes = cut(tried.groupBy("a").agg(F.ceil(F.count("*") / COMPANY).alias("groups")))
    members = tried.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("salt"))
    own = members.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", F.lit(True).alias("member"), "b", "text")
    first = sizes.join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("a").alias("b"), "text")
    sorted_ = own.unionByName(first).repartition("a", "salt").sortWithinPartitions("a", "salt", "member")
    node = tried.schema["a"].dataType.simpleString()
    return sorted_.mapInArrow(compare, f"a {node}, b {node}")


#: Documents whose shingles tell which are common, and common shingles that are told to every task at most. Both only
#: decide the order in which shingles are looked at: any order gives the same pairs.
SAMPLED, COMMON = 4096, 1 << 16


def _prefixes(rows: DataFrame, common: np.ndarray, least: float) -> DataFrame:
    """(s, row, part, n, place, short) from (row, part, text): the shingles by which a text can meet its near copies.

    Shingles are taken in one order for all texts, common ones last. Two sets of similarity ``least`` share one of
    the first ``n - ceil(least * n) + 1`` of the longer set and of the first ``n - ceil(2 * least / (1 + least) * n) + 1`` of the
    shorter one; ``short`` marks the latter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                found: list[tuple[np.ndarray, ...]] = []
                for k, text in enumerate(utf8(part.column(2))):
                    hashes = shingles(text)
                    n = len(hashes)
                    often = np.isin(hashes, common, assume_unique=True)
                    order = np.concatenate([hashes[~often], hashes[often]])
                    longer = n - int(np.ceil(least * n - 1e-9)) + 1
                    shorter = n - int(np.ceil(2 * least / (1 + least) * n - 1e-9)) + 1
                    place = np.arange(min(n, longer))
                    found.append((order[: len(place)], np.full(len(place), k), np.full(len(place), n), place, place < shorter))
                if not found:
                    continue
                s, k, n, place, short = (np.concatenate(c) for c in zip(*found))
                of = pa.array(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.view(np.int64)), part.column(0).take(of), part.column(1).take(of), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(short)],
                    names=["s", "row", "part", "n", "place", "short"],
                )

    return rows.select("row", "part", "text").mapInArrow(run, "s long, row long, part long, n int, place int, short boolean")


def _common_shingles(texts: DataFrame, total: int) -> np.ndarray:
    """Ascending hashes of shingles that several of SAMPLED texts have, at most COMMON of them."""

    @F.arrow_udf("array<long>")
    def hashes(t: pa.Array) -> pa.Array:
        return pa.array([shingles(x).view(np.int64) for x in utf8(t)], pa.list_(pa.int64()))

    part = max(1, total // SAMPLED)
    each = texts.where(F.pmod(F.xxhash64("row"), F.lit(part)) == 0).select(F.explode(hashes("text")).alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(COMMON)
    return np.sort(np.array([r.s for r in often.select("s").collect()], np.int64).view(np.uint64))


def _meeting(prefixes: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (x, y) of rows of different parts whose prefixes meet and whose places leave enough to share.

    Of each shingle only the texts outside its first part look for others, so a shingle that the near copies of
    one component share makes no pairs.
    """
    parts = prefixes.groupBy("s").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("s", "p")
    kept = cut(prefixes.join(parts, "s"))
    longer = [F.col(c).alias(f"x_{c}") for c in ("row", "part", "n", "place")]
    shorter = [F.col(c).alias(f"y_{c}") for c in ("row", "part", "n", "place")]
    size = (F.struct("y_n", "y_row") < F.struct("x_n", "x_row")) & (F.col("y_n") >= F.lit(least) * F.col("x_n") - 1e-9)
    rest = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))  # this shingle and those after it
    enough = rest >= F.lit(least / (1 + least)) * (F.col("x_n") + F.col("y_n")) - 1e-9
    met = (F.col("x_part") != F.col("y_part")) & size & enough
    outside, inside = F.col("part") != F.col("p"), F.col("part") == F.col("p")
    one = kept.where(outside).select("s", *longer).join(kept.where("short").select("s", *shorter), "s").where(met)
    other = kept.where(inside).select("s", *longer).join(kept.where(F.col("short") & outside).select("s", *shorter), "s").where(met)
    return one.select("x_row", "y_row").union(other.select("x_row", "y_row")).distinct()


def _connected_in_buckets(members: DataFrame, signs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(node, root) of the components that near pairs in buckets make; ``members``: bucket, lead (its least class), node.

    Every class is compared with the least lead of its buckets first, so a large group of near copies costs one
    comparison a class. Then only buckets that hold more than one component have anything left to say. Their
    classes meet by the first of their shingles, common ones last: texts that share a common passage and are not near
    copies do not meet, and no pair of near copies in different components is lost.
    """
    a, b = F.col("a"), F.col("b")
    tried = cut(members.groupBy(F.col("node").alias("b")).agg(F.min("lead").alias("a")).select("a", "b").where(_could(a, b, least)))
    near = cut(_near_leads(tried, texts, least).distinct())
    roots = connected(near)
    every = members.select("bucket", "node").union(members.select("bucket", F.col("lead").alias("node")))
    labelled = every.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
    extent = labelled.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket")
    left = labelled.join(extent, "bucket", "left_semi").groupBy("node").agg(F.first("part").alias("part"))
    numbered = number_rows(left, ["part", "node"])
    rows = cut(numbered.join(numbered.groupBy("part").agg(F.min("row").alias("part_row")), "part").select("node", "row", F.col("part_row").alias("part")))
    total = rows.count()
    if total < 2:
        return roots
    found = cut(rows.join(texts, "node").select("node", "row", "part", "text"))
    pairs = _meeting(_prefixes(found, _common_shingles(found, total), least), least)
    known = rows.join(signs, "node").select("row", "node", "sign")
    x, y = (known.select(*[F.col(c).alias(f"{side}_{c}") for c in known.columns]) for side in "xy")
    alike = pairs.join(x, "x_row").join(y, "y_row").where(enough_alike(F.col("x_sign"), F.col("y_sign"), least))
    fresh = cut(alike.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")))
    return connected(near.union(cut(_near(fresh, texts, least).distinct())))


def near_copies(docs: DataFrame, *, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs`` (doc_id, text and any other columns).

    Rows are linked if their sets of SHINGLE-word shingles are at least ``least`` similar; a shorter text is
    one shingle. component_id is the least doc_id that can be reached over links, the document's own
    included. Null, empty and blank texts are one component. Rows that repeat a doc_id stay rows of their
    own. A row without doc_id gets the least id of its component, null if there is none. An empty table
    gives an empty result.
    """
    marked, named = _near_classes(docs, least)
    component = F.nullif(F.col("root.id"), F.lit((1 << 63) - 1)).alias("component_id")
    return marked.join(named, "set_key").select(F.col("id").alias("doc_id"), component)


def one_of_each(docs: DataFrame, *, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component of near_copies left, all of its columns as they are.

    The row with the least doc_id stays (rows without one come last), of several texts under that doc_id
    the one with the least digest, of rows equal in both any one. So a doc_id that stands with texts of
    two components stays with both.
    """
    marked, named = _near_classes(docs, least)
    times = marked.join(named, "set_key").where((F.coalesce("id", F.lit((1 << 63) - 1)) == F.col("root.id")) & (F.col("text_key") == F.col("root.text_key")))
    stay = cut(times.groupBy(F.col("id").alias("_stay_id"), F.col("text_key").alias("_stay_text")).agg(F.count("*").alias("_stay_n")))
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    once, often = stay.where("_stay_n = 1"), stay.where("_stay_n > 1")
    of = lambda some: F.col("doc_id").cast("long").eqNullSafe(some["_stay_id"]) & (key == some["_stay_text"])
    single = docs.join(once, of(once), "left_semi")
    several = docs.join(often, of(often)).dropDuplicates(["_stay_id", "_stay_text"]).select(*[docs[c] for c in docs.columns])
    return single.unionByName(several)


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


__all__ = ["connected", "fingerprints", "hex64", "links", "near_copies", "near_duplicates", "one_of_each", "shingles", "similarity", "simhash", "variants"]
