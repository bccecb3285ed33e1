"""The trie of conversation prefixes, built from vertical bitmaps.

Conversations are numbered by id and dealt into shards of SHARD consecutive ones. In a shard, every
(position, turn) has a posting: the set of its conversations as a bitset. A node is the set of the
conversations that begin with its path; walking depth first, the children of a node are the
intersections of its bitset with the postings of the next position that its members name. Popcounts are
the numbers of members, and every shard gives the list of members that end at a node.

A path is named by its depth and the xor of 128-bit hashes of its (position, turn) pairs, so the nodes
of all shards meet by an aggregation, and long conversations are cut into blocks of BLOCK positions:
a task holds the bitsets of SHARD conversations at BLOCK positions, however long a conversation is.

Sums over subtrees need no walk over levels. A conversation is a node's first if it has the node's least
id; the nodes it is first of are the lower end of its path. Let kept(c) be the characters of c before
those nodes: what c shares with conversations of lesser ids. A subtree saves the sum of kept(c) over
its members, less what the path above its top holds of it, and its leaves are its members that are first
of a leaf. Both are sums over bitsets, which a second pass takes with the same bitsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.operators.census import number_rows

#: Conversations of a shard (a multiple of 16), and positions of a block.
SHARD, BLOCK = 512, 64

KEY = ["depth", "key1", "key2"]
NODE = (
    "shard long, block long, depth long, key1 long, key2 long, parent1 long, parent2 long, turn binary, first_id long, n long, "
    "chars long, above long, ends array<long>, members binary"
)


@dataclass
class Turns:
    """Conversations with their turns in order.

    rows: conv_id, position (from 0, gapless), turn (digest of role and text), chars (code points of the
    text). heads: conv_id, length, one row a conversation, those without turns included.
    """

    rows: DataFrame
    heads: DataFrame


def ordered(conversations: DataFrame) -> Turns:
    """The turns of ``conversations`` (conv_id, turn, role, text and any other columns) in order.

    Turns are ordered by turn, null first, ties by role and text; rows that are equal in all of these are turns
    of their own. A null role or text counts as empty, a text of any length is read whole. Rows without
    conv_id belong to no conversation. An empty table has no conversations.

    A conversation of any number of rows is spread over tasks: rows are dealt out by ranges, and each
    partition's part of a conversation is numbered from the rows in the parts before.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    digest = F.unhex(F.md5(F.concat_ws("\n", F.length("role").cast("string"), "role", "text")))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    kept = cut(rows.orderBy(*order).select("conv_id", digest.alias("turn"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("_id")))
    placed = kept.withColumn("_part", F.shiftright("_id", 33))
    parts = placed.groupBy("conv_id", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = cut(parts.withColumn("_before", F.coalesce(before, F.lit(0))))  # a row a conversation and partition
    position = (F.col("_id") - F.col("_first") + F.col("_before")).alias("position")
    return Turns(
        placed.join(spans, ["conv_id", "_part"]).select("conv_id", position, "turn", "chars"),
        spans.groupBy("conv_id").agg(F.sum("_n").alias("length")),
    )


def spliced(turns: Turns, *, group: int = 100, shared: int = 6) -> Turns:
    """Every conversation c rebuilt to begin like the first of its group.

    It gets the first h turns of conversation c - c % group (all if there are fewer, none if it is absent),
    h = crc32(decimal c) % shared, and then its own turns after its first h. The first of a group stays as it is.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    others = turns.heads.withColumn("base", base).withColumn("h", h).where("base <> conv_id")
    bases = turns.heads.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    taken = F.least("h", F.coalesce("base_length", F.lit(0)))
    heads = others.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))
    heads = cut(heads.unionByName(turns.heads.where(base == F.col("conv_id")).select("conv_id", base.alias("base"), F.lit(0).alias("h"), F.lit(0).alias("taken"), "length")))
    own = turns.rows.join(heads.select("conv_id", "h", "taken"), "conv_id").where("position >= h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "turn", "chars")
    lent = turns.rows.where((F.col("position") < shared) & (base == F.col("conv_id"))).withColumnRenamed("conv_id", "base")
    # At most shared - 1 turns of a conversation, for at most 2 * group others.
    begun = heads.where("taken > 0").select("conv_id", "base", "taken").join(lent, "base").where("position < taken").select("conv_id", "position", "turn", "chars")
    return Turns(own.unionByName(begun), heads.select("conv_id", "length"))


@dataclass(frozen=True)
class Layout:
    """Conversations of a shard and positions of a block."""

    shard: int = SHARD
    block: int = BLOCK

    @property
    def sparse(self) -> int:
        """Sets of up to so many members are stored as two-byte numbers, larger ones as bitsets."""
        return self.shard // 16

    def members(self, bits: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(self.shard // 8, "little"), np.uint8), bitorder="little"))

    def stored(self, bits: int, members: np.ndarray) -> bytes:
        return members.astype("<u2").tobytes() if len(members) <= self.sparse else bits.to_bytes(self.shard // 8, "little")


class _Postings:
    """Postings of one shard at the positions of one block, with the conversations that reach it."""

    def __init__(self, rows: pa.Table, heads: pa.Table, block: int, layout: Layout) -> None:
        self.start = block * layout.block
        who = heads.column("ordinal").to_numpy()
        self.present = np.sort(who)

        def by_ordinal(name: str) -> np.ndarray:
            out = np.zeros(layout.shard, np.int64)
            out[who] = heads.column(name).to_numpy()
            return out

        self.ids, self.length, self.head1, self.head2, self.above = map(by_ordinal, ("conv_id", "length", "head1", "head2", "head_chars"))
        at = rows.column("position").to_numpy() - self.start
        key1, key2, of = (rows.column(c).to_numpy() for c in ("key1", "key2", "ordinal"))
        order = np.lexsort((key2, key1, at))
        a, b = order[1:], order[:-1]
        new = np.append(np.ones(min(1, len(order)), bool), (at[a] != at[b]) | (key1[a] != key1[b]) | (key2[a] != key2[b]))
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        firsts = order[new]
        self.key1, self.key2, self.chars = key1[firsts], key2[firsts], rows.column("chars").to_numpy()[firsts]
        self.turn = rows.column("turn").combine_chunks().take(pa.array(firsts)).to_pylist() if len(firsts) else []
        self.named = np.full((layout.block, layout.shard), -1, np.int64)  # the posting of each conversation at each position
        self.named[at, of] = number
        self.sets = [0] * len(firsts)
        for posting, ordinal in zip(number.tolist(), of.tolist()):
            self.sets[posting] |= 1 << ordinal

    def tops(self) -> Iterator[tuple[np.ndarray, int, int, int]]:
        """(members, key1, key2, characters) of the nodes above the block: the root, or those the block before ends with."""
        if self.start == 0:
            yield self.present, 0, 0, 0
            return
        going = self.present
        order = going[np.lexsort((going, self.head2[going], self.head1[going]))]
        same = (self.head1[order][1:] == self.head1[order][:-1]) & (self.head2[order][1:] == self.head2[order][:-1])
        for members in np.split(order, np.flatnonzero(~same) + 1):
            m = members[0]
            yield members, int(self.head1[m]), int(self.head2[m]), int(self.above[m])


def _nodes_of_shard(key: tuple, rows: pa.Table, heads: pa.Table, layout: Layout) -> pa.Table:
    """The nodes of one shard at the positions of one block, found depth first."""
    shard, block = (int(k.as_py()) for k in key)
    if not heads.num_rows:
        return pa.Table.from_pylist([], schema=_NODE_ARROW)
    p = _Postings(rows, heads, block, layout)
    out: list[list] = [[] for _ in range(12)]

    def emit(bits: int, members: np.ndarray, depth: int, key1: int, key2: int, parent: tuple[int, int], turn: bytes | None, chars: int, above: int) -> None:
        ends = p.ids[members[p.length[members] == depth]].tolist()
        values = (depth, key1, key2, *parent, turn, int(p.ids[members[0]]), len(members), chars, above, ends, layout.stored(bits, members))
        for column, value in zip(out, values):
            column.append(value)

    for members, key1, key2, above in p.tops():
        top = sum(1 << m for m in members.tolist())
        if block == 0:
            emit(top, members, 0, 0, 0, (0, 0), None, 0, 0)
        stack = [(top, members, 0, key1, key2, above)]
        while stack:
            bits, members, level, key1, key2, above = stack.pop()
            if level == layout.block:
                continue
            named = p.named[level, members]
            # Only postings that a member names can meet the parent's set.
            for posting in np.unique(named[named >= 0]).tolist() if len(members) > 1 else named[named >= 0].tolist():
                child = bits & p.sets[posting]
                inside = layout.members(child) if len(members) > 1 else members
                own = (key1 ^ int(p.key1[posting]), key2 ^ int(p.key2[posting]))
                chars = int(p.chars[posting])
                emit(child, inside, p.start + level + 1, *own, (key1, key2), p.turn[posting], chars, above)
                stack.append((child, inside, level + 1, *own, above + chars))
    here = [pa.array([v] * len(out[0]), pa.int64()) for v in (shard, block)]
    return pa.Table.from_arrays(here + [pa.array(c, f.type) for c, f in zip(out, list(_NODE_ARROW)[2:])], schema=_NODE_ARROW)


_L = pa.int64()
_NODE_ARROW = pa.schema(
    [("shard", _L), ("block", _L), ("depth", _L), ("key1", _L), ("key2", _L), ("parent1", _L), ("parent2", _L), ("turn", pa.binary()), ("first_id", _L), ("n", _L), ("chars", _L), ("above", _L), ("ends", pa.list_(_L)), ("members", pa.binary())]
)
_SUM_ARROW = pa.schema([("depth", _L), ("key1", _L), ("key2", _L), ("first_id", _L), ("first_kept", _L), ("kept", _L), ("leaves", _L)])


def _sums_of_shard(nodes: pa.Table, heads: pa.Table, layout: Layout) -> pa.Table:
    """For each node of one shard and block the sums of kept and leaf over its members."""
    kept, leaf = np.zeros(layout.shard, np.int64), np.zeros(layout.shard, np.int64)
    who = heads.column("ordinal").to_numpy()
    kept[who], leaf[who] = heads.column("kept").to_numpy(), heads.column("leaf").to_numpy()
    n, stored = nodes.column("n").to_numpy(), nodes.column("members").to_pylist()
    totals = np.zeros((3, len(n)), np.int64)  # kept of the first, kept, leaves
    few, many = np.flatnonzero(n <= layout.sparse), np.flatnonzero(n > layout.sparse)
    if len(few):
        members = np.frombuffer(b"".join([stored[k] for k in few]), "<u2")
        starts = np.concatenate([[0], np.cumsum(n[few])[:-1]])
        totals[:, few] = kept[members[starts]], np.add.reduceat(kept[members], starts), np.add.reduceat(leaf[members], starts)
    for k in many:
        members = layout.members(int.from_bytes(stored[k], "little"))
        totals[:, k] = kept[members[0]], kept[members].sum(), leaf[members].sum()
    columns = [nodes.column(c).combine_chunks() for c in ("depth", "key1", "key2", "first_id")] + [pa.array(t) for t in totals]
    return pa.Table.from_arrays(columns, schema=_SUM_ARROW)


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node from rows (depth, key1, key2, shard, ends) sorted by all of these; holds one shard's list at a time."""
    at, digest = None, None
    for batch in batches:
        found: list[tuple] = []
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        for key, ends in zip(keys, batch.column(4).to_pylist()):
            text = ",".join(map(str, ends)).encode()
            if key == at:
                digest.update(b"," + text)
                continue
            if at is not None:
                found.append((*at, digest.hexdigest()))
            at, digest = key, hashlib.sha256(text)
        yield _digest_rows(found)
    if at is not None:
        yield _digest_rows([(*at, digest.hexdigest())])


def _digest_rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (_L, _L, _L, pa.string()))], names=[*KEY, "ends_sha256"])


def nodes(turns: Turns, layout: Layout = Layout()) -> DataFrame:
    """One row a node of the trie of ``turns``, the root included.

    conv_id (least member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (nodes without children in the subtree, the node itself included), saved_tokens (over the subtree,
    members less one times code points of the last text), ends_sha256 (hex digest of the members that end
    here, decimal ids ascending, comma-joined), turn (digest of the last role and text; null for the root;
    ``texts`` has what it stands for). Conversations without turns are members of the root. Without
    conversations there are no nodes. Equal conversations share all of their nodes.
    """
    ranked = number_rows(turns.heads, ["conv_id"])
    ranked = cut(ranked.select("conv_id", "length", F.floor((F.col("row") - 1) / layout.shard).alias("shard"), ((F.col("row") - 1) % layout.shard).alias("ordinal")))
    keys = [F.xxhash64(F.lit(k), "position", "turn").alias(f"key{k}") for k in (1, 2)]
    rows = turns.rows.join(ranked.select("conv_id", "shard", "ordinal"), "conv_id")
    rows = cut(rows.select("conv_id", "shard", F.floor(F.col("position") / layout.block).alias("block"), "ordinal", "position", "turn", "chars", *keys))

    # What lies before each block of a conversation: one row for BLOCK turns.
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("key1").alias("x1"), F.bit_xor("key2").alias("x2"), F.sum("chars").alias("c"))
    w = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.bit_xor("x1").over(w).alias("head1"), F.bit_xor("x2").over(w).alias("head2"), F.sum("c").over(w).alias("head_chars")]
    total = F.sum("c").over(Window.partitionBy("conv_id")).alias("total")
    blocks = ranked.join(sums.select("conv_id", "block", *before, total), "conv_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("block", "head1", "head2", "head_chars", "total")]
    blocks = cut(blocks.select("conv_id", "length", "shard", "ordinal", *zero))

    place = ["shard", "block"]
    found = cut(rows.drop("conv_id").groupBy(*place).cogroup(blocks.groupBy(*place)).applyInArrow(lambda key, rows, heads: _nodes_of_shard(key, rows, heads, layout), NODE))
    merged = found.groupBy(*KEY).agg(
        F.min("first_id").alias("conv_id"), F.sum("n").alias("n_convs"), *[F.first(c).alias(c) for c in ("parent1", "parent2", "turn", "chars", "above")]
    )
    above = F.col("depth") - 1
    children = merged.where("depth > 0").groupBy(above.alias("depth"), F.col("parent1").alias("key1"), F.col("parent2").alias("key2")).agg(F.count("*").alias("n_children"))
    merged = cut(merged.join(children, KEY, "left").fillna(0, ["n_children"]))

    firsts = merged.groupBy("conv_id").agg(F.min_by("above", "depth").alias("kept"), F.max(F.col("n_children") == 0).alias("leaf"))
    scalars = blocks.join(firsts, "conv_id", "left").select(
        *place, "ordinal", F.coalesce("kept", "total").alias("kept"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf")
    )
    held = found.select(*place, *KEY, "first_id", "n", "members")
    part = held.groupBy(*place).cogroup(scalars.groupBy(*place)).applyInArrow(lambda nodes, heads: _sums_of_shard(nodes, heads, layout), "depth long, key1 long, key2 long, first_id long, first_kept long, kept long, leaves long")
    totals = part.groupBy(*KEY).agg(F.min_by("first_kept", "first_id").alias("first_kept"), F.sum("kept").alias("kept"), F.sum("leaves").alias("n_leaves"))

    ends = found.where(F.size("ends") > 0).select(*KEY, "shard", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "shard")
    digests = ends.mapInArrow(_end_digests, "depth long, key1 long, key2 long, ends_sha256 string")
    parents = merged.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"))
    whole = merged.join(totals, KEY).join(digests, KEY, "left").join(parents, ["depth", "parent1", "parent2"], "left")
    saved = F.col("kept") - F.col("first_kept") - F.col("above") * (F.col("n_convs") - 1)
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.lower(F.hex("turn")).alias("turn"),
    )


def texts(conversations: DataFrame) -> DataFrame:
    """(turn, role, text): what the digests in ``nodes`` stand for, each once."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat_ws("\n", F.length(role).cast("string"), role, text))
    return conversations.select(digest.alias("turn"), role.alias("role"), text.alias("text")).groupBy("turn").agg(F.first("role").alias("role"), F.first("text").alias("text"))


__all__ = ["Layout", "Turns", "nodes", "ordered", "spliced", "texts"]
