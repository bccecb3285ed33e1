"""Mixing of sources to target weights by blocks of words, in DataFrame operations only.

Every source is one long stream of words, cut into blocks of a fixed number of words (its last block is
what remains). The targets of all sources share the words of the corpus. The mix is a number of output
shards with a fixed number of slots each; every shard draws how many of its slots each source fills, by
its share of the target: the whole part of what is expected surely, the rest by a multinomial draw
(residual sampling), so totals stay near their targets at every size. A source's slots are numbered
across shards; each run through its blocks is one pass, and a pseudorandom permutation of its block
numbers (swap-or-not rounds over a hash) says which block fills each slot of a pass. Slots past the last
pass that is allowed stay empty. Blocks are joined to slots by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut

#: Words of a block, slots of an output shard, most words of a source as a multiple of its size.
BLOCK, SHARD_SLOTS, MOST = 64, 8192, 3
ROUNDS = 12
#: Documents that share one stretch of a source's stream when their places are summed up.
STRETCH = 250


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_no, source_size, target) from rows (source, source_size).

    Sources in code point order, null last, get the weights in turn. They share the sum of all sizes by
    weight; no target passes ``most`` times its source's size, and what is cut off goes to the others by
    weight. With sources in the order of the level at which they are capped, those before the first that
    stays below its cap are the capped ones, so two running sums give the level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("capped_at", "source_no")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    all_ = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") % len(weights)) + 1).cast("int"))
    ranked = (
        sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", place.cast("double"))
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("capped_at", F.col("cap") / F.col("weight"))
    )
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    shares = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = ranked.withColumn("own_level", left / shares).withColumn(
        "level", F.min(F.when(F.col("own_level") < F.col("capped_at"), F.struct("capped_at", "source_no", "own_level"))).over(all_)
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level.own_level") * F.col("weight"), F.col("cap")))
    return levelled.select("source", "source_no", "source_size", target.alias("target"))


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. n-1 at ``index``, one for each value of ``key``."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        bit = F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index.cast("long"), swap)


def _numbers(rows: DataFrame, count: Column, name: str, step: int = 4096) -> DataFrame:
    """Each row once for every number below ``count``; the work of a large count is dealt out."""
    parts = F.ceil(count / step).cast("long")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or few bytes would become one task
    parted = rows.where(count > 0).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = parted.repartition(tasks, "_part", *rows.columns)
    first = F.col("_part") * step
    return dealt.withColumn(name, F.explode(F.sequence(first, F.least(first + step, count) - 1))).drop("_part")


def plan(sources: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(source_no, source_size, blocks, wanted): the blocks of each source with words, and the slots that meet its target."""
    size = F.col("source_size")
    blocks = F.ceil(size / block)
    return sources.where("source_size > 0").select("source_no", "source_size", blocks.alias("blocks"), (F.col("target") * blocks / size).alias("wanted"))


def draw(plans: DataFrame, *, shard_slots: int = SHARD_SLOTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """(source_no, source_size, blocks, shard, slots, first): the slots of each output shard that a source fills.

    A shard of n slots expects n times a source's share of all slots. The whole part is given; the slots
    that are left are thrown, each into the source whose stretch of the fractions its hash falls in.
    ``first`` numbers a source's slots across shards; none is numbered past ``most`` passes.
    """
    all_ = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a source
    total = F.sum("wanted").over(all_)
    shared = plans.withColumn("_all", F.round(total).cast("long")).withColumn("_share", F.col("wanted") / total)
    shards = F.ceil(F.col("_all") / shard_slots).cast("long")
    each = _numbers(shared, shards, "shard").withColumn("_n", F.least(F.lit(shard_slots), F.col("_all") - F.col("shard") * shard_slots))
    expected = each.withColumn("_sure", F.floor(F.col("_n") * F.col("_share"))).withColumn("_part", F.col("_n") * F.col("_share") - F.col("_sure"))
    here = Window.partitionBy("shard").orderBy("source_no")
    whole = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut_up = (
        expected.withColumn("_to", F.sum("_part").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_from", F.coalesce(F.lag("_to").over(here), F.lit(0.0)))
        .withColumn("_sum", F.sum("_part").over(whole))
        .withColumn("_left", F.col("_n") - F.sum("_sure").over(whole))
        .withColumn("_last", F.col("source_no") == F.max("source_no").over(whole))
    )
    thrown = F.when(F.col("_left") > 0, F.sequence(F.lit(1).cast("long"), F.col("_left"))).otherwise(F.array().cast("array<long>"))
    point = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("shard"), k), F.lit(1 << 52)) / float(1 << 52) * F.col("_sum")
    hits = F.size(F.filter(thrown, lambda k: (point(k) >= F.col("_from")) & ((point(k) < F.col("_to")) | F.col("_last"))))
    counts = cut_up.select("source_no", "source_size", "blocks", "shard", (F.col("_sure") + hits).alias("slots"))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    return first.withColumn("slots", F.greatest(F.least("slots", F.col("blocks") * most - F.col("first")), F.lit(0))).where("slots > 0")


def fill(draws: DataFrame, *, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(shard, source_no, slot, block, words): the block that fills each slot, and the words it holds."""
    slots = _numbers(draws, F.col("slots"), "_k").withColumn("slot", F.col("first") + F.col("_k"))
    turn, j = F.floor(F.col("slot") / F.col("blocks")), F.col("slot") % F.col("blocks")
    filled = slots.withColumn("block", permuted(j, F.col("blocks"), F.lit(seed), F.col("source_no"), turn))
    words = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    return filled.select("shard", "source_no", "slot", "block", words.alias("words"))


def lay_out(sized: DataFrame) -> DataFrame:
    """``sized`` (doc_id, size, source_no, ..) with ``start``, each document's place in its source's stream.

    Documents lie in stretches by a hash of doc_id and text and in the order of doc_id within one; places
    are summed up over stretches first, so no task has to see a whole source.
    """
    stretches = max(1, sized.count() // STRETCH)
    placed = sized.withColumn("_stretch", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(stretches)))
    totals = placed.groupBy("source_no", "_stretch").agg(F.sum("size").alias("_sum"))
    over = Window.partitionBy("source_no").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source_no", "_stretch", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("source_no", "_stretch").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    started = placed.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return started.join(offsets, ["source_no", "_stretch"]).withColumn("start", F.col("_offset") + F.col("_within")).drop("_stretch", "_offset", "_within")


def _parts(docs: DataFrame, weights: tuple[int, ...], block: int) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, and the piece of each document in each block of its source.

    Pieces are rows (doc_id, source, size, source_size, target, source_no, tie, start, block, _from, _to);
    a document without words has one without block.
    """
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", "source", words.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("tie")))
    sources = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights))
    known = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = lay_out(known)
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / block), F.floor((end - 1) / block)
    parts = (
        placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        .withColumn("_from", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)))
        .withColumn("_to", F.least(end - F.col("block") * block, F.lit(block)))
    )
    return sources, parts


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source).

    size counts words (null or empty text: 0); target is the words that the document's source should give
    to the mix, taken those the mix takes of this document, repeats counted, at most 3 times its size. A
    text of any length is counted whole. Rows that repeat a doc_id, with the same text or another, are
    documents of their own; a null source is a source. Other columns are not read. An empty table gives no
    rows, one without any word targets and words of 0. The same rows in any order give the same result.
    """
    sources, parts = _parts(docs, weights, block)
    filled = fill(draw(plan(sources, block=block), shard_slots=shard_slots, seed=seed), block=block, seed=seed)
    times = filled.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    parts = parts.join(times.hint("merge"), ["source_no", "block"], "left")  # its size can't be told from the few rows it comes from
    of_block = (F.col("_to") - F.col("_from")) * F.col("times")
    keys = ["doc_id", "source", "size", "source_size", "target", "source_no", "start"]
    # Documents without words share a place: what sets them apart is dropped, and each counts.
    summed = parts.groupBy(*keys).agg(F.coalesce(F.sum(of_block), F.lit(0)).cast("long").alias("taken"), F.count(F.when(F.col("size") == 0, 1)).alias("_empty"))
    rows = summed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("_empty"), F.lit(1)))))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken")


def spans(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """The mix itself: (shard, slot, source, block, place, doc_id, first_word, words), in any order.

    A slot of a shard holds the words of its block in the order of ``place``: ``words`` words of the
    document from its ``first_word`` on. Summed up by document these are the ``taken`` of mix.
    """
    sources, parts = _parts(docs, weights, block)
    filled = fill(draw(plan(sources, block=block), shard_slots=shard_slots, seed=seed), block=block, seed=seed).drop("words")
    joined = parts.where("size > 0").join(filled.hint("merge"), ["source_no", "block"])
    first = F.col("block") * block + F.col("_from") - F.col("start")
    return joined.select("shard", "slot", "source", "block", F.col("_from").alias("place"), "doc_id", first.alias("first_word"), (F.col("_to") - F.col("_from")).alias("words"))


def mixed_documents(docs: DataFrame, *, seed: int = 0, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words are taken, at most 3 times.

    A share of a document that is left over rounds up or down by a hash of its doc_id, in proportion, so
    a source keeps its words within the spread of that draw. Rows that share a doc_id share its mean;
    documents without words are not taken. All columns stay as they are, whatever their names.
    """
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    found = mix(docs, seed=seed, **options).where("size > 0").groupBy("doc_id").agg(F.sum("taken").alias("_t"), F.sum("size").alias("_s"))
    times = found.select(F.col("doc_id").alias("id"), F.floor(F.col("_t") / F.col("_s") + chance).cast("int").alias("times")).where("times > 0")
    rows = docs.select(F.col("doc_id").alias("own_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").rlike(WORD).alias("has_words"))
    repeated = rows.where("has_words").join(times, F.col("own_id").eqNullSafe(F.col("id")))
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
