"""Knowledge search: exact tiers, then BM25 over postings; retrieval metrics.

The corpus is kept as postings (term, ref, tf) and document lengths. A query set is a table, so many
queries are answered by one join of their terms with the postings; nothing is searched on the driver.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.canonical import once
from tessera.sources.shared import materialise

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Lower-case letters with diacritics and the letters they are written on, from Unicode's decompositions.
_MARKED = {chr(c): base for c in range(0xC0, 0x2000) if len(base := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and base != chr(c)}


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits without their diacritics."""
    plain = F.regexp_replace(F.translate(F.lower(text), "".join(_MARKED), "".join(_MARKED.values())), r"\p{Mn}", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def term_counts(words: Column) -> Column:
    """Array of (term, tf) of an array of words, in the order of terms; counted in the row, so no table of words is grouped."""
    starts = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    pairs = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i - 1).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).cast("long").alias("tf")))
    counts = once(F.array_sort(words), lambda s: once(starts(s), lambda at: pairs(s, at)))
    return F.when(F.size(words) > 0, counts).otherwise(F.array().cast("array<struct<term: string, tf: bigint>>"))


def postings(records: DataFrame) -> DataFrame:
    """(ref, term, tf, length) of records (ref, text)."""
    words = records.select("ref", terms(F.col("text")).alias("w"))
    each = words.select("ref", F.size("w").alias("length"), F.explode("w").alias("term"))
    return each.groupBy("ref", "term", "length").agg(F.count("*").alias("tf"))


def lengths(records: DataFrame) -> DataFrame:
    """(ref, length) of every record (ref, text), those without a word too."""
    return records.select("ref", F.greatest(F.size(terms(F.col("text"))), F.lit(0)).alias("length"))


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, term) of queries (query_id, text), each term of a query once."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def bm25(queries: DataFrame, records: DataFrame, *, limit: int = 10) -> DataFrame:
    """``rank`` over records (ref, text) that have no postings yet.

    The texts are split once: of each record the words that some query has are kept, and one row with its length.
    """
    wanted = asked(queries)
    words = records.select("ref", F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("w"))
    each = words.select("ref", F.size("w").alias("length"), F.explode(F.array_append("w", F.lit(None).cast("string"))).alias("term"))
    known = wanted.select("term").distinct().withColumn("_asked", F.lit(True))
    kept = each.join(known, "term", "left").where("_asked OR term IS NULL")
    held = materialise(kept.groupBy("ref", "term", "length").agg(F.count("*").alias("tf")))
    stats = held.where("term IS NULL").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    return rank(wanted, held.where("term IS NOT NULL"), stats, limit=limit)


def rank_postings(queries: DataFrame, known: DataFrame, sizes: DataFrame, *, limit: int = 10) -> DataFrame:
    """``rank`` for queries (query_id, text) over all postings ``known``; ``sizes``: the lengths of all records."""
    wanted = asked(queries)
    stats = sizes.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    return rank(wanted, known.join(wanted.select("term").distinct(), "term", "left_semi"), stats, limit=limit)


def rank(asked: DataFrame, held: DataFrame, stats: DataFrame, *, limit: int = 10) -> DataFrame:
    """(query_id, rank, ref, score): the best ``limit`` records that hold all terms of each query.

    ``asked``: (query_id, term); ``held``: the postings of these terms; ``stats``: one row (docs, mean), the number of
    records and their mean length.

    A record that holds all terms holds the query's rarest one, so the postings of that are the only
    candidates, and a common term meets those instead of the whole corpus. A term that most records hold
    weighs LEAST_IDF. Queries of the same terms have the same answer: it is found once and given to all of them.
    """
    sets = asked.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    firsts = sets.groupBy("_terms").agg(F.min("query_id").alias("_first"))
    found = _rank(firsts.select(F.col("_first").alias("query_id"), F.explode("_terms").alias("term")), held, stats, limit)
    of = sets.join(firsts, "_terms").select("query_id", "_first")
    return of.join(found.withColumnRenamed("query_id", "_first"), "_first").select("query_id", "rank", "ref", "score")


def _rank(asked: DataFrame, held: DataFrame, stats: DataFrame, limit: int) -> DataFrame:
    """``rank`` of queries no two of which have the same terms."""
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    rated = asked.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = rated.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    candidates = rarest.join(held, "term").select("query_id", "ref")
    hits = candidates.join(rated, "query_id").join(held, ["ref", "term"]).crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.groupBy("query_id", "ref").agg(F.round(F.sum(weight), 6).alias("score"), F.count("*").alias("got"))
    full = scored.join(needed, "query_id").where("got = needed")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ref"))
    return full.withColumn("rank", place).where(F.col("rank") <= limit).select("query_id", "rank", "ref", "score")


def exact_tiers(queries: DataFrame, refs: DataFrame, aliases: DataFrame, titles: DataFrame, *, limit: int = 10) -> DataFrame:
    """(query_id, rank, ref, tier): hits of equal ref, else equal alias, else equal title, each ref in its best tier.

    ``queries``: query_id, text, norm. ``refs``: ref. ``aliases``: ref, norm. ``titles``: ref, norm. Of a name
    that many records share only the first ``limit`` refs can be hits, as all before them rank higher; so a
    common name costs a query no more than a rare one.
    """
    by_name = F.row_number().over(Window.partitionBy("norm").orderBy("ref"))
    first = lambda rows: rows.select("ref", "norm").distinct().withColumn("_k", by_name).where(F.col("_k") <= limit)
    by_ref = queries.join(refs, queries.text == refs.ref).select("query_id", "ref", F.lit(1).alias("tier"))
    by_alias = queries.join(first(aliases), "norm").select("query_id", "ref", F.lit(2).alias("tier"))
    by_title = queries.join(first(titles), "norm").select("query_id", "ref", F.lit(3).alias("tier"))
    best = by_ref.union(by_alias).union(by_title).groupBy("query_id", "ref").agg(F.min("tier").alias("tier"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "ref"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "ref", "tier")


def retrieval_metrics(outcomes: DataFrame) -> DataFrame:
    """Recall at 1 and 5, MRR, and accuracy on negatives, per category and over all ("all").

    ``outcomes``: category, negative, rank (of the expected hit within 5; null: not there), hits. A
    measure without cases is null. If there is a column evidence_ok, whether the expected hit came with its
    expected evidence, evidence_correct is its share of the positive cases.
    """
    told = ["negative", "rank", "hits", *(["evidence_ok"] if "evidence_ok" in outcomes.columns else [])]
    both = outcomes.select("category", *told).unionByName(outcomes.select(F.lit("all").alias("category"), *told))
    pos = ~F.col("negative")
    ratio = lambda c: F.avg(F.when(pos, c.cast("double")))
    within = lambda n: F.coalesce(F.col("rank") <= n, F.lit(False))
    return both.groupBy("category").agg(
        F.count_if(pos).alias("positives"), F.count_if(~pos).alias("negatives"), F.round(ratio(within(1)), 6).alias("recall_1"),
        F.round(ratio(within(5)), 6).alias("recall_5"), F.round(F.avg(F.when(pos, F.when(within(5), 1.0 / F.col("rank")).otherwise(F.lit(0.0)))), 6).alias("mrr"),
        F.round(F.avg(F.when(~pos, (F.col("hits") == 0).cast("double"))), 6).alias("no_match"),
        *([F.round(ratio(F.coalesce("evidence_ok", F.lit(False))), 6).alias("evidence_correct")] if len(told) > 3 else []),
    )


_CASES = "schema_version int, cases array<struct<query: string, expected_ref: string, expected_evidence_ref: string, category: string, kinds: array<string>>>"
_CASE_FIELDS = ("query", "expected_ref", "expected_evidence_ref", "category", "kinds")


def evaluation_cases(documents: DataFrame) -> DataFrame:
    """(case, query, expected_ref, expected_evidence_ref, category, kinds) of JSON documents (text), schema 1 to 3.

    Before schema 3 a case without category is "legacy", from then on "uncategorized". A document of another
    schema, without cases, or with a case that has other fields or no query fails the job.
    """
    d = F.from_json("text", _CASES)
    names = F.flatten(F.transform(F.from_json(F.get_json_object("text", "$.cases"), "array<map<string,string>>"), lambda c: F.map_keys(c)))
    fine = d["schema_version"].between(1, 3) & (F.size(d["cases"]) > 0) & (F.size(F.array_except(names, F.array(*map(F.lit, _CASE_FIELDS)))) == 0) & F.forall(d["cases"], lambda c: F.coalesce(c["query"], F.lit("")) != "")
    checked = documents.where(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("not a document of evaluation cases")).cast("boolean")))
    each = checked.select(d["schema_version"].alias("v"), F.posexplode(d["cases"]).alias("case", "c"))
    other = F.when(F.col("v") < 3, F.lit("legacy")).otherwise(F.lit("uncategorized"))
    return each.select("case", "c.query", "c.expected_ref", "c.expected_evidence_ref", F.coalesce("c.category", other).alias("category"), F.coalesce("c.kinds", F.array().cast("array<string>")).alias("kinds"))

