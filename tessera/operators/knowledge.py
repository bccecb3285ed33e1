"""Knowledge records: one shape for all kinds, enrichment, invariants, and bundles of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import search_text


def records(rows: DataFrame, kind: str) -> DataFrame:
    """(ref, kind, title, body) of rows (ref, title, body); a body of several texts is joined by lines."""
    return rows.select("ref", F.lit(kind).alias("kind"), F.trim("title").alias("title"), F.array_join("body", "\n").alias("body"))


def aliases(rows: DataFrame) -> DataFrame:
    """(ref, norm, alias) from (ref, position, alias): one spelling of each normalised alias, the first."""
    named = rows.withColumn("norm", search_text("alias")).where("norm <> ''")
    first = F.row_number().over(Window.partitionBy("ref", "norm").orderBy("position", "alias"))
    return named.withColumn("_k", first).where("_k = 1").select("ref", "norm", "alias")


def evidence(rows: DataFrame) -> DataFrame:
    """(ref, ordinal, evidence_ref) from (ref, position, evidence_ref): each once, in the order of first mention."""
    first = rows.groupBy("ref", "evidence_ref").agg(F.min("position").alias("position"))
    ordinal = F.row_number().over(Window.partitionBy("ref").orderBy("position", "evidence_ref")) - 1
    return first.select("ref", ordinal.alias("ordinal"), "evidence_ref")


def enrich(rows: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """``rows`` with categories, the sorted distinct names of ``categories`` (key, category); an unknown key fails the job."""
    stray = categories.select(key).distinct().join(rows.select(key), key, "left_anti").select(key, F.lit(True).alias("_stray"))
    listed = categories.groupBy(key).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    joined = rows.join(listed, key, "left").join(stray, key, "full_outer")
    kept = joined.where(F.when(F.col("_stray").isNull(), F.lit(True)).otherwise(F.raise_error(F.lit("category of an unknown key")).cast("boolean")))
    return kept.drop("_stray").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


#: Most bytes of a bundle.
MOST_BYTES = 16 << 20


def bundles(found: DataFrame, profile: str) -> DataFrame:
    """(session_id, bundle_id, payload, payload_sha256): the findings of each session as one canonical document.

    ``found``: session_id, change_id, rule, kind, path, method. The id is a digest of the document
    without it, so the same findings give the same bundle. One of more than MOST_BYTES fails the job.
    """
    return bundles_by_profile(found.withColumn("profile", F.lit(profile))).drop("profile")


def bundles_by_profile(found: DataFrame) -> DataFrame:
    """(profile, session_id, bundle_id, payload, payload_sha256): ``bundles`` of the sessions of each ``profile``."""
    one = F.to_json(F.struct("change_id", "kind", "method", "path", "rule"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    key = ["profile", "session_id"]
    listed = found.select(*key, "change_id", one.alias("doc")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("change_id", "doc"))).alias("f"))
    texts = F.array_join(F.transform("f", lambda x: x["doc"]), ",")
    open_ = lambda id_: F.concat(F.lit("{"), id_, F.lit('"findings":['), texts, F.lit('],"profile":'), quoted(F.col("profile")), F.lit(',"session_id":'), quoted(F.col("session_id")), F.lit("}"))
    named = listed.withColumn("bundle_id", F.concat(F.lit("promotion."), F.sha2(open_(F.lit("")), 256)))
    payload = open_(F.concat(F.lit('"bundle_id":"'), "bundle_id", F.lit('",')))
    small = F.when(F.octet_length("payload") <= MOST_BYTES, F.lit(True)).otherwise(F.raise_error(F.lit("bundle is too large")).cast("boolean"))
    return named.withColumn("payload", payload).where(small).select(*key, "bundle_id", "payload", F.sha2("payload", 256).alias("payload_sha256"))


def materialise(outbox: DataFrame, path: str) -> int:
    """Append the bundles of ``outbox`` (session_id, bundle_id, payload, payload_sha256) that ``path`` lacks; their number.

    A bundle that is there with other bytes fails the call before anything is written. After the call ``path`` can be
    read, also if no bundle was ever written to it.
    """
    spark = outbox.sparkSession
    schema = "session_id string, bundle_id string, payload string, payload_sha256 string"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    written = spark.read.schema(schema).parquet(path) if known else spark.createDataFrame([], schema)
    both = outbox.select("bundle_id", "payload_sha256").unionByName(written.select("bundle_id", "payload_sha256"))
    if not both.groupBy("bundle_id").agg(F.countDistinct("payload_sha256").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a bundle is written already with other bytes")
    fresh = outbox.select("session_id", "bundle_id", "payload", "payload_sha256").dropDuplicates(["bundle_id"]).join(written.select("bundle_id"), "bundle_id", "left_anti")
    n = fresh.count()
    if n or not known:
        fresh.select("session_id", "bundle_id", "payload", "payload_sha256").write.mode("append").parquet(path)
    return n


def pending(outbox: DataFrame, written: DataFrame) -> DataFrame:
    """Bundles that are not written yet, in the order in which they were made."""
    return outbox.join(written.select("bundle_id"), "bundle_id", "left_anti").orderBy("created_at", "bundle_id")
