"""A search index in files: postings by term, rebuilt only for records that changed.

Postings lie in hash buckets of their terms, so the terms of a question read only their buckets. Each posting
carries its record's length and version. Beside them are the records with the digest of their texts, by ref: an
update compares digests, adds postings of new and changed records, and puts the postings of what they were on a
list of superseded ones; it reads the texts once and rewrites no postings. ``compact`` drops superseded
postings. The number of records and the sum of their lengths, which ranking needs, stand in the commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.sources.buckets import Buckets
from tessera.sources.shared import materialise

SCHEMAS = {
    "records": "ref string, sha256 string, length bigint, version bigint",
    "postings": "term string, ref string, tf bigint, length bigint, version bigint",
    "superseded": "ref string, version bigint",
}
KEYS = {"records": ["ref"], "postings": ["term"], "superseded": ["ref"]}


class PostingIndex(Buckets):
    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 64):
        super().__init__(spark, root, SCHEMAS, KEYS, buckets)

    def update(self, records: DataFrame) -> int:
        """Make the index that of ``records`` (ref, text), each ref once, and return its version.

        Records whose text is as before are left alone; if all are and none is gone, no version is made and nothing is
        written. A null text counts as empty. A ref that stands twice fails the update.
        """
        base = self.at()
        version = base["version"] + 1
        text = F.coalesce(F.col("text"), F.lit(""))
        given = records.select(F.col("ref").cast("string").alias("ref"), text.alias("text"), F.sha2(text, 256).alias("sha256"))
        known = self.read(base, "records").select("ref", F.col("sha256").alias("was"), F.col("length").alias("was_length"), F.col("version").alias("was_version"))
        marks = materialise(given.groupBy("ref").agg(F.max("sha256").alias("sha256"), F.count("*").alias("n")).join(known, "ref", "full_outer"))
        if not marks.where("n > 1").isEmpty():
            raise ValueError("a ref stands more than once")
        moved = marks.where("sha256 IS NULL OR was IS NULL OR sha256 <> was")
        if moved.isEmpty():
            return base["version"]
        fresh = moved.where("sha256 IS NOT NULL").select("ref")
        # Words are split and counted once, in the row of their record.
        counted = given.join(fresh, "ref", "left_semi").select("ref", search.terms(F.col("text")).alias("w")).select("ref", F.explode(F.array("w")).alias("w"))
        # A record's own row has no term: it carries the length of records without words too.
        own = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))
        each = counted.select("ref", F.size("w").cast("long").alias("length"), F.explode(F.array_append(search.term_counts(F.col("w")), own)).alias("c"))
        each = materialise(each.select("ref", "length", "c.term", "c.tf"))
        new = each.where("term IS NULL").join(moved.select("ref", "sha256"), "ref").select("ref", "sha256", "length", F.lit(version).cast("long").alias("version"))
        added = each.where("term IS NOT NULL").select("term", "ref", "tf", "length", F.lit(version).cast("long").alias("version"))
        gone = moved.where("was IS NOT NULL").select("ref", F.col("was_version").alias("version"))
        touched = self.touched(moved, "records", base)
        rest = self.read(base, "records", touched).join(moved.select("ref"), "ref", "left_anti")
        facts = base["facts"]
        plus, minus = new.agg(F.count("*"), F.sum("length")).first(), moved.where("was IS NOT NULL").agg(F.count("*"), F.sum("was_length")).first()
        self.publish(
            version, base, {"records": (rest.unionByName(new), touched)}, {"postings": added, "superseded": gone},
            records=facts.get("records", 0) + plus[0] - minus[0], length=facts.get("length", 0) + (plus[1] or 0) - (minus[1] or 0), superseded=facts.get("superseded", 0) + minus[0],
        )
        return version

    def compact(self) -> int:
        """A version without superseded postings, if there are any; its number."""
        base = self.at()
        if not base["facts"].get("superseded"):
            return base["version"]
        version = base["version"] + 1
        every = list(range(base["buckets"]))
        self.publish(version, base, {"postings": (self._valid(base, self.read(base, "postings")), every), "superseded": (self.read(base, "superseded").limit(0), every)}, superseded=0)
        return version

    def _valid(self, commit: dict, postings: DataFrame) -> DataFrame:
        return postings.join(self.read(commit, "superseded"), ["ref", "version"], "left_anti")

    def postings(self, terms: DataFrame, version: int | None = None) -> DataFrame:
        """(ref, term, tf, length) of the terms (term); only the files of their buckets are read."""
        commit = self.at(version)
        held = self.read(commit, "postings", self.touched(terms, "postings", commit))
        return self._valid(commit, held.join(terms.select("term").distinct(), "term", "left_semi")).select("ref", "term", "tf", "length")

    def search(self, queries: DataFrame, *, limit: int = 10, version: int | None = None) -> DataFrame:
        """(query_id, rank, ref, score): the best ``limit`` records with all terms of each query (query_id, text), as search.rank_postings."""
        facts = self.at(version)["facts"]
        asked = search.asked(queries)
        docs = facts.get("records", 0)
        stats = self.spark.createDataFrame([(docs, facts.get("length", 0) / docs if docs else 0.0)], "docs bigint, mean double")
        return search.rank(asked, self.postings(asked, version), stats, limit=limit)
