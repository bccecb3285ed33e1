"""The engine's operations end to end: rebuild tables into generations, and read them in bounded pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import canonical, cursor
from tessera.functions.text import search_text
from tessera.operators import consistency, current, detect, knowledge, search, sessions, snapshot
from tessera.sources import atomic, ordered
from tessera.sources.generations import Generations
from tessera.sources.parts import publish
from tessera.sources.postings import PostingIndex

#: Most rows of a page. Fixed value.
MOST = 1000


def detect_changes(observations: DataFrame, baseline: DataFrame, relations: DataFrame | None = None, families: DataFrame | None = None) -> dict[str, DataFrame]:
    """facts, counts and findings of http observations (and links) against a baseline."""
    facts = [detect.endpoint_facts(observations, detect.compile_contract(baseline))]
    if "body_keys" in observations.columns:
        facts.append(detect.operation_facts(observations, baseline.where(~F.col("method").isin(*detect.SAFE_METHODS) & F.col("body_keys").isNotNull())))
    if "fields" in observations.columns:
        facts.append(detect.form_facts(observations, baseline))
    if relations is not None and families is not None:
        facts.append(detect.relation_facts(relations, families))
    every = reduce(DataFrame.unionByName, facts)
    return {"facts": every, "counts": every.groupBy("state").agg(F.count("*").alias("n")), "findings": detect.findings(every)}


class Workspace:
    """Tables of one store, in generations under ``root``. A reader keeps the generation that it opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.generations = Generations(spark, self.root)

    def table(self, generation: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/generation={generation}/{name}")

    # Current state

    def rebuild_current(self, generation: str, observations: DataFrame, roster: DataFrame, surfaces: DataFrame, *, keys: list[str], order: list[str], unit: str = "unit_id") -> None:
        """Fold observations to the latest state, split it by the roster, and publish it with its fingerprint.

        The tables become a generation when all of them are there: it is sealed, and then it is the one that is shown.
        """
        state = current.latest_state(observations, keys, order)
        verified, orphans = current.split_by_roster(state, roster, unit)
        tables = {"units": roster, "products": verified, "orphans": orphans, "surfaces": current.surface_coverage(roster, surfaces, unit)}
        publish(tables, self.root, generation)
        meta = self._fingerprint(generation).select("fingerprint", F.lit("ready").alias("status"), F.col("rows"))
        publish({"meta": meta}, self.root, generation)
        self.generations.seal(generation, [*tables, "meta"])

    def load_current(self, keys: list[str], *, unit: str = "unit_id") -> dict[str, DataFrame]:
        """All tables of the generation that is shown, after a look at every row and at the rules between the tables.

        Units stand once, products and orphans once by ``keys``; products are of known units, orphans of unknown
        ones, surfaces of known ones. ValueError if a table is not that of the manifest, or a rule is broken.
        """
        t = self.generations.load()
        found = [snapshot.repeated_keys(t["units"], "units", [unit]), *[snapshot.repeated_keys(t[n], n, keys) for n in ("products", "orphans")]]
        found += [snapshot.dangling(t[n], n, keys if n != "surfaces" else [unit], unit, t["units"], unit, absent=n != "orphans") for n in ("products", "orphans", "surfaces")]
        if bad := reduce(DataFrame.unionByName, found).limit(5).collect():
            raise ValueError(f"the snapshot is not sound: {[tuple(r) for r in bad]}")
        return t

    def _fingerprint(self, generation: str) -> DataFrame:
        """One row (rows, fingerprint) over every column of every row of the current state's tables."""
        parts = []
        for name in ("units", "products", "orphans", "surfaces"):
            df = self.table(generation, name)
            flat = df.select([F.col(c).cast("string").alias(c) for c in sorted(df.columns)])
            parts.append(canonical.rows_fingerprint(flat, *flat.columns).select(F.lit(name).alias("name"), "rows", "fingerprint"))
        every = reduce(DataFrame.unionByName, parts)  # a row a table
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "fingerprint"))), lambda x: F.concat(x["name"], F.lit(":"), x["fingerprint"])), "-")
        return every.agg(F.max(F.when(F.col("name") == "products", F.col("rows"))).alias("rows"), F.sha2(text, 256).alias("fingerprint"))

    def current_status(self, generation: str) -> DataFrame:
        return self.table(generation, "meta")

    def verify(self, generation: str) -> bool:
        """Whether all values of all tables are still those that were published."""
        now = self._fingerprint(generation).first()["fingerprint"]
        return now == self.table(generation, "meta").first()["fingerprint"]

    def mark_stale(self, generation: str, following: str, reason: str) -> None:
        """Publish the metadata of ``generation`` as stale under the generation ``following``."""
        publish({"meta": consistency.mark_stale(self.table(generation, "meta"), reason)}, self.root, following)

    def plan(self, generation: str, *, weeks: int = current.WEEKS, limit: int = 100) -> dict[str, DataFrame]:
        """Rows of units whose surface is ready, best margin first, and the units that were left out."""
        if not 1 <= limit <= MOST:
            raise ValueError(f"limit must be 1 to {MOST}")
        surfaces = self.table(generation, "surfaces")
        ready = self.table(generation, "products").join(surfaces.where("status = 'ready'").select("unit_id"), "unit_id", "left_semi")
        return {"rows": current.top_plan(ready, limit=limit, weeks=weeks), "excluded": surfaces.where("status <> 'ready'").orderBy("unit_id").limit(limit)}

    # Pages

    def _sorted(self, generation: str, name: str, keys: list[str]) -> str:
        return f"{self.root}/generation={generation}/{name}.by.{'.'.join(keys)}"

    def sort(self, generation: str, name: str, keys: list[str], *, per_file: int = ordered.ROWS) -> None:
        """Keep a table of a generation in the order of ``keys`` too, so that its pages read two or three files."""
        ordered.write_ordered(self.table(generation, name), self._sorted(generation, name, keys), keys, per_file=per_file)

    def record(self, generation: str, name: str, keys: list[str], value: tuple) -> DataFrame:
        """The row of a key of a table that is kept in the order of ``keys``, or none."""
        return ordered.read_key(self.spark, self._sorted(generation, name, keys), keys, value)

    def page(self, generation: str, name: str, keys: list[str], *, limit: int = 100, after: str | None = None, where: str | None = None, prefix: tuple = ()) -> tuple[list, str | None]:
        """Rows of a table in the order of ``keys`` and the cursor of the next page, null at the end.

        Only rows for which ``where`` holds and whose first keys are ``prefix``. Where the table is kept in this order
        (``sort``) and there is no ``where``, only the files that hold the page are read.
        """
        if not 1 <= limit <= MOST:
            raise ValueError(f"limit must be 1 to {MOST}")
        scope = f"{name}|{where or ''}" + (f"|{list(prefix)}" if prefix else "")
        at = self._sorted(generation, name, keys)
        kept = not where and atomic.exists(self.spark, f"{at}/index")
        rows = self.spark.read.parquet(f"{at}/rows") if kept else self.table(generation, name)
        kinds = dict(rows.dtypes)
        start = None
        if after:
            of, key = cursor.decode(after, name, scope)
            if of != generation:
                raise ValueError("cursor is of another generation")
            start = tuple(F.lit(k).cast(kinds[c]) for c, k in zip(keys, key))
        if kept:
            page = ordered.read_page(self.spark, at, keys, limit=limit, after=start, prefix=prefix)
        else:
            own = reduce(lambda df, kv: df.where(F.col(kv[0]) == F.lit(kv[1])), zip(keys, prefix), rows.where(where) if where else rows)
            page = sessions.keyset_page(own, keys, limit=limit, after=start)
        # Spark writes the keys as text and reads them again, so that any type comes back as it was.
        found = page.select(F.struct("*").alias("row"), F.array(*[F.col(c).cast("string") for c in keys]).alias("key")).collect()  # a page
        more = bool(found) and found[-1]["row"]["has_more"]
        return [r["row"] for r in found], cursor.encode(name, scope, generation, tuple(found[-1]["key"])) if more else None

    # Knowledge

    def rebuild_index(self, generation: str, records: DataFrame, aliases: DataFrame, evidence: DataFrame) -> None:
        """Publish records (ref, kind, title, body), their aliases, evidence and postings."""
        publish({"records": records.withColumn("norm", search_text("title")), "aliases": knowledge.aliases(aliases), "evidence": knowledge.evidence(evidence)}, self.root, generation)
        publish({"texts": self._texts(generation)}, self.root, generation)
        texts = self.table(generation, "texts")  # what is written is read again, so that records are made once
        publish({"postings": search.postings(texts), "lengths": search.lengths(texts)}, self.root, generation)

    def _texts(self, generation: str) -> DataFrame:
        """(ref, text) of the records and their aliases, as they are written; both sides grow, so neither is sent to every task."""
        words = self.table(generation, "aliases").groupBy("ref").agg(F.array_join(F.collect_list("alias"), " ").alias("words"))
        return self.table(generation, "records").join(words.hint("merge"), "ref", "left").select("ref", F.concat_ws(" ", "title", "words", "body").alias("text"))

    def update_index(self, records: DataFrame) -> int:
        """Bring the index in files to ``records`` (ref, text) and return its version; what did not change is left alone."""
        return PostingIndex(self.spark, f"{self.root}/postings").update(records)

    def search_index(self, queries: DataFrame, *, limit: int = 10) -> DataFrame:
        """(query_id, rank, ref, score) from the index in files; only the buckets of the questions' terms are read."""
        return PostingIndex(self.spark, f"{self.root}/postings").search(queries, limit=limit)

    def index_problems(self, generation: str) -> DataFrame:
        """Postings that are not those of the texts, and texts that are not those of the records; none in a sound index."""
        texts = self.table(generation, "texts")
        again = self._texts(generation)
        of_words = lambda df: df.select("ref", F.array_sort(F.split("text", " ")).alias("words"))  # noqa: E731  aliases in any order
        one = snapshot.mirror_problems(search.postings(texts), self.table(generation, "postings")).select("ref", "side", F.lit("postings").alias("table"))
        return one.unionByName(snapshot.mirror_problems(of_words(again), of_words(texts)).select("ref", "side", F.lit("texts").alias("table")))

    def search(self, generation: str, queries: DataFrame, *, kinds: tuple[str, ...] = (), limit: int = 10) -> DataFrame:
        """(query_id, rank, ref, tier): equal ref, alias, title, then BM25, each record in its best tier.

        ``queries``: query_id, text. Only records of ``kinds``, if any are named.
        """
        records = self.table(generation, "records")
        kept = (records.where(F.col("kind").isin(*kinds)) if kinds else records).select("ref", "norm")
        asked = queries.withColumn("norm", search_text("text"))
        named = self.table(generation, "aliases").select("ref", "norm").join(kept.select("ref"), "ref", "left_semi")
        exact = search.exact_tiers(asked, kept.select("ref"), named, kept, limit=limit).select("query_id", "ref", "tier", F.lit(0.0).alias("score"))
        own = lambda name: self.table(generation, name).join(kept.select("ref"), "ref", "left_semi")
        ranked = search.rank_postings(queries, own("postings"), own("lengths"), limit=2 * limit)
        every = exact.unionByName(ranked.select("query_id", "ref", F.lit(4).alias("tier"), "score"))
        best = every.groupBy("query_id", "ref").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("b"))
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("b.tier", "b.s", "ref"))
        return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "ref", F.col("b.tier").alias("tier"))

    def get(self, generation: str, ref: str) -> DataFrame:
        """One record with its aliases and first evidence."""
        one = self.table(generation, "records").where(F.col("ref") == ref)
        names = self.table(generation, "aliases").where(F.col("ref") == ref).groupBy("ref").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
        seen = consistency.top_evidence(self.table(generation, "evidence").where(F.col("ref") == ref))
        return one.join(names, "ref", "left").join(seen, "ref", "left")
