"""Body events of a session to typed pages: units' goods and companies' rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import artifacts as A
from tessera.functions import recognise
from tessera.operators import market_pages


def _loaded(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``events`` with content, the text of the artifact (ref, content) that response_body_ref names; null if there is none."""
    known = artifacts.select(F.col("ref").alias("response_body_ref"), F.col("content").cast("string").alias("content"))
    return events.join(known, "response_body_ref", "left")


def goods(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(session_id, sequence, observed_at, unit_id, ref, problem, rows) of the goods events among ``events``.

    rows is null where there is a problem: "incompatible" (the page is of another contract and makes the
    state stale), "missing artifact", "other unit", or what the artifact's own check says.
    """
    own = _loaded(events.withColumn("unit_id", recognise.goods_unit()).where("unit_id IS NOT NULL"), artifacts).withColumn("a", A.unit_economics(F.col("content")))
    problem = F.when(F.col("content").isNull(), F.lit("missing artifact")).otherwise(F.coalesce("a.problem", F.when(F.col("a.page.unit_id") != F.col("unit_id"), F.lit("other unit"))))
    return own.withColumn("problem", problem).select(
        "session_id", "sequence", "observed_at", "unit_id", F.col("response_body_ref").alias("ref"), "problem", F.when(F.col("problem").isNull(), F.col("a.page.rows")).alias("rows")
    )


def goods_rows(projected: DataFrame) -> DataFrame:
    """A row for each product of the sound pages of ``goods``. A problem other than "incompatible" fails the job."""
    broken = F.col("problem").isNotNull() & (F.col("problem") != "incompatible")
    checked = projected.where(F.when(~broken, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("goods event: "), F.coalesce("problem", F.lit("")))).cast("boolean")))
    return checked.select("session_id", "sequence", "observed_at", "unit_id", F.explode("rows").alias("r")).select("session_id", "sequence", "observed_at", "unit_id", "r.*")


def parser_incompatible(*projected: DataFrame) -> DataFrame:
    """One row (incompatible, pages): whether any page is of a contract that this parser does not read."""
    told = [p.select(F.coalesce(F.col("problem") == "incompatible", F.lit(False)).alias("i")) for p in projected]
    every = told[0]
    for p in told[1:]:
        every = every.unionByName(p)
    return every.agg(F.coalesce(F.bool_or("i"), F.lit(False)).alias("incompatible"), F.count_if("i").alias("pages"))


def rosters(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(session_id, sequence, observed_at, company_id, ref, title, text, problem) of the roster events among ``events``."""
    own = _loaded(events.withColumn("company_id", recognise.roster_company()).where("company_id IS NOT NULL"), artifacts).withColumn("a", A.company_page(F.col("content")))
    problem = F.when(F.col("content").isNull(), F.lit("missing artifact")).otherwise(F.col("a.problem"))
    return own.select("session_id", "sequence", "observed_at", "company_id", F.col("response_body_ref").alias("ref"), "a.title", "a.text", problem.alias("problem"))


def roster_units(projected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, problems) of the sound pages of ``rosters``, with their company; see market_pages.roster."""
    sound = projected.where("problem IS NULL")
    page = F.concat_ws("#", "session_id", F.col("sequence").cast("string"), "company_id")
    units, problems = market_pages.roster(sound.select(page.alias("page_id"), "text"))
    return units.withColumn("company_id", F.substring_index("page_id", "#", -1)), problems
