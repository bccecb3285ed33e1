"""Response bodies of finished requests: which are kept, as what artifact, and why others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import artifacts as A
from tessera.functions import recognise
from tessera.functions.pages import visible_page
from tessera.operators import market_pages
from tessera.sources.frames import value_lists

#: Most bytes of a body. A fixed value of the policy.
MOST_BYTES = 2 << 20


def finished_candidates(events: DataFrame) -> DataFrame:
    """(session_id, sequence, request_id, method, url_path, query, status_code, mime_type, encoded_length, kind, observed_at)
    of the finished requests of ``events`` (of frames.network_events) whose body has a use; kind says which."""
    key = ["session_id", "request_id", "redirect_index"]
    asked = events.where("event_type = 'http.request'").groupBy(*key).agg(F.min_by(F.struct("method", "url_path", value_lists(F.col("query")).alias("query")), "sequence").alias("q"))
    told = events.where("event_type = 'http.response'").groupBy(*key).agg(F.min_by(F.struct("status_code", "mime_type"), "sequence").alias("r"))
    done = events.where("event_type = 'http.finished'").select(*key, "sequence", "encoded_length", "observed_at")
    rows = done.join(asked, key).join(told, key).select("session_id", "sequence", "request_id", "q.*", "r.*", "encoded_length", "observed_at")
    return rows.withColumn("kind", recognise.capture_plan()).where("kind IS NOT NULL")


def decoded(candidates: DataFrame, bodies: DataFrame, *, most: int = MOST_BYTES) -> DataFrame:
    """``candidates`` with html and problem, why there is none.

    ``bodies``: session_id, request_id, body, base64_encoded. A size is looked at before anything is decoded.
    """
    joined = candidates.join(bodies.select("session_id", "request_id", "body", "base64_encoded"), ["session_id", "request_id"], "left")
    raw = F.when(F.col("base64_encoded"), F.try_to_binary("body", F.lit("base64"))).otherwise(F.col("body").cast("binary"))
    too_long = F.when(F.col("base64_encoded"), F.length("body") > (most + 2) // 3 * 4 + 8).otherwise(F.octet_length("body") > most)
    problem = (
        F.when(F.col("encoded_length") > most, F.lit("encoded size exceeds limit"))
        .when(F.col("body").isNull() | F.col("base64_encoded").isNull(), F.lit("no body"))
        .when(too_long | (F.octet_length("raw") > most), F.lit("size exceeds limit"))
        .when(F.col("raw").isNull() | ~F.is_valid_utf8(F.col("raw").cast("string")), F.lit("can't be decoded"))
    )
    sized = joined.withColumn("raw", F.when(~F.coalesce(too_long, F.lit(False)), raw)).withColumn("problem", problem)
    return sized.withColumn("html", F.when(F.col("problem").isNull(), F.col("raw").cast("string"))).drop("raw", "body", "base64_encoded")


def body_events(events: DataFrame, bodies: DataFrame, *, most: int = MOST_BYTES) -> dict[str, DataFrame]:
    """events (http.response_body), artifacts (ref, content) and warnings (session_id, sequence, problem).

    A company's page is kept as its title and visible text, a unit's goods page as its typed rows.
    """
    read = decoded(finished_candidates(events), bodies, most=most)
    sound = read.where("problem IS NULL").withColumn("page_id", F.concat_ws("#", "session_id", F.col("sequence").cast("string")))
    company = sound.where("kind = 'company-roster'").withColumn("p", visible_page("html")).withColumn("content", A.company_page_text(F.col("p.title"), F.col("p.text"))).drop("p")
    unit = F.element_at("query", F.lit("id"))[0].cast("long")
    goods = sound.where("kind = 'unit-economics'")
    rows, problems = market_pages.goods(goods.select("page_id", unit.alias("unit_id"), "html"))
    whole = F.struct(*[F.col("product_id" if n == "product_numeric_id" else n).alias(n) for n in sorted([*A.NUMBERS, "city_quality", "stock_quality"])])
    listed = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(whole), lambda a, b: F.when(a["product_numeric_id"] < b["product_numeric_id"], -1).otherwise(1)).alias("rows"))
    typed = goods.join(problems, "page_id", "left_anti").join(listed, "page_id", "left")
    none = F.array().cast(listed.schema["rows"].dataType)
    units = typed.withColumn("content", A.unit_economics_text(unit, F.coalesce("rows", none))).select(company.columns)
    kept = company.unionByName(units).withColumn("ref", A.ref(F.col("content")))
    made = kept.select(
        "session_id", "sequence", F.lit("cdp.network").alias("source"), F.lit("http.response_body").alias("event_type"), "request_id", "method", "url_path", "query", "status_code", "observed_at",
        F.col("ref").alias("response_body_ref"), F.col("kind").alias("response_body_kind"),
    )
    broken = goods.join(problems, "page_id", "left_semi").select("session_id", "sequence", F.lit("rows of the page are not sound").alias("problem"))
    warned = read.where("problem IS NOT NULL").select("session_id", "sequence", "problem").unionByName(broken)
    return {"events": made, "artifacts": kept.select("ref", "content").dropDuplicates(["ref"]), "warnings": warned}
