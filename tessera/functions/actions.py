"""User actions out of the observer's JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.normalise import DROP_FIELDS, key_set
from tessera.functions.text import is_json

_PAYLOAD = """schema int, kind string, isTrusted boolean, wallTimeMs double, performanceTimeMs double, pagePath string,
  element struct<tag: string, type: string, name: string, role: string, selector: string>, form struct<method: string, actionPath: string, fieldNames: array<string>>"""
#: Actions that are taken, and the largest payload in bytes. Fixed values.
KINDS, LARGEST = ("click", "change", "submit"), 32_768


def bounded(value: Column, limit: int) -> Column:
    """Trimmed text of at most ``limit`` characters; null if nothing is left."""
    text = F.trim(value)
    return F.when(text != "", F.substring(text, 1, limit))


def origin_path(value: Column) -> Column:
    """Path of an origin-relative location, without query and fragment; null if it names an origin."""
    text = bounded(value, 2048)
    return F.when(text.rlike("^/(?!/)"), F.substring(F.regexp_replace(text, "[?#].*$", ""), 1, 1024))


def _of_size() -> Column:
    """The payload, null if it is too large: such texts are not handed to Python."""
    return F.when(F.octet_length("payload") <= LARGEST, F.col("payload"))


def rejected_actions(payloads: DataFrame) -> DataFrame:
    """(session_id, sequence, problem) of the payloads that give no action event: none goes without a trace."""
    p = F.from_json("payload", _PAYLOAD, {"mode": "PERMISSIVE"})
    problem = (
        F.when(F.col("payload").isNull(), F.lit("no payload"))
        .when(F.octet_length("payload") > LARGEST, F.lit("too large"))
        .when(~is_json(_of_size()), F.lit("no JSON"))
        .when(~F.coalesce(p["schema"] == 1, F.lit(False)), F.lit("other schema"))
        .when(~F.coalesce(p["kind"].isin(*KINDS), F.lit(False)), F.lit("other kind"))
    )
    return payloads.select("session_id", "sequence", problem.alias("problem")).where("problem IS NOT NULL")


def action_events(payloads: DataFrame) -> DataFrame:
    """Action events of payloads (session_id, sequence, payload); what is no action of schema 1 is left to rejected_actions."""
    read = payloads.where((F.octet_length("payload") <= LARGEST) & is_json(_of_size())).withColumn("p", F.from_json("payload", _PAYLOAD, {"mode": "PERMISSIVE"}))
    known = read.where((F.col("p.schema") == 1) & F.col("p.kind").isin(*KINDS))
    name = bounded(F.col("p.element.name"), 128)
    method = F.upper(bounded(F.col("p.form.method"), 16))
    seconds = F.col("p.performanceTimeMs") / 1000
    return known.select(
        "session_id", "sequence", F.lit("dom.action").alias("source"), F.lit("dom.action").alias("event_type"), F.col("p.kind").alias("action_kind"), F.coalesce("p.isTrusted", F.lit(False)).alias("is_trusted"),
        F.when(seconds >= 0, seconds).alias("source_monotonic_time"), origin_path(F.col("p.pagePath")).alias("page_path"), F.lower(bounded(F.col("p.element.tag"), 32)).alias("element_tag"),
        F.lower(bounded(F.col("p.element.type"), 32)).alias("element_type"), F.when(~name.rlike("(?i)" + "|".join(DROP_FIELDS)), name).alias("element_name"), bounded(F.col("p.element.role"), 64).alias("element_role"),
        origin_path(F.col("p.form.actionPath")).alias("form_action_path"), F.when(method.rlike("^[A-Z]+$"), method).alias("form_method"), key_set(F.col("p.form.fieldNames")).alias("form_field_names"),
    )
