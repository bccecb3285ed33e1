"""Which user action caused which request: a scored interval join with one best action per request.

The online matcher links a request when it arrives to the best action seen before it; if there is none,
to the first action that comes later and qualifies. Over complete sessions with non-decreasing time this
is a ranking per request, so the batch form is a join on session, target and time bin and a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.matching import FIELDS, KEPT, Matcher, Timing


def score(t: Timing) -> Column:
    """Score of an action (a_ columns) for a request (r_ columns), the terms added in a fixed order."""
    delta = F.abs(F.col("r_time") - F.col("a_time"))
    same_frame = F.coalesce(F.col("a_frame") != "", F.lit(False)) & F.col("a_frame").eqNullSafe(F.col("r_frame"))
    path = F.coalesce(F.col("a_path") == F.col("r_path"), F.lit(False))
    method = F.coalesce(F.upper("a_method") == F.upper("r_method"), F.lit(False))
    term = lambda when, value: F.when(when, F.lit(value)).otherwise(F.lit(0.0))
    step = F.when(delta <= t.near, F.lit(0.30)).when(delta <= t.close, F.lit(0.22)).when(delta <= t.late, F.lit(0.10)).otherwise(F.lit(0.0))
    total = term(same_frame, 0.25) + step + term(path, 0.25) + term(method, 0.15) + term(F.coalesce("r_gesture", F.lit(False)), 0.10)
    total = total + term(F.coalesce("a_trusted", F.lit(False)), 0.05) + term((F.col("a_kind") == "submit") & path & method, 0.05)
    return F.least(total, F.lit(1.0))


def status(score_: Column) -> Column:
    """strong, probable, temporal-only, or null for no link."""
    path = F.coalesce(F.col("a_path") == F.col("r_path"), F.lit(False))
    grounded = path | F.coalesce("r_gesture", F.lit(False))
    weak = F.when(score_ >= 0.40, F.lit("temporal-only"))
    return F.when(grounded & (score_ >= 0.80), F.lit("strong")).when(grounded & (score_ >= 0.60), F.lit("probable")).otherwise(weak)


def correlate(actions: DataFrame, requests: DataFrame, timing: Timing | None = None) -> DataFrame:
    """(session_id, action_event_id, network_event_id, status, score, delta_ms): at most one link a request.

    ``actions``: session_id, event_id, sequence, time, target, frame, path, method, kind, trusted.
    ``requests``: session_id, event_id, sequence, time, target, frame, path, method, gesture.
    Frames have to agree where both are known. An action can serve many requests.
    """
    t = timing or Timing()
    w = t.window
    a = actions.select("session_id", "target", *[F.col(c).alias(f"a_{c}") for c in ("event_id", "sequence", "time", "frame", "path", "method", "kind", "trusted")])
    r = requests.select("session_id", "target", *[F.col(c).alias(f"r_{c}") for c in ("event_id", "sequence", "time", "frame", "path", "method", "gesture")])
    bin_ = lambda c: F.floor(F.col(c) / w)
    a = a.withColumn("bin", F.explode(F.array(bin_("a_time") - 1, bin_("a_time"), bin_("a_time") + 1)))
    r = r.withColumn("bin", bin_("r_time"))
    earlier, later = F.least("a_time", "r_time"), F.greatest("a_time", "r_time")
    frames = F.col("a_frame").isNull() | F.col("r_frame").isNull() | (F.col("a_frame") == F.col("r_frame"))
    met = a.join(r, ["session_id", "target", "bin"]).where(frames & (F.abs(F.col("r_time") - F.col("a_time")) <= w) & ~(earlier < later - w))
    scored = met.withColumn("raw", score(t)).withColumn("status", status(F.col("raw"))).where(F.col("status").isNotNull())
    delta = F.abs(F.col("r_time") - F.col("a_time")) * 1000
    before = F.col("a_sequence") < F.col("r_sequence")
    order = [
        F.when(before, 0).otherwise(1),
        F.when(before, -F.col("raw")).otherwise(F.lit(0.0)),
        F.when(before, delta).otherwise(F.lit(0.0)),
        F.when(~before, F.col("a_sequence")).otherwise(F.lit(0)),
        F.desc("a_event_id"),
    ]
    best = F.row_number().over(Window.partitionBy("session_id", "r_event_id").orderBy(*order))
    return scored.withColumn("_best", best).where("_best = 1").select(
        "session_id",
        F.col("a_event_id").alias("action_event_id"),
        F.col("r_event_id").alias("network_event_id"),
        "status",
        F.round("raw", 4).alias("score"),
        F.round(delta, 3).alias("delta_ms"),
    )


def correlate_sequenced(events: DataFrame, timing: Timing | None = None) -> DataFrame:
    """Links as ``correlate`` gives them, for sessions of any kind: (session_id, action_event_id, network_event_id, status, score, delta_ms).

    ``events``: session_id and FIELDS. Events are taken by sequence, as the online matcher takes them; those without
    id, sequence or time are left out. Sessions in which the clock never runs back, sequences and ids do not repeat
    and no window holds more than KEPT events of a kind are joined, however large they are. The others are
    folded in the order of their sequence, a session in one task, which holds 2 * KEPT events.
    """
    t = timing or Timing()
    e = events.select("session_id", *FIELDS).where("event_id <> '' AND sequence >= 0 AND time >= 0 AND time < double('infinity') AND session_id IS NOT NULL")
    w = Window.partitionBy("session_id").orderBy("sequence", "event_id")
    same_kind = Window.partitionBy("session_id", "is_action").orderBy("sequence", "event_id")
    odd = F.coalesce((F.col("time") < F.lag("time").over(w)) | (F.col("sequence") == F.lag("sequence").over(w)) | (F.col("time") - F.lag("time", KEPT).over(same_kind) <= t.window), F.lit(False))
    marked = e.select("session_id", "event_id", odd.alias("odd"))
    repeated = marked.groupBy("session_id", "event_id").agg(F.max("odd").alias("odd"), F.count("*").alias("n"))
    folded = repeated.groupBy("session_id").agg(F.max(F.col("odd") | (F.col("n") > 1)).alias("odd")).where("odd").select("session_id")
    plain = e.join(folded, "session_id", "left_anti")
    # An empty target, path or method links nothing; an empty frame is no frame.
    known = plain.where("target <> ''").withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("frame", "path", "method")})
    joined = correlate(known.where("is_action"), known.where("NOT is_action"), t)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, matcher = None, None
        for batch in batches:
            found = []
            rows = batch.astype(object).where(batch.notna(), None)
            for session_id, *values in rows[["session_id", *FIELDS]].itertuples(index=False, name=None):
                if session_id != session:
                    session, matcher = session_id, Matcher(t)
                found += [(session, *link) for link in matcher.observe(dict(zip(FIELDS, values)))]
            yield pd.DataFrame(found, columns=["session_id", "action_event_id", "network_event_id", "status", "score", "delta_ms"])

    rest = e.join(folded, "session_id", "left_semi").repartition("session_id").sortWithinPartitions("session_id", "sequence", "event_id")
    return joined.unionByName(rest.mapInPandas(fold, "session_id string, action_event_id string, network_event_id string, status string, score double, delta_ms double"))
