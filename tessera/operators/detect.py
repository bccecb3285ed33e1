"""Change detection: observations against a compiled contract, facts, findings and their history.

Each rule is a branch of a CASE over the observation and what the contract says about its path, method
and keys; facts that can occur together are an array that is exploded. Contract tables are joined on
equal keys and left to the planner, which broadcasts them where they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.canonical import canonical_sha256

SAFE_METHODS = ("GET", "HEAD", "OPTIONS", "TRACE")
#: Facts that become findings, and the rule of each kind. Fixed values of the rule catalogue.
RULES = {
    "endpoint.new": "HTTP-001", "endpoint.method_added": "HTTP-002", "endpoint.query_key_added": "HTTP-003", "endpoint.status_added": "HTTP-004",
    "form.signature_new": "FORM-001", "form.field_added": "FORM-002", "operation.new_signature": "OP-001", "operation.query_key_added": "OP-002",
    "operation.body_key_added": "OP-003", "action_http.request_family_new": "REL-001", "action_http.path_conflict": "REL-002",
}


def fact(kind: str, state: str, delta: Column | None = None) -> Column:
    none = F.lit("")
    return F.struct(F.lit(kind).alias("kind"), F.lit(state).alias("state"), (none if delta is None else F.coalesce(delta, none)).alias("delta"))


def _facts(rows: DataFrame, keep: list[str], facts: Column) -> DataFrame:
    return rows.select(*keep, F.explode(F.filter(facts, lambda f: f.isNotNull())).alias("f")).select(*keep, "f.*")


def compile_contract(events: DataFrame) -> dict[str, DataFrame]:
    """Tables of a contract from baseline observations (path, method, query_keys, status).

    paths: path. methods: path, method, all_keys, statuses. variants: path, method, query_keys, status.
    """
    variants = events.select("path", "method", "query_keys", "status").distinct()
    methods = events.groupBy("path", "method").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("query_keys")))).alias("all_keys"), F.array_sort(F.collect_set("status")).alias("statuses")
    )
    return {"paths": methods.select("path").distinct(), "methods": methods, "variants": variants}


def endpoint_facts(observations: DataFrame, contract: dict[str, DataFrame]) -> DataFrame:
    """(event_id, path, method, kind, state, delta) of http observations (event_id, path, method, query_keys, status).

    session_id stays, if observations have it.
    """
    paths = contract["paths"].select("path", F.lit(True).alias("_path"))
    methods = contract["methods"].select("path", "method", "all_keys", "statuses")
    rows = observations.join(paths, "path", "left").join(methods, ["path", "method"], "left")
    added = F.array_sort(F.array_except("query_keys", "all_keys"))
    new_keys = F.when(F.size(added) > 0, fact("endpoint.query_key_added", "NOVEL", F.array_join(added, ",")))
    unseen = F.col("status").isNotNull() & ~F.array_contains("statuses", F.col("status"))
    new_status = F.when(unseen, fact("endpoint.status_added", "NOVEL", F.col("status").cast("string")))
    known = F.when((F.size(added) == 0) & ~unseen, fact("endpoint.known", "KNOWN"))
    facts = (
        F.when(F.col("_path").isNull(), F.array(fact("endpoint.new", "NOVEL")))
        .when(F.col("all_keys").isNull(), F.array(fact("endpoint.method_added", "NOVEL", F.col("method"))))
        .otherwise(F.array(new_keys, new_status, known))
    )
    return _facts(rows, [*_session(observations), "event_id", "path", "method"], facts)


def _session(rows: DataFrame) -> list[str]:
    return [c for c in ("session_id",) if c in rows.columns]


def operation_facts(observations: DataFrame, signatures: DataFrame) -> DataFrame:
    """(event_id, path, method, kind, state, delta) of unsafe requests (event_id, path, method, query_keys, body_keys).

    ``signatures``: path, method, query_keys, body_keys. Null body keys are unknown, not empty.
    """
    unsafe = observations.where(~F.col("method").isin(*SAFE_METHODS))
    s = signatures.select("path", "method", F.col("query_keys").alias("s_query"), F.col("body_keys").alias("s_body")).distinct()
    more_query, more_body = F.array_sort(F.array_except("query_keys", "s_query")), F.array_sort(F.array_except("body_keys", "s_body"))
    holds = (F.size(F.array_except("s_query", "query_keys")) == 0) & (F.size(F.array_except("s_body", "body_keys")) == 0)
    exact = holds & (F.size(more_query) == 0) & (F.size(more_body) == 0)
    keep = [*_session(observations), "event_id", "path", "method"]
    keyed = unsafe.select(*keep, "query_keys", "body_keys")
    met = keyed.join(s, ["path", "method"], "left").withColumn("size", F.when(holds, F.size(more_query) + F.size(more_body)))
    per = met.groupBy(*keep).agg(
        F.bool_or(F.col("body_keys").isNull()).alias("unknown"),
        F.coalesce(F.bool_or(exact), F.lit(False)).alias("exact"),
        F.min(F.when(holds, F.struct("size", more_query.alias("q"), more_body.alias("b")))).alias("near"),
        F.array_sort(F.collect_list("size")).alias("sizes"),
    )
    unique = F.col("near").isNotNull() & (F.size(F.filter("sizes", lambda x: x == F.col("near.size"))) == 1)
    facts = (
        F.when(F.col("unknown"), F.array(fact("operation.indeterminate", "INDETERMINATE")))
        .when(F.col("exact"), F.array(fact("operation.known", "KNOWN")))
        .when(
            unique,
            F.array(
                F.when(F.size("near.q") > 0, fact("operation.query_key_added", "NOVEL", F.array_join("near.q", ","))),
                F.when(F.size("near.b") > 0, fact("operation.body_key_added", "NOVEL", F.array_join("near.b", ","))),
            ),
        )
        .otherwise(F.array(fact("operation.new_signature", "NOVEL")))
    )
    return _facts(per, keep, facts)


def form_facts(observations: DataFrame, signatures: DataFrame) -> DataFrame:
    """(event_id, path, method, kind, state, delta) of forms (event_id, path, method, fields) against known ``fields``."""
    s = signatures.select("path", "method", F.col("fields").alias("s_fields")).distinct()
    keep = [*_session(observations), "event_id", "path", "method"]
    met = observations.select(*keep, "fields").join(s, ["path", "method"], "left")
    within = F.size(F.array_except("fields", "s_fields")) == 0
    below = F.size(F.array_except("s_fields", "fields")) == 0
    delta = F.array_join(F.array_sort(F.array_except("fields", "s_fields")), ",")
    per = met.groupBy(*keep).agg(
        F.bool_or(F.col("s_fields").isNotNull()).alias("has"),
        F.coalesce(F.bool_or(within), F.lit(False)).alias("within"),
        F.max(F.when(below, F.size("s_fields"))).alias("largest"),
        F.collect_set(F.when(below, F.struct(F.size("s_fields").alias("n"), delta.alias("d")))).alias("deltas"),
    )
    best = F.array_distinct(F.transform(F.filter("deltas", lambda x: x["n"] == F.col("largest")), lambda x: x["d"]))
    facts = (
        F.when(~F.col("has"), F.array(fact("form.signature_new", "NOVEL")))
        .when(F.col("within"), F.array(fact("form.known", "KNOWN")))
        .when(F.size(best) == 1, F.array(fact("form.field_added", "NOVEL", F.try_element_at(best, F.lit(1)))))
        .otherwise(F.array(fact("form.signature_new", "NOVEL")))
    )
    return _facts(per, keep, facts)


def relation_facts(relations: DataFrame, families: DataFrame) -> DataFrame:
    """(event_id, path, method, kind, state, delta) of links (event_id, status, path, method, action_path).

    ``families``: (path, method) of requests that known actions make. A status that is not strong, probable
    or temporal-only fails the job.
    """
    known = families.select("path", "method").distinct().withColumn("_known", F.lit(True))
    rows = relations.join(known, ["path", "method"], "left")
    new = F.when(~F.col("method").isin(*SAFE_METHODS) & F.col("_known").isNull(), fact("action_http.request_family_new", "NOVEL"))
    other = F.col("action_path").isNotNull() & (F.col("action_path") != F.col("path"))
    conflict = F.when(other, fact("action_http.path_conflict", "CONFLICT", F.col("action_path")))
    both = F.array(new, conflict)
    facts = F.when(F.col("status") == "temporal-only", F.array(fact("relation.temporal_only", "INDETERMINATE"))).otherwise(
        F.when(F.size(F.array_compact(both)) == 0, F.array(fact("relation.known", "KNOWN"))).otherwise(both)
    )
    told = F.coalesce(F.col("status").isin("strong", "probable", "temporal-only"), F.lit(False))
    checked = rows.where(F.when(told, F.lit(True)).otherwise(F.raise_error(F.lit("status of a relation is unknown")).cast("boolean")))
    return _facts(checked, [*_session(relations), "event_id", "path", "method"], facts)


def linked_requests(links: DataFrame, actions: DataFrame, requests: DataFrame) -> DataFrame:
    """(session_id, event_id, status, path, method, action_path, problem) of links (session_id, action_event_id, network_event_id, status).

    ``actions`` and ``requests``: session_id, event_id, path and (requests) method. Both ends of a link are events of
    its own session; event ids alone only count where a side has no session_id. A link that names an event which is
    not there stays, and problem says which one.
    """
    own = lambda df: ["session_id"] if "session_id" in df.columns else []
    a = actions.select(*own(actions), F.col("event_id").alias("action_event_id"), F.col("path").alias("action_path"), F.lit(True).alias("_action"))
    r = requests.select(*own(requests), F.col("event_id").alias("network_event_id"), "path", "method", F.lit(True).alias("_request"))
    joined = links.join(r, [*own(requests), "network_event_id"], "left").join(a, [*own(actions), "action_event_id"], "left")
    problem = F.when(F.col("_request").isNull(), F.lit("unknown request")).when(F.col("_action").isNull(), F.lit("unknown action"))
    return joined.select("session_id", F.col("network_event_id").alias("event_id"), "status", "path", "method", "action_path", problem.alias("problem"))


_MEANING = ["change_id", "rule", "kind", "path", "method", "delta"]


def promotable(facts: DataFrame, version: str = "1") -> DataFrame:
    """The facts that become findings, with all their columns, rule and change_id.

    The id is a digest of what changed as canonical JSON, so no two changes share one; it is a column of
    each fact, so nothing has to be joined back.
    """
    names = F.create_map(*[x for k, v in RULES.items() for x in (F.lit(k), F.lit(v))])
    told = facts.where(F.col("state").isin("NOVEL", "CONFLICT")).withColumn("rule", names[F.col("kind")])
    digest = canonical_sha256(version=F.lit(version), **{c: F.col(c) for c in _MEANING[1:]})
    return told.withColumn("change_id", F.concat(F.lit("chg."), digest))


def finding_evidence(facts: DataFrame, version: str = "1") -> DataFrame:
    """(change_id, rule, kind, path, method, delta, event_id): the evidence of each finding, a row an event."""
    return promotable(facts, version).select(*_MEANING, "event_id").distinct()


def findings(facts: DataFrame, version: str = "1", *, first: int = 100) -> DataFrame:
    """(change_id, rule, kind, path, method, delta, n_evidence, evidence): promotable facts merged by their meaning.

    The id is a digest of what changed, not of the evidence. n_evidence counts the distinct events, evidence
    has the ``first`` of them in order, so that a common change is no row of unbounded size; all of them
    are the rows of finding_evidence.
    """
    rows = finding_evidence(facts, version)
    rank = F.row_number().over(Window.partitionBy(*_MEANING).orderBy("event_id"))
    few = rows.withColumn("_k", rank).where(F.col("_k") <= first).groupBy(*_MEANING).agg(F.array_sort(F.collect_list("event_id")).alias("evidence"))
    return rows.groupBy(*_MEANING).agg(F.count("*").alias("n_evidence")).join(few.select("change_id", "evidence"), "change_id").select(*_MEANING, "n_evidence", "evidence")


def change_rollup(found: DataFrame) -> DataFrame:
    """(change_id, first_seen, last_seen, occurrences, sessions) from (change_id, session_id, started_at).

    A session counts once, however often the change stands in it; sessions are taken in the order of
    their start, ties by id.
    """
    once = found.select("change_id", "session_id", "started_at").distinct()
    at = F.struct("started_at", "session_id")
    return once.groupBy("change_id").agg(
        F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"), F.count("*").alias("occurrences"),
        F.min(at)["session_id"].alias("first_session"), F.max(at)["session_id"].alias("last_session"),
    )


def with_profile(rows: DataFrame) -> DataFrame:
    """``rows`` with the analysis profile that they belong to, "default" where none is given."""
    return rows if "profile" in rows.columns else rows.withColumn("profile", F.lit("default"))


def existing_changes(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """(profile, change_id) of ``wanted`` that ``state`` holds in the same profile, each once."""
    known = with_profile(state).select("profile", "change_id")
    return with_profile(wanted).select("profile", "change_id").distinct().join(known, ["profile", "change_id"], "left_semi")


def evidence_conflicts(processed: DataFrame, session: DataFrame) -> DataFrame:
    """(session_id, n) of sessions that come with more than one evidence_sha256, in any profile, now or before."""
    both = processed.select("session_id", "evidence_sha256").unionByName(session.select("session_id", "evidence_sha256"))
    return both.groupBy("session_id").agg(F.countDistinct("evidence_sha256").alias("n")).where("n > 1")


def apply_session(state: DataFrame, processed: DataFrame, new: DataFrame, session: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next (state, processed) after a session's findings: an upsert that a repeated session doesn't change.

    ``state``: profile, change_id, first_seen, last_seen, occurrences. ``new``: profile, change_id, session_id,
    started_at. ``processed`` and ``session``: profile, session_id, evidence_sha256. A session counts once in
    each profile. Evidence of a session that differs from what was processed is a conflict, which
    evidence_conflicts finds; it has to be looked for before.
    """
    state, processed, new, session = map(with_profile, (state, processed, new, session))
    fresh = new.join(processed, ["profile", "session_id"], "left_anti").select("profile", "change_id", "session_id", "started_at").distinct()
    per = fresh.groupBy("profile", "change_id").agg(F.min("started_at").alias("n_first"), F.max("started_at").alias("n_last"), F.count("*").alias("n"))
    both = state.join(per, ["profile", "change_id"], "full_outer")
    merged = both.select(
        "profile", "change_id", F.least("first_seen", "n_first").alias("first_seen"), F.greatest("last_seen", "n_last").alias("last_seen"),
        (F.coalesce("occurrences", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("occurrences"),
    )
    return merged, processed.unionByName(session.distinct().join(processed, ["profile", "session_id"], "left_anti"))


def change_records(state: DataFrame, findings_: DataFrame, *, version: int = 1) -> DataFrame:
    """Index records of changes: one row for each change of ``state`` with its rule, kind and novelty class."""
    own = findings_.select("change_id", "rule", "kind").distinct()
    novelty = F.when(F.col("kind").endswith("_conflict"), F.lit("CONFLICT")).otherwise(F.lit("NOVEL"))
    return with_profile(state).join(own, "change_id").select(
        "profile", "change_id", F.col("rule").alias("rule_id"), F.lit(version).alias("rule_version"), "kind", novelty.alias("novelty_class"), "first_seen", "last_seen", "occurrences"
    )


def attach_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``requests`` (request_id, redirect_index, ..) with status and response_event_id of their response.

    problem says "duplicate", "before_request" or, where both sides have method and path, "disagrees", if
    the evidence is inconsistent. Responses that no request has are what unasked_responses gives.
    """
    keys = ["session_id", "request_id", "redirect_index"]
    told = [c for c in ("method", "path") if c in requests.columns and c in responses.columns]
    one = responses.groupBy(*keys).agg(F.min(F.struct("sequence", "event_id", "status", *told)).alias("r"), F.count("*").alias("n"))
    joined = requests.join(one, keys, "left")
    differ = F.lit(False)
    for c in told:
        differ = differ | ~F.col(f"r.{c}").eqNullSafe(requests[c])
    problem = F.when(F.col("n") > 1, F.lit("duplicate")).when(F.col("r.sequence") <= F.col("sequence"), F.lit("before_request")).when(F.col("r").isNotNull() & differ, F.lit("disagrees"))
    return joined.select(*requests.columns, F.col("r.status").alias("status"), F.col("r.event_id").alias("response_event_id"), problem.alias("problem"))


def unasked_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses whose session has no such request."""
    keys = ["session_id", "request_id", "redirect_index"]
    return responses.join(requests.select(*keys), keys, "left_anti")


def redirect_chain(requests: DataFrame) -> DataFrame:
    """``requests`` with the path of the hop before and the number of hops of their chain.

    If they carry redirect_status, the status that sent the browser on to them (null for a first hop), each
    hop that was left also gets it as hop_status, and problem where it is missing, or where the path that
    redirect_from names is not that of the hop before.
    """
    chain = Window.partitionBy("session_id", "request_id")
    ordered = chain.orderBy("redirect_index")
    linked = requests.withColumn("redirected_from", F.lag("path").over(ordered)).withColumn("hops", F.count("*").over(chain))
    if "redirect_status" not in requests.columns:
        return linked
    from_ = F.col("redirect_from") if "redirect_from" in requests.columns else F.col("redirected_from")
    problem = (
        F.when(F.col("redirected_from").isNull() & F.col("redirect_status").isNotNull(), F.lit("no hop before"))
        .when(F.col("redirected_from").isNotNull() & F.col("redirect_status").isNull(), F.lit("no status"))
        .when(F.col("redirected_from").isNotNull() & ~from_.eqNullSafe(F.col("redirected_from")), F.lit("other path"))
    )
    return linked.withColumn("hop_status", F.lead("redirect_status").over(ordered)).withColumn("problem", problem)
