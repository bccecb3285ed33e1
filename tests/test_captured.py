"""Pages as they are read, and what must fail: conflicts, gaps, unknown states, changed files."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import pages
from tessera.operators import detect, knowledge, projectors, search, snapshot
from tessera.sources import evidence
from tessera.streaming.changes import ChangeHistory

BOXED = """<html><head><title>A &amp; B</title></head><body><nav>menu</nav><div id="content"> One <p>two<br>three</p><script>no()</script>
<textarea>typed</textarea><select><option>pick</option></select></div><footer>foot</footer><div id="content">second</div></body></html>"""
HIDDEN = """<title>T</title>a<template>t</template><svg>s</svg><select><option>o</option></select><p style="visibility: collapse">c</p><p style="color:red; DISPLAY : none">d</p>
<div aria-hidden=" TRUE ">h</div><div inert>i<b>in</b></div><p style="background:display-none">shown</p><br hidden>end"""
FORMS = """<form action="/a"><input name="q" type="text" value="1"><input type="submit"><button name="b">x</button><textarea name="t">v</textarea></form>
<input name="out"><form method="post"><select name="s"></select></form><form action="/open"><input name="z">"""


def test_pages_as_they_are_read(spark):
    df = spark.createDataFrame([(0, BOXED), (1, HIDDEN), (2, FORMS), (3, "<p>no body</p>"), (4, "<body>x</b><i>y</p>z</body>after")], "k int, html string").coalesce(1)
    read = {r.k: r for r in df.select("k", pages.page_text("html").alias("p"), pages.visible_page("html").alias("v"), pages.page_forms("html").alias("f")).collect()}
    assert read[0].p.title == "A & B" and read[0].p.text == "One\ntwo\nthree\npick"  # the first element with that id, no menu, no foot
    assert read[0].v.text == "menu\nOne\ntwo\nthree\nfoot\nsecond"
    assert (read[1].v.title, read[1].v.text) == ("T", "a\nshown\nend")
    assert [(f.method, f.action, [tuple(x) for x in f.fields]) for f in read[2].f] == [("GET", "/a", [("q", "text", "1"), ("t", "textarea", None)]), ("POST", "", [("s", "select", None)])]
    plain = json.dumps(["POST", "", [{"name": "s", "type": "select", "value": None}]], sort_keys=True, separators=(",", ":"))
    import hashlib

    assert read[2].f[1].form_id == hashlib.sha256(plain.encode()).hexdigest()[:16]
    assert (read[3].p.title, read[3].p.text) == (None, "") and read[4].p.text == "x\ny\nz"


def test_unknown_relations_fail(spark):
    rows = spark.createDataFrame([("e", "weak", "/p", "GET", "/p")], "event_id string, status string, path string, method string, action_path string")
    with pytest.raises(Exception, match="status of a relation"):
        detect.relation_facts(rows, rows).collect()
    links = spark.createDataFrame([("s", "a1", "r1", "strong"), ("s", "a9", "r1", "strong"), ("s", "a1", "r9", "strong")], "session_id string, action_event_id string, network_event_id string, status string")
    a = spark.createDataFrame([("a1", "/p")], "event_id string, path string")
    r = spark.createDataFrame([("r1", "/q", "POST")], "event_id string, path string, method string")
    assert sorted((x.event_id, x.problem or "") for x in detect.linked_requests(links, a, r).collect()) == [("r1", ""), ("r1", "unknown action"), ("r9", "unknown request")]


def test_changed_evidence_fails(spark, tmp_path):
    h = ChangeHistory(spark, str(tmp_path))
    rows = lambda e: spark.createDataFrame([("c1", "s1", "t1", e)], "change_id string, session_id string, started_at string, evidence_sha256 string")
    h.apply(rows("x"), 0)
    h.apply(rows("x"), 1)
    with pytest.raises(ValueError, match="evidence"):
        h.apply(rows("y"), 2)
    assert [(r.change_id, r.occurrences) for r in h.latest(1).collect()] == [("c1", 1)]


def test_ids_of_changes_are_those_of_their_parts(spark):
    facts = spark.createDataFrame([("e1", "endpoint.new", "NOVEL", "/a|b", "GET", ""), ("e2", "endpoint.new", "NOVEL", "/a", "b|GET", "")], "event_id string, kind string, state string, path string, method string, delta string")
    found = detect.findings(facts.union(facts))
    assert found.select("change_id").distinct().count() == 2 and all(r.n_evidence == 1 for r in found.collect())
    many = spark.range(300).select(F.format_string("e%03d", "id").alias("event_id"), F.lit("endpoint.new").alias("kind"), F.lit("NOVEL").alias("state"), F.lit("/a").alias("path"), F.lit("GET").alias("method"), F.lit("").alias("delta"))
    one = detect.findings(many).first()
    assert one.n_evidence == 300 and one.evidence == [f"e{k:03d}" for k in range(100)] and detect.finding_evidence(many).count() == 300


def test_files_are_looked_at(spark, tmp_path):
    event = {"schema_version": "1.0", "event_id": "e0", "session_id": "s", "sequence": 0, "observed_at": "t", "monotonic_time": 0.5, "source": "system", "event_type": "x", "confidence": "c"}
    write = lambda name, *rows: (tmp_path / name).write_text("".join(json.dumps(event | r) + "\n" for r in rows)) and str(tmp_path / name)
    good = write("good.jsonl", {}, {"event_id": "e1", "sequence": 1})
    known = evidence.snapshot_identity(spark, good)
    known.write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))
    assert evidence.verified_events(spark, good, expected=known).count() == 2
    write("good.jsonl", {}, {"event_id": "e1", "sequence": 1, "observed_at": "u"})
    with pytest.raises(ValueError, match="not those expected"):
        evidence.verified_events(spark, good, expected=known)
    with pytest.raises(ValueError, match="gaps"):
        evidence.verified_events(spark, write("gap.jsonl", {}, {"event_id": "e1", "sequence": 2}))
    with pytest.raises(ValueError, match="more than once"):
        evidence.verified_events(spark, write("twice.jsonl", {}, {"sequence": 1}))
    for k, at in enumerate(("2024-01-02T00:00:00+05:00", "2024-01-01T20:00:00Z", "2024-01-01T20:00:00Z")):
        (tmp_path / f"m{k}.json").write_text(json.dumps({"session_id": f"s{2 - k}", "started_at": at, "status": "completed"}))
    files = [str(tmp_path / f"m{k}.json") for k in range(3)]
    assert [r.session_id for r in evidence.read_manifests(spark, *files).collect()] == ["s2", "s0", "s1"]
    assert [r.session_id for r in evidence.read_manifests(spark, *files, selected=["s0", "s1"]).collect()] == ["s0", "s1"]


def test_bundles_are_written_once(spark, tmp_path):
    found = spark.createDataFrame([('s"1', "c1", "R", "k", "/p", "GET")], "session_id string, change_id string, rule string, kind string, path string, method string")
    made = knowledge.bundles(found, 'a"b')
    doc = json.loads(made.first().payload)
    assert doc["profile"] == 'a"b' and doc["session_id"] == 's"1'
    where = str(tmp_path / "out")
    assert knowledge.materialise(made, where) == 1 and knowledge.materialise(made, where) == 0
    with pytest.raises(ValueError, match="other bytes"):
        knowledge.materialise(made.withColumn("payload_sha256", F.lit("x")), where)


def test_records_and_cases_that_are_not_sound_fail(spark):
    seen = "source_id string, path_pattern string, count long, methods map<string,long>, query_keys array<string>, mime_types array<string>, evidence array<string>"
    good = ("s", "/a", 3, {"get": 1, "post": 2}, ["b", "a"], [], [])
    assert projectors.session_endpoint_records(spark.createDataFrame([good], seen)).first().body == "GET POST\na b"
    for bad in ([("s", "/a", 4, {"get": 1, "post": 2}, [], [], [])], [good, good]):
        with pytest.raises(Exception, match="not sound"):
            projectors.session_endpoint_records(spark.createDataFrame(bad, seen)).collect()
    doc = lambda v: spark.createDataFrame([(json.dumps(v),)], "text string")
    assert [(r.query, r.category) for r in search.evaluation_cases(doc({"schema_version": 1, "cases": [{"query": "a"}, {"query": "b", "category": "x"}]})).collect()] == [("a", "legacy"), ("b", "x")]
    for bad in ({"schema_version": 4, "cases": [{"query": "a"}]}, {"schema_version": 1, "cases": []}, {"schema_version": 1, "cases": [{"query": "a", "more": 1}]}, {"schema_version": 1, "cases": [{}]}):
        with pytest.raises(Exception, match="evaluation cases"):
            search.evaluation_cases(doc(bad)).collect()
    paths = spark.createDataFrame([('{"a":{"Cookie":1,"b_value":[2]},"t":"x\\u0000"}',), ("{",), ("{}",)], "t string").select(snapshot.forbidden_paths("t"))
    assert [r[0] for r in paths.collect()] == [["$.a.Cookie", "$.a.b_value", "$.t"], ["not JSON"], []]


def test_an_outbox_without_bundles_can_be_read(spark, tmp_path):
    from tessera.operators import knowledge

    none = spark.createDataFrame([], "session_id string, bundle_id string, payload string, payload_sha256 string")
    where = str(tmp_path / "none")
    assert knowledge.materialise(none, where) == 0 and knowledge.materialise(none, where) == 0
    assert spark.read.parquet(where).select("bundle_id").count() == 0
