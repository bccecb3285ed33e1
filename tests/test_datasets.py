"""Datasets from captures, recognisers, actions, help pages, registries and ingest streams."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import actions, recognise, wiki
from tessera.operators import consistency, datasets
from tessera.sources import har, registry
from tessera.streaming import ingest

PAGE = '<html><title>T</title><body><a href="https://x.test/shop/id/5">s</a><script>go("/a/b?id=3&amp;product=4.");"/{no}"</script><form action="/go" method="post"><input name="q"></form></body></html>'
HELP = '<font class="text">Use <b>it</b><br>well</font> Читайте также <a href="/wikihelp/topic/A%20b+c">x</a><a href="/wikihelp?x=1&topic=T2">y</a><a href="/wikihelp/topic/A%20b+c">x</a></table><a href="/wikihelp/topic/no">n</a>'


def entry(url, mime, text, kind="document", status=200):
    content = {"mimeType": mime} | ({} if text is None else {"text": text})
    return {"startedDateTime": "2024-01-01T00:00:00.000Z", "_resourceType": kind, "request": {"method": "GET", "url": url}, "response": {"status": status, "content": content}}


@pytest.fixture(scope="module")
def captured(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("har")
    rows = [entry("https://x.test/shop?id=1", "text/html", PAGE), entry("https://x.test/api", "application/json", '{"a":1}'), entry("https://x.test/bad", "application/json", "{no"), entry("https://x.test/css/a.css", "text/css", "", "stylesheet"),
            entry("https://x.test/wikihelp/topic/Start", "text/html", HELP), entry("https://y.test/", "text/html", PAGE), entry("https://x.test/gone", "text/html", PAGE, status=404)]
    (folder / "a.har").write_text(json.dumps({"log": {"entries": rows}}))
    (folder / "b.har").write_text(json.dumps({"log": {"entries": rows[4:5]}}))
    return har.read_har(spark, str(folder / "a.har"), str(folder / "b.har"), hosts=("x.test",)).cache()


def test_every_dataset(captured):
    got = {name: datasets.build(name, captured, "x.test") for name in datasets.BUILDERS}
    assert got["application-events"].count() == 6
    assert {r.path_pattern: (r["count"], r.query_keys) for r in got["endpoints"].collect()}["/shop"] == (1, "id")
    assert {r.path_pattern: r["count"] for r in got["endpoints"].collect()}["/wikihelp/topic/{topic}"] == 2
    assert [r.path for r in got["assets"].collect()] == ["/css/a.css"]
    patterns = {r.pattern: r["count"] for r in got["routes"].collect()}
    assert patterns["/shop/id/{id}"] == 2 and patterns["/shop?id={id}"] == 1 and patterns["/wikihelp/topic/{topic}"] >= 2
    assert [(r.method, r.action, [tuple(f) for f in r.fields], r.observed) for r in got["forms"].collect()] == [("POST", "/go", [("q", None, None)], 1)]
    assert [(r.entry, r.title) for r in got["pages"].collect()] == [(0, "T")]
    assert sorted((r.path, r.is_json) for r in got["json-responses"].collect()) == [("/api", True), ("/bad", False)]
    topics = got["wiki-topics"].collect()
    assert [(t.topic, t.capture, t.text, t.related_topics) for t in topics] == [("Start", "a.har", "Use it\nwell", ["A b+c", "T2"])]
    assert datasets.wiki_topics(captured, "x.test", ("b.har",)).first().capture == "b.har"
    with pytest.raises(ValueError):
        datasets.build("nothing", captured, "x.test")


def test_topics(spark):
    hrefs = ["/wikihelp/topic/a%20b", "https://h/wikihelp?topic=c+d", "/other/topic/x", "/wikihelp/topic/", "/wikihelp?topic=", None]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string").select(wiki.topic(F.col("h")))
    assert [r[0] for r in df.collect()] == ["a b", "c d", None, None, None, None]


def test_recognisers(spark):
    base = {"event_type": "http.response_body", "source": "cdp.network", "method": "GET", "status_code": 200, "mime_type": "text/html; charset=x"}
    rows = [("/units/", {"id": ["7"], "tab": ["goods"]}), ("/units/", {"id": ["7"], "tab": ["goods"], "x": ["1"]}), ("/units/", {"id": ["07"], "tab": ["goods"]}), ("/units/", {"id": ["7", "8"], "tab": ["goods"]}), ("/company/", {"id": ["9"], "tab": ["units"], "x": ["1"]})]
    df = spark.createDataFrame([(p, q) for p, q in rows], "url_path string, query map<string, array<string>>")
    for k, v in base.items():
        df = df.withColumn(k, F.lit(v))
    got = df.select(recognise.goods_unit(), recognise.roster_company(), recognise.capture_plan()).collect()
    assert [tuple(r) for r in got] == [("7", None, "unit-economics"), (None, None, None), (None, None, None), (None, None, None), (None, "9", "company-roster")]


def test_actions(spark):
    good = {"schema": 1, "kind": "submit", "isTrusted": True, "performanceTimeMs": 1500, "pagePath": "/p?x#y", "element": {"tag": "FORM", "name": "sessionToken", "role": " "}, "form": {"method": "post", "actionPath": "https://evil.test/", "fieldNames": ["b[1]", "password", "a"]}}
    rows = [(0, json.dumps(good)), (1, "no json"), (2, json.dumps(good | {"schema": 2})), (3, json.dumps(good | {"kind": "hover"})), (4, json.dumps(good | {"form": {"method": "po st", "actionPath": "/go?x"}}))]
    got = actions.action_events(spark.createDataFrame([("s", *r) for r in rows], "session_id string, sequence long, payload string")).orderBy("sequence").collect()
    assert [r.sequence for r in got] == [0, 4]
    odd = [*rows, (5, "x" * 40_000), (6, json.dumps(good) + "}"), (7, None)]
    told = actions.rejected_actions(spark.createDataFrame([("s", *r) for r in odd], "session_id string, sequence long, payload string")).orderBy("sequence").collect()
    assert [(r.sequence, r.problem) for r in told] == [(1, "no JSON"), (2, "other schema"), (3, "other kind"), (5, "too large"), (6, "no JSON"), (7, "no payload")]
    assert (got[0].page_path, got[0].element_tag, got[0].element_name, got[0].element_role, got[0].form_action_path, got[0].form_method, got[0].form_field_names, got[0].source_monotonic_time) == ("/p", "form", None, None, None, "POST", ["a", "b[n]"], 1.5)
    assert (got[1].form_action_path, got[1].form_method, got[1].form_field_names) == ("/go", None, None)


def test_consistency(spark):
    rows = spark.createDataFrame([("g", v) for v in (5, 1, 9, 3, 7)] + [("h", 2), ("h", None)], "g string, v int")
    assert {r.g: (r.p50, r.p95) for r in consistency.nearest_rank(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()} == {"g": (5, 9), "h": (2, 2)}
    c = spark.createDataFrame([("a", 2), ("b", 3)], "p string, count long")
    n = spark.createDataFrame([("a", "method", "GET", 2), ("b", "method", "GET", 2)], "p string, facet string, value string, n long")
    assert [r.p for r in consistency.census_conservation(c, n, "p").collect()] == ["b"]
    assert sorted(map(tuple, consistency.both_ways(c, n.where("p = 'a'"), ["p"]).collect())) == [("b", "left")]
    acts = spark.createDataFrame([("x", "/p", "POST", ["a"]), ("y", "/p", "POST", ["z"]), ("w", "/q", "GET", [])], "action_id string, path string, method string, fields array<string>")
    ops = spark.createDataFrame([("/p", "POST", ["a", "b"])], "path string, method string, keys array<string>")
    assert sorted(r.action_id for r in consistency.actions_without_operation(acts, ops).collect()) == ["w", "y"]
    e = spark.createDataFrame([("r", k, f"e{k}") for k in range(12)], "ref string, ordinal int, evidence_ref string")
    assert consistency.top_evidence(e).first().evidence == [f"e{k}" for k in range(8)]
    meta = spark.createDataFrame([("f", "ready")], "fingerprint string, status string")
    assert consistency.mark_stale(meta, "parser").first().status == "stale"


def test_registry(spark, tmp_path):
    one, two = spark.createDataFrame([("a", 1)], "source_id string, size long"), spark.createDataFrame([("b", 2)], "source_id string, size long")
    assert sorted(map(tuple, registry.source_catalog(har=one, web=two).collect())) == [("a", 1, "har"), ("b", 2, "web")]
    with pytest.raises(Exception, match="not unique"):
        registry.source_catalog(har=one, web=one).count()
    rows = spark.createDataFrame([("c", 3, None, None), (None, None, "s", 4)], "capture string, entry int, session_id string, sequence int")
    known = spark.createDataFrame([("c", "src")], "capture string, source_id string")
    assert sorted(r.ref for r in registry.translate_refs(rows, known).collect()) == ["s#seq-4", "src#entry-3"]
    with pytest.raises(Exception, match="unknown capture"):
        registry.translate_refs(rows, known.limit(0)).collect()
    (tmp_path / "p.json").write_text(json.dumps({"headers": {"drop": ["Cookie"]}, "fields": {"drop_patterns": ["(?i)pwd"]}}))
    assert registry.load_policy(str(tmp_path / "p.json")) == {"headers": ("cookie",), "fields": ("pwd",)}


def test_streams(spark, tmp_path):
    frames = [("s", "r1", 0, "http.request", "GET", "/a", None, 1.0), ("s", "r1", 1, "http.request", "GET", "/b", None, 1.5), ("s", "r1", 2, "http.response", None, None, 200, 2.0), ("s", "r2", 3, "http.request", "GET", "/c", None, 2.0), ("s", "r1", 4, "http.finished", None, None, None, 2.0), ("s", "r2", 5, "http.failed", None, None, None, 2.5), ("s", "r3", 6, "http.finished", None, None, None, 3.0)]
    schema = "session_id string, request_id string, sequence long, event_type string, method string, url_path string, status_code int, monotonic_time double"
    spark.createDataFrame(frames[:2], schema).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame(frames[2:], schema).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.finished_requests(stream).writeStream.format("memory").queryName("done").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("done").collect())
    assert got == [("s", "r1", "GET", "/b", 200, 1, "finished", 1.0), ("s", "r2", "GET", "/c", None, 0, "failed", 0.5)]

    spark.createDataFrame([("e1", "2024-01-01T00:00:00Z"), ("e1", "2024-01-01T00:00:00Z"), ("e2", "2024-01-02T00:00:00Z")], "event_id string, observed_at string").write.json(str(tmp_path / "ev"))
    for _ in range(2):  # a second start finds nothing new
        ingest.append_events(spark.readStream.schema("event_id string, observed_at string").json(str(tmp_path / "ev")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.json(str(tmp_path / "out")).collect()) == ["e1", "e2"]
