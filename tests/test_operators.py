"""Single operators on small, exact cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import normalise as N
from tessera.functions import pages, text
from tessera.operators import census, correlate, current, detect, experiments, integrity, market, paths, provenance, search, sessions

ACTION = "session_id string, event_id string, sequence long, time double, target string, frame string, path string, method string, kind string, trusted boolean"
REQUEST = "session_id string, event_id string, sequence long, time double, target string, frame string, path string, method string, gesture boolean"


def action(spark, *rows):
    full = [("s", f"a{k}", *r) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, ACTION)


def request(spark, *rows):
    return spark.createDataFrame([("s", f"r{k}", *r) for k, r in enumerate(rows)], REQUEST)


A0 = (0, 10.0, "t1", "f1", "/api/post", "POST", "submit", True)
CASES = {
    "strong": ([A0], [(1, 10.1, "t1", "f1", "/api/post", "POST", True)], [("a0", "r0", "strong")]),
    "other target": ([A0], [(1, 10.1, "t2", "f1", "/api/post", "POST", True)], []),
    "other frame": ([A0], [(1, 10.1, "t1", "f2", "/api/post", "POST", True)], []),
    "temporal": ([(0, 10.0, "t1", "f1", None, None, "click", True)], [(1, 10.1, "t1", "f1", "/x", "GET", False)], [("a0", "r0", "temporal-only")]),
    "stale": ([A0], [(1, 12.5, "t1", "f1", "/api/post", "POST", True)], []),
    "fan-out": ([A0], [(1, 10.05, "t1", "f1", "/api/post", "POST", True), (2, 10.08, "t1", "f1", "/api/post", "POST", True)], [("a0", "r0", "strong"), ("a0", "r1", "strong")]),
    "action later": ([(1, 40.1, "t1", "f1", "/api/post", "POST", "submit", True)], [(0, 40.0, "t1", "f1", "/api/post", "POST", True)], [("a0", "r0", "strong")]),
    "best wins": ([(0, 10.0, "t1", "f1", None, None, "click", True), (1, 10.05, "t1", "f1", "/api/post", "POST", "submit", True)], [(2, 10.1, "t1", "f1", "/api/post", "POST", True)], [("a1", "r0", "strong")]),
    "earlier qualifies": ([(0, 10.0, "t1", "f1", None, None, "click", True), (2, 10.2, "t1", "f1", "/api/post", "POST", "submit", True)], [(1, 10.1, "t1", "f1", "/api/post", "POST", True)], None),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_correlation(spark, name):
    a, r, want = CASES[name]
    got = [tuple(x) for x in correlate.correlate(action(spark, *a), request(spark, *r)).select("action_event_id", "network_event_id", "status").orderBy("network_event_id").collect()]
    if want is None:  # linked when the request came, to what was there
        assert [g[0] for g in got] == ["a0"]
    else:
        assert got == want


def test_correlation_is_the_same_however_dealt(spark, small):
    from tessera.plans import adapters, queries

    a, r = adapters.correlation_inputs(spark, small)
    want = sorted(map(tuple, correlate.correlate(a, r, queries.TIMING).collect()))
    assert want
    for n in (1, 7):
        assert sorted(map(tuple, correlate.correlate(a.repartition(n), r.repartition(n), queries.TIMING).collect())) == want


PLAN = [
    (33670, 101, 5, 1, 2, 30.0, 35.0, 0.5, 0.5, 10.0, 5.0), (33670, 102, 0, 0, 3, 50.0, 40.0, 0.5, 0.5, 45.0, 0.0), (33670, 103, 1, 0, 1, 10.0, 33.0, 0.4, 0.0, 5.0, 1.0),
    (33671, 101, 1, 2, 4, 20.0, 30.0, 0.5, 0.5, 12.0, 3.0), (33671, 102, 12, 0, 4, 20.0, 30.0, 0.5, 0.25, 12.0, 0.0),
]


def test_plan(spark):
    rows = spark.createDataFrame(PLAN, "unit_id long, product_id long, stock_qty long, supply_qty long, sales_volume long, our_price double, city_price double, city_quality double, stock_quality double, supply_cost double, profit double")
    got = {(r.unit_id, r.product_id): r for r in current.plan(rows).collect()}
    assert [(r.target, r.order_qty) for r in map(got.get, sorted(got))] == [(6, 0), (9, 9), (3, 2), (12, 9), (12, 0)]
    assert got[33670, 101].flags == "below_city,potential" and abs(got[33670, 101].recommended - 36.75) < 1e-9
    assert got[33670, 102].flags == "above_corridor,out_of_stock_risk"
    assert got[33670, 103].reference is None and got[33670, 103].flags.endswith("unknown")
    assert got[33671, 102].flags == "below_city,above_corridor"
    assert [r.product_id for r in current.top_plan(rows, limit=2).collect()] == [101, 101]
    with pytest.raises(ValueError):
        current.plan(rows, weeks=9)


def test_market_latest_and_append(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("j", 1, "d")], "key string, at int, id string")
    want = {("k", 2, "c", 3), ("j", 1, "d", 1)}
    for n in (1, 4):
        assert {tuple(r) for r in market.latest_per_key(rows.repartition(n), ["key"], ["at", "id"]).select("key", "at", "id", "n").collect()} == want
    assert market.append(rows, rows, ["id"]).count() == 4
    fresh = spark.createDataFrame([("n", 9, "e"), ("n", 9, "e"), ("k", 1, "a")], rows.schema)
    assert market.append(rows, fresh, ["id"]).count() == 5
    for clash in ([("other", 1, "a")], [("n", 9, "e"), ("n", 8, "e")]):  # against the log, and among the new
        with pytest.raises(Exception, match="conflicts"):
            market.append(rows, spark.createDataFrame(clash, rows.schema), ["id"]).count()
    assert market.latest_per_key(rows.limit(0), ["key"], ["at", "id"]).count() == 0


def test_paths(spark):
    known = spark.createDataFrame([("/u/{id}",), ("/u/new",), ("/{kind}/{id}",), ("/x/{a}",), ("/x/{b}",)], "pattern string")
    asked = spark.createDataFrame([("/u/7",), ("/u/new",), ("/v/7",), ("/x/1",), ("/deep/er/path",), ("/a.c/1",)], "path string")
    got = {r.path: (r.pattern, r.status) for r in paths.match(asked, known).collect()}
    assert got["/u/7"] == ("/u/{id}", "template") and got["/u/new"] == ("/u/new", "exact") and got["/v/7"] == ("/{kind}/{id}", "template")
    assert got["/x/1"] == (None, "ambiguous") and got["/deep/er/path"] == (None, "unknown")


def test_normalise(spark):
    df = spark.createDataFrame([("https://Shop.Example.com/a/b?x=1&x=2&empty&tok=a%20b+c#f", "819.94 млн p.", "+79.5%", "012")], "url string, m string, p string, i string")
    r = df.select(
        N.url_path(F.col("url")), N.url_host(F.col("url")), N.query_pairs(N.url_query(F.col("url"))), N.first_values(N.query_pairs(N.url_query(F.col("url")))),
        N.money(F.col("m")), N.percent(F.col("p")), N.canonical_id(F.col("i")), N.method(F.lit("get")), N.method(F.lit(" get")),
        N.key_set(F.array(*map(F.lit, ("b[3]", "12", "a", "a", "sessionId", " ")))), N.key_set(F.lit(None).cast("array<string>")),
        N.is_static(F.lit("/a.css/b"), F.lit("xhr")), N.is_static(F.lit("/.css"), F.lit("xhr")), N.is_static(F.lit("/x"), F.lit("font")), N.content_type(F.lit("Text/HTML; charset=x")),
    ).first()
    assert r[0] == "/a/b" and r[1] == "shop.example.com" and [tuple(p) for p in r[2]] == [("x", "1"), ("x", "2"), ("empty", ""), ("tok", "a b c")]
    assert [p.key for p in r[3]] == ["x", "empty", "tok"]
    assert r[4] == 819_940_000 and r[5] == 79.5 and r[6] is None and r[7] == "GET" and r[8] is None
    assert r[9] == ["a", "b[n]", "{numeric-key}"] and r[10] is None
    assert list(r[11:]) == [True, False, True, "text/html"]


def test_pages_and_text(spark):
    html = '<html><title>T &amp; x</title><body><script>no()</script><p>One <b>two</b></p><div hidden>gone</div><form method=post action="/go"><input name=a><select name=b></select></form><a href="/l">L</a></body></html>'
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    rows = df.select(pages.page_text("html"), pages.visible_text("html"), pages.page_forms("html"), pages.page_links("html")).collect()
    assert rows[0][0].title == "T & x" and rows[0][0].text == "One\ntwo\ngone\nL" and rows[0][1] == "One\ntwo\nL"
    assert [tuple(f) for f in rows[0][2][0].fields] == [("a", None, None), ("b", "select", None)] and rows[0][2][0].method == "POST" and rows[0][3] == ["/l"]
    assert rows[1][0].text == "" and rows[2][2] == []
    redacted = spark.createDataFrame([('{"a":1,"Token":2,"l":[{"cookie":1,"v":"é"}]}',), ("no json",), (None,)], "j string").select(text.redact_json(F.col("j")), text.search_text(F.lit("  Straße  ﬁ ")))
    assert [r[0] for r in redacted.collect()] == ['{"a":1,"l":[{"v":"é"}]}', None, None] and redacted.first()[1] == "strasse fi"


def test_detection(spark):
    obs = "event_id string, path string, method string, query_keys array<string>, status int"
    base = spark.createDataFrame([("b1", "/save", "POST", ["id"], 200), ("b2", "/save", "POST", ["id", "mode"], 302), ("b3", "/save", "GET", [], 200)], obs)
    seen = spark.createDataFrame([("e1", "/other", "GET", [], 200), ("e2", "/save", "PUT", [], 200), ("e3", "/save", "POST", ["id", "new"], 500), ("e4", "/save", "GET", [], None)], obs)
    facts = detect.endpoint_facts(seen, detect.compile_contract(base))
    got = {(r.event_id, r.kind, r.delta) for r in facts.collect()}
    assert got == {("e1", "endpoint.new", ""), ("e2", "endpoint.method_added", "PUT"), ("e3", "endpoint.query_key_added", "new"), ("e3", "endpoint.status_added", "500"), ("e4", "endpoint.known", "")}
    found = detect.findings(facts.union(facts))
    assert found.count() == 4 and all(r.change_id.startswith("chg.") and len(r.evidence) == 1 for r in found.collect())
    ops = "event_id string, path string, method string, query_keys array<string>, body_keys array<string>"
    known = spark.createDataFrame([("x", "/save", "POST", ["id"], ["name", "price"]), ("y", "/save", "POST", ["q"], ["name"])], ops)
    asked = spark.createDataFrame([("o1", "/save", "POST", ["id"], ["name", "price"]), ("o2", "/save", "POST", ["id"], None), ("o3", "/save", "POST", ["id", "m"], ["name", "price", "z"]), ("o4", "/none", "POST", [], []), ("o5", "/save", "GET", [], [])], ops)
    got = sorted((r.event_id, r.kind, r.delta) for r in detect.operation_facts(asked, known).collect())
    assert got == [("o1", "operation.known", ""), ("o2", "operation.indeterminate", ""), ("o3", "operation.body_key_added", "z"), ("o3", "operation.query_key_added", "m"), ("o4", "operation.new_signature", "")]
    form = "event_id string, path string, method string, fields array<string>"
    got = sorted((r.event_id, r.kind, r.delta) for r in detect.form_facts(
        spark.createDataFrame([("f1", "/s", "POST", ["name"]), ("f2", "/s", "POST", ["name", "price", "stock"]), ("f3", "/t", "POST", ["a"]), ("f4", "/s", "POST", ["z"])], form),
        spark.createDataFrame([("k", "/s", "POST", ["name", "price"])], form)).collect())
    assert got == [("f1", "form.known", ""), ("f2", "form.field_added", "stock"), ("f3", "form.signature_new", ""), ("f4", "form.signature_new", "")]


def test_history_takes_a_session_once(spark):
    state = spark.createDataFrame([("c1", "t1", "t1", 1)], "change_id string, first_seen string, last_seen string, occurrences long")
    done = spark.createDataFrame([("s1", "h")], "session_id string, evidence_sha256 string")
    new = spark.createDataFrame([("c1", "s2", "t2"), ("c1", "s2", "t2"), ("c2", "s2", "t2"), ("c1", "s1", "t1")], "change_id string, session_id string, started_at string")
    sessions_ = spark.createDataFrame([("s2", "h2"), ("s1", "h")], "session_id string, evidence_sha256 string")
    changed, processed = detect.apply_session(state, done, new, sessions_)
    assert sorted(map(tuple, changed.collect())) == [("default", "c1", "t1", "t2", 2), ("default", "c2", "t2", "t2", 1)] and processed.count() == 2
    other, _ = detect.apply_session(changed, processed, new.withColumn("profile", F.lit("p2")), sessions_.withColumn("profile", F.lit("p2")))
    assert other.where("profile = 'p2'").count() == 2  # a profile has a history of its own
    assert detect.existing_changes(changed, new.withColumn("profile", F.lit("p2"))).count() == 0 and detect.existing_changes(changed, new).count() == 2
    assert [r.session_id for r in detect.evidence_conflicts(processed, sessions_.where("session_id = 's2'").withColumn("evidence_sha256", F.lit("x"))).collect()] == ["s2"]
    again, _ = detect.apply_session(changed, processed, new, sessions_)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, changed.collect()))


def test_session_summary(spark):
    e = spark.createDataFrame(
        [("s", "a", "dom.action", "dom.action"), ("s", "r", "cdp.network", "http.request"), ("s", "p", "cdp.network", "http.response"), ("s", "l", "system", "correlation.action_http"), ("s", "b", "dom.action", "dom.action"), ("s", "f", "cdp.network", "http.failed")],
        "session_id string, event_id string, source string, event_type string",
    )
    links = spark.createDataFrame([("s", "a", "strong")], "session_id string, action_event_id string, status string")
    warned = spark.createDataFrame([("s", 1)], "session_id string, warning_count long")
    r = sessions.summaries(e, links, warned).first()
    assert (r.event_count, r.action_count, r.http_request_count, r.http_response_count, r.strong_count, r.probable_count, r.temporal_count, r.exact_count, r.uncorrelated_count, r.warning_count, r.anomaly_count) == (6, 2, 1, 1, 1, 0, 0, 0, 1, 1, 1)
    c = sessions.compare(sessions.summaries(e, links, warned), "s", "missing").first()
    assert c.before_found and not c.after_found and c.event_count_delta is None


def test_integrity_and_provenance(spark):
    e = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0), ("t", 2), ("u", 0), ("u", 0)], "session_id string, sequence long")
    assert {r.session_id: r.contiguous for r in integrity.sequence_gaps(e).collect()} == {"s": True, "t": False, "u": False}
    with pytest.raises(Exception, match="broken"):
        integrity.require(e, "sequence < 2", "broken").count()
    refs = spark.createDataFrame([("h#entry-1",), ("h#entry-9",), ("z#seq-0",), ("bad",)], "ref string")
    got = {r.ref: r.status for r in provenance.trace(refs, spark.createDataFrame([("h", 3)], "source_id string, size long")).collect()}
    assert got == {"h#entry-1": "resolved", "h#entry-9": "out_of_range", "z#seq-0": "unknown_source", "bad": "malformed"}


def test_experiments(spark):
    b = spark.createDataFrame([(1, 10, None), (2, 5, 1.0)], "k int, v int, w double")
    a = spark.createDataFrame([(1, 12, None), (2, 5, None)], "k int, v int, w double")
    got = {(r.k, r.field): (r.delta, r.changed) for r in experiments.deltas(b, a, ["k"], ["v", "w"]).collect()}
    assert got == {(1, "v"): (2.0, True), (1, "w"): (None, False), (2, "v"): (0.0, False), (2, "w"): (None, True)}
    with pytest.raises(Exception, match="keys differ"):
        experiments.deltas(b, a.where("k = 1"), ["k"], ["v"]).count()
    o = spark.createDataFrame([("unchanged", False, 0.0, False), ("change", True, 1.0, False), ("increase", True, -1.0, False), ("increase", True, 1.0, True)], "e string, c boolean, d double, k boolean")
    assert [r[0] for r in o.select(experiments.outcome(F.col("e"), F.col("c"), F.col("d"), F.col("k"))).collect()] == ["refuted", "confirmed", "refuted", "inconclusive"]


def test_search(spark):
    records = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "beta"), (4, None)], "ref long, text string")
    asked = spark.createDataFrame([(1, "Alpha beta"), (2, "nothing here"), (3, "beta")], "query_id long, text string")
    got = [(r.query_id, r.rank, r.ref) for r in search.bm25(asked, records).orderBy("query_id", "rank").collect()]
    assert got[0] == (1, 1, 1) and {g[2] for g in got if g[0] == 3} == {1, 3} and not [g for g in got if g[0] == 2]
    marked = spark.createDataFrame([(1, "Café Ångström"), (2, "tea")], "ref long, text string")
    asked = spark.createDataFrame([(1, "cafe"), (2, "ANGSTROM café"), (3, "Téa")], "query_id long, text string")
    assert {(r.query_id, r.ref) for r in search.bm25(asked, marked).collect()} == {(1, 1), (2, 1), (3, 2)}


def test_census_numbers(spark):
    rows = spark.range(1000).withColumn("k", (F.col("id") * 7) % 1000).repartition(5)
    got = census.number_rows(rows, ["k"]).select("k", "row").collect()
    assert all(r.row == r.k + 1 for r in got)
    m = sorted(map(tuple, census.partition_manifest(rows, ["k"], size=300).collect()))
    assert m == [(0, 300, 0, 0), (1, 300, 300, 300), (2, 300, 600, 600), (3, 100, 900, 900)]


def test_sources(spark, tmp_path):
    from tessera.sources import evidence, har, parts

    doc = {"log": {"entries": [
        {"startedDateTime": "2024-01-01T03:00:00.1239+03:00", "_resourceType": "document", "request": {"method": "get", "url": "https://x.test/p?a=1&a=2"}, "response": {"status": 200, "content": {"mimeType": "text/html; x", "text": "héllo"}}},
        {"startedDateTime": "2024-01-01T00:00:00.000Z", "request": {"method": "GET", "url": "https://other.test/i.png"}, "response": {"status": 200, "content": {"mimeType": "image/png", "encoding": "base64", "size": 3, "text": "YWJj"}}},
    ]}}
    (tmp_path / "c.har").write_text(json.dumps(doc))
    r = har.read_har(spark, str(tmp_path / "c.har"), hosts=("x.test",)).orderBy("entry").collect()
    assert r[0].capture == "c.har" and r[0].started_at == "2024-01-01T00:00:00.123Z" and r[0].query == {"a": "1"} and r[0].response_size == 6 and r[0].first_party
    assert bytes(r[1].body) == b"abc" and r[1].response_size == 3 and not r[1].first_party and r[1].started_at == "2024-01-01T00:00:00.000Z"

    rows = spark.range(130).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    parts.write_parts(rows, str(tmp_path / "d"), ["k"])
    back = parts.read_parts(spark, str(tmp_path / "d"), "k long, v string")
    assert back.count() == 130 and back.agg(F.max("part")).first()[0] == 2

    event = {"schema_version": "1.0", "event_id": "e", "session_id": "s", "sequence": 0, "observed_at": "t", "monotonic_time": 0.5, "source": "system", "event_type": "x", "confidence": "c"}
    (tmp_path / "e.jsonl").write_text(json.dumps(event) + "\n")
    assert evidence.read_events(spark, str(tmp_path / "e.jsonl")).count() == 1
    (tmp_path / "bad.jsonl").write_text(json.dumps(event | {"sequence": -1}) + "\n")
    with pytest.raises(Exception, match="not a valid event"):
        evidence.read_events(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "blob").write_bytes(b"abc")
    artifacts = evidence.read_artifacts(spark, str(tmp_path / "blob"))
    assert evidence.verified_artifacts(artifacts.select("ref"), artifacts).count() == 1
    with pytest.raises(Exception, match="artifact is missing"):
        evidence.verified_artifacts(spark.createDataFrame([("sha256:0",)], "ref string"), artifacts).count()


def page(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def test_market_pages(spark):
    from tessera.operators import market_pages as M

    link = '<a href="/analitics/retailmarket/?city=3&amp;retailgroup=7">{}</a>'
    city = page([link.format("<img>"), link.format("Food"), "819.94 млн p.", "x", "+79.5%", "13.73%", "173%", '<img title="c">', '<span title="Уровень цен:  67.74%"></span>'], ["total"])
    bad = city.replace("819.94 млн p.", "much")
    rows, problems = M.city_groups(spark.createDataFrame([(1, 3, city), (2, 3, bad), (3, 4, city)], "page_id long, city_id long, html string"))
    assert [tuple(r) for r in rows.collect()] == [(1, 3, 7, "Food", 819940000, 79.5, 13.73, 173.0, 67.74)]
    assert sorted(r.page_id for r in problems.collect()) == [2, 3]
    prices = page(['<a href="/city/?id=5">Town</a><div id="basketPrice[0]">12.5</div><div id="basketQuality[0]">1.5</div>', "", "", "", ""])
    rows, problems = M.group_cities(spark.createDataFrame([(1, 9, prices)], "page_id long, group_id long, html string"))
    assert [tuple(r) for r in rows.collect()] == [(1, 9, 5, "Town", 12.5, 1.5)] and problems.count() == 0
    vendors = page(["<h3>Tools</h3>"], ['<a href="/analitics/vendors/?product=4">a</a>'], ["<h3>Food</h3>"], ['<a href="/analitics/vendors/?product=6">b</a>', '<a href="/analitics/vendors/?product=7">c</a>'])
    rows, _ = M.vendor_products(spark.createDataFrame([(1, vendors)], "page_id long, html string"))
    assert sorted((r.product_id, r.group_name) for r in rows.collect()) == [(4, "Tools"), (6, "Food"), (7, "Food")]
    cells = ['<a href="?product=8">i</a>', '<a href="?product=8">n</a>', "", "1 200 / 300", "", "15 pcs", "1.25 q", "", "", '<input name="price[8]" value="40">', "2.5", "50", "7", "", '<input name="purchaseQuantity[8]" value="3"><input name="vendorPrice[8]" value="">']
    rows, problems = M.goods(spark.createDataFrame([(1, 2, page(cells)), (2, 2, page(cells, cells))], "page_id long, unit_id long, html string"))
    assert [tuple(r)[2:] for r in rows.collect()] == [(8, 1200, 300, 15, 1.25, 40, 2.5, 50, 7, 3, 0)] and [r.page_id for r in problems.collect()] == [2]
    text_ = "Head\nParis\nShop One (12)\n3\nRome\nShop Two (13)\n4"
    rows, problems = M.roster(spark.createDataFrame([(1, text_), (2, text_.replace("\n4", "\nx"))], "page_id long, text string"))
    assert [(r.unit_id, r.city, r.level) for r in rows.orderBy("unit_id").collect()] == [("12", "Paris", 3), ("13", "Rome", 4)] and problems.count() == 1


def test_frames_and_cursor(spark):
    from tessera.functions import cursor
    from tessera.sources import frames

    sent = lambda i, url, **k: json.dumps({"method": "Network.requestWillBeSent", "params": {"requestId": i, "request": {"url": url, "method": "post", "headers": {"Content-Type": "application/json", "Cookie": "c", "X-Ok": "1"}, "postData": '{"b":1,"password":2}'}, "timestamp": 1.5, **k}})
    rows = [(0, sent("r1", "https://x.test/a?q=1&token=2", hasUserGesture=True)), (1, sent("r2", "https://tracker.test/")), (2, sent("r1", "https://x.test/b")), (3, json.dumps({"method": "Network.responseReceived", "params": {"requestId": "r1", "response": {"status": 200}}})), (4, json.dumps({"method": "Page.x", "params": {}}))]
    got = frames.network_events(spark.createDataFrame([("s", *r) for r in rows], "session_id string, sequence long, frame string"), "x.test").orderBy("sequence").collect()
    assert [(r.sequence, r.event_type, r.redirect_index, r.method, r.url_path) for r in got] == [(0, "http.request", 0, "POST", "/a"), (2, "http.request", 1, "POST", "/b"), (3, "http.response", 1, None, None)]
    assert got[0].headers == {"Content-Type": "application/json", "X-Ok": "1"} and got[0].body_keys == ["b"] and [p.key for p in got[0].query] == ["q"] and got[0].has_user_gesture and got[2].body_keys is None
    token = cursor.encode("sessions", "all", "g" * 64, ("a", "b"))
    assert cursor.decode(token, "sessions", "all") == ("g" * 64, ("a", "b"))
    for bad in (token[:-2] + "AA", token.replace("tscur1.", "x"), token + "="):
        with pytest.raises(ValueError):
            cursor.decode(bad, "sessions", "all")
    with pytest.raises(ValueError):
        cursor.decode(token, "changes", "all")


def test_knowledge(spark):
    from tessera.operators import knowledge as K

    got = K.aliases(spark.createDataFrame([("r", 1, "Straße"), ("r", 2, "STRASSE"), ("r", 3, " x  y "), ("r", 4, "")], "ref string, position int, alias string"))
    assert sorted((r.norm, r.alias) for r in got.collect()) == [("strasse", "Straße"), ("x y", " x  y ")]
    base = spark.createDataFrame([("a",), ("b",)], "ref string")
    rich = K.enrich(base, spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x")], "ref string, category string"), "ref")
    assert {r.ref: r.categories for r in rich.collect()} == {"a": ["x", "y"], "b": []}
    with pytest.raises(Exception, match="unknown key"):
        K.enrich(base, spark.createDataFrame([("z", "y")], "ref string, category string"), "ref").count()
    found = spark.createDataFrame([("s", "c2", "R", "k", "/p", "GET"), ("s", "c1", "R", "k", "/p", "GET")], "session_id string, change_id string, rule string, kind string, path string, method string")
    one = K.bundles(found, "p").first()
    doc = json.loads(one.payload)
    assert [f["change_id"] for f in doc["findings"]] == ["c1", "c2"] and doc["bundle_id"] == one.bundle_id
    assert K.bundles(found.orderBy("change_id"), "p").first() == one
