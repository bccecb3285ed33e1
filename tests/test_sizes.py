"""Steps that have to hold for large inputs, on small ones that show the same fault."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F


def test_rows_of_pages_leave_in_pieces(spark, monkeypatch):
    """A page cut anywhere gives the rows of the whole, and few are held at a time."""
    from tessera.functions import tables

    one = '<tr><td><h3>A &amp; B</h3></td></tr><tr><td><a href="/x?a=1&amp;b=2">1 &lt; 2</a><input name="n[3]" value="v"></td><td>x<table><tr><td>in</td></tr></table>y</td></tr>'
    odd = '<table><tr><td><div id="k">left open</td></tr><tr><td>later</td></tr></div><tr><td><script>"<td>"</script>z<!-- <tr> --></td></tr></table>'
    html = ["<table>" + one * 40 + "</table>" + odd, None, "", "no table", odd * 3, "<table><tr><td>unclosed &am"]
    want = [(k, r["table"], r["row"], r["heading"], [(c["text"], c["hrefs"], c["values"]) for c in r["cells"]]) for k, h in enumerate(html) for r in tables.table_rows.func(tables.pd.Series([h]))[0]]
    for piece in (1, 7, 64, 1 << 18):
        monkeypatch.setattr(tables, "PIECE", piece)
        got = [(k, r["table"], r["row"], r["heading"], [(c["text"], c["hrefs"], c["values"]) for c in r["cells"]]) for k, h in enumerate(html) for r in tables._in_pieces(h or "")]
        assert sorted(got, key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])
    monkeypatch.setattr(tables, "PIECE", 64)
    reader, most = tables._in_pieces("<table>" + one * 1000 + "</table>"), 0
    for _ in reader:
        most = max(most, len(reader.gi_frame.f_locals["reader"].rows))
    assert most < 10
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    whole = pages.select("page_id", F.explode(tables.table_rows("html")).alias("r")).select("page_id", "r.*")
    assert sorted(map(str, tables.page_rows(pages).collect())) == sorted(map(str, whole.collect()))


def test_rows_of_one_shape_are_parsed_once(spark, monkeypatch):
    """Of a thousand rows with the same tags the reader sees one, and all rows are as it would give them."""
    from tessera.functions import tables

    one = '<tr class="c{0}"><td>{1} &amp; <b>B</b></td>\n<td title=" t {0}"><a href="?product={0}">{1}</a></td><td></td><td><input name="n[{0}]" value="{1}"><input name="m[{2}]" value=""/></td><td><div id="k{0}"> 4  5 </div></td></tr>'
    odd = [
        one.format(3, "a &l", 4).replace('id="k3"', 'id="k3" id="x"'), one.format(5, "&lt", 5).replace("m[5]", "n[5]"), one.format(6, "y", 6).replace('href="?product=6"', 'href=""'), one.format(7, "z", 7).replace("&amp;", "<!-- <tr> -->"),
        "<tr><td>open", one.format(8, "<table><tr><td>in</td></tr></table>", 9), one.format('1&amp;b="', "q", 1), "<tr><td><script>1</tr></script></td></tr>", "<tr></tr>", "<tr><td colspan='2'>w</td></tr>", "<TR><td>W</td></TR>",
    ]
    same = "".join(one.format(k, f" {k}  x", k + 1) for k in range(1000))
    html = ["<table>" + same + "</table>", "<table>" + "".join(x + one.format(k, "v", 0) for k, x in enumerate(odd * 2)) + "</table>" + one.format(0, 0, 0), None, same, "<table><tr><td>" + "<table>" + same[:3000]]
    seen, start = [], tables._Tables.handle_starttag
    monkeypatch.setattr(tables._Tables, "handle_starttag", lambda self, tag, attrs: seen.append(tag) or start(self, tag, attrs))
    runs = list(tables._in_pieces(html[0], tables._Shapes()))
    assert sum(len(r.values) for r in runs) == 1000 and seen.count("tr") == 1
    monkeypatch.undo()
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    whole = pages.select("page_id", F.explode(tables.table_rows("html")).alias("r")).select("page_id", "r.*")
    want = sorted(map(str, whole.collect()))
    assert sorted(map(str, tables.page_rows(pages).collect())) == want and len(want) > 1000
    monkeypatch.setattr(tables, "SHAPES", 1)
    assert sorted(map(str, tables.page_rows(pages).collect())) == want


def test_goods_pages_are_shuffled_once(spark):
    """Rows are judged and pages too after one shuffle; names that come twice or are null are found as before."""
    from tessera.operators import market_pages

    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "c", 5), (2, "a", 3), (3, None, 1), (3, None, 1), (4, None, 1), (5, "a", 0), (5, "b", 1)], "page_id long, k string, v long")
    good, bad = market_pages._sound(rows, F.col("v") > 0, ["k"])
    assert good._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in good.collect()) == [(1, "a", 1), (1, "b", 2), (4, None, 1)]
    assert sorted(tuple(r) for r in bad.collect()) == [(2, 2), (3, 2), (5, 1)]


def test_inputs_of_many_rows_are_counted(spark, small):
    """Goods pages are gathered as numbers, not as texts of rows; names are counted alike in rows of a shape and in odd ones."""
    import re
    from collections import Counter

    from tessera.functions import probes, tables
    from tessera.plans import captured

    plan = captured._goods_pages(spark, small)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    gathered = [k for k, line in enumerate(plan) if "collect_list" in line]
    assert len(gathered) == 1 and "<td>" not in "".join(plan[gathered[0] + 1 :])
    row = '<tr><td><input name="price[{0}]" value="4"></td><td><input name="a[{0}][{1}]" value=""><input name="b[{1}]"></td></tr>'
    odd = '<tr><td><input name="price[1]"><input name="price[1]"><input name="price[2]" NAME="x"></td><td><input name=bare[3]><div id="d[4]">5</div><input name="">'
    html = ["<table>" + "".join(row.format(k, k % 7) for k in range(500)) + odd + row.format(1, 1) + "</table>", "<table>" + odd * 3 + row.format(2, 2) * 9, None, row.format(1, 2)]
    want = Counter((k, re.sub(r"\[[0-9]+\]", "[n]", name)) for k, h in enumerate(html) for r in tables.table_rows.func(tables.pd.Series([h]))[0] for c in r["cells"] for name in c["values"])
    got = probes.input_inventory(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).collect()
    assert {(r.page_id, r.name): r.n for r in got} == dict(want) and want[0, "a[n][n]"] == 501


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_requests_still_waited_for_have_no_row(spark, sf):
    """At this size a request is still open at the end of the stream."""
    from tessera.plans.catalogue import QUERIES, SQL

    d = f"/root/testdata/{sf}"
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    df = QUERIES["stream_requests"](spark, d)
    cursor = db.execute(SQL["stream_requests"])
    names = [c[0] for c in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == want
    assert len(want) == 2499


def test_requests_of_a_bucket_are_one_value_of_state():
    """Two calls of the state and one timer a batch for 500 requests; all of them are given up by one timer."""
    from types import SimpleNamespace

    from tessera.streaming import ingest

    calls, values, timers = [], [], set()

    class Open:
        def get(self):
            calls.append("get")
            return values[-1] if values else None

        def update(self, v):
            calls.append("update")
            values.append(v)

        def clear(self):
            values.clear()

    follow = ingest._Follow(600_000)
    follow.init(SimpleNamespace(getValueState=lambda *a: Open(), registerTimer=timers.add, deleteTimer=timers.remove))
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    row = lambda k, n, kind: {"session_id": "s", "request_id": str(k), "sequence": n, "at_ms": 1000 + k, "event_type": kind, "method": "GET", "url_path": f"/{k}", "status_code": None, "monotonic_time": float(n or 0)}
    assert list(follow.handleInputRows((0,), iter([row(k, k, "http.request") for k in range(500)]), clock(0))) == []
    assert calls == ["get", "update"] and timers == {601_000}
    ended = list(follow.handleInputRows((0,), iter([row(k, 500 + k, "http.finished") for k in range(100)] + [row(200, 900, "http.request"), row(999, None, "http.request")]), clock(0)))
    assert sorted(int(r.request_id) for r in ended) == list(range(100)) and {r.seconds for r in ended} == {500.0} and calls == ["get", "update"] * 2 and timers == {601_100}
    timers.remove(601_100)  # Spark removes the timer that it calls for
    over = list(follow.handleExpiredTimer((0,), clock(601_300), None))
    assert sorted(int(r.request_id) for r in over) == list(range(100, 301)) and {r.hops for r in over if r.request_id == "200"} == {1} and {r.outcome for r in over} == {"open"}
    assert timers == {601_301} and len(values[-1][0]) == 199


def test_requests_that_share_a_bucket_keep_their_own_time(spark, tmp_path, monkeypatch):
    """One bucket for all: each request is given up when its own last frame is so far behind, to the millisecond."""
    from tessera.streaming import ingest
    from tessera.streaming.state import keyed_state

    monkeypatch.setattr(ingest, "BUCKETS", 1)
    folder, names = tmp_path / "in", ("session_id", "request_id", "sequence", "at", "event_type", "method", "url_path", "status_code", "monotonic_time")
    folder.mkdir()
    schema = "session_id string, request_id string, sequence long, at timestamp, event_type string, method string, url_path string, status_code int, monotonic_time double"
    of = lambda r, n, at, kind="http.request": ("s", r, n, f"2024-01-01T00:{at}Z", kind, "GET", f"/{r}", None, float(n))
    batches = [[of("a", 1, "00:00.000"), of("b", 2, "00:30.000"), of("d", 3, "00:30.001")], [of("z", 4, "11:30.000")], [of("a", 5, "11:35.000", "http.response"), of("z", 6, "11:40.000", "http.finished")], [of("d", 7, "11:41.000", "http.finished"), of("y", 8, "59:00.000")]]
    for k, rows in enumerate(batches):
        (folder / f"{k}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows))
        os.utime(folder / f"{k}.json", (100 * k + 100,) * 2)
    found = ingest.finished_requests(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), late="1 minute", idle=600.0)
    with keyed_state(spark):
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.request_id, r.outcome, r.seconds) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "open", 4.0), ("b", "open", 0.0), ("d", "finished", 4.0), ("z", "finished", 2.0)]


def test_queries_of_the_same_terms_are_ranked_once(spark, monkeypatch):
    """Many queries of one common name, which many records have: the candidates do not multiply."""
    from tessera.operators import search

    records = spark.createDataFrame([(f"r{k:03d}", "blue lamp" if k % 2 else "blue lamp small") for k in range(200)], "ref string, text string")
    texts = ["blue lamp", "Lamp blue", "small lamp blue", "none such", ""]
    asked = spark.createDataFrame([(k, texts[k % 5]) for k in range(300)], "query_id long, text string")
    got = search.rank_postings(asked, search.postings(records), search.lengths(records), limit=3)
    hits = {}
    for r in got.orderBy("query_id", "rank").collect():
        hits.setdefault(r.query_id, []).append((r["rank"], r.ref, r.score))
    alone = {t: [(r["rank"], r.ref, r.score) for r in search.rank_postings(asked.where(F.col("query_id") == k), search.postings(records), search.lengths(records), limit=3).orderBy("rank").collect()] for k, t in enumerate(texts)}
    assert hits == {k: alone[texts[k % 5]] for k in range(300) if alone[texts[k % 5]]} and len(alone["blue lamp"]) == 3
    inner, ranked = search._rank, []
    monkeypatch.setattr(search, "_rank", lambda one, *rest: ranked.append(one) or inner(one, *rest))
    search.rank_postings(asked, search.postings(records), search.lengths(records), limit=3)
    assert ranked[0].select("query_id").distinct().count() == 3


def test_a_session_is_one_value_of_state():
    """Three calls of the state a batch of a session; artifacts beyond the value are counted once each, too."""
    from tessera.streaming import manifests

    calls, values, refs, timers = [], [], set(), set()

    class Place:
        def get(self):
            calls.append("get")
            return values[-1] if values else None

        def update(self, v):
            calls.append("update")
            values.append(v)

        def clear(self):
            values.clear()

    class More:
        containsKey, clear = staticmethod(lambda k: k[0] in refs), staticmethod(refs.clear)
        updateValue = staticmethod(lambda k, v: refs.add(k[0]))

    class Handle:
        getValueState, getMapState = staticmethod(lambda *a: Place()), staticmethod(lambda *a: More())
        registerTimer = staticmethod(lambda t: (calls.append("timer"), timers.add(t)))
        deleteTimer = staticmethod(timers.discard)

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    close = manifests._Close(1000, "failed")
    close.init(Handle())
    event = lambda n, ref: {"sequence": n, "at_ms": 1000 * n, "file": "f", "refs": [ref], "warning": "w", "ended": None}
    assert list(close.handleInputRows(("s",), iter([event(k, f"sha256:{k % 300}") for k in range(600)]), Times())) == []
    assert calls == ["get", "timer", "update"] and len(refs) == 300 - manifests.INLINE
    assert list(close.handleInputRows(("s",), iter([event(599, "sha256:x"), event(600, "sha256:299"), event(601, "sha256:y")]), Times())) == []
    (made,) = close.handleExpiredTimer(("s",), Times(), None)
    assert (made.status, made.event_count, made.artifact_count, made.event_files, made.warnings, made.ended_at) == ("failed", 602, 301, ["f"], ["w"], "1970-01-01T00:10:01.000Z")
    assert not values and not refs and timers == {602_000}


def test_parts_share_files(spark, tmp_path):
    from tessera.sources import parts

    parts.write_parts(spark.range(1000).select(F.col("id").alias("k")), str(tmp_path / "p"), ["k"], size=10)
    assert len(list((tmp_path / "p" / "records").glob("*/*.json"))) == 1
    back = parts.read_parts(spark, str(tmp_path / "p"), "k long")
    assert back.columns == ["k", "row", "part"] and back.where("part = floor(k / 10) AND row = k + 1").count() == 1000


def test_texts_are_parsed_once(spark):
    from tessera.functions import artifacts
    from tessera.operators import projectors

    parsed = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json(")
    texts = spark.createDataFrame([("{}",)], "text string")
    assert parsed(texts.select(artifacts.unit_economics(F.col("text")).alias("a")).select("a.problem", "a.page.rows")) == 1
    plan = projectors.attribute_documents(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_json(") + plan.count("jsontostructs(") == 1


def test_texts_that_are_too_large_stay_out_of_python(spark):
    from tessera.functions import actions

    rows = spark.createDataFrame([("a", 0, "x" * 40_000), ("b", 0, "{"), ("c", 0, '{"schema":1,"kind":"click"}'), ("d", 0, None)], "session_id string, sequence long, payload string")
    assert [r[0] is None for r in rows.orderBy("session_id").select(actions._of_size()).collect()] == [True, False, False, True]
    assert sorted((r.session_id, r.problem) for r in actions.rejected_actions(rows).collect()) == [("a", "too large"), ("b", "no JSON"), ("d", "no payload")]


def test_pages_of_small_files_need_few_tasks(spark, tmp_path):
    from tessera.sources import ordered

    rows = spark.range(2000).select((F.col("id") * 7 % 2000).alias("k"))
    ordered.write_ordered(rows, str(tmp_path / "o"), ["k"], per_file=10)
    files = [f.name for f in (tmp_path / "o" / "rows").glob("*.parquet")]
    index = spark.read.parquet(str(tmp_path / "o" / "index"))
    assert len({f[:10] for f in files}) <= 4 < 200 <= len(files) and index.agg(F.max("rows"), F.sum("rows")).first() == (10, 2000)
    assert [r.k for r in ordered.read_page(spark, str(tmp_path / "o"), ["k"], limit=25, after=(994,)).collect()] == list(range(995, 1020))


def test_a_bucket_is_no_task_of_its_own(spark, tmp_path):
    """Few buckets, or one frequent term: postings are still written by all tasks, and words are counted in their row."""
    from collections import Counter

    from tessera.operators import search
    from tessera.sources.postings import PostingIndex

    texts = ["b a b", "", "one", "z z z", "b a c a b a", None]
    got = [[tuple(c) for c in r[0]] for r in spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1).select(search.term_counts(F.split(F.coalesce("t", F.lit("")), " "))).collect()]
    assert got == [sorted(Counter((t or "").split(" ")).items()) for t in texts]
    assert spark.sql("SELECT cast(array() AS array<string>) AS w").select(search.term_counts(F.col("w"))).first()[0] == []
    index = PostingIndex(spark, str(tmp_path / "i"), buckets=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.update(spark.range(400).select(F.concat(F.lit("r"), "id").alias("ref"), F.lit("common common").alias("text")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (folder,) = index.files(index.at(), "postings")
    rows = [spark.read.parquet(str(f)).count() for f in tmp_path.joinpath("i", *folder.rsplit("/", 3)[1:]).glob("*.parquet")]
    assert len(rows) >= 3 and sum(rows) == 400 and max(rows) <= 200
    assert index.postings(spark.createDataFrame([("common",)], "term string")).where("tf = 2 AND length = 2").count() == 400


def test_tables_are_digested_without_texts(spark):
    """No JSON is made of plain values, and any change of a value, a null or a number of rows shows."""
    from tessera.functions import canonical
    from tessera.sources import generations

    schema = "a string, b double, c array<int>, d map<string,int>, e struct<x: int, y: string>, f long"
    rows = [("x", 1.0, [1], {"k": 1}, (1, "y"), 1), ("", None, [], {}, None, None), (None, 0.0, None, None, (None, ""), 42)]
    digest = lambda rows: generations.table_digests({"t": spark.createDataFrame(rows, schema)})["t"]
    was = digest(rows)
    assert was == digest(rows[::-1]) and was["rows"] == 3 and was["columns"] == ["a", "b", "c", "d", "e", "f"]
    changed = [(0, 0, "null"), (0, 0, None), (0, 0, ""), (0, 1, 0.0), (0, 1, None), (2, 1, -0.0), (0, 2, None), (0, 2, [1, None]), (0, 2, [None, 1]), (0, 3, {"k": None}), (0, 4, (None, "y")), (1, 4, (None, None)), (1, 5, 42), (2, 5, None), (1, 2, None)]
    others = [[*rows[:r], (*rows[r][:c], v, *rows[r][c + 1 :]), *rows[r + 1 :]] for r, c, v in changed]
    assert len({was["fingerprint"], digest([*rows, rows[0]])["fingerprint"], *(digest(other)["fingerprint"] for other in others)}) == 2 + len(changed)
    assert generations.table_digests({"t": spark.createDataFrame([], schema)})["t"]["rows"] == 0
    plain = spark.createDataFrame(rows, schema).select("a", "b", "f", F.col("b").alias("o.d"))
    plan = canonical.values_fingerprint(plain)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "json" not in plan and "xxhash64(" in plan


def test_records_are_not_sent_to_every_task(spark, tmp_path):
    """Tables with a row a record meet by their keys, also where their files are small; records are made once."""
    from tessera import api
    from tessera.operators import projectors

    products = spark.createDataFrame([("1", "a lamp", ["A LAMP", "Light"], ["c"], ["e1", "e2"]), ("2", "b", None, None, None)], "key string, name string, names array<string>, categories array<string>, evidence array<string>")
    attributes = spark.createDataFrame([("1", ["heavy"])], "key string, terms array<string>")
    made = projectors.union_records(projectors.product_records(products, attributes), projectors.wiki_records(spark.createDataFrame([("t", "text", ["z"], ["e3"])], "topic string, text string, related_topics array<string>, evidence array<string>")))
    plans = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plans(made) and "SortMergeJoin" in plans(made)
    evaluated = spark.sparkContext.accumulator(0)
    counted = made.rdd.map(lambda r: evaluated.add(1) or r)
    rows = spark.createDataFrame(counted, made.schema)
    w = api.Workspace(spark, str(tmp_path))
    each = lambda c, name: made.select("ref", F.posexplode(c).alias("position", name))
    w.rebuild_index("1", rows.select("ref", "kind", "title", "body"), each("aliases", "alias"), each("evidence", "evidence_ref"))
    assert evaluated.value == 3  # once a record
    assert "Broadcast" not in plans(w._texts("1")) and w.index_problems("1").isEmpty()
    texts = {r.ref: set(r.text.split()) for r in w.table("1", "texts").collect()}
    assert texts == {"product:1": {"a", "lamp", "A", "LAMP", "Light", "c", "heavy"}, "product:2": {"b"}, "wiki:t": {"t", "z", "text"}}
    got = w.get("1", "product:1").select("aliases", "evidence").first()
    assert sorted(got.aliases) == ["A LAMP", "Light"] and list(got.evidence) == ["e1", "e2"]
