"""Recorded evidence: schemas, contexts, the matcher by sequence, generations, transactions, verified files, manifests."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import matching
from tessera.functions.schema import SchemaError, compile_schema
from tessera.operators import asof, contexts, correlate
from tessera.sources import atomic, evidence
from tessera.sources.generations import Generations
from tessera.streaming.changes import ChangeHistory


# Schemas


def test_schema_violations(spark):
    schema = {
        "type": "object", "required": ["a", "b"], "additionalProperties": False,
        "properties": {
            "a": {"type": "string", "minLength": 2, "pattern": "^x"}, "b": {"type": ["integer", "null"], "minimum": 3}, "c": {"type": "array", "items": {"type": "string"}, "uniqueItems": True, "maxItems": 2},
            "d": {"enum": ["q", None, 3, True]}, "e": {"format": "date-time", "type": "string"}, "f": {"$ref": "#/$defs/z"}, "g": {"propertyNames": {"maxLength": 1}, "additionalProperties": {"type": "boolean"}, "minProperties": 1},
        },
        "$defs": {"z": {"oneOf": [{"type": "string"}, {"type": "integer", "maximum": 5}]}}, "if": {"properties": {"a": {"const": "xx"}}}, "then": {"required": ["c"]}, "else": {"required": ["d"]},
    }
    cases = {
        '{"a":"xx","b":3,"c":["p","p","q"],"d":"q"}': ["$.c uniqueItems", "$.c maxItems"],
        '{"a":1,"b":2.5,"z":1}': ["$.z additionalProperties", "$.a type", "$.b type", "$.b minimum", "$.d required"],
        '{"a":"xy","b":null,"d":null,"e":"2024-02-30T00:00:00Z","f":7}': ["$.e format", "$.f oneOf"],
        '{"a":"xx","b":4.0,"c":[1],"d":true,"f":"s","e":"2024-02-29T10:00:00.5+01:00"}': ["$.c[0] type"],
        '{"a":"xx","b":5,"c":[],"d":3,"g":{"k":true,"long":1}}': ["$.g.long maxLength", "$.g.long type"],
        '{"a":"xx","b":5,"c":[],"g":{}}': ["$.g minProperties"],
        "[1]": ["$ type"], "null": ["$ type"], "{": ["$ json"], None: ["$ json"], '{"a":"xx","a":"xx","b":3}': ["$ json"],
    }
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string")
    for r in rows.select("t", compile_schema(schema)(F.col("t")).alias("v")).collect():
        assert sorted(f"{x.path} {x.rule}" for x in r.v) == sorted(cases[r.t]), r.t
    for bad in ({"patternProperties": {}}, {"properties": {"a": {"contains": {}}}}, {"$ref": "other.json"}, {"$ref": "#"}, {"format": "ipv4"}, {"enum": [[1]]}):
        with pytest.raises(SchemaError):
            compile_schema(bad)
    assert "BatchEvalPython" not in rows.select(compile_schema(schema)(F.col("t")))._jdf.queryExecution().toString()


# As-of and contexts


def test_last_known_over_partitions(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), k, rng.choice([None, None, None, k])) for k in range(400)] + [("hot", k, 7 if k == 3 else None) for k in range(600)]
    rows = spark.createDataFrame(data, "key string, at int, v int").repartition(7)
    want, known = {}, {}
    for key, at, v in sorted(data, key=lambda r: (str(r[0]), r[1])):
        known[key] = v if v is not None else known.get(key)
        want[key, at] = known[key]
    got = {(r.key, r.at): r.known for r in asof.last_known(rows, ["key"], ["at"], F.col("v"), "known").collect()}
    assert got == want


def test_contexts(spark):
    frames = [
        ("s", 1, contexts.CREATED, 1, "f1", "w", "o1"), ("s", 2, contexts.CALLED, 1, None, None, None), ("s", 3, contexts.CREATED, 1, "f2", "w", "o2"), ("s", 4, contexts.CALLED, 1, None, None, None),
        ("s", 5, contexts.DESTROYED, 1, None, None, None), ("s", 6, contexts.CALLED, 1, None, None, None), ("s", 7, contexts.CREATED, 2, "f3", "w", "o3"), ("s", 8, contexts.CLEARED, None, None, None, None),
        ("s", 9, contexts.CALLED, 2, None, None, None), ("t", 10, contexts.CALLED, 1, None, None, None), ("s", 11, contexts.CREATED, 2, "f4", "w", "o4"), ("s", 12, contexts.CALLED, 2, None, None, None),
        (None, 13, contexts.CALLED, 2, None, None, None), ("s", 14, contexts.CALLED, None, None, None, None),
    ]
    rows = spark.createDataFrame(frames, "session_id string, sequence long, method string, context_id long, frame_id string, world string, origin string")
    got = {r.sequence: r.context and r.context.frame_id for r in contexts.known_contexts(rows).where(F.col("method") == contexts.CALLED).collect()}
    assert got == {2: "f1", 4: "f2", 6: None, 9: None, 10: None, 12: "f4", 13: None, 14: None}


# The matcher


def plain_links(events, t):
    """The rule restated without queues by target: every event looks at the whole of what is kept."""
    actions, waiting, last, newest, out = [], [], -1, float("-inf"), []
    for e in events:
        if e["sequence"] <= last:
            continue
        last, newest = e["sequence"], max(newest, e["time"])
        for q in (actions, waiting):
            while q and q[0]["time"] < newest - t.window:
                q.pop(0)
        q = actions if e["is_action"] else waiting
        if all(x["event_id"] != e["event_id"] for x in q):
            q.append(e)
            del q[: -matching.KEPT]
        for r in list(waiting) if e["is_action"] else [e]:
            found = [(total, -gap, a["event_id"], status) for a in actions for total, status, gap in [matching.score(a, r, t)] if status]
            if found and (not e["is_action"] or max(found)[2] == e["event_id"]):
                total, gap, action, status = max(found)
                waiting[:] = [w for w in waiting if w["event_id"] != r["event_id"]]
                out.append((action, r["event_id"], status, round(total, 4), round(-gap * 1000, 3)))
    return out


def session(rng, name, n, *, disorder):
    rows, time = [], 0.0
    for k in range(n):
        time = max(0.0, time + rng.uniform(-0.6 if disorder else 0, 0.8))
        action = rng.random() < 0.4
        sequence = k - rng.randrange(3) if disorder and rng.random() < 0.1 else k
        event_id = f"{name}{k - 1 if disorder and k and rng.random() < 0.05 else k}"
        rows.append((name, max(0, sequence), event_id, round(time, 3), action, rng.choice(["t1", "t2", ""]), rng.choice(["f1", "f2", "", None]), rng.choice(["/a", "/b", None]), rng.choice(["GET", "post", None]), rng.choice(["submit", "click"]), rng.random() < 0.5, rng.random() < 0.5))
    return rows


EVENT = "session_id string, sequence long, event_id string, time double, is_action boolean, target string, frame string, path string, method string, kind string, trusted boolean, gesture boolean"


def test_matcher_by_sequence(spark):
    rng, t = random.Random(5), matching.Timing()
    data = [r for k in range(30) for r in session(rng, f"s{k}-", 60, disorder=k % 2 == 1)]
    # More waiting requests in a window than are kept, and then an action that they all fit.
    data += [("big", k, f"r{k:05d}", 1.0, False, "t", "f", "/a", "GET", None, None, True) for k in range(matching.KEPT + 50)] + [("big", 99999, "a", 1.1, True, "t", "f", "/a", "GET", "click", True, None)]
    names = [c.split()[0] for c in EVENT.split(", ")]
    sessions = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        sessions.setdefault(r[0], []).append(dict(zip(names, r)))
    want = sorted((s, *link) for s, events in sessions.items() for link in plain_links(events, t))
    got = sorted(tuple(r) for r in correlate.correlate_sequenced(spark.createDataFrame(data, EVENT).repartition(5), t).collect())
    assert got == want and sum(g[0] == "big" for g in got) == matching.KEPT


# Generations


def test_generations_are_whole(spark, tmp_path):
    g = Generations(spark, str(tmp_path))
    one = spark.range(50).selectExpr("id", "id * 0.5 AS v")
    assert g.current() is None
    g.publish("1", {"a": one, "b": one.limit(3)})
    assert g.current() == "1" and g.load()["a"].count() == 50 and g.problems() == []
    g.write("2", {"a": one.limit(10)})  # killed here: nothing of it is seen
    assert g.current() == "1" and g.load()["a"].count() == 50
    with pytest.raises(ValueError, match="not sealed"):
        g.load("2")
    g.write("2", {"a": one.limit(20)})
    g.seal("2", ["a"], taken={"b": "1"})
    assert g.current() == "2" and g.load()["a"].count() == 20 and g.load()["b"].count() == 3 and g.load("1")["a"].count() == 50
    with pytest.raises(FileExistsError):
        g.write("2", {"a": one})
    one.selectExpr("id", "CASE WHEN id = 7 THEN 0.0 ELSE v END AS v").limit(20).write.mode("overwrite").parquet(f"{tmp_path}/generation=2/a")
    assert g.problems() == ["a"]
    with pytest.raises(ValueError, match="manifest"):
        g.load()
    with pytest.raises(FileExistsError):
        atomic.write_new(spark, f"{tmp_path}/generation=2/_manifest.json", "{}")


# Change history


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "change_id string, session_id string, started_at string, evidence_sha256 string")


def test_batches_are_transactions(spark, tmp_path, monkeypatch):
    h = ChangeHistory(spark, str(tmp_path / "h"), buckets=16)
    h.apply(batch(spark, *[(f"c{k}", f"s{k % 5}", f"t{k % 5}", f"e{k % 5}") for k in range(60)]), 0)
    before = h.commit(0)
    assert h.latest().count() == 60 and h.outbox().count() == 5 and {r.state for r in h.outbox().collect()} == {"pending"}

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # everything is written but the commit
        m.setattr(atomic, "write_new", killed)
        with pytest.raises(KeyboardInterrupt):
            h.apply(batch(spark, ("c1", "s9", "t9", "e9")), 1)
    assert h.version() == 0 and h.latest().where("occurrences > 1").count() == 0 and h.processed().count() == 5
    h.apply(batch(spark, ("c1", "s9", "t9", "e9"), ("new", "s9", "t9", "e9")), 1)
    after = h.commit(1)
    moved = {name: [b for b in after["files"][name] if after["files"][name][b] != before["files"][name].get(b)] for name in after["files"]}
    assert len(moved["changes"]) <= 2 and len(moved["processed"]) == 1 and len(moved["outbox"]) == 1  # only what the batch touches
    assert [(r.last_seen, r.occurrences) for r in h.get("c1").collect()] == [("t9", 2)] and h.get("c1", version=0).first().occurrences == 1
    h.apply(batch(spark, ("c1", "s9", "t9", "e9"), ("new", "s9", "t9", "e9")), 1)
    h.apply(batch(spark, ("c1", "s9", "t9", "e9")), 2)
    assert h.get("c1").first().occurrences == 2 and h.outbox().count() == 6 and h.problems().count() == 0
    payload = json.loads(h.outbox().where("session_id = 's9'").first().payload)
    assert [f["change_id"] for f in payload["findings"]] == ["new"]
    out = str(tmp_path / "out")
    with monkeypatch.context() as m:  # bundles are written, their commit is not
        m.setattr(atomic, "write_new", killed)
        with pytest.raises(KeyboardInterrupt):
            h.deliver(out, 3)
    assert h.outbox().where("state = 'pending'").count() == 6
    assert h.deliver(out, 3) == 0 and h.outbox().where("state = 'pending'").count() == 0 and spark.read.parquet(out).count() == 6
    with pytest.raises(ValueError, match="not after"):
        h.base(3)
    with pytest.raises(ValueError, match="not committed"):
        h.latest(77)


# Files


def test_files_that_change_later_fail_the_job(spark, tmp_path):
    event = {"schema_version": "1.0", "event_id": "e0", "session_id": "s", "sequence": 0, "observed_at": "t", "monotonic_time": 0.5, "source": "system", "event_type": "x", "confidence": "c"}
    at = tmp_path / "a.jsonl"
    at.write_text(json.dumps(event) + "\n\n" + json.dumps(event | {"event_id": "e1", "sequence": 1}) + "\n")
    evidence.snapshot_identity(spark, str(at)).write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))
    rows = evidence.verified_events(spark, str(at), expected=known)
    assert rows.count() == 2
    at.write_text(at.read_text().replace('"c"', '"d"'))  # after the look, before the next use
    with pytest.raises(Exception, match="not those expected"):
        rows.collect()
    (tmp_path / "b.jsonl").write_text("{}")
    with pytest.raises(ValueError, match="not those expected"):
        evidence.verified_lines(spark, str(at), str(tmp_path / "b.jsonl"), expected=known)


# Pages and the index in files


def test_pages_read_few_files(spark, tmp_path):
    from tessera.sources import ordered

    rng = random.Random(9)
    keys = ["a", "b"]
    rows = sorted({(rng.choice("xyz"), rng.randrange(3000)) for _ in range(2500)})
    at = str(tmp_path / "t")
    ordered.write_ordered(spark.createDataFrame([(*r, f"v{r[1]}") for r in rows], "a string, b long, v string").repartition(6), at, keys, per_file=200)
    assert spark.read.parquet(f"{at}/index").count() >= 10
    for prefix in ((), ("y",), ("none",)):
        want, seen, after = [r for r in rows if r[: len(prefix)] == prefix], [], None
        while True:
            assert len(ordered.page_files(spark, at, keys, limit=150, after=after, prefix=prefix)) <= 3
            page = ordered.read_page(spark, at, keys, limit=150, after=after, prefix=prefix).orderBy(*keys).collect()
            seen += [(r.a, r.b) for r in page]
            if not page or not page[-1].has_more:
                break
            after = seen[-1]
        assert seen == want
    assert [r.v for r in ordered.read_key(spark, at, keys, rows[700]).collect()] == [f"v{rows[700][1]}"] and ordered.read_key(spark, at, keys, ("x", -1)).count() == 0
    ordered.write_ordered(spark.createDataFrame([], "a string, b long, v string"), at, keys)
    assert ordered.read_page(spark, at, keys, limit=5).count() == 0


def test_index_follows_what_changed(spark, tmp_path):
    from tessera.operators import search
    from tessera.sources.postings import PostingIndex

    index = PostingIndex(spark, str(tmp_path / "i"), buckets=32)
    table = lambda rows: spark.createDataFrame(list(rows.items()), "ref string, text string")
    rows = {f"r{k:02d}": " ".join(f"w{j}" for j in range(k % 7, k % 7 + 5)) + f" own{k}" for k in range(40)} | {"empty": "", "null": None}
    asked = spark.createDataFrame([(1, "w3"), (2, "w1 w2"), (3, "own7 w4"), (4, "fresh"), (5, "nothing")], "query_id long, text string")
    same = lambda: sorted(map(tuple, index.search(asked, limit=50).collect())) == sorted(map(tuple, search.bm25(asked, table(rows), limit=50).collect()))
    assert index.update(table(rows)) == 0 and same()
    before = index.files(index.at(), "postings")
    assert index.update(table(rows)) == 0 and index.version() == 0  # nothing changed, nothing is written
    rows |= {"r07": "fresh words w3", "new": "fresh w4"}
    del rows["r08"]
    assert index.update(table(rows)) == 1 and same()
    after = index.files(index.at(), "postings")
    assert set(before) < set(after) and len(after) - len(before) <= 4  # the buckets of the new words, none of the old files
    one = spark.createDataFrame([("fresh",)], "term string")
    read = index.postings(one).inputFiles()
    assert 0 < len([f for f in read if "/postings/" in f]) <= 4 < len(after)
    assert index.compact() == 2 and same() and index.at()["facts"]["superseded"] == 0 and index.compact() == 2
    assert sorted(r.ref for r in index.search(asked, version=0, limit=50).where("query_id = 3").collect()) == ["r07"]
    with pytest.raises(ValueError, match="more than once"):
        index.update(table(rows).union(table(rows)))


def test_current_state_is_loaded_whole(spark, tmp_path):
    from tessera import api

    w = api.Workspace(spark, str(tmp_path))
    units = spark.createDataFrame([(1,), (2,)], "unit_id long")
    rows = spark.createDataFrame([(1, 10, 1, 5), (1, 10, 2, 6), (2, 11, 1, 7), (9, 12, 1, 8)], "unit_id long, product_id long, observed_at long, stock long")
    surfaces = spark.createDataFrame([(1, 1, "ready")], "unit_id long, observed_at long, status string")
    w.rebuild_current("1", rows, units, surfaces, keys=["unit_id", "product_id"], order=["observed_at"])
    t = w.load_current(["unit_id", "product_id"])
    assert w.generations.current() == "1" and sorted((r.unit_id, r.stock) for r in t["products"].collect()) == [(1, 6), (2, 7)] and t["orphans"].count() == 1
    broken = {n: df for n, df in t.items() if n != "units"} | {"units": units.where("unit_id = 1")}
    w.generations.publish("2", broken)
    with pytest.raises(ValueError, match="not sound"):
        w.load_current(["unit_id", "product_id"])
    w.generations.show("1")
    assert w.load_current(["unit_id", "product_id"])["units"].count() == 2


def test_session_manifests_close_once(spark, tmp_path):
    from tessera.sources import evidence as E
    from tessera.streaming.manifests import MANIFEST, write_manifests

    folder = tmp_path / "in"
    folder.mkdir()
    schema = "session_id string, sequence long, at timestamp, file string, refs array<string>, warning string, ended string"

    def write(name, rows):
        (folder / name).write_text("".join(json.dumps(dict(zip(("session_id", "sequence", "at", "file", "refs", "warning", "ended"), r))) + "\n" for r in rows))

    def run():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        write_manifests(events, str(tmp_path / "out"), str(tmp_path / "c"), late="1 minute", idle=600.0).awaitTermination()
        return {r.session_id: r for r in spark.read.schema(MANIFEST).json(str(tmp_path / "out")).collect()}

    write("1.json", [("s", 1, "2024-01-01T00:00:01Z", "a", ["sha256:x", "sha256:x", "other"], "w", None), ("s", 0, "2024-01-01T00:00:00Z", "a", None, None, None), ("t", 0, "2024-01-01T00:00:05Z", "a", None, None, None)])
    assert run() == {}  # both are open
    write("2.json", [("s", 2, "2024-01-01T00:05:00Z", "b", ["sha256:y", "sha256:x"], "w", "cancelled"), ("s", 3, "2024-01-01T00:05:01Z", "c", ["sha256:z"], "late", None), ("t", 0, "2024-01-01T00:05:02Z", "z", None, None, None)])
    found = run()
    s = found["s"]
    assert set(found) == {"s"} and (s.status, s.event_files, s.artifact_count, s.event_count, s.warnings) == ("cancelled", ["a", "b"], 2, 3, ["w"]) and (s.started_at, s.ended_at) == ("2024-01-01T00:00:00.000Z", "2024-01-01T00:05:00.000Z")
    write("3.json", [("u", 0, "2024-01-01T03:00:00Z", "a", None, None, None)])
    found = run()
    assert set(found) == {"s", "t"} and (found["t"].status, found["t"].event_count) == ("failed", 1)
    assert run() == found
    manifests = spark.createDataFrame([(r.session_id, r.event_files, r.event_count, r.status) for r in found.values()], "session_id string, event_files array<string>, event_count long, status string")
    events = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", "a"), ("v", "a")], "session_id string, file string")
    assert [tuple(r) for r in E.manifest_problems(manifests, events).collect()] == [("v", "no manifest")]


# Relations, attributes, markup


def test_links_stay_in_their_session(spark):
    from tessera.operators import detect

    links = spark.createDataFrame([("s", "a", "r", "strong"), ("t", "a", "r", "strong")], "session_id string, action_event_id string, network_event_id string, status string")
    a = spark.createDataFrame([("s", "a", "/p"), ("u", "a", "/other")], "session_id string, event_id string, path string")
    r = spark.createDataFrame([("s", "r", "/q", "POST"), ("t", "r", "/q", "POST")], "session_id string, event_id string, path string, method string")
    assert sorted((x.session_id, x.action_path, x.problem) for x in detect.linked_requests(links, a, r).collect()) == [("s", "/p", None), ("t", None, "unknown action")]


def test_attributes_that_are_not_sound_fail(spark):
    from tessera.operators import projectors

    good = {"product_id": "p", "confidence": "documented", "storage": "dry", "evidence": ["e", "e"], "awards": [{"label": "l", "value": "v"}], "recipe": {"output_name": "o", "materials": [{"slug": "s", "name": "v"}]}}
    read = lambda *docs: projectors.attribute_documents(spark.createDataFrame([(json.dumps(d),) for d in docs], "text string")).collect()
    assert [tuple(r) for r in read(good)] == [("p", ["dry", "l", "v", "o", "s"], ["e"])]
    bad = [{"confidence": "guessed"}, {"product_id": None}, {"evidence": []}, {"storage": " "}, {"awards": [{"label": "l"}]}, {"recipe": "text"}]
    for change in bad:
        with pytest.raises(Exception):
            read(good | change)
    with pytest.raises(Exception, match="not unique"):
        read(good, good | {"storage": "cold"})


def test_ambiguous_attributes_say_nothing(spark):
    from tessera.functions.tables import table_rows

    html = (
        '<table><tr><td><a href="/1" title="t">one</a><input name="n" value="1"></td><td><a href="/2" HREF="/3">two<b title="in">x</b></a><a href="/4">after</a></td></tr></table>'
        '<table id="a" ID="b"><tr><td colspan="2"><a href="/5">five</a></td></tr></table><table><tr><td><img src="a" src="b"><a href="/6">six</a></td></tr></table>'
    )
    rows = spark.createDataFrame([(html,)], "h string").select(table_rows("h").alias("r")).first().r
    got = [[(c.text, c.colspan, c.hrefs, c.titles) for c in r.cells] for r in rows]
    assert got == [[("one", 1, ["/1"], ["t"]), ("twoxafter", 1, ["/4"], [])], [("five", 1, [], [])], [("six", 1, ["/6"], [])]] and rows[0].cells[0]["values"] == {"n": "1"}


# Paths and experiments


def test_templates_meet_by_their_first_literal(spark):
    from tessera.operators import paths

    known = ["/a/{x}", "/{x}/b", "/{x}/{y}/c", "/{x}/{y}/{z}", "/a", "/{x}/{y}/{z}/d", "/a/{y}/c", "a/{x}", "/"]
    asked = {"/a/1": ("/a/{x}", "template"), "/1/b": ("/{x}/b", "template"), "/a/b": (None, "ambiguous"), "/1/2/c": ("/{x}/{y}/c", "template"), "/a/2/c": ("/a/{y}/c", "template"), "/1/2/3": ("/{x}/{y}/{z}", "template"), "/1/2/3/d": ("/{x}/{y}/{z}/d", "template"), "/1/2/3/4": (None, "unknown"), "/a": ("/a", "exact"), "a/1": ("a/{x}", "template"), "/": ("/", "exact"), "": (None, "unknown"), "/a/{x}": ("/a/{x}", "exact")}
    got = paths.match(spark.createDataFrame([(p,) for p in asked], "path string"), spark.createDataFrame([(p,) for p in known], "pattern string"))
    assert {r.path: (r.pattern, r.status) for r in got.collect()} == asked


def test_experiments_need_their_rows_and_sound_controls(spark):
    from tessera.operators import experiments

    side = lambda a, b: spark.createDataFrame([(1, a), (2, b)], "product long, price long")
    rows = experiments.deltas(side(1, 5), side(2, 5), ["product"], ["price"])
    asked = lambda *r: spark.createDataFrame(list(r), "experiment_id string, product long, field string, changed_field string, expected string")
    control = lambda *r: spark.createDataFrame(list(r), "experiment_id string, changed_field string, before_value double, after_value double")
    found = experiments.evaluate(rows, asked(("up", 1, "price", "ad", "increase"), ("same", 2, "price", "ad", "change"), ("both", 1, "price", "ad", "increase")), control(("both", "ad", 1.0, 1.0), ("up", "other", 1.0, 1.0)), ["product"])
    assert sorted((r.experiment_id, r.outcome, r.control_unchanged) for r in found.collect()) == [("both", "inconclusive", True), ("same", "refuted", None), ("up", "confirmed", True)]
    with pytest.raises(Exception, match="no row"):
        experiments.evaluate(rows, asked(("x", 9, "price", "ad", "change")), control(), ["product"]).collect()
    with pytest.raises(Exception, match="control differ"):
        experiments.evaluate(rows, asked(("x", 1, "price", "ad", "change")), control(("x", "ad", 1.0, 2.0)), ["product"]).collect()


def test_requests_that_end_and_that_do_not(spark, tmp_path):
    from tessera.streaming.ingest import finished_requests
    from tessera.streaming.state import keyed_state

    folder = tmp_path / "in"
    folder.mkdir()
    names = ("session_id", "request_id", "sequence", "at", "event_type", "method", "url_path", "status_code", "monotonic_time")
    schema = "session_id string, request_id string, sequence long, at timestamp, event_type string, method string, url_path string, status_code int, monotonic_time double"

    def write(name, rows):
        (folder / name).write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows))
        os.utime(folder / name, (int(name[0]) * 100, int(name[0]) * 100))  # the order in which the stream takes them

    write("1.json", [("s", "a", 2, "2024-01-01T00:00:02Z", "http.response", None, None, 302, 2.0), ("s", "a", 1, "2024-01-01T00:00:01Z", "http.request", "GET", "/a", None, 1.0), ("s", "b", 3, "2024-01-01T00:00:03Z", "http.request", "POST", "/b", None, 3.0), ("s", "c", 4, "2024-01-01T00:00:04Z", "http.finished", None, None, None, 4.0)])
    write("2.json", [("s", "a", 5, "2024-01-01T00:01:00Z", "http.request", "GET", "/a2", None, 5.0), ("s", "a", 6, "2024-01-01T00:01:01Z", "http.response", None, None, 200, 6.0), ("s", "a", 7, "2024-01-01T00:01:02Z", "http.failed", None, None, None, 8.0)])
    write("3.json", [("s", "d", 8, "2024-01-01T09:00:00Z", "http.request", "GET", "/d", None, 9.0)])
    found = finished_requests(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), late="1 minute", idle=600.0)
    with keyed_state(spark):
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r)[1:] for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "GET", "/a2", 200, 1, "failed", 7.0), ("b", "POST", "/b", None, 0, "open", 0.0)]


def test_matcher_over_batches(spark, tmp_path):
    """Events that come in many batches give the links of the whole, whatever the clocks say."""
    from tessera.streaming.matcher import match_stream
    from tessera.streaming.state import keyed_state

    rng, t = random.Random(6), matching.Timing()
    data = [r for k in range(6) for r in session(rng, f"s{k}-", 60, disorder=k % 2 == 1)]
    names = [c.split()[0] for c in EVENT.split(", ")]
    folder, whole = tmp_path / "in", {}
    folder.mkdir()
    for part in range(4):
        rows = [dict(zip(names, r)) for r in data if r[1] // 15 == part]
        for r in sorted(rows, key=lambda r: (r["session_id"], r["sequence"], r["event_id"])):
            whole.setdefault(r["session_id"], []).append(r)
        (folder / f"{part}.json").write_text("".join(json.dumps(r | {"at": f"2024-01-01T00:0{part}:00Z"}) + "\n" for r in rows))
        os.utime(folder / f"{part}.json", (part * 100 + 100, part * 100 + 100))
    events = spark.readStream.schema(EVENT + ", at timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    found = match_stream(events, t, idle=600.0)
    with keyed_state(spark):
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = sorted((s, *link) for s, rows in whole.items() for link in plain_links(rows, t))
    assert sorted(tuple(r) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()) == want and len(want) > 30
