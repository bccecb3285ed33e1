"""Projectors, contracts, artifacts and probes."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import artifacts, probes
from tessera.functions.pages import page_links
from tessera.operators import contract, projectors


def test_projectors(spark):
    e = spark.createDataFrame([("/a", ["GET"], ["q"], ["x#entry-1", "x#entry-1"])], "path_pattern string, methods array<string>, query_keys array<string>, evidence array<string>")
    w = spark.createDataFrame([("T", "text", ["Other"], None)], "topic string, text string, related_topics array<string>, evidence array<string>")
    p = spark.createDataFrame([("1", "Lamp", ["Light"], ["home"], [])], "key string, name string, names array<string>, categories array<string>, evidence array<string>")
    t = spark.createDataFrame([("1", ["glass", "wire"])], "key string, terms array<string>")
    o = spark.createDataFrame([("/a", "POST", ["q"], None, [])], "path string, method string, query_keys array<string>, body_keys array<string>, evidence array<string>")
    f = spark.createDataFrame([("POST", "/a", ["n"], [])], "method string, action string, fields array<string>, evidence array<string>")
    a = spark.createDataFrame([("unit.save", "Save", "POST", "/a", ["n"], [])], "action_id string, title string, method string, path string, fields array<string>, evidence array<string>")
    parts = [projectors.endpoint_records(e), projectors.wiki_records(w), projectors.product_records(p, t), projectors.operation_records(o), projectors.form_records(f), projectors.action_records(a)]
    got = {r.kind: r for r in projectors.union_records(*parts).collect()}
    assert got["endpoint"].evidence == ["x#entry-1"] and got["endpoint"].body == "GET\nquery: q" and got["product"].body == "home\nglass wire" and got["wiki"].aliases == ["Other"]
    assert got["operation"].ref.startswith("ts.operation.v1.") and len(got["form"].ref) == len("ts.form.v1.") + 24
    with pytest.raises(Exception, match="ref is not unique"):
        projectors.union_records(parts[0], parts[0]).collect()
    with pytest.raises(Exception, match="attributes are not unique"):
        projectors.product_records(p, t.union(t)).collect()


def test_contract(spark):
    templates = spark.createDataFrame([("/u/{id}/save",)], "pattern string")
    rows = spark.createDataFrame([("/u/1/save", "post", ["id", "id"], ["price[3]", "csrf"]), ("/u/2/save", "POST", ["id"], ["price[9]"]), ("/x", "POST", [], None)], "path string, method string, query_keys array<string>, body_keys array<string>")
    got = {(r.path, r.method, tuple(r.query_keys), tuple(r.body_keys) if r.body_keys is not None else None): r.posts for r in contract.operation_signatures(rows, templates).collect()}
    assert got == {("/u/{id}/save", "POST", ("id",), ("price[n]",)): 2, ("/x", "POST", (), None): 1}
    with pytest.raises(Exception, match="path of no endpoint"):
        contract.resolve(rows, templates, required=True).collect()
    variants = spark.createDataFrame([("/u/{id}/save", "POST", ["id"], 200)], "path string, method string, query_keys array<string>, status int")
    assert contract.merge_endpoints(variants, contract.operation_signatures(rows, templates)).count() == 2
    one, two = contract.profile({"v": rows}, {"n": 1}), contract.profile({"v": rows.repartition(3)}, {"n": 1})
    assert one == two != contract.profile({"v": rows}, {"n": 2})


def test_artifacts(spark):
    row = {"city_price": 1, "city_quality": 1.0, "our_price": 2, "product_numeric_id": 3, "profit": 4, "revenue": 5, "sales_volume": 6, "stock_qty": 7, "stock_quality": 0.5, "supply_cost": 8, "supply_qty": 9}
    page = {"contract_version": 1, "coverage": "observed", "rows": [row], "schema": "unit-economics/v1", "unit_id": "7"}
    dump = lambda p: json.dumps(p, sort_keys=True, separators=(",", ":"))
    texts = [dump(page), json.dumps(page), dump(page | {"x": 1}), dump(page | {"schema": "unit-economics/v0"}), dump(page | {"rows": [row, row]}), dump(page | {"rows": [row | {"profit": -1}]}), "no", dump(page | {"schema": "other"}), dump(page | {"contract_version": 2})]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(artifacts.unit_economics(F.col("t")).alias("a")).select("a.*")
    assert [r.problem for r in df.collect()] == [None, "not canonical", "not canonical", "incompatible", "repeated product", "out of range", "not canonical", "not canonical", "incompatible"]
    assert df.first().page.rows[0].revenue == 5
    again = spark.createDataFrame([(dump(page),)], "t string").select(artifacts.unit_economics(F.col("t"))["page"].alias("p")).select(artifacts.unit_economics_text(F.col("p.unit_id"), F.col("p.rows")))
    assert again.first()[0] == dump(page)
    company = {"media_type": "text/html", "sanitizer_version": 2, "schema_version": "1.0", "text": "a\nb", "title": None}
    told = [dump(company), json.dumps(company), dump(company | {"sanitizer_version": 1}), dump(company | {"x": 1}), dump(company | {"media_type": "text/plain"}), "[]", None]
    got = spark.createDataFrame([(t,) for t in told], "t string").select(artifacts.company_page(F.col("t")).alias("a")).select("a.*").collect()
    assert [r.problem for r in got] == [None, "not canonical", "incompatible", "not canonical", "other media type", "not canonical", "not canonical"] and got[0].text == "a\nb"


def test_probes(spark):
    html = '<a href="/s/id/1">a</a><a href="/s/id/2">b</a><a href="//x/">c</a><table><tr><td><input name="price[1]"></td><td><input name="price[2]"></td></tr></table>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [tuple(r) for r in probes.link_inventory(df).collect()] == [(1, "/s/id/{id}", 2)]
    assert [tuple(r) for r in probes.input_inventory(df).collect()] == [(1, "price[n]", 2)]
    assert df.select(probes.identity_candidates(page_links("html"), "/id/([0-9]+)")).first()[0] == ["1", "2"]
