"""The engine's operations end to end."""

import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.plans import adapters as A


def test_current_state(spark, small, tmp_path):
    w = api.Workspace(spark, str(tmp_path))
    roster = A.table(spark, small, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("unit_id"))
    surfaces = roster.where("unit_id % 2 = 0").select("unit_id", F.lit(1).alias("observed_at"), F.lit("ready").alias("status"))
    rows = A.unit_products(spark, small)
    for g in ("1", "2"):
        w.rebuild_current(g, rows if g == "1" else rows.repartition(7), roster, surfaces, keys=A.STATE_KEYS, order=A.STATE_ORDER)
    assert w.current_status("1").first() == w.current_status("2").first() and w.verify("1")
    changed = w.table("1", "products").withColumn("our_price", F.lit(0.0))
    for name in ("units", "orphans", "surfaces", "meta"):
        w.table("1", name).write.parquet(f"{tmp_path}/generation=9/{name}")
    changed.write.parquet(f"{tmp_path}/generation=9/products")
    assert not w.verify("9")  # every value counts, not only the keys
    w.mark_stale("1", "3", "parser")
    assert w.current_status("3").first().status == "stale"
    plan = w.plan("1", limit=5)
    assert plan["rows"].count() == 5 and all(r.unit_id % 2 == 0 for r in plan["rows"].collect()) and plan["excluded"].count() <= 5
    seen, after = [], None
    while True:
        found, after = w.page("1", "products", A.STATE_KEYS, limit=700, after=after, where="unit_id < 6")
        seen += [(r.unit_id, r.product_id) for r in found]
        if after is None:
            break
    assert seen == sorted(seen) and len(seen) == w.table("1", "products").where("unit_id < 6").count()
    with pytest.raises(ValueError):
        w.page("1", "products", A.STATE_KEYS, limit=0)
    with pytest.raises(ValueError):
        w.plan("1", limit=5000)
    for keys in (["our_price", "unit_id", "product_id"], ["observed_at", "o1", "o2"]):  # keys of other types
        first, after = w.page("1", "products", keys, limit=3)
        second, _ = w.page("1", "products", keys, limit=3, after=after)
        both = [tuple(r[k] for k in keys) for r in [*first, *second]]
        assert len(both) == 6 and both == sorted(both) == [tuple(r) for r in w.table("1", "products").select(*keys).orderBy(*keys).limit(6).collect()]


def test_knowledge(spark, tmp_path):
    w = api.Workspace(spark, str(tmp_path))
    records = spark.createDataFrame([("p:1", "product", "Red Lamp", "a bright lamp"), ("p:2", "product", "Lamp", "dark lamp oil"), ("a:1", "action", "Sell", "sell a lamp")], "ref string, kind string, title string, body string")
    names = spark.createDataFrame([("p:1", 0, "Beacon"), ("p:1", 1, "BEACON")], "ref string, position int, alias string")
    seen = spark.createDataFrame([("p:1", 1, "x#entry-1"), ("p:1", 0, "y#seq-2"), ("p:1", 2, "x#entry-1")], "ref string, position int, evidence_ref string")
    w.rebuild_index("1", records, names, seen)
    asked = spark.createDataFrame([(1, "p:2"), (2, "beacon"), (3, "LAMP"), (4, "oil"), (5, "nothing")], "query_id long, text string")
    got = {}
    for r in w.search("1", asked, kinds=("product",)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.ref, r.tier))
    assert got[1][0] == ("p:2", 1) and got[2] == [("p:1", 2)] and got[3][0] == ("p:2", 3) and ("p:1", 4) in got[3] and got[4] == [("p:2", 4)] and 5 not in got
    one = w.get("1", "p:1").first()
    assert one.aliases == ["Beacon"] and one.evidence == ["y#seq-2", "x#entry-1"]


def test_detect(spark, small):
    ob = A.observations(spark, small)
    got = api.detect_changes(ob.where("NOT known"), ob.where("known"))
    assert got["facts"].count() == got["counts"].agg(F.sum("n")).first()[0] and got["findings"].count() > 0
    assert got["findings"].count() == got["findings"].select("change_id").distinct().count()
