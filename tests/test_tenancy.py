"""Secured views and enriched streams: each tenant its own rows, none without a tenant, dimensions that change between batches."""

import pytest

from teleflect.operators import tenancy as T
from teleflect.streaming import enrich


@pytest.fixture
def tables(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "region": df([(1, "north"), (2, "south")], "id long, tenant string"),
        "depot": df([(10, 1), (20, 2), (30, None)], "depot_id long, region_id long"),
        "van": df([(100, 10), (101, 10), (200, 20), (300, 30), (400, 99)], "vin long, depot_id long"),
        "note": df([("a", 100), ("b", 200), ("c", 200), ("d", None), ("e", 12345)], "text string, vin long"),
        "metric": df([("m",)], "name string"),
    }


OWNERS = {"note": T.Owner("vin", "van"), "van": T.Owner("depot_id", "depot", "vin"), "depot": T.Owner("region_id", "region", "depot_id"), "region": T.Owner("tenant", None, "id")}


def seen(spark, views):
    return {v: spark.table(v).count() for v in views}


def test_each_tenant_sees_its_own(spark, tables):
    views = T.secure(spark, tables, OWNERS, ("metric",), "s_")
    assert set(views) == {f"s_{t}" for t in tables}
    assert set(seen(spark, views).values()) == {0}
    T.as_tenant(spark, "north")
    assert seen(spark, views) == {"s_region": 1, "s_depot": 1, "s_van": 2, "s_note": 1, "s_metric": 1}
    T.as_tenant(spark, "south")
    assert sorted(r["text"] for r in spark.table("s_note").collect()) == ["b", "c"]
    T.as_tenant(spark, "'; drop")
    assert seen(spark, views) == {"s_region": 0, "s_depot": 0, "s_van": 0, "s_note": 0, "s_metric": 1}
    T.as_tenant(spark, None)
    assert set(seen(spark, views).values()) == {0}
    assert spark.sql("SELECT owner_of_van(200) AS o, owner_of_van(400) AS n").first().asDict() == {"o": "south", "n": None}


def test_no_table_is_forgotten(spark, tables):
    with pytest.raises(ValueError, match="metric"):
        T.secure(spark, tables, OWNERS)
    with pytest.raises(ValueError, match="no tenant"):
        T.way("a", {"a": T.Owner("b_id", "b", "id"), "b": T.Owner("a_id", "a", "id")})
    with pytest.raises(ValueError, match="no tenant"):
        T.way("a", {"a": T.Owner("b_id", "b", "id")})


def test_a_dimension_that_changes_between_batches(spark, tmp_path):
    source, out, c = (str(tmp_path / x) for x in ("in", "out", "c"))
    state = {"rows": [(1, "north"), (2, "south")]}
    dimension = lambda s: s.createDataFrame(state["rows"], "vin long, tenant string")
    send = lambda rows: spark.createDataFrame(rows, "vin long, n int").coalesce(1).write.mode("append").parquet(source)
    run = lambda: enrich.follow(spark.readStream.schema("vin long, n int").parquet(source), dimension, "vin", "tenant", out, c)
    send([(1, 1), (2, 2), (3, 3)])
    run()
    state["rows"] = [(1, "south"), (2, "south"), (3, "north"), (3, "north")]
    send([(1, 4), (3, 5), (None, 6)])
    run()
    run()
    of = lambda t, after=-1: sorted(r["n"] for r in enrich.feed_of(spark, out, "tenant", t, after).collect())
    assert (of("north"), of("south"), of(enrich.UNKNOWN), of(None), of("south", 0)) == ([1, 5], [2, 4], [3, 6], [], [4])
    plan = enrich.feed_of(spark, out, "tenant", "north")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "(cast(tenant" in plan.split("PartitionFilters: [")[1] or "(tenant" in plan.split("PartitionFilters: [")[1]
