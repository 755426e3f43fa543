"""Invariants of the operators on small literal rows."""

import datetime
import os
import pathlib
import time
import warnings

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from galena.functions.names import has_words, is_audit, is_key_like, layer_of_name, safe_identifier
from galena.operators import history, ingest, profile, quality, refine, relate, selection, summarise
from galena.plans import derive, lineage, pages, runs, tiles
from galena.plans.metrics import Attribute, Entity, Filter, Join, Measure, MetricQuery, Model, Refused, metric_query
from galena.sources import readers, stored
from galena.streaming import streams


def test_names():
    assert [safe_identifier(x) for x in ("Order ID", "  9 lives!", "--", "a__b")] == ["order_id", "t_9_lives", "unnamed", "a_b"]
    assert not is_key_like("paid") and is_key_like("order_id") and is_key_like("id")
    assert is_audit("etl_run") and is_audit("ingested_at") and not is_audit("profile_name")
    assert layer_of_name("raw_orders") == "bronze" and layer_of_name("fact_sales") == "gold" and layer_of_name("orders") is None
    assert has_words("billing_email", ["email"])


RULES = [
    quality.Rule("not_null", ("order_id",)),
    quality.Rule("allowed_values", ("status",), values=("shipped", "pending", "O'Brien'; drop table x --")),
    quality.Rule("type", ("amount",), to="float"),
    quality.Rule("not_null", ("amount",), "warn"),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [("ORD-1", "shipped", "120.50"), ("ORD-2", "pending", "not-a-number"), ("ORD-3", None, "80.00"), (None, "shipped", "60.00"), ("ORD-5", "teleported", "x"), ("ORD-6", "shipped", None)]
    return spark.createDataFrame(rows, "order_id string, status string, amount string")


def test_quality_loses_nothing(raw):
    own = quality.evaluate(raw, RULES)
    held = quality.quarantine(own, "r", F.current_timestamp())
    assert quality.clean(own).count() + held.count() == raw.count()
    assert {r.order_id: r._dq_rule for r in held.collect()} == {"ORD-2": "type:amount", None: "not_null:order_id", "ORD-5": "allowed_values:status; type:amount"}
    assert set(held.columns) == {*raw.columns, "_dq_rule", "_dq_run_id", "_dq_quarantined_at"}
    assert quality.warning_summary(own).collect() == [Row(rule="not_null:amount", n=1)]


def test_money_passes_as_the_cast_reads_it(spark):
    rows = [("A", "1200.00"), ("B", "1,850.00"), ("C", "$2,400.50"), ("D", "N/A"), ("E", "see addendum")]
    own = quality.evaluate(spark.createDataFrame(rows, "id string, amount string"), [quality.Rule("type", ("amount",), to="decimal")])
    assert {r.id for r in quality.clean(own).collect()} == {"A", "B", "C"}
    got = quality.clean(own).select(refine.typed(F.col("amount"), "decimal").cast("double").alias("v")).collect()
    assert sorted(r.v for r in got) == [1200.0, 1850.0, 2400.5]


def test_breach_needs_a_hundred_rows(spark):
    rule = [quality.Rule("non_negative", ("x",))]
    assert not quality.breach(quality.evaluate(spark.range(-50, 49).select(F.col("id").alias("x")), rule)).first().breached
    assert quality.breach(quality.evaluate(spark.range(-50, 50).select(F.col("id").alias("x")), rule)).first().breached


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "c")], "k int, v string")
    once = ingest.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, ingest.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    for keys in ([], ["nope"]):
        with pytest.raises(ValueError):
            ingest.upsert(old, new, keys)


def test_histories_by_event_time(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    kind = "k int, v string, seen timestamp"
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    seen = lambda h: sorted((r.k, r.v, r[history.FROM].day, r[history.TO] and r[history.TO].day, r[history.CURRENT]) for r in h.collect())
    one = history.scd2_events(None, rows((1, "z", t(1)), (1, "a", t(3)), (1, "a", t(4)), (2, "x", t(2)), (None, "n", t(1)), (3, "n", None)), ["k"], "seen")
    assert seen(one) == [(1, "a", 3, None, True), (1, "z", 1, 3, False), (2, "x", 2, None, True)]
    late = history.scd2_events(one, rows((1, "late", t(2)), (2, "w", t(1)), (4, "new", t(9))), ["k"], "seen")
    want = [(1, "a", 3, None, True), (1, "late", 2, 3, False), (1, "z", 1, 2, False), (2, "w", 1, 2, False), (2, "x", 2, None, True), (4, "new", 9, None, True)]
    assert seen(late) == want
    assert seen(history.scd2_events(late, rows((1, "late", t(2)), (4, "new", t(9))), ["k"], "seen")) == want
    # A late version that equals what follows it moves its start; one at a time that is there takes its place.
    assert seen(history.scd2_events(one, rows((1, "a", t(2)), (2, "y", t(2))), ["k"], "seen")) == [(1, "a", 2, None, True), (1, "z", 1, 2, False), (2, "y", 2, None, True)]
    assert seen(history.scd2_events(None, rows().limit(0), ["k"], "seen")) == [] and seen(history.scd2_events(one, rows().limit(0), ["k"], "seen")) == seen(one)


def test_changed_tracking_is_told(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "b")], "k int, v string, w string")
    history.scd2_merge(None, rows, ["k"], "2026-01-01", ["v"]).write.parquet(f"{tmp_path}/h")
    old = spark.read.parquet(f"{tmp_path}/h")
    assert history.tracked_of(old) == ["v"]
    with pytest.warns(UserWarning, match="versioned by v, now by v, w"):
        new = history.scd2_merge(old, rows, ["k"], "2026-02-01")
    assert tuple(history.scd2_stats(old, new, "2026-02-01").first()) == (1, 1, 0) and history.tracked_of(new) == ["v", "w"]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert history.scd2_merge(new, rows, ["k"], "2026-03-01").count() == 2


def test_as_of_join_of_a_key_with_many_versions(spark):
    stamp = "timestamp_seconds(1700000000 + {}) "
    versions = spark.range(100_000).selectExpr("1 k", "id v", stamp.format("id * 600") + history.FROM, f"if(id = 99999, null, {stamp.format('id * 600 + 600')}) " + history.TO, f"id = 99999 {history.CURRENT}", f"'' {history.HASH}")
    gap = spark.createDataFrame([(2, 7, 0, 50)], "k int, v bigint, a int, b int").selectExpr("k", "v", stamp.format("a") + history.FROM, stamp.format("b") + history.TO, f"false {history.CURRENT}", f"'' {history.HASH}")
    facts = spark.range(50_000).selectExpr("if(id % 50 = 0, 2, 1) k", "id", stamp.format("id * 1201 - 700") + "at").unionByName(spark.createDataFrame([(None, -1), (1, -2)], "k int, id bigint").selectExpr("k", "id", f"if(k is null, {stamp.format(0)}, null) at"))
    got = {r.id: r.v for r in history.as_of_join(facts, versions.unionByName(gap), ["k"], "at").collect()}
    assert len(got) == 50_002 and got[-1] is None and got[-2] is None and got[0] is None
    for i in range(50_000):
        s = i * 1201 - 700
        assert got[i] == ((7 if 0 <= s < 50 else None) if i % 50 == 0 else None if s < 0 else min(s // 600, 99_999)), i


def test_window_stops_at_the_ceiling_and_starts_afresh(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, t(1)), (2, t(2)), (3, t(3)), (4, None)], "id int, updated_at timestamp")
    got = ingest.read_window(df, "updated_at", t(1))
    assert (sorted(r.id for r in got.rows.collect()), got.ceiling, got.null_rows) == ([2, 3], t(3), 1)
    assert ingest.read_window(df, "created_at", t(3)).rows.count() == 4
    assert ingest.choose_watermark(spark.createDataFrame([(1, 2.0)], "amount int, qty double")).column is None


def test_load_bronze_moves_state_after_the_write(spark, tmp_path):
    t = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, "a", t(1)), (2, "b", t(2))]
    kind = "k int, v string, updated_at timestamp"
    first = ingest.load_bronze(spark.createDataFrame(rows, kind), str(tmp_path), "d", ["k"], None)
    more = [*rows, (2, "B", t(3)), (3, "c", t(3))]
    second = ingest.load_bronze(spark.createDataFrame(more, kind), str(tmp_path), "d", ["k"], first["state"])
    assert (first["mode"], second["mode"], second["rows_read"]) == ("replace", "upsert", 2)
    assert sorted((r.k, r.v) for r in ingest.read_bronze(spark, str(tmp_path), "d").collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert second["state"].first().rows_total == 4
    # State without the table: all rows are read again, not only what is newer.
    third = ingest.load_bronze(spark.createDataFrame(more, kind), f"{tmp_path}/lost", "d", ["k"], second["state"])
    assert (third["mode"], third["rows_read"]) == ("replace", 4) and ingest.read_bronze(spark, f"{tmp_path}/lost", "d").count() == 3


def test_watermarks_do_not_move_with_the_zone(spark, tmp_path):
    was = os.environ.get("TZ")
    try:
        os.environ["TZ"] = "Asia/Tokyo"
        time.tzset()
        rows = lambda *ts: spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "k int, s string").selectExpr("k", "cast(s as timestamp) updated_at")
        first = ingest.load_bronze(rows("2024-01-01 00:00:00"), str(tmp_path), "z", ["k"], None)
        second = ingest.load_bronze(rows("2024-01-01 00:00:00", "2024-01-01 00:00:01"), str(tmp_path), "z", ["k"], first["state"])
        assert second["rows_read"] == 1 and ingest.read_bronze(spark, str(tmp_path), "z").count() == 2
        third = ingest.load_bronze(rows("2024-01-01 00:00:00", "2024-01-01 00:00:01"), str(tmp_path), "z", ["k"], second["state"])
        assert third["rows_read"] == 0 and third["state"].first().watermark == second["state"].first().watermark
    finally:
        os.environ.pop("TZ") if was is None else os.environ.update(TZ=was)
        time.tzset()


def test_upserts_leave_other_buckets_alone(spark, tmp_path):
    path, kind = f"{tmp_path}/t", "k int, v string"
    fold = lambda old, new: ingest.upsert(old, new, ["k"])
    one = stored.folded(path, spark.range(1000).selectExpr("cast(id as int) k", "'a' v"), ["k"], fold, buckets=8)
    before = stored.manifest(spark, path, one)
    assert len(before) == 8
    own = spark.createDataFrame([(5, "B", 1.5), (6, None, 2.5)], f"{kind}, w double")
    two = stored.folded(path, own, ["k"], fold, one)
    after = stored.manifest(spark, path, two)
    hit = {r[0] for r in own.select(stored.bucket(["k"], 8)).collect()}
    assert {p for p in after if after[p] != before[p]} == hit and all(len(after[p]) == 1 for p in after)
    got = {r.k: (r.v, r.w) for r in stored.read(spark, path).collect()}
    assert len(got) == 1000 and got[5] == ("B", 1.5) and got[6] == (None, 2.5) and got[7] == ("a", None)
    # New keys go beside what their bucket has; nothing is rewritten. A wider key stays in its bucket.
    three = stored.folded(path, spark.createDataFrame([(5000, "n")], "k bigint, v string"), ["k"], fold, two)
    grown = {p: f for p, f in stored.manifest(spark, path, three).items() if f != after[p]}
    assert len(grown) == 1 and all(f[:1] == after[p] and len(f) == 2 for p, f in grown.items())
    assert stored.read(spark, path).count() == 1001 and stored.read(spark, path, one).count() == 1000
    four = stored.folded(path, spark.createDataFrame([(5000, "N")], "k bigint, v string"), ["k"], fold, three)
    assert stored.read(spark, path, four).where("k = 5000").collect() == [Row(k=5000, v="N", w=None)]
    assert stored.folded(path, own.limit(0), ["k"], fold, four).number == 4 and stored.read(spark, path).count() == 1001
    # A version that was written but not logged, as after a crash, is not current, and the next load replaces it.
    spark.range(1).write.parquet(f"{path}/data/v5")
    assert stored.current(spark, path).number == 4
    with pytest.raises(ValueError, match="kept by"):
        stored.folded(path, own, ["v"], fold, four)


def test_changed_files_are_loaded_in_place(spark, tmp_path):
    src, root, schema = f"{tmp_path}/a b+c", f"{tmp_path}/out", spark.range(0).selectExpr("id", "'' v").schema
    put = lambda name, lo, hi, v: spark.range(lo, hi).selectExpr("id", f"'{v}' v").toPandas().to_parquet(f"{src}/{name}.parquet")
    os.makedirs(src)
    for i, name in enumerate("wxyz"):
        put(name, i * 10, i * 10 + 10, "old")
    pathlib.Path(f"{src}/y.parquet").write_text("no parquet at all")
    load = lambda: {r.path.rpartition("/")[2]: r.status for r in ingest.load_files(ingest.list_files(spark, src), root, "d", schema).collect()}
    rows = lambda: {r.v: r.n for r in ingest.read_bronze(spark, root, "d").groupBy("v").count().withColumnRenamed("count", "n").collect()}
    assert load() == {"w.parquet": "LOADED", "x.parquet": "LOADED", "y.parquet": "FAILED", "z.parquet": "LOADED"} and rows() == {"old": 30}
    put("x", 10, 15, "new")
    put("y", 20, 30, "mended")
    was = stored.manifest(spark, f"{root}/bronze/d", stored.current(spark, f"{root}/bronze/d"))
    assert load() == {"x.parquet": "LOADED", "y.parquet": "LOADED"} and rows() == {"old": 20, "new": 5, "mended": 10}
    now = stored.manifest(spark, f"{root}/bronze/d", stored.current(spark, f"{root}/bronze/d"))
    assert sum(now[p] == was.get(p) for p in now) == 2 and load() == {}
    pathlib.Path(f"{src}/z.parquet").write_text("broken later")
    assert load() == {"z.parquet": "FAILED"} and rows() == {"old": 20, "new": 5, "mended": 10} and load() == {"z.parquet": "FAILED"}
    assert ingest.read_registry(spark, root, "d").where("status = 'FAILED'").count() == 3


def test_changed_files(spark):
    stamp = datetime.datetime(2024, 1, 1)
    listing = spark.createDataFrame([("a", 1, stamp), ("b", 2, stamp), ("c", 3, stamp)], "path string, length bigint, modificationTime timestamp")
    version = lambda n: f"{n}-{int(stamp.replace(tzinfo=datetime.UTC).timestamp() * 1e6)}"
    known = spark.createDataFrame([("a", version(1), "LOADED"), ("b", version(9), "LOADED"), ("c", version(3), "FAILED")], "path string, version string, status string")
    assert sorted(r.path for r in ingest.changed_files(listing, known).collect()) == ["b", "c"]


BASE = [("L1", "Acme", 50000.0), ("L2", "Globex", 42000.0)]
LEASE = "lease_id string, tenant string, monthly_rent double"


def test_scd2(spark):
    one = history.scd2_merge(None, spark.createDataFrame(BASE, LEASE), ["lease_id"], "2026-01-01")
    again = history.scd2_merge(one, spark.createDataFrame(BASE, LEASE), ["lease_id"], "2026-02-01")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, one.collect()))
    moved = spark.createDataFrame([("L1", None, 50000.0), ("L3", "New", 1.0), (None, "x", 1.0)], LEASE)
    two = history.scd2_merge(one, moved, ["lease_id"], "2026-02-01")
    assert tuple(history.scd2_stats(one, two, "2026-02-01").first()) == (2, 1, 1)
    now = two.where(history.CURRENT)
    assert now.count() == now.select("lease_id").distinct().count() == 3
    assert {r.tenant for r in history.scd2_as_of(two, "2026-01-15").collect()} == {"Acme", "Globex"}
    swapped = spark.createDataFrame([("k", "a", None), ("k", None, "a")], "k string, x string, y string").select(history.change_hash(["x", "y"]).alias("h"), history.change_hash(["y", "x"]).alias("g")).collect()
    assert swapped[0].h != swapped[1].h and all(r.h == r.g for r in swapped)
    facts = spark.createDataFrame([("L1", datetime.datetime(2026, 1, 5)), ("L1", datetime.datetime(2026, 3, 5))], "lease_id string, at timestamp")
    assert [r.tenant for r in history.as_of_join(facts, two, ["lease_id"], "at").orderBy("at").collect()] == ["Acme", None]


def model(spark):
    orders = spark.createDataFrame([(1, 1, "a%", 10.0), (2, 1, "b", 20.0), (3, None, "b", 5.0)], "id int, cust int, status string, amount double")
    customers = spark.createDataFrame([(1, "SE", "a@x.org"), (2, "NO", "b@x.org")], "id int, country string, email string")
    own = (Attribute("id"), Attribute("status"))
    return Model(
        (Entity("orders", orders, own), Entity("customers", customers, (Attribute("id"), Attribute("country"), Attribute("email", pii="email")))),
        (Measure("total", "orders", "sum", "amount"), Measure("n", "orders", "count"), Measure("people", "customers", "count"), Measure("odd", "orders", "ratio", "amount")),
        (Join("orders", "customers", (("cust", "id"),)),),
    )


@pytest.mark.parametrize(
    "query",
    [
        MetricQuery(()),
        MetricQuery(("nope",)),
        MetricQuery(("odd",)),
        MetricQuery(("total", "people")),
        MetricQuery(("people",), ("orders.status",)),
        MetricQuery(("total",), ("status",)),
        MetricQuery(("total",), ("orders.nope",)),
        MetricQuery(("total",), order=(("n", True),)),
        MetricQuery(("total",), filters=(Filter("customers.email", "eq", "a@x.org"),)),
        MetricQuery(("total",), filters=(Filter("orders.status", "in", []),)),
        MetricQuery(("total",), filters=(Filter("orders.id", "between", (1,)),)),
        MetricQuery(("total",), filters=(Filter("orders.id", "like", 1),)),
    ],
)
def test_refusals(spark, query):
    with pytest.raises(Refused):
        metric_query(model(spark), query)


def test_metric_names_joins_and_masks(spark):
    m = model(spark)
    assert metric_query(m, MetricQuery(("total",), ("orders.id",))).columns == ["orders_id", "total"]
    assert [tuple(r) for r in metric_query(m, MetricQuery(("total", "n"), ("customers.country",))).collect()] == [("SE", 30.0, 2), (None, 5.0, 1)]
    assert [r.email for r in metric_query(m, MetricQuery(("n",), ("customers.email",))).collect()] == ["•••@x.org", None]
    assert metric_query(m, MetricQuery(("n",), ("customers.email",), permissions=frozenset({"email"}))).first().email == "a@x.org"
    assert metric_query(m, MetricQuery(("n",), filters=(Filter("orders.status", "contains", "%"),))).first().n == 1
    assert metric_query(m, MetricQuery(("n",), filters=(Filter("orders.status", "eq", "x' or '1'='1"),))).first().n == 0


def test_folding_keeps_the_total(spark):
    rows = [(i, f"c{i % 15}", float(i)) for i in range(200)] + [(999, None, 7.0)]
    own = Model((Entity("t", spark.createDataFrame(rows, "id int, c string, x double"), (Attribute("c"),)),), (Measure("x", "t", "sum", "x"), Measure("mean", "t", "avg", "x")))
    got = tiles.fold_tail(own, ("x", "mean"), "t.c", 5).collect()
    assert len(got) == 6 and sum(r.x for r in got) == sum(r[2] for r in rows)
    rest = next(r for r in got if r.label.startswith("Other"))
    assert rest.label == "Other (11)" and 0 < rest.mean < 200
    assert tiles.cross_filter((Filter("a.b", "eq", 1),), "a.b", 1) == ()
    assert tiles.cross_filter((Filter("a.b", "eq", 1),), "a.b", 2) == (Filter("a.b", "eq", 2),)
    made = tiles.run_dashboard(own, [tiles.Tile("good", "stat", ("x",)), tiles.Tile("bad", "stat", ("nope",))])
    assert made["good"].count() == 1 and isinstance(made["bad"], str)


def test_tiles_share_one_aggregate_and_fail_alone(spark):
    rows = [(i, f"c{i % 15}", i % 3, float(i), datetime.datetime(2024, 1 + i % 6, 1)) for i in range(300)]
    own = Model((Entity("t", spark.createDataFrame(rows, "id int, c string, k int, x double, at timestamp"), (Attribute("c"), Attribute("k"), Attribute("at"))),), (Measure("x", "t", "sum", "x"), Measure("n", "t", "count"), Measure("mean", "t", "avg", "x"), Measure("kinds", "t", "count_distinct", "k"), Measure("text", "t", "sum", "c"), Measure("wrong", "t", "sum", "nothing")))
    page = [tiles.Tile("total", "stat", ("x",)), tiles.Tile("by c", "bar", ("x", "n"), "t.c"), tiles.Tile("trend", "line", ("n",), time="t.at"), tiles.Tile("mean", "bar", ("mean",), "t.k"), tiles.Tile("lost", "bar", ("x",), "t.gone"), tiles.Tile("detail", "detail", ("x",), "t.k", "t.at")]
    only = (Filter("t.k", "lt", 2),)
    page += [tiles.Tile("mean share", "donut", ("x",), "t.c"), tiles.Tile("mean by c", "bar", ("mean", "kinds"), "t.c"), tiles.Tile("means", "stacked", ("mean", "n"), "t.c"), tiles.Tile("stat", "stat", ("mean",), time="t.at"), tiles.Tile("delta", "delta", ("n",), time="t.at"), tiles.Tile("pairs", "scatter", ("x", "n"), "t.k"), tiles.Tile("late", "stat", ("x",), filters=(Filter("t.k", "eq", 9),), time="t.at")]
    got, want = pages.collect_page(own, page, only), tiles.run_dashboard(own, page, only)
    fixed = lambda v: round(v, 9) if isinstance(v, float) else [tuple(map(fixed, x)) for x in v] if isinstance(v, list) else v
    assert list(got) == [t.name for t in page] and isinstance(got["lost"], str)
    for name, rows in want.items():
        if name != "lost":
            assert [tuple(map(fixed, r)) for r in got[name]] == [tuple(map(fixed, r)) for r in rows.collect()], name
            assert not got[name] or list(got[name][0].asDict()) == rows.columns, name
    assert any(r.label.startswith("Other (2)") for r in got["means"]) and len(got["trend"]) == 4
    broken = pages.collect_page(own, [*page, tiles.Tile("broken", "stat", ("wrong",)), tiles.Tile("fails", "stat", ("text",)), tiles.Tile("no bar", "bar", ("x",)), tiles.Tile("two", "line", ("x", "n"), time="t.at"), tiles.Tile("one", "combo", ("x",), time="t.at")])
    assert isinstance(broken["broken"], str) and not isinstance(broken["mean"], str) and len(broken["by c"]) == 9
    assert "CAST_INVALID_INPUT" in broken["fails"] and broken["no bar"] == "a bar needs a dimension" and "1 measures, not 2" in broken["two"] and "2 to 8" in broken["one"]
    stat = broken["stat"][0]
    assert (stat.total, stat.direction, len(stat.series)) == (149.5, "up", 6)
    points = pages.page_points(spark, own, [*page, tiles.Tile("broken", "stat", ("wrong",))], only).collect()
    assert {r.tile for r in points if r.problem} == {"lost", "broken"} and sum(r.tile == "trend" for r in points) == 4
    empty = pages.collect_page(own, page, (Filter("t.k", "eq", 9),))
    assert empty["by c"] == [] and empty["total"][0].x is None and empty["detail"] == []
    chosen = pages.default_page(own)
    assert [t.kind for t in chosen].count("stat") == 4 and {t.dimension for t in chosen if t.kind == "bar"} == {"t.c", "t.k"} and chosen[0].time == "t.at"
    about = tiles.about_tiles(spark, own, page, only).collect()
    assert {r.measure: r.definition for r in about}["mean"] == "avg(t.x)" and all("t.k lt 2" in r.filters for r in about)


def test_folding_more_labels_than_a_query_shows(spark):
    # 60,002 labels; the largest by size is negative, and rows without a label are in the tail.
    table = spark.range(60_000).selectExpr("id", "concat('c', id) c", "if(id = 5, -1e6, if(id = 6, 2e5, 1.0)) x").unionByName(spark.createDataFrame([(60_000, None, 0.5), (60_001, "z", 2.0)], "id bigint, c string, x double"))
    own = Model((Entity("t", table, (Attribute("c"),)),), (Measure("x", "t", "sum", "x"), Measure("n", "t", "count")))
    got = {r.label: (r.x, r.n) for r in tiles.fold_tail(own, ("x", "n"), "t.c", 3).collect()}
    assert got == {"c5": (-1e6, 1), "c6": (2e5, 1), "z": (2.0, 1), "Other (59999)": (59_998.5, 59_999)}


def test_lineage_ends_on_cycles(spark):
    rows = [("a", "x", "b", "x", "s", None), ("b", "x", "c", "x", "s", None), ("c", "x", "a", "x", "s", None), ("c", "x", "tile", "t", "d", "bar")]
    own = lineage.edges(spark, rows)
    assert lineage.upstream(own, "tile", "t").count() == 4
    assert ("tile", "t") in {(r.target_table, r.target_column) for r in lineage.downstream(own, "a", "x").collect()}
    straight = lineage.edges(spark, rows[:2] + rows[3:])
    assert [tuple(r) for r in lineage.origins(lineage.upstream(straight, "tile", "t")).collect()] == [("a", "x")]
    assert [r.name for r in lineage.steps_without_edges(spark.createDataFrame([("s",), ("lost",)], "name string"), own).collect()] == ["lost"]


def test_freshness_thresholds_are_strict(spark):
    at = datetime.datetime(2026, 1, 2)
    ages = {"fresh": 150, "late": 151, "late2": 200, "stale": 201, "future": -5}
    done = [(c, "succeeded", at - datetime.timedelta(seconds=s)) for c, s in ages.items()] + [("failed", "failed", at)]
    plans = [(c, 100, True) for c in (*ages, "failed", "never")] + [("off", 100, False)]
    got = runs.freshness(spark.createDataFrame(done, "connection string, status string, finished_at timestamp"), spark.createDataFrame(plans, "connection string, interval_seconds int, enabled boolean"), at)
    assert {r.connection: r.state for r in got.collect()} == {"fresh": "fresh", "late": "late", "late2": "late", "stale": "stale", "future": "unknown", "failed": "unknown", "never": "unknown", "off": "unknown"}


def test_freshness_counts_whole_seconds_that_have_passed(spark):
    at = datetime.datetime(2026, 1, 2)
    ages = {"fresh": 150.9, "late": 151.0, "late2": 200.5, "stale": 201.0, "future": -0.5}
    done = [(c, "succeeded", at - datetime.timedelta(seconds=s)) for c, s in ages.items()]
    plans = [(c, 100, True) for c in ages]
    got = runs.freshness(spark.createDataFrame(done, "connection string, status string, finished_at timestamp"), spark.createDataFrame(plans, "connection string, interval_seconds int, enabled boolean"), at)
    assert {r.connection: (r.state, r.age_seconds) for r in got.collect()} == {"fresh": ("fresh", 150), "late": ("late", 151), "late2": ("late", 200), "stale": ("stale", 201), "future": ("unknown", -1)}


def test_medallion_run(spark, tmp_path):
    rows = [(i % 500, f"  {i % 3} ", "N/A" if i == 7 else f"${i % 50}.25", datetime.datetime(2024, 1 + i % 3, 1), "b1") for i in range(540)]
    df = spark.createDataFrame(rows, "`Order ID` int, status string, amount_usd string, order_date timestamp, batch_id string")
    sets = [runs.Dataset("orders", df, rules=(quality.Rule("type", ("amount_usd",), to="decimal"),)), runs.Dataset("broken", df, rules=(quality.Rule("not_null", ("nope",)),))]
    log = runs.run_medallion(sets, str(tmp_path), "r1", F.lit("2026-01-01").cast("timestamp"))
    status = {(r.dataset, r.step): r.status for r in log.collect()}
    assert status["orders", "gold"] == "succeeded" and status["broken", "silver"] == "failed"
    assert runs.run_status(log).first().status == "partial"
    silver = spark.read.parquet(f"{tmp_path}/silver/orders")
    assert "batch_id" not in silver.columns and "order_id" in silver.columns and silver.count() < 540


def test_shadows_pii_and_keys(spark):
    rows = [(f"{i:05d}", str(i), "yes" if i % 2 else "no", f"2024-01-{i % 28 + 1:02d}", "03/09/2026", f"${i}.50", f"12{i % 10}-45-67{i:02d}") for i in range(40)]
    df = spark.createDataFrame(rows, "code string, n string, flag string, day string, slash string, price string, tax_id string")
    assert {r.column: r.shadow_type for r in profile.shadow_types(df).collect()} == {"code": None, "n": "integer", "flag": "boolean", "day": "date", "slash": None, "price": "decimal", "tax_id": None}
    assert {r.column: (r.kind, r.confidence) for r in profile.detect_pii(df).collect()} == {"tax_id": ("national_id", 0.97)}
    assert profile.key_candidates(df) [0] == ["code"]
    pair = spark.createDataFrame([(i // 10, i % 10) for i in range(100)], "left_no int, right_no int")
    assert profile.key_candidates(pair) == [["left_no", "right_no"]]
    three = spark.range(400).selectExpr("id div 4 a_no", "(id + 2) div 4 b_no", "(id + 1) div 2 c_no", "id % 7 few")
    assert [sorted(k) for k in profile.key_candidates(three, most=3)] == [["a_no", "b_no", "c_no"]] and profile.key_candidates(three) == []
    assert profile.key_candidates(three.unionByName(three.where("few = 1")), most=3) == []
    empty = profile.profile(df.limit(0))
    assert empty.count() == 7


def test_rows_are_told_apart_by_digests_and_as_a_whole(spark, monkeypatch):
    rows = [(1, "a", [1]), (1, "a", [1]), (None, "a", None), (None, "a", None), (2, None, [1, 2]), (2, None, [2, 1]), (None, None, None)]
    df = spark.createDataFrame(rows, "k int, v string, xs array<int>")
    for most in (500_000, 0):
        monkeypatch.setattr(profile, "MOST_REPEATED", most)
        assert tuple(profile.duplicate_ratio(df).first()) == (7, 5, 0.2857)
    swapped = spark.createDataFrame([(None, 1), (1, None), (1, 1)], "a int, b int")
    assert tuple(profile.duplicate_ratio(swapped).first()) == (3, 3, 0.0) and tuple(profile.duplicate_ratio(swapped.limit(0)).first()) == (0, 0, 0.0)


def test_quartiles_and_counts_of_large_columns(spark):
    df = spark.range(50_000).selectExpr("id * 37 % 50000 a", "cast(id % 7 as double) + 0.25 b", "if(id % 10 = 0, null, pow(id, 2)) c", "if(id = 3, double('nan'), id / 8) d", "cast(id as string) e")
    exact = df.agg(*[F.percentile(x, F.array(*map(F.lit, profile.SHARES))).alias(x) for x in "abcd"]).first()
    got = {r.column: (r.p25, r.p50, r.p75) for r in profile.quartiles(df, list("abcd")).collect()}
    assert {c: list(q) for c, q in got.items()} == {c: exact[c] for c in "abcd"}
    whole, part = ({r.column: r for r in profile.profile(df, n).collect()} for n in (100_000, 1_000))
    for c in "abcde":
        assert (whole[c].p50, whole[c].min, whole[c].max_length, whole[c].shadow_type) == (part[c].p50, part[c].min, part[c].max_length, part[c].shadow_type) or c == "d"
        assert whole[c].distinct_is_exact and abs(part[c].distinct_count - whole[c].distinct_count) <= 0.05 * whole[c].distinct_count
    assert part["a"].is_unique and part["e"].shadow_type == "integer" and part["b"].decimal_places == 2
    none = profile.profile(df.limit(0)).collect()
    assert len(none) == 5 and all(r.rows == 0 and r.p50 is None for r in none)


def test_columns_of_many_values_are_counted_exactly(spark):
    df = spark.range(30_000).selectExpr("id % 20000 a", "if(id % 3 = 0, null, cast(id % 9001 as string)) b", "id % 7 few", "id key")
    for details in (True, False):
        got = {r.column: r for r in profile.profile(df, 1_000, details).collect()}
        assert {c: (r.distinct_count, r.is_unique) for c, r in got.items()} == {"a": (20_000, False), "b": (9_001, False), "few": (7, False), "key": (30_000, True)}
        assert all(r.distinct_is_exact for r in got.values())


def test_selection_of_ranks(spark, monkeypatch):
    # Values over all magnitudes, ties, both infinities, NaN, a group of one, a null group, a column without values.
    wide = spark.range(3_000).selectExpr("if(id % 3 = 0, null, id % 3) g", "case when id = 7 then double('inf') when id = 8 then double('-inf') when id % 5 = 0 then 0 else (if(id % 2 = 0, -1, 1)) * pow(10, (id * 7919) % 600 - 300) end x", "id % 4 y", "cast(null as int) z")
    wide = wide.unionByName(spark.sql("select 9 g, 2.5d x, 1 y, null z union all select 1, double('nan'), 3, null"))
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    want = {(r.g, c): r[c] for r in wide.groupBy("g").agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in "xy"]).collect() for c in "xy"}
    for few in (10_000, 5):
        monkeypatch.setattr(selection, "FEW", few)
        for most in (20_000, 2):
            monkeypatch.setattr(selection, "MOST_BROADCAST", most)
            rows = selection.quantiles(wide, {"g": F.col("g")}, {c: F.col(c) for c in "xyz"}, shares).collect()
            got = {(r.g, r.of): [r[f"q{j}"] for j in range(5)] for r in rows}
            assert got.keys() == want.keys() and all(a == b or (a != a and b != b) for k in want for a, b in zip(got[k], want[k], strict=True))
    assert selection.quantiles(wide.limit(0), {"g": F.col("g")}, {"x": F.col("x")}, shares).count() == 0
    own = Model((Entity("t", wide, (Attribute("g"),)),), (Measure("mid", "t", "median", "y"), Measure("n", "t", "count"), Measure("late", "t", "median", "y", Filter("y", "gt", 1))))
    got = {r.g: (r.mid, r.n, r.late) for r in metric_query(own, MetricQuery(("mid", "n", "late"), ("t.g",))).collect()}
    plain = wide.groupBy("g").agg(F.median("y"), F.count("*"), F.median(F.when(F.col("y") > 1, F.col("y")))).collect()
    assert got == {r[0]: tuple(r)[1:] for r in plain} and len(got) == 4
    assert tuple(metric_query(own, MetricQuery(("mid",))).first()) == (wide.agg(F.median("y")).first()[0],)
    page = pages.collect_page(own, [tiles.Tile("mid", "bar", ("mid",), "t.g"), tiles.Tile("n", "stat", ("n",))])
    assert len(page["mid"]) == 4 and page["n"][0].n == 3_002


def test_unique_rule_counts_nulls_as_a_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    got = {r.v: r[quality.WARNS] for r in quality.evaluate(df, [quality.Rule("unique", ("k",), "warn"), quality.Rule("unique", ("k", "v"), "warn")]).collect()}
    assert got == {"a": "unique:k", "b": "unique:k", "c": "", "d": "unique:k", "e": "unique:k"}


def test_derived_model(spark):
    rows = spark.createDataFrame([(1, 7, 10.0, 0.5, "a@x.org", datetime.datetime(2024, 1, 1)), (2, 7, 20.0, 0.25, "b@x.org", datetime.datetime(2024, 2, 1))], "order_id int, customer_id int, total_amount double, margin_pct double, email string, placed_at timestamp")
    people = spark.createDataFrame([(7, "SE")], "customer_id int, country string")
    facts = {n: profile.profile(df).collect() for n, df in (("Orders", rows), ("customers", people))}
    path = [{"from_dataset": "Orders", "from_column": "customer_id", "to_dataset": "customers", "to_column": "customer_id", "cardinality": "many_to_one"}]
    made = derive.derive_model([derive.Table("Orders", rows, facts["Orders"], ("order_id",)), derive.Table("customers", people, facts["customers"], ("customer_id",))], path)
    assert made.roles["orders", "order_id"] == "key" and made.roles["orders", "customer_id"] == "reference" and made.roles["orders", "placed_at"] == "time"
    assert {m.name: (m.agg, m.format) for m in made.model.measures} == {"orders_count": ("count", "number"), "total_amount": ("sum", "currency"), "avg_total_amount": ("avg", "currency"), "avg_margin_pct": ("avg", "percent"), "customers_count": ("count", "number")}
    assert [tuple(r) for r in metric_query(made.model, MetricQuery(("total_amount",), ("customers.country",))).collect()] == [("SE", 30.0)]
    assert metric_query(made.model, MetricQuery(("orders_count",), ("orders.email",))).first().email.startswith("•••")


def test_incremental_runs_and_crashes(spark, tmp_path):
    t = lambda d: datetime.datetime(2024, 1, d)
    kind, at = "k int, v string, updated_at timestamp", F.lit("2026-01-01").cast("timestamp")
    for run, rows in (("r1", [(1, "a", t(1)), (2, "b", t(1))]), ("r2", [(1, "old", t(1)), (2, "B", t(2)), (3, "c", t(3))])):
        log = runs.run_medallion([runs.Dataset("d", spark.createDataFrame(rows, kind), rules=(), keys=("k",))], str(tmp_path), run, at).collect()
        assert log[0].status == "succeeded", log
    assert "upsert of 2 rows" in log[0].note
    assert stored.current(spark, f"{tmp_path}/bronze/d").number == 1 and sorted((r.k, r.v) for r in ingest.read_bronze(spark, str(tmp_path), "d").collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_impact_and_samples(spark):
    own = lineage.edges(spark, [("raw", "x", "orders", "x", "s", None), ("orders", "x", "measure", "total", "m", "sum"), ("measure", "total", "tile", "trend", "d", "line")])
    found = {tuple(r) for r in lineage.impact(own, spark.createDataFrame([("s",), ("blind",)], "name string"), "raw", "x").collect()}
    assert found == {("table", "orders"), ("measure", "total"), ("tile", "trend"), ("unknown effect", "blind")}
    assert readers.sample(spark.range(3), 3).truncated is False and readers.sample(spark.range(4), 3).truncated is True


def test_relationship_names():
    assert relate.name_affinity("customer_id", "customers", "id") == 1.0
    assert relate.name_affinity("customer_id", "customers", "customer_id") == 0.9
    assert relate.name_affinity("id", "customers", "id") == 0.45
    assert relate.name_affinity("billing_customer_key", "customers", "x") == 0.7
    assert relate.name_affinity("status", "customers", "id") == 0.0
    assert relate.name_affinity("customer_ref_id", "customers", "x") == 0.85 and relate.name_affinity("paid", "ids", "x") == 0.0
    assert all(relate.name_affinity(f"{noun}_id", table, "x") == 1.0 for noun, table in (("city", "cities"), ("box", "boxes"), ("order", "orders"), ("class", "class"), ("class", "classes")))


def test_sketches_leave_only_pairs_that_may_hold(spark, monkeypatch):
    """Ten tables that may refer to ten parents, of which three do: one wholly, one for exactly the least share, one that is
    small beside its parent."""
    key = lambda n, start=0: spark.range(start, start + n)
    parents = {f"p{i}": key(60_000, 100_000 * i).select(F.col("id").alias("item_id")) for i in range(10)}
    shares = {0: key(30_000), 1: key(40_000, 100_000 + 30_000), 2: key(8, 200_000)}
    children = {f"c{i}": shares.get(i, key(20_000, 10_000_000)).select(F.col("id").alias("item_id"), F.lit("x").alias("note")) for i in range(10)}
    compared = []
    possible = relate.possible_pairs
    monkeypatch.setattr(relate, "possible_pairs", lambda d, p: compared.append((len(p), possible(d, p))) or compared[-1][1])
    found = relate.infer_relationships(parents | children, {p: ["item_id"] for p in parents}, {}).where("from_dataset like 'c%'").collect()
    assert {(r.from_dataset, r.to_dataset, r.overlap) for r in found} == {("c0", "p0", 1.0), ("c1", "p1", 0.75), ("c2", "p2", 1.0)}
    ((before, after),) = compared
    left = {(child, parent) for child, _, parent, *_ in after}
    assert before == 190 and {("c0", "p0"), ("c1", "p1"), ("c2", "p2")} <= left
    # Eight values say nothing beside a parent of 60,000, so that child is compared with every parent; no other pair is.
    assert left == {("c0", "p0"), ("c1", "p1")} | {("c2", f"p{i}") for i in range(10)}


def test_values_are_compared_in_tasks_of_bounded_size(spark, monkeypatch):
    """The same shares, whatever the number of tasks and words of flags; a task gets its part of the values."""
    own = {"orders": spark.range(9_000).selectExpr("id order_id", "cast(id % 400 as string) customer_id"), "customers": spark.range(100, 3_100).selectExpr("id customer_id"), "lines": spark.range(20_000).selectExpr("id div 2 order_id")}
    keys = {"orders": ["order_id"], "customers": ["customer_id"]}
    columns = [("customers", "customer_id"), ("lines", "order_id"), ("orders", "customer_id"), ("orders", "order_id")]
    for values, flags in ((250_000, 62), (500, 1)):
        monkeypatch.setattr(relate, "VALUES", values), monkeypatch.setattr(relate, "FLAGS", flags)
        found = relate.infer_relationships(own, keys, {}).collect()
        assert [(r.from_dataset, r.from_column, r.to_dataset, r.overlap) for r in found] == [("lines", "order_id", "orders", 0.9), ("orders", "customer_id", "customers", 0.75)]
        plan = relate.shared_values(own, columns, set(), 22_400)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and ("45)" in plan or values > 500)


def test_sketched_pairs_of_empty_columns_and_ties(spark):
    none = spark.createDataFrame([(None,)], "item_id string")
    own = {"a": none, "b": spark.createDataFrame([("",), (" x",)], "item_id string"), "c": spark.createDataFrame([("x",), ("",), ("x",)], "item_id string"), "d": none.limit(0)}
    found = relate.infer_relationships(own, {d: ["item_id"] for d in own}, {}).collect()
    assert {(r.from_dataset, r.to_dataset, r.overlap) for r in found} == {("b", "c", 1.0), ("c", "b", 1.0)}
    assert relate.infer_relationships({"a": none}, {"a": ["item_id"]}, {}).count() == 0


def test_readers_and_conform(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "a.tsv").write_text("id\tname\n1\tx,z\n")
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    read = lambda n: readers.read_remote(spark, f"{tmp_path}/{n}")
    assert (read("a.csv").count(), read("a.tsv").first().name, read("a.jsonl").count(), read("a.json").count()) == (2, "x,z", 2, 2)
    assert {(r.name, r.logical_type, r.rows) for r in readers.describe(read("a.csv")).collect()} == {("id", "integer", 2), ("name", "string", 2)}
    text = spark.createDataFrame([("1,200", "$3.5", "12%", "Yes", "2024-01-02 03:04:05", "x")], "i string, f string, d string, b string, t string, n string")
    got = readers.conform(text, {"i": "integer", "f": "float", "d": "decimal", "b": "boolean", "t": "timestamp", "n": "integer", "gone": "date"}).first()
    assert (got.i, got.f, float(got.d), got.b, str(got.t), got.n, got.gone) == (1200, 3.5, 12.0, True, "2024-01-02 03:04:05", None, None)
    path = readers.write_layer(text.limit(0), str(tmp_path), "bronze", "none")
    assert spark.read.parquet(path).columns == text.columns


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).withColumn("v", F.col("id") * 2).write.format("jdbc").options(url=url, dbtable="T", driver=driver).save()
    got = readers.read_table_jdbc(spark, url, "T", "ID", 4, driver=driver)
    assert got.count() == 100 and got.rdd.getNumPartitions() == 4


def test_streams(spark, tmp_path):
    src, kind = f"{tmp_path}/in", "k int, v string, ts timestamp"
    t = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    spark.createDataFrame([(1, "a", t(1)), (2, "b", t(1)), (-1, "bad", t(1))], kind).write.mode("append").parquet(src)
    go = lambda: streams.stream_ingest(spark, src, kind, f"{tmp_path}/out", ["k"], f"{tmp_path}/cp", "ts").awaitTermination()
    go()
    spark.createDataFrame([(2, "B", t(2))], kind).write.mode("append").parquet(src)
    go()
    assert {r.k: r.v for r in streams.current(spark, f"{tmp_path}/out").collect()} == {1: "a", 2: "B", -1: "bad"}
    stream = lambda: spark.readStream.schema(kind).parquet(src)
    streams.stream_quality(stream(), [quality.Rule("non_negative", ("k",))], f"{tmp_path}/c", f"{tmp_path}/q", f"{tmp_path}/cp2", "r").awaitTermination()
    assert (spark.read.parquet(f"{tmp_path}/c").count(), spark.read.parquet(f"{tmp_path}/q").count()) == (3, 1)
    streams.stream_scd2(stream(), f"{tmp_path}/h", ["k"], "ts", f"{tmp_path}/cp3").awaitTermination()
    assert streams.current(spark, f"{tmp_path}/h").where(history.CURRENT).count() == 3
    daily = streams.stream_summary(stream(), "ts", [], ["k"]).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    daily.processAllAvailable()
    daily.stop()
    assert {str(r.period)[:10]: r.record_count for r in spark.sql("select * from daily").collect()} == {"2024-01-01": 3, "2024-01-02": 1}
    once = streams.stream_dedupe(stream(), ["k"], "ts", "10 days").writeStream.format("memory").queryName("once").outputMode("append").start()
    once.processAllAvailable()
    once.stop()
    assert spark.sql("select count(*) n from once").first().n == 3


def test_drifting_json_keeps_every_line(spark, tmp_path):
    lines = ['{"a": 1, "b\'c": [1, 2], "_LINE": 3}', "", '{"a": 2.5, "A": true, "o": {"x": null}}', "[1]", '{"a"', "{}", "null", '{"t": "x"}', '{"t": 7}']
    (tmp_path / "d.jsonl").write_text("\n".join(lines) + "\n")
    got = readers.read_drifting_json(spark, f"{tmp_path}/d.jsonl")
    assert sorted(got.columns) == sorted(["A", "a_", "b'c", "o", "t", "_LINE_", "_line", "_reason"])
    rows = {r["_line"]: r for r in got.collect()}
    assert len(rows) == len(lines) and {k: r["_reason"] for k, r in rows.items() if r["_reason"]} == {"": "blank", "[1]": "not an object", '{"a"': "not json", "null": "not an object"}
    first, third = rows[lines[0]], rows[lines[2]]
    assert (float(first["a_"]), first["b'c"], first["_LINE_"]) == (1.0, "[1,2]", 3) and (float(third["a_"]), third["A"], third["o"]) == (2.5, True, '{"x":null}')
    assert [rows[x]["t"] for x in lines[-2:]] == ["x", "7"]
    (tmp_path / "e.jsonl").write_text("")
    assert readers.read_drifting_json(spark, f"{tmp_path}/e.jsonl").columns == ["_line", "_reason"]


def test_counts_alone_are_those_of_the_whole_profile_and_take_one_pass_a_column(spark, monkeypatch):
    rows = [(1, "a", 1.5, None, '{"a": 1}'), (2, "a", float("nan"), None, None), (3, None, -0.0, None, "{}"), (4, "b", 0.0, None, "[]"), (5, "b", float("nan"), None, "{}")]
    df = spark.createDataFrame(rows, "k bigint, t string, x double, none int, j string").withColumns({"d": F.col("x").cast("decimal(38,2)"), "b": F.col("t").cast("binary"), "m": F.map_from_arrays(F.array("k"), F.array("k"))})
    counts = ["column", "position", "logical_type", "distinct_is_exact", "rows", "nulls", "distinct_count", "null_pct", "distinct_pct", "is_unique", "is_constant"]
    told = lambda frame, details: [tuple(r) for r in profile.profile(frame, details=details).select(*counts).orderBy("position").collect()]
    frames = [df, df.limit(0), df.select("b")]
    want = [told(frame, True) for frame in frames]
    monkeypatch.setattr(profile, "_wide", lambda *_: pytest.fail("a pass for estimates"))
    assert [told(frame, False) for frame in frames] == want


def test_values_are_converted_once_each_and_measured_as_rows_are(spark, monkeypatch):
    rows = [(i, "xyz"[i % 3] if i % 7 else None, None if i % 11 == 0 else (i % 5) / 8 - 0.25, f"{i % 4}.{i % 4}", "12"[i % 2], float(i % 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "k bigint, flag string, amount double, price string, zone string, total_cost double")
    types = {"amount": "decimal(38,2)", "price": "decimal(12,1)", "flag": "string", "zone": "int"}
    typed = profile.conformed(df, types)
    told = lambda frame, **how: [tuple(r) for r in profile.profile(frame, details=False, **how).orderBy("position").collect()]
    odd = spark.createDataFrame([(1.001, -0.0), (1.002, 0.0), (None, 1.5), (1.001, 2.0)], "a double, b double")
    as_text = {"a": "decimal(38,2)", "b": "string"}
    assert told(df, types=types) == told(typed) and told(odd, types=as_text) == told(profile.conformed(odd, as_text))
    assert [r[6] for r in told(odd, types=as_text)] == [1, 4]
    facts = profile.profile(df, details=False, types=types).collect()
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString().splitlines()
    by_row = lambda frame: [x for x in plan(frame) if "Project [" in x and ("cast(amount" in x or "cast(price" in x)]
    for by in ("flag", "zone", None):
        ways = []
        for least in (1, 10**9):
            monkeypatch.setattr(summarise, "WEIGHED", least)
            ways.append(summarise.measure_all(df, facts, by=by, types=types))
        few, all_rows = ways
        assert not by_row(few) and by_row(all_rows)
        assert [(f.name, f.dataType) for f in few.schema] == [(f.name, f.dataType) for f in all_rows.schema]
        own = lambda frame: sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in frame.collect()), key=str)
        assert own(few) == own(all_rows) and len(own(few)) == {"flag": 4, "zone": 2, None: 1}[by]
