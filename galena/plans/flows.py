"""Registered queries that write and read again: sources, layers, loads, runs, derived models, streams."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.operators import history, ingest, profile, quality, refine, relate, summarise
from galena.plans import derive, lineage, runs, tiles
from galena.plans.catalogue import CHANGED, HISTORY, JUDGED, MONEY, RULES, changed_customers, messy_orders, plain, registered, sales_model, table
from galena.plans.metrics import MetricQuery, metric_query
from galena.sources import readers, stored
from galena.sources.folders import work_folder
from galena.streaming import streams

AT = "2026-01-01"
EVENTS = "select event_id, user_id, event_type, value from events"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


# --- sources and layers -------------------------------------------------------------------------------------------------

@registered(EVENTS)
def read_delimited_events(spark, sf_dir):
    """Events through csv files, types inferred."""
    path = work_folder(spark, "events") + ".csv"
    events(spark, sf_dir).write.csv(path, header=True)
    return readers.read_delimited(spark, path)


@registered(EVENTS)
def read_json_events(spark, sf_dir):
    """Events through files of one document a line."""
    path = work_folder(spark, "events") + ".jsonl"
    events(spark, sf_dir).write.json(path)
    return readers.read_json(spark, path).select("event_id", "user_id", "event_type", "value")


@registered("""select case when event_type <> 'purchase' then event_id end event_id, case when event_type = 'purchase' then null when value < 50 then cast(props->'k' as varchar) else 'k' || cast(props->'k' as varchar) end k,
case when event_type <> 'purchase' and value >= 50 then user_id * 2 end twice, case when event_type = 'purchase' then 'not json' end reason from events""")
def read_drifting_events(spark, sf_dir):
    """Events as lines of JSON that drift: a number becomes a text and a field comes in with higher values; lines of
    purchases are cut off and stay as rows with a reason."""
    path = work_folder(spark, "drifting") + ".jsonl"
    own = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    early = F.format_string('{"event_id": %d, "k": %s}', "event_id", "k")
    later = F.format_string('{"event_id": %d, "k": "k%s", "twice": %d}', F.col("event_id"), F.col("k"), F.col("user_id") * 2)
    line = F.when(F.col("value") < 50, early).otherwise(later)
    own.select(F.when(F.col("event_type") == "purchase", F.substring(line, 1, 9)).otherwise(line)).write.text(path)
    return readers.read_drifting_json(spark, path).select("event_id", "k", "twice", F.col("_reason").alias("reason"))


@registered("select c_custkey, c_name, c_mktsegment from customer")
def read_remote_customer(spark, sf_dir):
    return readers.read_remote(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")


@registered("select n_nationkey, n_name from nation")
def read_parquet_nation(spark, sf_dir):
    return readers.read_parquet(spark, f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")


@registered("select least(100, count(*)) n, count(*) > 100 truncated from customer union all select least(100, count(*)), count(*) > 100 from nation")
def sample_tables(spark, sf_dir):
    """How many rows a sample of 100 has, and whether it left any out: of customer, and of nation."""
    own = [readers.sample(table(spark, sf_dir, t), 100) for t in ("customer", "nation")]
    one = lambda s: s.rows.agg(F.count(F.lit(1)).alias("n")).withColumn("truncated", F.lit(s.truncated))
    return one(own[0]).unionByName(one(own[1]))


@registered("select p_partkey, p_name from part where p_size > 25 union all select p_partkey + 1000000, p_name from part where p_size <= 25")
def write_layer_part(spark, sf_dir):
    """A silver table written, replaced and appended to, as it lies there."""
    root, part = work_folder(spark, "layers"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    readers.write_layer(part, root, "silver", "part")
    readers.write_layer(part.where("p_size > 25"), root, "silver", "part")
    path = readers.write_layer(part.where("p_size <= 25").withColumn("p_partkey", F.col("p_partkey") + 1_000_000), root, "silver", "part", "append")
    return spark.read.parquet(path).select("p_partkey", "p_name")


@registered(f"""select cast(date_trunc('month', o_orderdate) as date) month_of_ordered, count(*) order_count, cast(sum({MONEY}) as double) revenue from orders group by 1 order by 1 desc limit 60""")
def export_trend(spark, sf_dir):
    """A tile's rows as they lie in the exported file."""
    model, root = sales_model(spark, sf_dir), work_folder(spark, "export")
    tile = tiles.Tile("by month", "combo", ("order_count", "revenue"), time="orders.ordered")
    tiles.export_tiles(tiles.run_dashboard(model, [tile]), tiles.about_tiles(spark, model, [tile]), root)
    out = readers.read_delimited(spark, f"{root}/by_month", "month_of_ordered timestamp, order_count bigint, revenue double")
    return out.withColumn("month_of_ordered", F.col("month_of_ordered").cast("date"))


# --- loads, layers, runs ------------------------------------------------------------------------------------------------

@registered("select event_id, case when ts > timestamp '2024-01-10 00:00:00' then upper(event_type) else event_type end event_type, (select count(*) from events where ts > timestamp '2024-01-10 00:00:00') rows_read from events")
def load_bronze_events(spark, sf_dir):
    """Two loads of events: the second reads what is later than the first one's last, and only that is new."""
    own, root = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").alias("updated_at")), work_folder(spark, "bronze")
    first = own.where(F.col("updated_at") <= F.lit(datetime.datetime(2024, 1, 10)))
    ingest.save_state(ingest.load_bronze(first, root, "events", ["event_id"], ingest.read_state(spark, root))["state"], root)
    second = ingest.load_bronze(own.withColumn("event_type", F.upper("event_type")), root, "events", ["event_id"], ingest.read_state(spark, root))
    return ingest.read_bronze(spark, root, "events").select("event_id", "event_type", F.lit(second["rows_read"]).cast("bigint").alias("rows_read"))


def put(rows: DataFrame | str, path: str, spark: SparkSession) -> None:
    """One file of that name in whatever store the path is of: rows as parquet, or a text."""
    own = spark.createDataFrame([(rows,)], "value string") if isinstance(rows, str) else rows
    folder = work_folder(spark, "put")
    own.coalesce(1).write.format("text" if isinstance(rows, str) else "parquet").save(folder)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    store = paths(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    made = next(f.getPath() for f in store.listStatus(paths(folder)) if f.getPath().getName().startswith("part-"))
    store.mkdirs(paths(path).getParent())
    store.delete(paths(path), False)
    store.rename(made, paths(path))


@registered("select event_id, case event_id % 4 when 1 then upper(event_type) when 2 then 'mended' else event_type end event_type, case event_id % 4 when 0 then 1 when 3 then 1 else 2 end tries from events")
def load_changed_files(spark, sf_dir):
    """Events from four files, loaded three times. The second time one file has changed and one that was broken is whole;
    before the third, one that was loaded breaks, and its rows stay. tries: loads of each file, the third aside."""
    own, root, src = table(spark, sf_dir, "events").select("event_id", "event_type"), work_folder(spark, "bronze"), work_folder(spark, "files")
    for i in range(4):
        put("no parquet" if i == 2 else own.where(F.col("event_id") % 4 == i), f"{src}/events-{i}.parquet", spark)
    load = lambda: ingest.load_files(ingest.list_files(spark, src), root, "events", own.schema)
    load()
    put(own.where("event_id % 4 = 1").withColumn("event_type", F.upper("event_type")), f"{src}/events-1.parquet", spark)
    put(own.where("event_id % 4 = 2").withColumn("event_type", F.lit("mended")), f"{src}/events-2.parquet", spark)
    load()
    registry = ingest.read_registry(spark, root, "events").groupBy("path").agg(F.count(F.lit(1)).alias("tries"))
    tries = {int(r.path[-9]): r.tries for r in registry.collect()}
    put("broken later", f"{src}/events-3.parquet", spark)
    load()
    told = F.element_at(F.create_map(*[F.lit(x) for i, n in tries.items() for x in (i, n)]), (F.col("event_id") % 4).cast("int"))
    return ingest.read_bronze(spark, root, "events").select("event_id", "event_type", told.alias("tries"))


@registered(f"select * from {CHANGED} union all select c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment from customer c where c_custkey not in (select c_custkey from {CHANGED})")
def upsert_stored_customers(spark, sf_dir):
    """Customers in a table of buckets, after an upsert that rewrites the buckets of changed customers."""
    path, keys = work_folder(spark, "stored"), ["c_custkey"]
    fold = lambda old, new: ingest.upsert(old, new, keys)
    first = stored.folded(path, table(spark, sf_dir, "customer"), keys, fold)
    stored.folded(path, changed_customers(spark, sf_dir), keys, fold, first)
    return stored.read(spark, path)


CLEAN = f"""(select distinct "Order ID" order_id, customer_key, nullif(trim(status), '') status, nullif(trim(amount_text), '') amount_text, cast(cast(total_price as decimal(38,2)) as double) total_price, cast(order_date as date) order_date from {JUDGED} where rejects = '') c"""


@registered(f"select *, date '{AT}' refined_on, (select count(*) from {JUDGED} where rejects <> '') rejected from {CLEAN}")
def refine_silver_orders(spark, sf_dir):
    """The messy extract as it is refined after its rules, with the time of refinement and the number of rejected rows."""
    df = messy_orders(spark, sf_dir)
    facts = profile.profile(df).collect()
    rules = tuple(r for r in RULES if r.severity == "reject")
    out, rejected = runs.refine_silver(df, facts, rules, work_folder(spark, "silver"), "orders", "run-1", F.lit(AT).cast("timestamp"), profile.duplicate_ratio(df).first().duplicate_ratio)
    return plain(out).withColumn("refined_on", F.col(refine.REFINED_AT).cast("date")).drop(refine.REFINED_AT).withColumn("rejected", F.lit(rejected).cast("bigint"))


@registered("select o_orderstatus, count(*) orders, avg(o_custkey) avg_custkey from orders group by 1")
def carry_gold_orders(spark, sf_dir):
    """A table of averages goes to gold as it is."""
    gold = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.avg("o_custkey").alias("avg_custkey"))
    return spark.read.parquet(readers.write_layer(summarise.carry_gold(gold), work_folder(spark, "gold"), "gold", "orders"))


@registered(f"""select 'orders' dataset, 'bronze' step, 'succeeded' status, (select count(*) from {JUDGED}) as "rows" union all select 'orders', 'silver', 'succeeded', (select count(*) from {CLEAN})
union all select 'orders', 'gold', 'succeeded', (select count(*) from (select distinct date_trunc('month', order_date), status from {CLEAN})) union all select 'broken', 'bronze', 'succeeded', (select count(*) from nation) union all select 'broken', 'silver', 'failed', null""")
def run_medallion_orders(spark, sf_dir):
    """The log of a run of three layers, in which one of two datasets fails at its rules.

    Prices are in whole hundreds, as a number that no other row has is not summed up.
    """
    rows = messy_orders(spark, sf_dir).withColumn("total_price", F.floor(F.col("total_price") / 100) * 100.0)
    own = runs.Dataset("orders", rows, rules=tuple(r for r in RULES if r.severity == "reject"))
    broken = runs.Dataset("broken", table(spark, sf_dir, "nation"), rules=(quality.Rule("not_null", ("nothing",)),))
    return runs.run_medallion([own, broken], work_folder(spark, "run"), "run-1", F.lit(AT).cast("timestamp")).select("dataset", "step", "status", "rows")


@registered(f"select * from {CHANGED} union all select c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment from customer c where c_custkey not in (select c_custkey from {CHANGED})")
def run_medallion_incremental(spark, sf_dir):
    """Bronze after two runs of a dataset with a key: the second run brings changed and new customers."""
    root, at = work_folder(spark, "run"), F.lit(AT).cast("timestamp")
    for run, rows in (("run-1", table(spark, sf_dir, "customer")), ("run-2", changed_customers(spark, sf_dir))):
        log = runs.run_medallion([runs.Dataset("customer", rows, rules=(), keys=("c_custkey",), full=run == "run-1")], root, run, at)
        assert log.where("step = 'bronze' and status = 'succeeded'").count() == 1, log.collect()
    return ingest.read_bronze(spark, root, "customer")


@registered("""select column_name source_column, column_name target_column, 'ingest' via, cast(null as varchar) transform from (describe orders)
union all select 'o_totalprice', 'revenue', 'model', 'sum' union all select '*', 'order_count', 'model', 'count'""")
def lineage_edges(spark, sf_dir):
    """The edges that an ingest of orders and the measures of its model declare."""
    model = sales_model(spark, sf_dir)
    declared = lineage.identity_edges(table(spark, sf_dir, "orders"), "orders_raw", "orders", "ingest")
    measured = lineage.measure_edges(spark, model).where("target_column in ('revenue', 'order_count')").withColumn("source_column", F.regexp_replace("source_column", "^price$", "o_totalprice"))
    return declared.unionByName(measured).select("source_column", "target_column", "via", "transform")


# --- derived models -----------------------------------------------------------------------------------------------------

@registered("""select c_mktsegment segment, count(*) orders_count, cast(sum(cast(o_totalprice as decimal(38,2))) as double) total_order_price from orders join customer on o_custkey = c_custkey group by 1""")
def derived_model_by_segment(spark, sf_dir):
    """A metric of a model that is derived from profiles, keys and inferred relationships alone."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_key"), F.col("o_orderdate").alias("order_date"), F.col("o_totalprice").cast("decimal(38,2)").alias("order_price"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_key"), F.col("c_mktsegment").alias("segment"))
    own = {"orders": orders, "customers": customers}
    facts = {n: profile.profile(df).collect() for n, df in own.items()}
    keys = {n: profile.key_candidates(df, facts[n])[0] for n, df in own.items()}
    found = relate.infer_relationships(own, keys, {n: {k[0]} for n, k in keys.items()}).collect()
    made = derive.derive_model([derive.Table(n, df, facts[n], tuple(keys[n])) for n, df in own.items()], found)
    return plain(metric_query(made.model, MetricQuery(("orders_count", "total_order_price"), ("customers.segment",))))


# --- streams ------------------------------------------------------------------------------------------------------------

def staged(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[str, DataFrame]:
    """A folder of event files, and the stream that reads it."""
    own = table(spark, sf_dir, "events").select(*[F.col(c).cast("timestamp").alias(c) if c == "ts" else c for c in columns])
    path = work_folder(spark, "stream-in")
    own.write.parquet(path)
    return path, spark.readStream.schema(own.schema).parquet(path)


def finished(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """What a stream leaves when it has read all there is."""
    out = work_folder(spark, "stream-out")
    frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


@registered("select event_id, user_id, event_type from events")
def stream_ingest_events(spark, sf_dir):
    """Files of events, the second half of them arriving later, upserted by a stream."""
    own, path, out = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), work_folder(spark, "stream-in"), work_folder(spark, "stream-out")
    for part in (own.where("event_id % 2 = 0").withColumn("event_type", F.lit("early")), own):
        part.write.mode("append").parquet(path)
        streams.stream_ingest(spark, path, own.schema, out, ["event_id"], f"{out}-at", "ts").awaitTermination()
    return streams.current(spark, out).select("event_id", "user_id", "event_type")


@registered("select event_id, 'clean' part, null rule from events where not (value < 10 or value > 90) union all select event_id, 'quarantine', 'range:value' from events where value < 10 or value > 90")
def stream_quality_events(spark, sf_dir):
    """Events judged by a rule as they come."""
    _, stream = staged(spark, sf_dir, "event_id", "value")
    out = work_folder(spark, "stream-out")
    rule = quality.Rule("range", ("value",), low=10, high=90)
    streams.stream_quality(stream, [rule], f"{out}/clean", f"{out}/held", f"{out}-at", "run-1").awaitTermination()
    good = spark.read.parquet(f"{out}/clean").select("event_id", F.lit("clean").alias("part"), F.lit(None).cast("string").alias("rule"))
    return good.unionByName(spark.read.parquet(f"{out}/held").select("event_id", F.lit("quarantine").alias("part"), F.col("_dq_rule").alias("rule")))


@registered("select distinct user_id, event_type from events")
def stream_dedupe_events(spark, sf_dir):
    """The first event of each user and type within a year."""
    _, stream = staged(spark, sf_dir, "user_id", "event_type", "ts")
    return finished(spark, streams.stream_dedupe(stream, ["user_id", "event_type"], "ts", "365 days").select("user_id", "event_type"))


LATE_DAYS, PARTS = 3, ("2024-01-01", "2024-01-10", "2024-01-20", "2024-03-01")


@registered(f"""with e as (select cast(date_trunc('day', ts) as date) period, * from events)
select period, event_type, count(*) record_count, round(sum(value), 3) total_value from e where period + interval 1 day <= (select max(ts) from events) - interval 1 day group by 1, 2""")
def stream_summary_events(spark, sf_dir):
    """Events by day and type, as their days are closed: files come in the order of their times, the last one with copies
    of events of the first days, which are late and left out; days that the watermark has not passed are not told yet."""
    own = table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    path = work_folder(spark, "stream-in")
    day = F.datediff(F.col("ts"), F.lit(PARTS[0]))
    for lo, hi in zip(PARTS, PARTS[1:], strict=False):
        rows = own.where((F.col("ts") >= lo) & (F.col("ts") < hi))
        rows = rows.unionByName(own.where(day < LATE_DAYS)) if hi == PARTS[-1] else rows
        rows.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(path)
    summary = streams.stream_summary(stream, "ts", ["event_type"], ["value"], "1 day")
    return finished(spark, summary).select(F.col("period").cast("date").alias("period"), "event_type", "record_count", F.round("total_value", 3).alias("total_value"))


def versions_sql(rows: str) -> str:
    """Where the last event type of a user changes, of rows (user_id, ts, event_type, late); late rows count at equal times."""
    once = f"select *, row_number() over (partition by user_id, ts order by late desc, event_type desc) rn from {rows}"
    return f"select user_id, ts, event_type from (select *, lag(event_type) over (partition by user_id order by ts) was from ({once}) o where rn = 1) c where was is null or was <> event_type"


EARLY = f"({versions_sql('(select *, 0 late from events where event_id % 3 <> 0) e')}) v"


@registered(f"""with v as ({versions_sql(f"(select *, 0 late from {EARLY} union all select user_id, ts, event_type, 1 from events where event_id % 3 = 0) u")})
select user_id, event_type, epoch_us(ts) valid_from, epoch_us(lead(ts) over (partition by user_id order by ts)) valid_to, lead(ts) over (partition by user_id order by ts) is null is_current from v""")
def stream_scd2_events(spark, sf_dir):
    """What each user did last, over time: a first batch with many changes of a user, and a second one with events that fall
    between those."""
    own = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path, out = work_folder(spark, "stream-in"), work_folder(spark, "stream-out")
    for late in (False, True):
        rows = own.where((F.col("event_id") % 3 == 0) == F.lit(late)).drop("event_id")
        rows.write.mode("append").parquet(path)
        streams.stream_scd2(spark.readStream.schema(rows.schema).parquet(path), out, ["user_id"], "ts", f"{out}-at").awaitTermination()
    h = streams.current(spark, out)
    return h.select("user_id", "event_type", F.unix_micros(history.FROM).alias("valid_from"), F.unix_micros(history.TO).alias("valid_to"), F.col(history.CURRENT).alias("is_current"))


@registered("""with v as (select user_id, ts, max(event_type) event_type from events where event_type <> 'click' group by 1, 2)
select c.event_id, v.event_type as last_action from (select * from events where event_type = 'click') c asof left join v on c.user_id = v.user_id and c.ts >= v.ts""")
def as_of_join_events(spark, sf_dir):
    """Each click with what its user had done last before it."""
    own = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    acts = own.where("event_type <> 'click'").select("user_id", F.col("event_type").alias("last_action"), "ts")
    clicks = own.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return history.as_of_join(clicks, history.scd2_events(None, acts, ["user_id"], "ts"), ["user_id"], "ts").select("event_id", "last_action")


@registered(f"select * from {HISTORY}")
def stream_scd2_customer(spark, sf_dir):
    """The history of customers after two batches of a stream."""
    path, out, own = work_folder(spark, "stream-in"), work_folder(spark, "stream-out"), None
    for rows, at in ((table(spark, sf_dir, "customer"), "2026-01-01"), (changed_customers(spark, sf_dir), "2026-02-01")):
        own = rows.withColumn("seen_at", F.lit(at).cast("timestamp"))
        own.write.mode("append").parquet(path)
        streams.stream_scd2(spark.readStream.schema(own.schema).parquet(path), out, ["c_custkey"], "seen_at", f"{out}-at").awaitTermination()
    h = streams.current(spark, out)
    return h.select("c_custkey", "c_mktsegment", F.col(history.CURRENT).alias("is_current"), F.col(history.FROM).cast("date").alias("valid_from"), F.col(history.TO).cast("date").alias("valid_to"))


