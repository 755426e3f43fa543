"""Every registered query over the given tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import masks, names
from galena.operators import classify, history, ingest, profile, quality, refine, relate, summarise
from galena.plans import lineage, pages, runs, tiles
from galena.plans.metrics import Attribute, Entity, Filter, Join, Measure, MetricQuery, Model, Refused, dimension_values, metric_query
from galena.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL twin if it has one."""

    def add(function: Query) -> Query:
        own = name or function.__name__
        QUERIES[own] = function
        if sql:
            ORACLE_SQL[own] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- metric queries -------------------------------------------------------------------------------------------------


def sales_model(spark: SparkSession, sf_dir: str) -> Model:
    t = lambda n: table(spark, sf_dir, n)
    money = t("orders").withColumn("price", F.col("o_totalprice").cast("decimal(38,2)"))
    lines = t("lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(38,2)"))
    at = lambda *names: tuple(Attribute(n) for n in names)
    return Model(
        (
            Entity("orders", money, (Attribute("ordered", "o_orderdate"), Attribute("status", "o_orderstatus"), Attribute("priority", "o_orderpriority"), Attribute("key", "o_orderkey"))),
            Entity("customer", t("customer"), (Attribute("segment", "c_mktsegment"), Attribute("name", "c_name", pii="person_name"), Attribute("number", "c_custkey"))),
            Entity("nation", t("nation"), (Attribute("nation", "n_name"),)),
            Entity("region", t("region"), (Attribute("region", "r_name"),)),
            Entity("lines", lines, (Attribute("flag", "l_returnflag"), Attribute("shipped", "l_shipdate"))),
            Entity("part", t("part"), (Attribute("brand", "p_brand"), *at("p_type"))),
        ),
        (
            Measure("revenue", "orders", "sum", "price", format="money"),
            Measure("order_count", "orders", "count"),
            Measure("avg_price", "orders", "avg", "o_totalprice", format="money"),
            Measure("min_price", "orders", "min", "price"),
            Measure("max_price", "orders", "max", "price"),
            Measure("priced", "orders", "count", "o_totalprice"),
            Measure("customers", "orders", "count_distinct", "o_custkey"),
            Measure("median_price", "orders", "median", "o_totalprice"),
            Measure("finished", "orders", "sum", "price", Filter("o_orderstatus", "eq", "F")),
            Measure("finished_count", "orders", "count", None, Filter("o_orderstatus", "eq", "F")),
            Measure("line_revenue", "lines", "sum", "price"),
            Measure("line_count", "lines", "count"),
            Measure("returned", "lines", "sum", "price", Filter("l_returnflag", "eq", "R")),
        ),
        (
            Join("orders", "customer", (("o_custkey", "c_custkey"),)),
            Join("customer", "nation", (("c_nationkey", "n_nationkey"),)),
            Join("nation", "region", (("n_regionkey", "r_regionkey"),)),
            Join("lines", "orders", (("l_orderkey", "o_orderkey"),)),
            Join("lines", "part", (("l_partkey", "p_partkey"),)),
        ),
    )


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and timestamps as dates, as the SQL twins give them."""
    kind = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select(*[F.col(c).cast("double").alias(c) if k == "decimal" else F.col(c).cast("date").alias(c) if k.startswith("timestamp") else F.col(c) for c, k in kind.items()])


SALES = """orders o left join customer c on o.o_custkey = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey
left join region r on n.n_regionkey = r.r_regionkey"""
MONEY = "cast(o_totalprice as decimal(38,2))"


@registered(f"""select cast(date_trunc('month', o_orderdate) as date) month_of_ordered, r_name region, cast(sum({MONEY}) as double) revenue,
count(*) order_count from {SALES} group by 1, 2""")
def metric_revenue_by_region_month(spark, sf_dir):
    query = MetricQuery(("revenue", "order_count"), ("region.region",), "orders.ordered", "month", limit=50_000)
    return plain(metric_query(sales_model(spark, sf_dir), query))


@registered(f"""select cast(sum({MONEY}) as double) revenue, count(*) order_count, round(avg(o_totalprice), 4) avg_price,
cast(min({MONEY}) as double) min_price, cast(max({MONEY}) as double) max_price, count(o_totalprice) priced,
count(distinct o_custkey) customers, median(o_totalprice) median_price from orders""")
def metric_aggregations(spark, sf_dir):
    names = ("revenue", "order_count", "avg_price", "min_price", "max_price", "priced", "customers", "median_price")
    return plain(metric_query(sales_model(spark, sf_dir), MetricQuery(names))).withColumn("avg_price", F.round("avg_price", 4))


@registered(f"""select o_orderpriority priority, cast(sum(case when o_orderstatus = 'F' then {MONEY} end) as double) finished,
count(*) filter (where o_orderstatus = 'F') finished_count, count(*) order_count from orders group by 1""")
def metric_filtered_measure(spark, sf_dir):
    return plain(metric_query(sales_model(spark, sf_dir), MetricQuery(("finished", "finished_count", "order_count"), ("orders.priority",))))


FILTERS = {
    "eq": (Filter("orders.status", "eq", "F"), "o_orderstatus = 'F'"),
    "ne": (Filter("orders.status", "ne", "F"), "o_orderstatus <> 'F'"),
    "gt": (Filter("orders.key", "gt", 500), "o_orderkey > 500"),
    "gte": (Filter("orders.key", "gte", 500), "o_orderkey >= 500"),
    "lt": (Filter("orders.key", "lt", 500), "o_orderkey < 500"),
    "lte": (Filter("orders.key", "lte", 500), "o_orderkey <= 500"),
    "in": (Filter("region.region", "in", ["ASIA", "EUROPE"]), "r_name in ('ASIA', 'EUROPE')"),
    "not_in": (Filter("region.region", "not_in", ["ASIA"]), "r_name not in ('ASIA')"),
    "contains": (Filter("customer.segment", "contains", "UI"), "contains(c_mktsegment, 'UI')"),
    "starts_with": (Filter("customer.segment", "starts_with", "B"), "starts_with(c_mktsegment, 'B')"),
    "between": (Filter("orders.key", "between", (10, 900)), "o_orderkey between 10 and 900"),
    "is_null": (Filter("region.region", "is_null"), "r_name is null"),
    "is_not_null": (Filter("region.region", "is_not_null"), "r_name is not null"),
}
for _op, (_filter, _where) in FILTERS.items():
    registered(f"select o_orderpriority priority, count(*) order_count, cast(sum({MONEY}) as double) revenue from {SALES} where {_where} group by 1", f"metric_filter_{_op}")(
        lambda spark, sf_dir, f=_filter: plain(metric_query(sales_model(spark, sf_dir), MetricQuery(("order_count", "revenue"), ("orders.priority",), filters=(f,))))
    )

for _grain in ("day", "week", "month", "quarter", "year"):
    registered(f"select cast(date_trunc('{_grain}', o_orderdate) as date) {_grain}_of_ordered, count(*) order_count from orders group by 1", f"metric_grain_{_grain}")(
        lambda spark, sf_dir, g=_grain: plain(metric_query(sales_model(spark, sf_dir), MetricQuery(("order_count",), time="orders.ordered", grain=g, limit=50_000)))
    )


@registered(f"""select c_custkey number, cast(sum({MONEY}) as double) revenue from {SALES} group by 1
order by 2 desc nulls last, 1 limit 20""")
def metric_topk_customers(spark, sf_dir):
    return plain(metric_query(sales_model(spark, sf_dir), MetricQuery(("revenue",), ("customer.number",), limit=20)))


@registered("select p_type, count(*) line_count from lineitem left join part on l_partkey = p_partkey where contains(p_type, 'A') group by 1 order by 2 desc, 1 limit 50")
def metric_dimension_values(spark, sf_dir):
    return dimension_values(sales_model(spark, sf_dir), "part.p_type", "line_count", "A", 50)


@registered("""select l_returnflag, l_linestatus is null no_status, cast(count(*) as bigint) record_count, cast(sum(l_quantity::decimal(38,2)) as double) total_l_quantity,
round(avg(l_quantity), 6) avg_l_quantity, cast(sum(l_extendedprice::decimal(38,2)) as double) total_l_extendedprice, round(avg(l_extendedprice), 4) avg_l_extendedprice,
cast(sum(l_discount::decimal(38,2)) as double) total_l_discount, round(avg(l_discount), 8) avg_l_discount, cast(sum(l_tax::decimal(38,2)) as double) total_l_tax, round(avg(l_tax), 8) avg_l_tax
from lineitem group by 1, 2""")
def measure_all_lineitem(spark, sf_dir):
    money = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    types = dict.fromkeys(money, "decimal(38,2)")
    df, keys = table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_partkey", "l_suppkey")
    own = df.select("l_returnflag", *keys, "l_linenumber", *money)
    asked = summarise.asked_of(profile.conformed(own, types), keys, "l_returnflag")
    facts = profile.profile(own.select(*asked), details=False, types=types).collect()
    out = summarise.measure_all(df, facts, foreign_keys=keys, by="l_returnflag", types=types)
    rounded = {f"avg_{c}": F.round(f"avg_{c}", n) for c, n in zip(money, (6, 4, 8, 8), strict=True)}
    return plain(out).withColumns(rounded).withColumn("no_status", F.lit(False))


ASKED = {
    "orders by segment": MetricQuery(("order_count",), ("customer.segment",)),
    "customers by status": MetricQuery(("customer_count",), ("orders.status",)),
    "orders by line flag": MetricQuery(("order_count",), ("lines.flag",)),
    "orders by name": MetricQuery(("order_count",), filters=(Filter("customer.name", "eq", "x"),)),
    "two facts": MetricQuery(("order_count", "line_count")),
    "no field": MetricQuery(("order_count",), ("orders.nothing",)),
}


@registered("""select 'orders by segment' question, true answered, (select count(*) from (select distinct c_mktsegment from orders left join customer on o_custkey = c_custkey)) as "rows", '' why
union all select 'customers by status', not exists (select 1 from orders group by o_custkey having count(*) > 1), null, 'orders has a key of o_custkey more than once, so joining it would multiply rows'
union all select 'orders by line flag', false, null, 'lines cannot be reached from orders without multiplying its rows' union all select 'orders by name', false, null, 'customer.name is masked, and a filter would tell its values'
union all select 'two facts', false, null, 'measures of two entities' union all select 'no field', false, null, 'no attribute of orders nothing'""")
def metric_refusals(spark, sf_dir):
    """Questions, one of which is answered. A model says that customers have one order each: the rows say no."""
    model = sales_model(spark, sf_dir)
    model = Model(model.entities, (*model.measures, Measure("customer_count", "customer", "count")), (*model.joins, Join("customer", "orders", (("c_custkey", "o_custkey"),), "one_to_one")))
    out = []
    for name, query in ASKED.items():
        try:
            out.append((name, True, metric_query(model, query).count(), ""))
        except Refused as why:
            out.append((name, False, None, str(why)))
    return spark.createDataFrame(out, "question string, answered boolean, rows bigint, why string")


# --- masks ----------------------------------------------------------------------------------------------------------

PEOPLE = """(select c_custkey, c_name as full_name, case when c_custkey % 17 = 0 then null when c_custkey % 13 = 0 then 'nobody' else 'user' || c_custkey || '@' || lower(c_mktsegment) || '.com' end as email,
case when c_custkey % 19 = 0 then '12' else '+1 415 555 ' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') end as phone, '10.0.' || (c_custkey % 256) || '.7' as ip, cast(1950 + c_custkey % 50 as varchar) || '-03-09' as born, c_acctbal from customer) p"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_name").alias("full_name"),
        F.when(key % 17 == 0, None).when(key % 13 == 0, "nobody").otherwise(F.concat(F.lit("user"), text(key), F.lit("@"), F.lower("c_mktsegment"), F.lit(".com"))).alias("email"),
        F.when(key % 19 == 0, "12").otherwise(F.concat(F.lit("+1 415 555 "), F.lpad(text(key % 10000), 4, "0"))).alias("phone"),
        F.concat(F.lit("10.0."), text(key % 256), F.lit(".7")).alias("ip"),
        F.concat(text(1950 + key % 50), F.lit("-03-09")).alias("born"),
        "c_acctbal",
    )


MASK_SQL = {
    "domain": ("email", "case when instr(email, '@') > 0 then '•••@' || substr(email, instr(email, '@') + 1) else '••• masked' end"),
    "last4": ("phone", "case when length(phone) >= 4 then '•••' || right(phone, 4) else '••• masked' end"),
    "initials": ("full_name", "case when length(full_name) >= 1 then left(full_name, 1) || '•••' else '••• masked' end"),
    "prefix": ("ip", "case when length(ip) >= 3 then left(ip, 3) || '•••' else '••• masked' end"),
    "year": ("born", "left(born, 4) || '•••'"),
    "redact": ("full_name", "'••• masked'"),
}
for _strategy, (_column, _sql) in MASK_SQL.items():
    registered(f"select c_custkey, case when {_column} is null then null else {_sql} end as masked from {PEOPLE}", f"mask_{_strategy}")(
        lambda spark, sf_dir, s=_strategy, c=_column: people(spark, sf_dir).select("c_custkey", masks.mask(F.col(c), s).alias("masked"))
    )


@registered(f"""select case when email is null then null else {MASK_SQL['domain'][1]} end email, count(*) people, cast(sum(c_acctbal::decimal(38,2)) as double) balance from {PEOPLE} group by 1""")
def mask_before_grouping(spark, sf_dir):
    own = people(spark, sf_dir).withColumn("money", F.col("c_acctbal").cast("decimal(38,2)"))
    model = Model((Entity("people", own, (Attribute("email", pii="email"),)),), (Measure("people", "people", "count"), Measure("balance", "people", "sum", "money")))
    return plain(metric_query(model, MetricQuery(("people", "balance"), ("people.email",))))


@registered(f"""select c_custkey, left(full_name, 1) || '•••' full_name, case when email is null then null else {MASK_SQL['domain'][1]} end email, {MASK_SQL['last4'][1]} phone,
{MASK_SQL['prefix'][1]} ip, {MASK_SQL['year'][1]} born, c_acctbal from {PEOPLE}""")
def mask_table(spark, sf_dir):
    return masks.mask_table(people(spark, sf_dir), {"full_name": "person_name", "email": "email", "phone": "phone", "ip": "ip_address", "born": "date_of_birth"})


# --- profiles -------------------------------------------------------------------------------------------------------

COUNTS = """select '{c}' as "column", cast(count(*) as bigint) as "rows", cast(count(*) - count({c}) as bigint) nulls, count(distinct {c}) distinct_count,
round((count(*) - count({c})) / count(*), 4) null_pct, round(count(distinct {c}) / count(*), 4) distinct_pct, count(distinct {c}) = count(*) and count({c}) = count(*) is_unique, count(distinct {c}) <= 1 is_constant from {t}"""


def each(template: str, **tables: str) -> str:
    return " union all ".join(template.format(c=c, t=t) for t, columns in tables.items() for c in columns.split())


@registered(each(COUNTS, customer="c_custkey c_name c_nationkey c_acctbal c_mktsegment"))
def profile_counts(spark, sf_dir):
    return profile.profile_counts(profile.value_counts(table(spark, sf_dir, "customer")))


NUMBERS = """select '{c}' as "column", cast(min({c}) as double) "min", cast(max({c}) as double) "max", round(avg({c}), 4) mean, round(stddev_pop({c}), 4) stddev,
round(quantile_cont({c}, 0.25), 6) p25, round(quantile_cont({c}, 0.5), 6) p50, round(quantile_cont({c}, 0.75), 6) p75 from {t}"""


@registered(each(NUMBERS, lineitem="l_quantity l_extendedprice l_discount l_linenumber"))
def profile_numeric(spark, sf_dir):
    out = profile.profile_numeric(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")).drop("decimal_places")
    return out.select("column", "min", "max", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), *[F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")])


@registered("""select 'o_orderdate' as "column", strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') "first", strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') "last" from orders""")
def profile_temporal(spark, sf_dir):
    return profile.profile_temporal(table(spark, sf_dir, "orders"))


TEXTS = """select '{c}' as "column", round(avg(length({c})), 6) mean_length, cast(max(length({c})) as bigint) max_length, count(*) filter (where regexp_full_match({c}, '\\s*')) blanks,
left(min({c}), 40) smallest, left(max({c}), 40) largest from {t}"""


@registered(each(TEXTS, events="event_type props", documents="lang source"))
def profile_text(spark, sf_dir):
    both = profile.profile_text(table(spark, sf_dir, "events")).unionByName(profile.profile_text(table(spark, sf_dir, "documents").select("lang", "source")))
    return both.select("column", F.round("mean_length", 6).alias("mean_length"), F.col("max_length").cast("bigint").alias("max_length"), F.col("blanks").cast("bigint").alias("blanks"), "smallest", "largest")


@registered("""with v as (select 'c_mktsegment' as "column", c_mktsegment "value" from customer union all select 'c_nationkey', cast(c_nationkey as varchar) from customer),
n as (select "column", "value", count(*) n from v group by 1, 2), r as (select *, row_number() over (partition by "column" order by n desc, "value") rank, sum(n) over (partition by "column") total from n)
select "column", "value", n, round(n / total, 4) pct, cast(rank as int) rank from r where rank <= 10""")
def profile_top_values(spark, sf_dir):
    return profile.top_values(profile.value_counts(table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey")))


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a messy extract: numbers as text, blanks, nulls, copies, load metadata."""
    key = F.col("o_orderkey")
    money = F.col("o_totalprice").cast("decimal(38,2)").cast("string")
    amount = F.when(key % 97 == 0, "N/A").when(key % 17 == 0, None).when(key % 7 == 0, F.concat(F.lit("$"), money)).otherwise(money)
    own = table(spark, sf_dir, "orders").select(
        F.when(key % 101 != 0, key).alias("Order ID"),
        F.col("o_custkey").alias("customer_key"),
        F.when(key % 13 == 0, "   ").otherwise(F.col("o_orderstatus")).alias("status"),
        amount.alias("amount_text"),
        F.col("o_totalprice").alias("total_price"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("order_date"),
        F.concat(F.lit("batch_"), (key % 4).cast("string")).alias("batch_id"),
        F.col("o_orderkey").alias("__key"),
    )
    return own.unionByName(own.where("__key % 20 = 0")).drop("__key")


MESSY = """(select case when k % 101 <> 0 then k end as "Order ID", o_custkey customer_key, case when k % 13 = 0 then '   ' else o_orderstatus end status,
case when k % 97 = 0 then 'N/A' when k % 17 = 0 then null when k % 7 = 0 then '$' || cast(cast(o_totalprice as decimal(38,2)) as varchar) else cast(cast(o_totalprice as decimal(38,2)) as varchar) end amount_text,
o_totalprice total_price, strftime(o_orderdate, '%Y-%m-%d') order_date, 'batch_' || (k % 4) batch_id
from (select *, o_orderkey k from orders union all select *, o_orderkey k from orders where o_orderkey % 20 = 0)) m"""
AMOUNT = "try_cast(nullif(regexp_replace(amount_text, '[^0-9eE.+-]', '', 'g'), '') as decimal(38,9))"


def shadow_sql(column: str, rows: str) -> str:
    """One row: what a text column of `rows` really holds."""
    share = lambda form, x="v": f"avg(regexp_matches({x}, '{form}')::int)"
    words = ", ".join(f"'{w}'" for w in profile.BOOLEAN_WORDS)
    return f"""select '{column}' as "column", case when count(v) < {profile.SHADOW_LEAST} or min(v) = max(v) then null
when bool_and(lower(v) in ({words})) and count(distinct lower(v)) <= 2 then 'boolean' when {share("^0[^.]")} > 0.05 then null when {share(profile.INTEGER_FORM)} >= 0.95 then 'integer'
when {share(profile.FLOAT_FORM, "replace(v, ',', '')")} >= 0.95 then 'float' when {share(profile.MONEY_FORM)} >= 0.9 then 'decimal'
when {share(profile.DATE_FORM)} >= 0.9 then case when bool_or(regexp_matches(v, '[T ]')) then 'timestamp' else 'date' end end shadow_type from (select nullif(trim({column}), '') v from {rows}) x"""


PLAIN_AMOUNTS = f"(select * replace (replace(amount_text, '$', '') as amount_text) from {MESSY}) p"


@registered(" union all ".join(shadow_sql(c, PLAIN_AMOUNTS) for c in ("amount_text", "order_date", "status", "batch_id")))
def profile_shadow(spark, sf_dir):
    # One amount in 7 has a currency sign, so it is neither: of those without, all but N/A are numbers.
    own = messy_orders(spark, sf_dir).withColumn("amount_text", F.regexp_replace("amount_text", "[$]", ""))
    return profile.shadow_types(own.select("amount_text", "order_date", "status", "batch_id"))


def pii_sql(column: str, rows: str | None = None) -> str:
    """One row: the kind of personal data that a text column of `rows` (PEOPLE) shows by its values and by its name."""
    by_name = profile.pii_of_name(column)
    told = f"'{by_name}'" if by_name else "cast(null as varchar)"
    not_a_date = r"(?!\d{4}-\d{2}-\d{2}$)"  # looking ahead is a condition of its own in SQL
    meets = lambda form: f"(regexp_matches(v, '{form.replace(not_a_date, '')}'){r""" and not regexp_matches(v, '^\d{4}-\d{2}-\d{2}$')""" if not_a_date in form else ""})"
    forms = " ".join(f"when avg({meets(form)}::int) >= {profile.VALUE_SHARE} then '{kind}'" for kind, form in profile.PII_FORMS)
    return f"""select '{column}' as "column", case {forms} end by_value, {told} by_name from (select nullif(trim({column}), '') v from {rows or PEOPLE}) x"""


def pii_told(names: str) -> str:
    """Kind, confidence and basis as columns of these names, of rows (by_value, by_name)."""
    kind, sure, basis = names.split()
    return f"""coalesce(by_value, by_name) {kind}, cast(case when by_value = by_name then 0.97 when by_value is not null and by_name is not null then 0.8 when by_value is not null then 0.85 when by_name in {profile.NAME_ALONE} then 0.6 when by_name is not null then 0.4 end as double) {sure},
case when by_value = by_name then 'name+value' when by_value is not null then 'value' when by_name is not null then 'name' end {basis}"""


@registered(f"""with k as ({" union all ".join(map(pii_sql, ("full_name", "email", "phone", "ip")))}) select "column", {pii_told("kind confidence basis")} from k where coalesce(by_value, by_name) is not null""")
def profile_pii(spark, sf_dir):
    return profile.detect_pii(people(spark, sf_dir).select("full_name", "email", "phone", "ip"))


@registered(f"""select cast(count(*) as bigint) "rows", cast((select count(*) from (select distinct * from {MESSY})) as bigint) distinct_rows,
round(1 - (select count(*) from (select distinct * from {MESSY})) / count(*), 4) duplicate_ratio from {MESSY}""")
def duplicate_ratio(spark, sf_dir):
    return profile.duplicate_ratio(messy_orders(spark, sf_dir))


def key_sql(dataset: str, rows: str, *keys: str) -> str:
    """The first of the keys (columns joined by +) that names each row, if any."""
    each_row = lambda k: f"(select count(*) from (select distinct {k.replace('+', ', ')} from {rows} where {' and '.join(f'{c} is not null' for c in k.split('+'))})) = (select count(*) from {rows})"
    return f"""select '{dataset}' dataset, case {" ".join(f"when {each_row(k)} then '{k}'" for k in keys)} end "key" """


HALVES = "(select o_orderkey // 2 lower_half, (o_orderkey + 1) // 2 upper_half, o_orderstatus from orders) h"
# Orders by their keys in fours, in other fours and in other twos: any two of these leave some orders together.
STEPS = "(select o_orderkey // 4 fours, (o_orderkey + 2) // 4 later_fours, (o_orderkey + 1) // 2 later_twos from orders) d"
KEYS = (
    ("nation", "nation", "n_nationkey", "n_regionkey", "n_name"), ("events", "events", "event_id", "user_id", "event_type"), ("part", "part", "p_partkey", "p_name", "p_brand"),
    ("lineitem", "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_orderkey+l_partkey"), ("halves", HALVES, "lower_half", "upper_half", "o_orderstatus", "lower_half+upper_half"),
    ("steps", STEPS, "fours", "later_fours", "later_twos", "fours+later_fours", "fours+later_twos", "later_fours+later_twos", "fours+later_fours+later_twos"),
)


@registered("select * from (" + " union all ".join(key_sql(*k) for k in KEYS) + """) k where "key" is not null""")
def key_candidates(spark, sf_dir):
    """The first key of each table; halves of order keys name an order as a pair only, steps of them only as three."""
    t = {n: table(spark, sf_dir, n) for n in ("nation", "events", "part", "lineitem")}
    key = F.col("o_orderkey")
    t["halves"] = table(spark, sf_dir, "orders").select(F.floor(key / 2).alias("lower_half"), F.floor((key + 1) / 2).alias("upper_half"), "o_orderstatus")
    t["steps"] = table(spark, sf_dir, "orders").select(F.floor(key / 4).alias("fours"), F.floor((key + 2) / 4).alias("later_fours"), F.floor((key + 1) / 2).alias("later_twos"))
    found = [(n, "+".join(sorted(k))) for n, df in t.items() for k in profile.key_candidates(df, most=3)[:1]]
    return spark.createDataFrame(found, "dataset string, key string")


#: What the extract is made of: safe names, and the logical type of each column.
EXTRACT = f"""(select "Order ID" order_id, * exclude ("Order ID") from {MESSY}) x"""
EXTRACT_KINDS = {"order_id": "integer", "customer_key": "integer", "status": "string", "amount_text": "string", "total_price": "float", "order_date": "string", "batch_id": "string"}


def column_facts(rows: str, kinds: dict[str, str]) -> str:
    """Counts, text statistics and shadow types of the columns of `rows`, a row each; shadow types of texts only."""
    texts = [c for c, k in kinds.items() if k == "string"]
    per = lambda template, columns: " union all ".join(template.format(c=c, t=rows) for c in columns)
    none = """select null "column", null mean_length, null max_length, null blanks, null smallest, null largest"""
    shadows = " union all ".join(shadow_sql(c, rows) for c in texts) or """select null "column", null shadow_type"""
    return f"""(select * from ({per(COUNTS, kinds)}) c left join ({per(TEXTS, texts) or none}) t using ("column") left join ({shadows}) s using ("column")) f"""


PROFILED = """mean stddev p25 p50 p75 mean_length""".split()


@registered(f"""select case "column" when 'order_id' then 'Order ID' else "column" end "column", position, logical_type, true distinct_is_exact, f.* exclude ("column"),
"min", "max", mean, stddev, p25, p50, p75, decimal_places, cast(null as varchar) "first", cast(null as varchar) "last", {pii_told("pii_kind pii_confidence pii_basis")}
from {column_facts(EXTRACT, EXTRACT_KINDS)} join (values {", ".join(f"('{c}', {i}, '{k}')" for i, (c, k) in enumerate(EXTRACT_KINDS.items()))}) k("column", position, logical_type) using ("column")
left join ({" union all ".join(NUMBERS.format(c=c, t=EXTRACT) for c, k in EXTRACT_KINDS.items() if k in ("integer", "float"))}) n using ("column")
left join (select unnest(['order_id', 'customer_key', 'total_price']) "column", unnest([0, 0, (select max(length(rtrim(split_part(cast(o_totalprice as varchar), '.', 2), '0'))) from orders)]) decimal_places) d using ("column")
left join ({" union all ".join(pii_sql(c, EXTRACT) for c, k in EXTRACT_KINDS.items() if k == "string")}) p using ("column")""")
def profile_orders(spark, sf_dir):
    """The whole profile of the messy extract, top values left out."""
    out = profile.profile(messy_orders(spark, sf_dir)).drop("top_values")
    return out.withColumns({c: F.round(c, 4 if c in ("mean", "stddev") else 6) for c in PROFILED})


def renamed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    return {
        "customers": t("customer").select(F.col("c_custkey").alias("customer_key"), F.col("c_nationkey").alias("nation_key")),
        "orders": t("orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_key")),
        "lines": t("lineitem").select(F.col("l_orderkey").alias("order_key"), "l_linenumber"),
        "nations": t("nation").select(F.col("n_nationkey").alias("nation_key"), F.col("n_regionkey").alias("region_key")),
        "regions": t("region").select(F.col("r_regionkey").alias("region_key")),
    }


def overlap_sql(child: str, column: str, parent: str, key: str, from_: str, own: str, to: str, other: str) -> str:
    """One row if the child's values lie in the parent's key; both columns have one name there, which counts 0.9."""
    return f"""select * from (select '{child}' from_dataset, '{column}' from_column, '{parent}' to_dataset, '{key}' to_column, 'inferred' kind, round(least(0.99, 0.65 * s + 0.35 * 0.9), 3) confidence, round(s, 3) overlap, 'many_to_one' cardinality
from (select count(*) filter (where v in (select {other} from {to})) / count(*) s from (select distinct {own} v from {from_} where {own} is not null))) where overlap >= {relate.LEAST_OVERLAP}"""


@registered(" union all ".join([
    overlap_sql("orders", "customer_key", "customers", "customer_key", "orders", "o_custkey", "customer", "c_custkey"),
    overlap_sql("lines", "order_key", "orders", "order_key", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    "select 'customers', 'nation_key', 'nations', 'nation_key', 'declared', 1.0, 1.0, 'many_to_one'",
]))
def relationships(spark, sf_dir):
    keys = {"customers": ["customer_key"], "orders": ["order_key"], "nations": ["nation_key"], "regions": ["region_key"]}
    declared = spark.createDataFrame([("customers", "nation_key", "nations", "nation_key")], relate.COLUMNS)
    rejected = spark.createDataFrame([("nations", "region_key", "regions", "region_key")], relate.COLUMNS)
    return relate.infer_relationships(renamed(spark, sf_dir), keys, {}, declared, rejected)


MONTHLY = """(select date_trunc('month', o_orderdate) "month", o_orderstatus status, sum(o_totalprice) total_revenue, count(*) order_count, avg(o_totalprice) avg_order_value from orders group by 1, 2) g"""
MONTHLY_KINDS = {"month": "timestamp", "status": "string", "total_revenue": "float", "order_count": "integer", "avg_order_value": "float"}
CUSTOMER_KINDS = {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "string"}


def layer_sql(dataset: str, rows: str, kinds: dict[str, str], *keys: str) -> str:
    """dataset, layer: the weights of all evidence that holds, added up for each layer."""
    of = lambda test: "(" + ", ".join(f"'{c}'" for c in ("", *kinds) if not c or test(c)) + ")"
    number = lambda c: kinds[c] in ("integer", "float", "decimal")
    measure = lambda c: number(c) and names.is_measure(c)
    grain = lambda c: names.is_grain(c) or kinds[c] in ("date", "timestamp")
    key_like = lambda c: kinds[c] in classify.KEY_TYPES and not names.is_measure(c)
    given = {
        "types_missing_many": ("bronze", "mistyped >= 0.4 * columns"), "types_missing": ("bronze", "mistyped >= 0.2 * columns and mistyped < 0.4 * columns"), "types_applied": ("silver", "mistyped = 0"),
        "sparse": ("bronze", "is_sparse"), "full": ("silver", "not is_sparse and mean_null <= 0.05"), "duplicates_many": ("bronze", "copies >= 0.05"), "duplicates": ("bronze", "copies >= 0.01 and copies < 0.05"),
        "no_duplicates": ("silver", "copies < 0.01 and n > 50"), "key_exact": ("silver", '"key" is not null'), "no_key": ("bronze", '"key" is null'), "blanks": ("bronze", "blank > 0"), "metadata": ("bronze", "audit > 0"),
        "aggregated": ("gold", "is_summary"), "wide": ("gold", "not is_summary and measures >= 2 and columns >= 12"), "normalised": ("silver", "small >= 2 and n > 100 and measures = 0"),
        "naming": (names.layer_of_name(dataset), "true"),
    }
    total = lambda layer: " + ".join(f"{classify.WEIGHTS[w]} * ({when})::int" for w, (own, when) in given.items() if own == layer)
    return f"""select '{dataset}' dataset, case when {total("bronze")} > {total("silver")} then 'bronze' when {total("gold") or 0} > {classify.WEIGHTS["naming"]} then 'gold' else 'silver' end layer
from (select *, mean_null >= 0.25 or sparse >= greatest(2, columns // 4) is_sparse, measures >= 2 and grains > 0 and identifiers = 0 is_summary from (select count(*) columns, max("rows") n,
count(*) filter (where shadow_type is not null) mistyped, avg(null_pct) mean_null, count(*) filter (where null_pct > 0.6) sparse, count(*) filter (where blanks > 0) blank, count(*) filter (where "column" in {of(names.is_audit)}) audit,
count(*) filter (where "column" in {of(measure)}) measures, count(*) filter (where "column" in {of(grain)}) grains, count(*) filter (where distinct_count between 2 and 12) small,
count(*) filter (where is_unique and "column" in {of(key_like)} and coalesce(shadow_type, '') not in ('integer', 'float', 'decimal')) identifiers from {column_facts(rows, kinds)}),
(select round(1 - (select count(*) from (select distinct * from {rows})) / count(*), 4) copies from {rows}), ({key_sql(dataset, rows, *keys)}))"""


@registered(" union all ".join([
    layer_sql("orders_raw", EXTRACT, EXTRACT_KINDS, "order_id", "order_id+batch_id"), layer_sql("customer", "customer", CUSTOMER_KINDS, "c_custkey"),
    layer_sql("sales_summary", MONTHLY, MONTHLY_KINDS, "month+status"), "select 'unprofiled', 'bronze'",
]))
def classify_layers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    monthly = orders.groupBy(F.date_trunc("month", "o_orderdate").alias("month"), F.col("o_orderstatus").alias("status"))
    monthly = monthly.agg(F.sum("o_totalprice").alias("total_revenue"), F.count(F.lit(1)).alias("order_count"), F.avg("o_totalprice").alias("avg_order_value"))
    own = {"orders_raw": messy_orders(spark, sf_dir), "customer": table(spark, sf_dir, "customer"), "sales_summary": monthly}
    facts, rows = None, [("unprofiled", 0.0, False, False)]
    for name, df in own.items():
        p = profile.profile(df)
        has_key = bool(profile.key_candidates(df, p.collect()))
        rows.append((name, profile.duplicate_ratio(df).first().duplicate_ratio, has_key, False))
        p = p.drop("top_values").withColumn("dataset", F.lit(name))
        facts = p if facts is None else facts.unionByName(p)
    tables = spark.createDataFrame(rows, "dataset string, duplicate_ratio double, has_key boolean, key_declared boolean")
    return classify.classify_layers(facts, tables).select("dataset", "layer")


# --- quality, silver, gold -------------------------------------------------------------------------------------------

RULES = (
    quality.Rule("not_null", ("Order ID",)),
    quality.Rule("type", ("amount_text",), to="decimal"),
    quality.Rule("allowed_values", ("status",), "warn", values=("F", "O")),
    quality.Rule("range", ("total_price",), "warn", low=1000, high=400_000),
    quality.Rule("non_negative", ("total_price",)),
    quality.Rule("unique", ("Order ID",), "warn"),
)
REJECT_SQL = f"""concat_ws('; ', case when "Order ID" is null then 'not_null:Order ID' end,
case when amount_text is not null and trim(amount_text) <> '' and {AMOUNT} is null then 'type:amount_text' end, case when total_price < 0 then 'non_negative:total_price' end)"""
WARN_SQL = """concat_ws('; ', case when status not in ('F', 'O') then 'allowed_values:status' end, case when total_price < 1000 or total_price > 400000 then 'range:total_price' end,
case when count(*) over (partition by "Order ID") > 1 then 'unique:Order ID' end)"""
JUDGED = f"(select *, {REJECT_SQL} rejects, {WARN_SQL} warnings from {MESSY}) j"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.evaluate(messy_orders(spark, sf_dir), RULES)


@registered(f"""select "Order ID" order_id, batch_id, rejects, warnings from {JUDGED}""")
def quality_evaluate(spark, sf_dir):
    return judged(spark, sf_dir).select(F.col("Order ID").alias("order_id"), "batch_id", F.col(quality.REJECTS).alias("rejects"), F.col(quality.WARNS).alias("warnings"))


@registered(f"""select 'clean' part, null rule, count(*) n, cast(sum(customer_key) as bigint) keys from {JUDGED} where rejects = '' union all
select 'quarantine', rejects, count(*), cast(sum(customer_key) as bigint) from {JUDGED} where rejects <> '' group by rejects""")
def quality_split(spark, sf_dir):
    own = judged(spark, sf_dir)
    held = quality.quarantine(own, "run-1", F.lit("2026-01-01").cast("timestamp"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("customer_key").alias("keys")]
    good = quality.clean(own).agg(*sums).select(F.lit("clean").alias("part"), F.lit(None).cast("string").alias("rule"), "n", "keys")
    return good.unionByName(held.groupBy(F.col("_dq_rule").alias("rule")).agg(*sums).select(F.lit("quarantine").alias("part"), "rule", "n", "keys"))


@registered(f"select warnings as rule, count(*) n from {JUDGED} where warnings <> '' group by 1")
def quality_warnings(spark, sf_dir):
    return quality.warning_summary(judged(spark, sf_dir))


@registered(f"select rejects as rule, count(*) n from {JUDGED} where rejects <> '' group by 1 order by 2 desc, 1 limit 4")
def quality_summary(spark, sf_dir):
    held = quality.quarantine(judged(spark, sf_dir), "run-1", F.lit("2026-01-01").cast("timestamp"))
    return quality.quarantine_summary(held, "run-1")


@registered(f"select count(*) total, count(*) filter (where rejects <> '') rejected, count(*) >= 100 and count(*) filter (where rejects <> '') > 0.05 * count(*) breached from {JUDGED}")
def quality_breach(spark, sf_dir):
    return quality.breach(judged(spark, sf_dir))


SIGNED = f"(select distinct * replace ('$' || replace(amount_text, '$', '') as amount_text) from {MESSY}) d"


@registered(f"""select distinct "Order ID" order_id, customer_key, nullif(trim(status), '') status, cast({AMOUNT} as double) amount_text,
cast(cast(total_price as decimal(38,2)) as double) total_price, cast(order_date as date) order_date from {SIGNED}""")
def silver_orders(spark, sf_dir):
    """Every amount has a currency sign here, so the profile itself finds money and dates in the texts."""
    signed = F.concat(F.lit("$"), F.regexp_replace("amount_text", "[$]", ""))
    df = messy_orders(spark, sf_dir).withColumn("amount_text", signed)
    facts = profile.profile(df).collect()
    plan = refine.plan_refine(facts, profile.duplicate_ratio(df).first().duplicate_ratio)
    return plain(refine.refine(df, plan, F.lit("2026-01-01").cast("timestamp")).drop(refine.REFINED_AT))


@registered("""select cast(date_trunc('month', o_orderdate) as date) period_month, o_orderstatus, o_orderpriority, count(*) record_count,
cast(sum(cast(floor(o_totalprice / 100) * 100 as bigint)) as double) total_o_totalprice, round(avg(floor(o_totalprice / 100) * 100) * count(*), 2) avg_times_count from orders group by 1, 2, 3""")
def gold_orders_summary(spark, sf_dir):
    """Prices in whole hundreds, as a price that no other order has is not summed up."""
    price = (F.floor(F.col("o_totalprice") / 100) * 100).cast("decimal(38,2)").alias("o_totalprice")
    df = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderstatus", "o_orderpriority", price)
    out = plain(summarise.summarise(df, profile.profile(df, details=False).collect()))
    return out.withColumn("avg_times_count", F.round(F.col("avg_o_totalprice") * F.col("record_count"), 2)).drop("avg_o_totalprice")


@registered("""select cast(date_trunc('month', l_shipdate) as date) period_month, l_returnflag, l_linestatus, count(*) record_count, cast(sum(cast(l_extendedprice as decimal(38,2))) as double) total_l_extendedprice,
round(avg(l_extendedprice) * count(*), 2) price_times_count, sum(l_quantity) total_l_quantity, round(avg(l_quantity) * count(*), 2) quantity_times_count from lineitem group by 1, 2, 3""")
def gold_lineitem_summary(spark, sf_dir):
    """Lines by month and flags, as the profile of the table suggests."""
    df = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", F.col("l_extendedprice").cast("decimal(38,2)").alias("l_extendedprice"))
    out = plain(summarise.summarise(df, profile.profile(df, details=False).collect()))
    # Averages times the count: rounded averages are ties, which the engines break apart.
    times = lambda c: F.round(F.col(c) * F.col("record_count"), 2)
    return out.withColumn("price_times_count", times("avg_l_extendedprice")).withColumn("quantity_times_count", times("avg_l_quantity")).drop("avg_l_extendedprice", "avg_l_quantity")


# --- loads and history ------------------------------------------------------------------------------------------------

CHANGED = """(select c_custkey, c_name, c_nationkey, c_acctbal, case when c_custkey % 10 = 0 then 'CHANGED' else c_mktsegment end c_mktsegment from customer where c_custkey % 2 = 0
union all select c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey % 50 = 1)"""


def changed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    moved = c.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    return moved.unionByName(c.where("c_custkey % 50 = 1").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))


@registered(f"select * from {CHANGED} union all select c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment from customer c where c_custkey not in (select c_custkey from {CHANGED})")
def upsert_customers(spark, sf_dir):
    return ingest.upsert(table(spark, sf_dir, "customer"), changed_customers(spark, sf_dir), ["c_custkey"])


FIRST, SECOND = "2026-01-01 00:00:00", "2026-02-01 00:00:00"


def customer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = history.scd2_merge(None, table(spark, sf_dir, "customer"), ["c_custkey"], FIRST)
    return history.scd2_merge(first, changed_customers(spark, sf_dir), ["c_custkey"], SECOND)


HISTORY = f"""(with s as (select * from {CHANGED}) select c.c_custkey, c.c_mktsegment, s.c_mktsegment is null or s.c_mktsegment = c.c_mktsegment is_current, date '2026-01-01' valid_from,
case when s.c_mktsegment <> c.c_mktsegment then date '2026-02-01' end valid_to from customer c left join s using (c_custkey)
union all select s.c_custkey, s.c_mktsegment, true, date '2026-02-01', null from s left join customer c using (c_custkey) where c.c_custkey is null or c.c_mktsegment <> s.c_mktsegment) h"""


@registered(f"select * from {HISTORY}")
def scd2_customer(spark, sf_dir):
    h = customer_history(spark, sf_dir)
    return h.select("c_custkey", "c_mktsegment", F.col(history.CURRENT).alias("is_current"), F.col(history.FROM).cast("date").alias("valid_from"), F.col(history.TO).cast("date").alias("valid_to"))


@registered(f"select c_custkey, c_mktsegment from {HISTORY} where valid_from <= date '2026-01-15' and (valid_to is null or date '2026-01-15' < valid_to)")
def scd2_as_of(spark, sf_dir):
    return history.scd2_as_of(customer_history(spark, sf_dir), "2026-01-15 00:00:00").select("c_custkey", "c_mktsegment")


@registered("select event_id, event_type from events where ts > timestamp '2024-01-10 00:00:00'")
def read_window_events(spark, sf_dir):
    import datetime

    since = datetime.datetime(2024, 1, 10)
    return ingest.read_window(table(spark, sf_dir, "events"), "ts", since).rows.select("event_id", "event_type")


@registered()
def changed_files(spark, sf_dir):
    """Files of the input folder against a registry that knows all of them but the largest."""
    listing = ingest.list_files(spark, sf_dir).where("path like '%.parquet%'")
    known = ingest.changed_files(listing, spark.createDataFrame([], "path string, version string, status string"))
    most = known.agg(F.max(F.struct("length", "path")).alias("m")).select(F.col("m.path").alias("largest"))
    registry = known.join(F.broadcast(most), F.col("path") != F.col("largest")).select("path", "version", F.lit("LOADED").alias("status"))
    return ingest.changed_files(listing, registry).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length")


# --- tiles --------------------------------------------------------------------------------------------------------------

@registered(f"select cast(sum({MONEY}) as double) revenue from orders")
def stat_total(spark, sf_dir):
    return plain(tiles.stat_total(sales_model(spark, sf_dir), "revenue"))


@registered("""with m as (select cast(date_trunc('month', o_orderdate) as date) month_of_ordered, count(*) v from orders group by 1), d as (select *, lag(v) over (order by month_of_ordered) p, row_number() over (order by month_of_ordered desc) rn from m)
select month_of_ordered, v as value, p as previous, v - p as delta, (v - p) / abs(p) as delta_pct, case when v > p then 'up' when v < p then 'down' else 'flat' end direction from d where rn = 1""")
def stat_delta_orders(spark, sf_dir):
    return plain(tiles.period_delta(sales_model(spark, sf_dir), "order_count", "orders.ordered"))


@registered(f"""select cast(date_trunc('month', o_orderdate) as date) month_of_ordered, count(*) order_count, cast(sum({MONEY}) as double) revenue from orders group by 1 order by 1 desc limit 60""")
def timeline_orders(spark, sf_dir):
    return plain(tiles.timeline(sales_model(spark, sf_dir), ("order_count", "revenue"), "orders.ordered"))


@registered(f"""select coalesce(n_name, 'Not set') as label, cast(sum({MONEY}) as double) revenue from {SALES} group by 1 order by 2 desc, 1 limit 12""")
def breakdown_nation(spark, sf_dir):
    return plain(tiles.breakdown(sales_model(spark, sf_dir), ("revenue",), ("nation.nation",)))


FOLD = """with g as (select p_brand, cast(sum(cast(l_extendedprice as decimal(38,2))) as double) v, count(*) n from lineitem left join part on l_partkey = p_partkey group by 1),
r as (select *, row_number() over (order by abs(v) desc, p_brand) rn, count(*) over () total from g),
f as (select case when total > {k} + 1 and rn > {k} then 'Other (' || (total - {k}) || ')' else coalesce(p_brand, 'Not set') end as label, sum(cast(v as decimal(38,2))) v, sum(n) n from r group by 1)"""


@registered(FOLD.format(k=8) + " select label, cast(v as double) line_revenue, cast(n as bigint) line_count from f")
def fold_tail_brand(spark, sf_dir):
    return plain(tiles.fold_tail(sales_model(spark, sf_dir), ("line_revenue", "line_count"), "part.brand", 8))


@registered(FOLD.format(k=6) + " select label, cast(v as double) line_revenue, round(cast(v as double) / (select sum(cast(v as double)) from f), 9) as share from f")
def share_brand(spark, sf_dir):
    return plain(tiles.share(sales_model(spark, sf_dir), "line_revenue", "part.brand")).withColumn("share", F.round("share", 9))


@registered(f"""select coalesce(c_mktsegment, 'Not set') as label, cast(sum({MONEY}) as double) revenue, count(*) order_count from {SALES} group by 1""")
def multi_measure_orders(spark, sf_dir):
    return plain(tiles.scatter(sales_model(spark, sf_dir), ("revenue", "order_count"), "customer.segment"))


@registered(f"""select cast(date_trunc('year', o_orderdate) as date) year_of_ordered, c_mktsegment segment, cast(sum({MONEY}) as double) revenue, count(*) order_count from {SALES} group by 1, 2""")
def detail_table(spark, sf_dir):
    return plain(tiles.detail(sales_model(spark, sf_dir), ("revenue", "order_count"), "customer.segment", "orders.ordered", "year"))


@registered(f"select cast(sum({MONEY}) as double) revenue from {SALES} where r_name = 'ASIA' and o_orderstatus = 'O'")
def cross_filtered(spark, sf_dir):
    own = tiles.cross_filter(tiles.cross_filter((), "region.region", "ASIA"), "orders.status", "O")
    return plain(tiles.stat_total(sales_model(spark, sf_dir), "revenue", own))


def points_sql(tile: str, key: str | None, values: dict[str, str], rows: str, tail: str = "") -> str:
    """The points of a tile in SQL: a row for each label (in the order of `tail`, if it has more than one) and measure."""
    place = f"cast(row_number() over ({tail}) - 1 as int)" if tail else "0"
    made = f"select {place} p, {key or 'cast(null as varchar)'} k, {', '.join(f'{v} {m}' for m, v in values.items())} from {rows}{' group by 2, ' + key if key and tail else ''}"
    return " union all ".join(f"select '{tile}' tile, p position, k as label, '{m}' measure, cast({m} as double) as value, cast(null as varchar) problem from ({made}) g" for m in values)


def page_sql() -> str:
    """The points of dashboard_orders in SQL."""
    measures = {"revenue": f"cast(sum({MONEY}) as double)", "order_count": "count(*)", "avg_price": "avg(o_totalprice)", "min_price": f"cast(min({MONEY}) as double)"}
    month = "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"
    out = []
    for m, v in measures.items():
        line = f"(select *, lag(v) over (order by k) b, row_number() over (order by k desc) rn from (select {month} k, {v} v from orders group by 1) x) y"
        parts = {"total": f"(select {v} from orders)", "value": "v", "previous": "b", "delta": "v - b", "delta_pct": "(v - b) / abs(b)"}
        out.append(points_sql(f"total {m}", None, parts, f"{line} where rn = 1"))
    by_time = f"order by {month}"
    late = f"orders where {month} in (select distinct {month} from orders order by 1 desc limit {tiles.PERIODS})"
    out.append(points_sql("trend", month, {"revenue": measures["revenue"]}, late, by_time))
    for field, column in (("orders.status", "o_orderstatus"), ("orders.priority", "o_orderpriority"), ("customer.segment", "c_mktsegment")):
        out.append(points_sql(f"by {field}", column, {"revenue": measures["revenue"]}, SALES, f"order by sum({MONEY}) desc, {column}"))
    total = f"{measures['revenue']} / (select {measures['revenue']} from orders)"
    out.append(points_sql("share", "o_orderstatus", {"revenue": measures["revenue"], "share": total}, "orders", f"order by sum({MONEY}) desc"))
    out.append(points_sql("combo", month, {m: measures[m] for m in ("revenue", "order_count")}, late, by_time))
    cells = f"(select {month} || ' · ' || o_orderstatus k, {', '.join(f'{v} {m}' for m, v in measures.items())}, row_number() over (order by sum({MONEY}) desc, {month}, o_orderstatus) rn from orders group by 1, {month}, o_orderstatus) c"
    out += [f"select 'detail', cast(rn - 1 as int), k, '{m}', cast({m} as double), null from {cells} where rn <= 200" for m in measures]
    out += [f"select '{t}', 0, null, null, null, '{why}'" for t, why in (("lost", "Refused"), ("broken", "AnalysisException"), ("fails", "NumberFormatException"))]
    return f"select tile, position, label, measure, round(value, 6) as value, problem from ({' union all '.join(out)}) p"


@registered(page_sql())
def dashboard_orders(spark, sf_dir):
    """The default page of the model's leading fact, with a tile that is refused, one that cannot be planned and one that
    fails in running: each of them has its problem, all others their rows."""
    model = sales_model(spark, sf_dir)
    wrong = (Measure("nothing", "orders", "sum", "no_such_column"), Measure("words", "orders", "sum", "o_orderstatus"))
    model = Model(model.entities, (*model.measures, *wrong), model.joins)
    page = [*pages.default_page(model), tiles.Tile("lost", "bar", ("revenue",), "lines.flag"), tiles.Tile("broken", "stat", ("nothing",)), tiles.Tile("fails", "stat", ("words",))]
    kind = F.when(F.col("problem").rlike("^[A-Za-z]+: "), F.regexp_extract("problem", "^([A-Za-z]+):", 1)).when(F.col("problem").isNotNull(), "Refused")
    return pages.page_points(spark, model, page).select("tile", "position", "label", "measure", F.round("value", 6).alias("value"), kind.alias("problem"))


# --- lineage, runs, freshness -------------------------------------------------------------------------------------------

def record_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each record to the records that refer to it: region → nation → customer → order."""
    found = None
    for child, own, parent, key in (("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey")):
        ends = [F.lit(parent), F.col(key).cast("string"), F.lit(child), F.col(own).cast("string"), F.lit("key"), F.lit(None).cast("string")]
        one = table(spark, sf_dir, child).select(*[e.alias(n) for e, n in zip(ends, lineage.COLUMNS, strict=True)])
        found = one if found is None else found.unionByName(one)
    return found


EDGES = """(select 'region' st, n_regionkey sc, 'nation' tt, n_nationkey tc from nation union all select 'nation', c_nationkey, 'customer', c_custkey from customer union all select 'customer', o_custkey, 'orders', o_orderkey from orders) e"""


@registered(f"""with recursive w as (select *, 1 depth from {EDGES} where tt = 'orders' and tc = (select max(o_orderkey) from orders) union select e.*, w.depth + 1 from {EDGES} join w on e.tt = w.st and e.tc = w.sc)
select st source_table, cast(sc as varchar) source_column, tt target_table, cast(tc as varchar) target_column, cast(min(depth) as int) depth from w group by 1, 2, 3, 4""")
def lineage_upstream(spark, sf_dir):
    """What the latest order's record refers to, step by step."""
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return lineage.upstream(record_edges(spark, sf_dir), "orders", str(last)).drop("via", "transform")


@registered(f"""with recursive w as (select *, 1 depth from {EDGES} where st = 'region' and sc = 1 union select e.*, w.depth + 1 from {EDGES} join w on e.st = w.tt and e.sc = w.tc)
select st source_table, cast(sc as varchar) source_column, tt target_table, cast(tc as varchar) target_column, cast(min(depth) as int) depth from w group by 1, 2, 3, 4""")
def lineage_downstream(spark, sf_dir):
    """Every record that a change of region 1 reaches: its nations, their customers, their orders."""
    return lineage.downstream(record_edges(spark, sf_dir), "region", "1").drop("via", "transform")


@registered("""with l as (select user_id, max(ts) t from events where event_type <> 'click' group by 1), a as (select c.user_id, l.t, epoch(timestamp '2024-01-30 12:00:00' - l.t) age from (select distinct user_id from events) c left join l using (user_id))
select cast(user_id as varchar) as connection, case when t is null or age < 0 then 'unknown' when floor(age) > 172800 then 'stale' when floor(age) > 129600 then 'late' else 'fresh' end as state from a""")
def freshness(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    finished = events.select(F.col("user_id").cast("string").alias("connection"), F.when(F.col("event_type") != "click", "succeeded").otherwise("failed").alias("status"), F.col("ts").cast("timestamp").alias("finished_at"))
    plans = finished.select("connection").distinct().select("connection", F.lit(86_400).alias("interval_seconds"), F.lit(True).alias("enabled"))
    return runs.freshness(finished, plans, "2024-01-30 12:00:00").select("connection", "state")


@registered(f"""with recursive w as (select * from {EDGES} where st = 'nation' and sc = 3 union select e.* from {EDGES} join w on e.st = w.tt and e.sc = w.tc)
select distinct 'table' kind, tt "name" from w union all select distinct 'unknown effect', event_type from events where event_type <> 'key'""")
def lineage_impact(spark, sf_dir):
    """The tables that a change of nation 3 reaches, and the steps (kinds of events) that declare no edges."""
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).union(spark.createDataFrame([("key",)], "name string"))
    return lineage.impact(record_edges(spark, sf_dir), steps, "nation", "3")


# --- sources ------------------------------------------------------------------------------------------------------------

@registered(f"""select "Order ID" order_id, cast({AMOUNT} as double) amount, cast(order_date as date) order_date from {MESSY}""")
def conform_orders(spark, sf_dir):
    own = messy_orders(spark, sf_dir).withColumnRenamed("Order ID", "order_id").withColumnRenamed("amount_text", "amount")
    return readers.conform(own, {"order_id": "integer", "amount": "decimal", "order_date": "date"}).withColumn("amount", F.col("amount").cast("double"))


@registered("""select 'n_nationkey' as name, 'integer' logical_type, cast(0 as int) position, (select count(*) from nation) as "rows" union all select 'n_name', 'string', 1, (select count(*) from nation) union all select 'n_regionkey', 'integer', 2, (select count(*) from nation)""")
def describe_nation(spark, sf_dir):
    return readers.describe(table(spark, sf_dir, "nation")).select("name", "logical_type", "position", "rows")


@registered("select l_orderkey order_key, count(*) line_count from lineitem group by 1")
def rename_safe_lineitem(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("Order Key!")).agg(F.count(F.lit(1)).alias("Line  Count"))
    return refine.rename_safe(own)
