"""Times the headline work and prints one line of JSON: full-scan profile, three-layer run, eight-tile dashboard, and others."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from galena.operators import profile
from galena.plans import catalogue, pages, runs, tiles

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def dashboard(spark: SparkSession) -> None:
    """Eight tiles over orders."""
    model = catalogue.sales_model(spark, SF)
    few = {"orders.status": 3, "orders.priority": 5, "customer.segment": 5}
    rows = pages.collect_page(model, tiles.overview(model, "orders", "orders.ordered", few)[-8:])
    assert len(rows) == 8 and not any(isinstance(r, str) for r in rows.values()), rows


def medallion(spark: SparkSession) -> None:
    """Bronze, silver and gold of the messy orders extract."""
    at = F.lit("2026-01-01").cast("timestamp")
    rules = tuple(r for r in catalogue.RULES if r.kind not in ("unique", "not_null"))
    own = runs.Dataset("orders", catalogue.messy_orders(spark, SF), rules=rules)
    log = runs.run_medallion([own], tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp"), "bench", at).collect()
    assert all(r.status == "succeeded" for r in log), log


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    query = lambda name: lambda: catalogue.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    work = {
        "profile_lineitem": lambda: profile.profile(spark.read.parquet(f"{SF}/lineitem.parquet")).collect(),
        "medallion_orders": lambda: medallion(spark),
        "dashboard_8_tiles": lambda: dashboard(spark),
    }
    work |= {n: query(n) for n in ("metric_revenue_by_region_month", "metric_topk_customers", "quality_evaluate", "upsert_customers", "scd2_customer", "fold_tail_brand", "relationships")}
    query("metric_revenue_by_region_month")()  # starts the executors
    took = {}
    for name, run in work.items():
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
