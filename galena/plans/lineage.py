"""Column lineage: edges that transforms declare, and what lies up and down of a column.

Edges are rows of source_table, source_column, target_table, target_column, via, transform (null: passed through).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.sources.folders import work_folder

EDGE = "source_table string, source_column string, target_table string, target_column string, via string, transform string"

COLUMNS = ["source_table", "source_column", "target_table", "target_column", "via", "transform"]


def edges(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, EDGE)


def identity_edges(df: DataFrame, source: str, target: str, via: str) -> DataFrame:
    """An edge for every column that is carried over under its name."""
    return edges(df.sparkSession, [(source, c, target, c, via, None) for c in df.columns])


def projection_edges(spark: SparkSession, source: str, target: str, via: str, declared: dict[str, list[tuple[str, str | None]]]) -> DataFrame:
    """Edges of a projection or aggregation: target column → (source column, transform) that it is made of."""
    return edges(spark, [(source, s, target, t, via, how) for t, parts in declared.items() for s, how in parts])


def measure_edges(spark: SparkSession, model) -> DataFrame:
    """From the columns of entities to the measures that are made of them."""
    return edges(spark, [(m.entity, m.column or "*", "measure", m.name, "model", m.agg) for m in model.measures])


def tile_edges(spark: SparkSession, tiles) -> DataFrame:
    return edges(spark, [("measure", m, "tile", t.name, "dashboard", t.kind) for t in tiles for m in t.measures])


def _walk(all_edges: DataFrame, table: str, column: str, near: str, far: str, folder: str | None, most_depth: int | None) -> DataFrame:
    """Edges reached from a column, with their depth; each edge once, so cycles end.

    Each round joins the columns that the round before reached for the first time with the edges. What a round finds is
    written below `folder` and read again; nothing but its row count comes to the driver, and there is no limit on edges.
    """
    spark = all_edges.sparkSession
    folder = work_folder(spark, "lineage", folder)
    ends = lambda df, side: df.select(F.col(f"{side}_table").alias("t"), F.col(f"{side}_column").alias("c")).distinct()
    at_near = lambda cols: (F.col(f"{near}_table") == cols["t"]) & (F.col(f"{near}_column") == cols["c"])
    frontier, visited, found, depth = spark.createDataFrame([(table, column)], "t string, c string"), None, None, 0
    while most_depth is None or depth < most_depth:
        depth += 1
        path = f"{folder}/round-{depth:04d}"
        step = all_edges.join(frontier, at_near(frontier), "left_semi").distinct()
        step.withColumn("depth", F.lit(depth)).write.mode("overwrite").parquet(path)
        step = spark.read.parquet(path)
        if not step.count():
            break
        visited = frontier if visited is None else visited.unionByName(frontier)
        found = step if found is None else found.unionByName(step)
        frontier = ends(step, far).join(visited, ["t", "c"], "left_anti")
    return found if found is not None else spark.createDataFrame([], f"{EDGE}, depth int")


def upstream(all_edges: DataFrame, table: str, column: str, folder: str | None = None, most_depth: int | None = None) -> DataFrame:
    """Every edge that a column's values come along, with the least depth at which it is reached."""
    return _walk(all_edges, table, column, "target", "source", folder, most_depth)


def origins(found: DataFrame) -> DataFrame:
    """The columns at the far ends of upstream edges."""
    targets = found.select(F.col("target_table").alias("source_table"), F.col("target_column").alias("source_column"))
    return found.select("source_table", "source_column").distinct().join(targets, ["source_table", "source_column"], "left_anti")


def downstream(all_edges: DataFrame, table: str, column: str, folder: str | None = None, most_depth: int | None = None) -> DataFrame:
    """Every edge that a column's values go along: the tables, measures and tiles that a change would reach."""
    return _walk(all_edges, table, column, "source", "target", folder, most_depth)


def impact(all_edges: DataFrame, steps: DataFrame, table: str, column: str, folder: str | None = None) -> DataFrame:
    """kind, name: what a change of a column reaches: tables, measures and tiles, and the steps (name) whose effect is
    unknown, as they declare no edges."""
    reached = downstream(all_edges, table, column, folder).select("target_table", "target_column").distinct()
    kind = F.when(F.col("target_table").isin("measure", "tile"), F.col("target_table")).otherwise("table")
    name = F.when(kind == "table", F.col("target_table")).otherwise(F.col("target_column"))
    known = reached.select(kind.alias("kind"), name.alias("name")).distinct()
    return known.unionByName(steps_without_edges(steps, all_edges).select(F.lit("unknown effect").alias("kind"), "name").distinct())


def steps_without_edges(steps: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Steps (name) of which nothing is known: their effect is always to be told."""
    return steps.join(all_edges.select(F.col("via").alias("name")).distinct(), "name", "left_anti")
