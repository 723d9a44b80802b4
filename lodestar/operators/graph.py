"""Graphs as edge tables: merges with endpoint checks, neighbourhoods, components, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: each round is computed once."""
    return stored(df, "round")


def merged_nodes(rows: DataFrame, *key: str) -> DataFrame:
    return rows.dropDuplicates(list(key))


def merged_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct edges (src, dst) with both ends in nodes (id), one row: merged, skipped)."""
    ids = nodes.select("id").distinct()
    whole = edges.distinct()
    kept = whole.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    count = whole.agg(F.count("*").alias("n")).join(kept.agg(F.count("*").alias("merged")), how="inner", on=F.lit(True))
    return kept, count.selectExpr("merged", "n - merged as skipped")


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """id, distance of what is within depth steps of start (id). A step joins the frontier alone and drops who was met before."""
    steps = edges.select("src", "dst")
    steps = steps if directed else steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    met = cut(start.select("id", F.lit(0).cast("long").alias("distance")).distinct())
    frontier = met
    for k in range(1, depth + 1):
        frontier = frontier.select(F.col("id").alias("src")).join(steps, "src").select(F.col("dst").alias("id")).distinct().join(met, "id", "left_anti")
        frontier = cut(frontier.select("id", F.lit(k).cast("long").alias("distance")))
        if frontier.isEmpty():
            break
        met = met.unionByName(frontier)
    return met


def components(edges: DataFrame, nodes: DataFrame, most: int = 60) -> DataFrame:
    """id, component (its least id), by smallest labels with pointer jumping: rounds grow with the logarithm of a chain's length."""
    e = edges.select("src", "dst").where("src <> dst")
    e = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(nodes.select("id").distinct().withColumn("label", F.col("id")))
    for _ in range(most):
        near = e.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        hung = labels.join(near, F.col("id") == F.col("src"), "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = hung.select(F.col("id").alias("at"), F.col("label").alias("far"))
        new = cut(hung.join(jump, F.col("label") == F.col("at")).select("id", "was", F.least("label", "far").alias("label")))
        labels = new.select("id", "label")
        if new.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("labels don't settle")
