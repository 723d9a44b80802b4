"""Deterministic apportionment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apportioned(groups: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """name and n: `total` shared by weight, whole numbers by largest remainder, ties by name. groups: one row a name, few."""
    whole = groups.agg(F.sum(weight)).first()[0]
    share = groups.select(name, (F.col(weight) / F.lit(whole) * total).alias("share")) if whole else groups.select(name, F.lit(0.0).alias("share"))
    share = share.withColumn("base", F.floor("share"))
    left = total - (share.agg(F.sum("base")).first()[0] or 0) if whole else 0
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("share") - F.col("base")), name))
    return share.withColumn("rank", rank).select(name, (F.col("base") + (F.col("rank") <= left).cast("int")).cast("long").alias("n"))
