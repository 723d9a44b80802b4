"""Reductions of append-only logs: latest state, folds to a terminal event, states as of a time, upserts, diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the order. Give the order a unique last column, so that ties have one outcome."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest_columns(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of the row with the greatest order of each key, by max_by: combined before the shuffle, no sort, no hot task."""
    top = F.max_by(F.struct(*columns), F.struct(*order)).alias("s")
    return df.groupBy(*by).agg(top).select(*by, "s.*")


def top_n(df: DataFrame, by: Sequence[str], n: int, *order: Column) -> DataFrame:
    """Up to n rows of each key with their rank. Spark limits each task's share of a key before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def folded(events: DataFrame, by: str, at: str, tie: str, state: str, terminal: Sequence[str]) -> DataFrame:
    """State of each key when its events are folded in (at, tie) order and the first terminal one ends it.

    by, state, n_events (folded), ended: two aggregations, no window.
    """
    end = F.min(F.when(F.col(state).isin(*terminal), F.struct(at, tie))).alias("end")
    ends = events.groupBy(by).agg(end)
    kept = events.join(ends, by).where(F.col("end").isNull() | (F.struct(at, tie) <= F.col("end")))
    return kept.groupBy(by).agg(F.max_by(state, F.struct(at, tie)).alias("state"), F.count("*").alias("n_events"), F.bool_or(F.col(state).isin(*terminal)).alias("ended"))


def as_of(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """left with the latest `value` of right at or before left_at, as `as_of`.

    Both sides go through one window over their union, so a key costs its rows, not its pairs.
    """
    both = left.select(F.struct("*").alias("row"), F.col(by).alias("k"), F.col(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v"))
    both = both.unionByName(right.select(F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.col(by).alias("k"), F.col(right_at).alias("at"), F.lit(0).alias("side"), F.col(value).alias("v")))
    w = Window.partitionBy("k").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("v", ignorenulls=True).over(w)).where("side = 1").select("row.*", "as_of")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, those of `new` in place of old ones with the key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and an order-insensitive fingerprint of the rows: combined before the shuffle, one row a task."""
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("x"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).select("n_rows", F.sha2(F.concat_ws("|", "n_rows", "x", "s"), 256).alias("fingerprint"))


def changes(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """key and status: added, removed, changed or same."""
    a, b = before.select(F.col(key), F.col(content).alias("a"), F.lit(1).alias("x")), after.select(F.col(key), F.col(content).alias("b"), F.lit(1).alias("y"))
    status = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))
