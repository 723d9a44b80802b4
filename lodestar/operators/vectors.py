"""Exact vector search by cosine, and passages of neighbouring rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cosine(column: str, query: Sequence[float]):
    """Cosine of an array column with a constant vector, in JVM expressions."""
    q = F.array(*[F.lit(float(x)) for x in query])
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(column, q, lambda a, b: a.cast("double") * b), zero, lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(column, zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm * float(sum(x * x for x in query)) ** 0.5)


def nearest(vectors: DataFrame, query: Sequence[float], k: int, group: str | None = None, oversample: int = 8) -> DataFrame:
    """The k rows with the greatest cosine, 4 places; with a group column, one of each group from k * oversample rows."""
    rows = vectors.withColumn("cosine", cosine("embedding", query))
    top = rows.orderBy(F.desc("cosine"), "vec_id").limit(k * oversample if group else k)
    if group:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("cosine"), "vec_id"))
        top = top.withColumn("rank", rank).where("rank = 1").orderBy(F.desc("cosine"), "vec_id").limit(k).drop("rank")
    return top.withColumn("cosine", F.round("cosine", 4))


def windows(rows: DataFrame, by: str, order: str, columns: Sequence[str], size: int = 6, stride: int = 3) -> DataFrame:
    """by, window_no, and the window's rows in order: runs of `size` rows every `stride`; a last run inside the one before is left out."""
    n, i = F.count("*").over(Window.partitionBy(by)), F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    placed = rows.select(by, order, *columns, i.alias("i"), n.alias("n"))
    last = f"greatest(0, ceil((n - {size}) / {stride}))"
    no = F.expr(f"sequence(greatest(0, cast(ceil((i - {size - 1}) / {stride}) as int)), least(cast(i div {stride} as int), cast({last} as int)))")
    valid = placed.where(f"greatest(0, cast(ceil((i - {size - 1}) / {stride}) as int)) <= least(cast(i div {stride} as int), cast({last} as int))")
    each = valid.select(by, order, *columns, F.explode(no).alias("window_no"))
    return each.groupBy(by, "window_no").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))
