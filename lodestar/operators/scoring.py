"""Scores against a ground truth: rates over grouping sets, pairwise clustering scores, error-free counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a part that `dealt` makes, about.
PART_ROWS = 250_000


def dealt(rows: DataFrame, *by: str, part_rows: int = PART_ROWS) -> DataFrame:
    """rows shuffled once by the columns of a grouping, in parts that don't grow with the table, so that neither do the tables of groups in a task's memory."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, rows.count() // part_rows + 1), *by)


def rate(a, b):
    """a / b to four places; null over zero."""
    return F.round(F.try_divide(a, b), 4)


def scores(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 by all columns of `by`, by each, and overall, in one pass over (by..., truth, found).

    A column that a row sums over is null there, and its bit of `level` is set.
    """
    sets = [list(by), *[[c] for c in by], []]
    hit, found, truth = F.count_if(F.col("truth") & F.col("found")), F.count_if("found"), F.count_if("truth")
    out = outcomes.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.grouping_id().cast("long").alias("level"), hit.alias("tp"), found.alias("n_found"), truth.alias("n_truth"))
    p, r = F.try_divide("tp", "n_found"), F.try_divide("tp", "n_truth")
    return out.select(*by, "level", "tp", "n_found", "n_truth", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"))


def pairwise(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """Pairwise precision and recall of clusters. Pairs are counted from group sizes, never made."""
    pairs = lambda n: n * (n - 1) / 2
    cells = rows.groupBy(truth, found).agg(F.count("*").alias("n"))
    total = lambda key, name: cells.groupBy(key).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("both"))
    one_row = F.lit(True)
    out = both.join(total(truth, "t"), one_row).join(total(found, "f"), one_row)
    return out.select(rate(F.col("both"), F.col("f")).alias("precision"), rate(F.col("both"), F.col("t")).alias("recall"))
