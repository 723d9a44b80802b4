"""Tables of the session's catalog: written with statistics, and counted from them where they are."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_dir


def create_with_statistics(df: DataFrame, name: str) -> None:
    """df as the table `name`, its files in the shared folder, with the statistics that the optimizer reads."""
    df.write.option("path", shared_dir(df.sparkSession, name)).saveAsTable(name)
    df.sparkSession.sql(f"analyze table {name} compute statistics")


def row_count(spark: SparkSession, name: str) -> tuple[int | None, str]:
    """(rows, how they were found) of a table: from its statistics, else counted, else null where there is no such table."""
    if not spark.catalog.tableExists(name):
        return None, "missing"
    told = spark.sql(f"describe table extended {name}").where("col_name = 'Statistics'").first()
    rows = re.search(r"(\d+) rows", told["data_type"]) if told else None
    return (int(rows[1]), "statistics") if rows else (spark.table(name).count(), "counted")
