"""An append-only store of run-scoped tables: Parquet, partitioned by run, in a folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir


class IndexStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def temporary(cls, spark: SparkSession) -> IndexStore:
        """A store in a fresh folder that the cluster shares."""
        return cls(spark, shared_dir(spark, "index"))

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("run").parquet(f"{self.path}/{table}")

    def read(self, table: str, where: Mapping[str, object] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows equal on all of `where`; an unknown column is an error."""
        df = self.spark.read.parquet(f"{self.path}/{table}")
        for c in (*(where or {}), *(columns or ())):
            if c not in df.columns:
                raise ValueError(f"{table} has no column {c}")
        for c, v in (where or {}).items():
            df = df.where(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
        return df.select(*columns) if columns else df

    def replace_sources(self, table: str, rows: DataFrame) -> None:
        """Append rows (source, run, ...); files of earlier runs of their sources go once the new ones are written.

        Rows lie by source and run, so nothing else is read or written again.
        """
        rows.write.mode("append").partitionBy("source", "run").parquet(f"{self.path}/{table}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for r in rows.select("source", "run").distinct().toLocalIterator():
            folder = hadoop.Path(f"{self.path}/{table}/source={r.source}")
            fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for old in fs.listStatus(folder):
                if old.getPath().getName() not in (f"run={r.run}", "_SUCCESS"):
                    fs.delete(old.getPath(), True)

    def delete_run(self, run: str, tables: Sequence[str]) -> None:
        """Drop a run's partitions; others aren't touched."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for table in tables:
            path = hadoop.Path(f"{self.path}/{table}/run={run}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
