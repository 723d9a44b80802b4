"""Assets to read: scopes by globs, media types, table rows as documents, incremental plans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Media types by ending (fixed values).
MIME = {"html": "text/html", "json": "application/json", "pdf": "application/pdf", "txt": "text/plain"}


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: * is any run, ? any character."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def in_scope(assets: DataFrame, column: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Assets that an include glob matches (any, if there are none) and no exclude glob does."""
    if include:
        assets = assets.where(F.col(column).rlike("|".join(map(glob_pattern, include))))
    return assets.where(~F.col(column).rlike("|".join(map(glob_pattern, exclude)))) if exclude else assets


def mime_of(column: str) -> Column:
    out = F.lit("application/octet-stream")
    for ending, kind in MIME.items():
        out = F.when(F.lower(column).endswith(f".{ending}"), kind).otherwise(out)
    return out


def rows_as_documents(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """asset_key, part, text, version: each non-blank text column of a row is a part; a row's version is the digest of its texts."""
    version = F.sha2(F.concat_ws("|", *columns), 256)
    parts = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("text")) for c in columns])
    return rows.select(F.col(key).alias("asset_key"), version.alias("version"), F.explode(parts).alias("p")).where("trim(p.text) <> ''").select("asset_key", "p.part", "p.text", "version")


def incremental_plan(now: DataFrame, before: DataFrame) -> DataFrame:
    """asset_id and whether its version changed since `before`; new assets have changed."""
    old = before.select("asset_id", F.col("version").alias("old"))
    return now.join(old, "asset_id", "left").select("asset_id", F.when(F.col("old") == F.col("version"), "unchanged").otherwise("changed").alias("status"))


def binary_files(spark, path: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """path, length, sha256 of files; those over `most` bytes have the status too_large."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    large = F.lit(False) if most is None else F.col("length") > most
    return files.select("path", "length", F.when(large, "too_large").otherwise("ok").alias("status"), F.when(~large, F.sha2("content", 256)).alias("sha256"))
