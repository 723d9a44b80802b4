"""Profiling of tables: column statistics in one pass, key candidates, foreign keys by name and by measured overlap."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Endings of names that look like keys, endings that make one sure of it, words of a column's name that tell nothing of its target.
KEY_SUFFIXES = ("_sk", "_id", "_key", "key", "id")
SURE_SUFFIXES = ("_sk", "_id")
STOP_WORDS = frozenset("sk id key dim bill ship sold returned return refunded returning current first last start end open closed close creation access".split())
#: Types that are joined with one another (fixed values); others only with themselves.
FAMILIES = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "decimal", "double": "decimal"}
#: Share of a foreign key's distinct values that must be found.
ACCEPTED = 0.95


def column_stats(df: DataFrame, table: str, exact: bool = False) -> DataFrame:
    """table_name, column_name, n_rows, non_null, ndv, lo, hi, null_rate: one scan, one aggregation, then one row a column.

    exact: count distinct values exactly, else by a sketch, which needs no shuffle of values.
    """
    names = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"c{i}"), (F.count_distinct(x) if exact else F.approx_count_distinct(x)).alias(f"d{i}"), F.min(x).cast("string").alias(f"l{i}"), F.max(x).cast("string").alias(f"h{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("non_null"), F.col(f"d{i}").alias("ndv"), F.col(f"l{i}").alias("lo"), F.col(f"h{i}").alias("hi")) for i, c in enumerate(names)])
    out = df.agg(*aggs).select("n_rows", F.explode(rows).alias("s"))
    return out.select(F.lit(table).alias("table_name"), "s.column_name", "n_rows", "s.non_null", "s.ndv", "s.lo", "s.hi", F.round(F.try_divide(F.col("n_rows") - F.col("s.non_null"), "n_rows"), 4).alias("null_rate"))


def primary_keys(df: DataFrame, table: str) -> DataFrame:
    """table_name, column_name, confidence of columns without nulls, named like a key, whose exact distinct count is the row count.

    The sketch rules most columns out, so only likely ones are counted exactly.
    """
    first = column_stats(df, table).where("non_null = n_rows and n_rows > 0 and ndv >= 0.85 * n_rows")
    likely = [r["column_name"] for r in first.select("column_name").collect() if r["column_name"].lower().endswith(KEY_SUFFIXES)]
    if not likely:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, confidence double")
    exact = column_stats(df.select(*likely), table, exact=True)
    sure = F.when(F.expr(" or ".join(f"endswith(lower(column_name), '{x}')" for x in SURE_SUFFIXES)), 0.95).otherwise(0.8)
    return exact.where("ndv = n_rows").select("table_name", "column_name", sure.alias("confidence"))


def words(name: str) -> list[str]:
    """Words of a table's or column's name that say what it is about; a word may end in key (custkey)."""
    parts = (re.sub(r"(?<=.)key$", "", x) for x in re.findall(r"[a-z0-9]+", name.lower()))
    return [x for x in parts if x not in STOP_WORDS]


def stem(column: str) -> list[str]:
    """A column's words without its table's prefix, unless nothing else is left."""
    prefix, all_words = column.lower().split("_")[0], words(column)
    return [x for x in all_words if x != prefix] or all_words


def name_score(column: str, table: str, key: str | None = None) -> float:
    """How well a column's name points at a table (and its key).

    1: its stem is the table's name or the key's stem. 0.9: each word shortens one of the table's to three letters or more, and one is no word
    of the table. 0.8: a word of four letters or more is the table's first initial and a beginning of its last word. 0.7: they share a word. Else 0.
    """
    mine, its = stem(column), words(table)
    if not (mine and its):
        return 0.0
    if "".join(mine) == "".join(its) or (key and stem(key) == mine):
        return 1.0
    shortens = [len(x) >= 3 and any(y.startswith(x) for y in its) for x in mine]
    if all(shortens) and not set(mine) <= set(its):
        return 0.9
    if len(its) > 1 and any(len(x) > 3 and x[0] == its[0][0] and its[-1].startswith(x[1:]) for x in mine):
        return 0.8
    return 0.7 if set(mine) & set(its) else 0.0


def family(kind: str) -> str:
    return "decimal" if kind.startswith("decimal") else FAMILIES.get(kind, kind)


def refers(table: str, column: str) -> bool:
    """Whether a column looks like a key and doesn't name its own table."""
    return column.lower().endswith(KEY_SUFFIXES) and words(table) not in (stem(column), words(column))


def targets(table: str, column: str, kind: str, keys: Iterable[tuple[str, str, str, int]]) -> list[tuple[float, str, str, int]]:
    """(score by name, table, key, its rows) of the keys (table, key, family, rows) of other tables that have the column's type."""
    return [(name_score(column, t, k), t, k, n) for t, k, f, n in keys if t != table and f == family(kind)]


def candidates(catalogue: Iterable[tuple[str, str, str, int, int, bool]], named: int = 3, most: int = 400) -> list[tuple[str, str, str, str, float, int]]:
    """(table, column, target, its key, score by name, its rows) from rows (table, column, type, rows, distinct values, is key) of a catalogue.

    A column that looks like a key, is none in its table and doesn't name the table itself goes to the `named` best keys of its type by name, the
    smaller table first; without a name, to every key of its type in a table of at least as many rows as it has values. At most `most` pairs in all.
    """
    columns = list(catalogue)
    keys = [(t, c, family(kind), n) for t, c, kind, n, _, is_key in columns if is_key]
    out = []
    for table, column, kind, _, values, is_key in columns:
        if is_key or not values or not refers(table, column):
            continue
        fits = targets(table, column, kind, keys)
        by_name = sorted((x for x in fits if x[0] > 0), key=lambda x: (-x[0], x[3]))[:named]
        out += [(table, column, t, k, score, n) for score, t, k, n in by_name or [x for x in fits if values <= x[3]]]
    return out[:most]


def overlap(fk: DataFrame, fk_column: str, pk: DataFrame, pk_column: str) -> DataFrame:
    """n_distinct and n_unmatched values of a foreign key; both sides are reduced to distinct keys before they meet."""
    left = fk.select(F.col(fk_column).alias("k")).where("k is not null").distinct()
    right = pk.select(F.col(pk_column).alias("k"), F.lit(1).alias("hit")).distinct()
    return left.join(right, "k", "left").agg(F.count("*").alias("n_distinct"), F.count_if(F.col("hit").isNull()).alias("n_unmatched"))


def catalogue_of(tables: Mapping[str, DataFrame], declared: Mapping[str, str] | None = None, exact: bool = False) -> list[tuple[str, str, str, int, int, bool]]:
    """(table, column, type, rows, distinct values, is key) of each column: one row a column, whatever the tables hold.

    declared: the key of each table that has one, else keys are looked for. exact: values are counted exactly, each column by itself, where
    `candidates` holds their number against rows, which is where no key fits by name; elsewhere, and without it, by a sketch.
    """
    out = []
    for t, df in tables.items():
        keys = {r["column_name"] for r in primary_keys(df, t).collect()} if declared is None else {declared.get(t)}
        kinds = dict(df.dtypes)
        out += [(t, r["column_name"], kinds[r["column_name"]], r["n_rows"], r["ndv"], r["column_name"] in keys) for r in column_stats(df, t).collect()]
    if not exact:
        return out
    keys = [(t, c, family(kind), n) for t, c, kind, n, _, is_key in out if is_key]
    by_size = lambda t, c, kind, is_key: not is_key and refers(t, c) and not any(x[0] > 0 for x in targets(t, c, kind, keys))
    return [(t, c, kind, n, column_stats(tables[t].select(f"`{c}`"), t, exact=True).first()["ndv"] if by_size(t, c, kind, is_key) else values, is_key) for t, c, kind, n, values, is_key in out]


def foreign_keys(tables: Mapping[str, DataFrame], named: int = 3) -> DataFrame:
    """fk_table, fk_column, pk_table, pk_column, score, match_ratio: the best target of each column, by found share, then name, then the smaller table.

    Each candidate is measured on distinct keys. A score of 0 is found in the data alone: a suggestion, no relationship yet.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = [
        overlap(tables[table], column, tables[t], k).select(
            F.lit(table).alias("fk_table"), F.lit(column).alias("fk_column"), F.lit(t).alias("pk_table"), F.lit(k).alias("pk_column"), F.lit(score).alias("score"), F.lit(n).alias("pk_rows"),
            F.round(1 - F.try_divide("n_unmatched", "n_distinct"), 4).alias("match_ratio"),
        )
        for table, column, t, k, score, n in candidates(catalogue_of(tables), named)
    ]
    if not parts:
        return spark.createDataFrame([], "fk_table string, fk_column string, pk_table string, pk_column string, score double, match_ratio double")
    rank = F.row_number().over(Window.partitionBy("fk_table", "fk_column").orderBy(F.desc("match_ratio"), F.desc("score"), "pk_rows", "pk_table"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(f"rank = 1 and match_ratio >= {ACCEPTED}").drop("rank", "pk_rows")
