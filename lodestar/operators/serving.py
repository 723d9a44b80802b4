"""Lookups and checks beside the reading chain: dictionary values, phrases, labels, anchors, evidence, permissions, requests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised, pattern_spans


def forms_of(rows: DataFrame, of: str, key: str, kinds: Mapping[str, str]) -> DataFrame:
    """class, instance, kind, column, value, key of each identifier column of rows, in one scan; empty values are left out."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c, k in kinds.items()])
    out = rows.select(F.lit(of).alias("class"), F.col(key).alias("instance"), F.explode(each).alias("f")).select("class", "instance", "f.*")
    return out.withColumn("key", normalised(F.col("value"))).where("key <> ''")


def looked_up(asked: DataFrame, forms: DataFrame) -> DataFrame:
    """asked (column, value, ...) with the instance of forms whose column and normal value are the same."""
    known = forms.select("column", "key", "class", "instance").distinct()
    return asked.withColumn("key", normalised(F.col("value"))).join(known, ["column", "key"])


def phrases(texts: DataFrame, of: Mapping[str, Sequence[str]]) -> DataFrame:
    """id, class, start_at, end_at, surface: whole phrases of each class in texts (id, text), whatever their case."""
    found = F.array(*[F.struct(F.lit(c).alias("class"), pattern_spans(r"(?i)\b(?:" + "|".join(p.replace(" ", r"\s+") for p in words) + r")\b")("text").alias("spans")) for c, words in of.items()])
    rows = texts.select("id", F.explode(found).alias("f")).select("id", "f.class", F.explode("f.spans").alias("s"))
    return rows.select("id", "class", "s.start_at", "s.end_at", "s.surface")


def labelled(texts: DataFrame, rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    """id, line, label, class, value: lines `label: value` of texts (id, text) whose label, in lower case, has a rule (class, kind); kind value names nothing."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    pairs = lines.select("id", "line", F.trim(F.regexp_extract("s", r"^([^:]+):\s*(.+)$", 1)).alias("label"), F.trim(F.regexp_extract("s", r"^([^:]+):\s*(.+)$", 2)).alias("value"))
    of = F.coalesce(*[F.when(F.lower("label") == name, F.lit(c)) for name, (c, kind) in rules.items() if kind != "value"])
    return pairs.where("value <> ''").withColumn("class", of).where("class is not null").select("id", "line", "label", "class", "value")


def anchored(constraints: DataFrame, anchor: DataFrame, related: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    """Rows of anchor that meet the constraints on their common columns, with related by its composite key where there is any: at most `most` + 1 of a cluster.

    One more than the limit tells the caller that there were too many.
    """
    common = [c for c in constraints.columns if c in anchor.columns]
    rows = constraints.join(anchor, common).join(related, list(keys), "left")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).where(F.col("nth") <= most + 1)


def evidence_agreement(truth: DataFrame, found: DataFrame) -> DataFrame:
    """n, agreeing: claims of both sides, and those with an asset (claim, asset) in common."""
    side = lambda df, flag: df.select("claim", "asset").distinct().withColumn(flag, F.lit(1))
    both = side(truth, "t").join(side(found, "f"), ["claim", "asset"], "full")
    each = both.groupBy("claim").agg(F.max("t").alias("t"), F.max("f").alias("f"), F.max(F.col("t") + F.col("f")).alias("shared"))
    return each.where("t = 1 and f = 1").agg(F.count("*").alias("n"), F.count("shared").alias("agreeing"))


def permitted(requests: DataFrame, grants: DataFrame, actions: Mapping[str, Sequence[str]]) -> DataFrame:
    """requests (principal, organisation, action, model) with allowed: a grant of the principal in the organisation whose role has the action, for the model or, where it names none, for all."""
    has = reduce(lambda a, b: a | b, [(F.col("role") == r) & F.col("action").isin(list(of)) for r, of in actions.items()])
    scopes = grants.select("principal", "organisation", "role", F.col("model").alias("scope")).distinct()
    keys = ["principal", "organisation", "action", "model"]
    fits = requests.select(*keys).distinct().join(scopes, ["principal", "organisation"]).where(has & (F.col("scope").isNull() | (F.col("scope") == F.col("model"))))
    # null-safe on the model: a request for none is met by a whole-organisation grant alone
    allowed = fits.select(*[F.col(k).alias(f"a_{k}") for k in keys]).distinct().withColumn("hit", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"a_{k}")) for k in keys])
    return requests.join(allowed, same, "left").select(*requests.columns, F.col("hit").isNotNull().alias("allowed"))


def inserted(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (id, key, hash) with outcome: the first of a key that is not stored is new; the same hash returns it, another is a conflict."""
    first = requests.groupBy("key").agg(F.min_by(F.struct("id", "hash"), "id").alias("first"))
    known = first.join(stored.select("key", F.col("hash").alias("stored_hash")), "key", "left")
    rows = requests.join(known, "key")
    held = F.coalesce("stored_hash", "first.hash")
    outcome = F.when(F.col("stored_hash").isNull() & (F.col("id") == F.col("first.id")), "new").when(F.col("hash") == held, "existing").otherwise("conflict")
    return rows.select("id", outcome.alias("outcome"))


def one_reference(assets: DataFrame, references: DataFrame) -> DataFrame:
    """asset, authorised: exactly one reference (asset, allows) allows it."""
    n = references.groupBy("asset").agg(F.count_if("allows").alias("n"))
    return assets.select("asset").join(n, "asset", "left").select("asset", F.coalesce(F.col("n") == 1, F.lit(False)).alias("authorised"))
