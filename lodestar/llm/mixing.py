"""Operator 6: mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule w(t) = weight * (1 + slope * (2t - 1)) over training time t in [0, 1]; its
integral from 0 to t, over the integral to 1, is the share of the source's target that training has asked for
by t. A document lies at an interval of its source's token line (in hash order); inverting the demand at the
interval's middle gives its training position, and documents are range-sorted by position. A target above the
source's size is met by further passes over the line, so a document is taken up to three times.

Rows that are alike in every column are one stretch of the line with a number of copies. Prefix sums of a source are
made in three levels: within (source, hash bucket), over the buckets of a group of buckets, over the groups, so no
source is ever one task. Buckets follow the number of rows, and a stretch's place is a hash of the whole row, so rows
without an id or with one in common spread as others do.

Nulls: a null text has size 0 and takes no words; null sources form one source, last in order; null doc_ids are
ordinary documents. Repeated rows each take a place. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: How far a source's schedule tilts over time, repeating: rises, falls, stays.
SLOPES = (0.5, -0.5, 0.0)
#: A target stops at this many times its source's size.
MOST = 3.0
#: Stretches in a hash bucket, about, and buckets in a group.
BUCKET_ROWS = 2_000
GROUP = 1024
#: Sources whose table is broadcast (some 60 bytes each); with more it is joined by a shuffle.
MOST_BROADCAST = 50_000


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, most: float = MOST) -> list[float]:
    """Share the sum of sizes by weight; cap each at most * size, resharing the excess until none is above."""
    free, left, out = set(range(len(sizes))), float(sum(sizes)), [0.0] * len(sizes)
    while free:
        whole = sum(weights[i % len(weights)] for i in free)
        want = {i: left * weights[i % len(weights)] / whole for i in free}
        over = [i for i in sorted(free) if want[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = want[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
            free.discard(i)
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), mark (hash of the text), row (hash of all columns) and copies of each different row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("mark"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    return rows.groupBy("doc_id", "source", "size", "mark", "row").agg(F.count("*").alias("copies"))


def before(*by: str, order: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def lines(docs: DataFrame, weights: Sequence[float], slopes: Sequence[float], most: float) -> DataFrame:
    """sized(docs) with source_size, target and slope of the source, and begin: where the stretch begins on its source's line."""
    spark = docs.sparkSession
    rows = stored(sized(docs), "sizes")
    # one row a source: a table of sources, which are few by nature and are ordered here
    by_source = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("total")).collect()
    by_source = sorted(by_source, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["total"] for r in by_source], weights, most)
    table = spark.createDataFrame([(r["source"], int(r["total"]), float(g), float(slopes[i % len(slopes)])) for i, (r, g) in enumerate(zip(by_source, goal))], "s string, source_size long, target double, slope double")
    table = F.broadcast(table) if len(by_source) <= MOST_BROADCAST else table
    buckets = max(1, -(-sum(r["n"] for r in by_source) // BUCKET_ROWS))
    place = F.xxhash64(F.lit("mix"), "doc_id", "row")
    rows = rows.withColumn("place", place).withColumn("bucket", F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * buckets).cast("long"))
    rows = rows.withColumn("words", F.col("size") * F.col("copies"))
    sums = lambda order, *by: F.coalesce(F.sum("words").over(before(*by, order=order)), F.lit(0))
    per_bucket = stored(rows.groupBy("source", "bucket").agg(F.sum("words").alias("words")).withColumn("group", F.expr(f"bucket div {GROUP}")), "buckets")
    per_group = per_bucket.groupBy("source", "group").agg(F.sum("words").alias("words")).withColumn("base", sums(["group"], "source"))
    per_group = per_group.select(F.col("source").alias("s"), F.col("group").alias("g"), "base")
    within = per_bucket.withColumn("skip", sums(["bucket"], "source", "group"))
    head = within.join(per_group, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g"))).drop("s")
    head = head.join(table, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("bucket").alias("b"), (F.col("base") + F.col("skip")).alias("base"), "source_size", "target", "slope")
    rows = rows.withColumn("at", sums(["place", "doc_id", "row"], "source", "bucket"))
    rows = rows.join(head, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.withColumn("begin", F.col("base") + F.col("at")).drop("s", "b", "base", "at", "place", "bucket", "words")


def positions(most: float) -> str:
    """SQL: the training times of copy j of a stretch. In pass k its middle is k source sizes further on; it is taken if the demand reaches it."""
    middle = "(begin + (j + 0.5D) * size)"
    passes = f"if(size > 0 and target >= {middle}, least({int(most)}, cast(floor((target - {middle}) / source_size) as int) + 1), 0)"
    share = f"least(1.0D, ({middle} + k * source_size) / target)"
    # solve (1 - slope) t + slope t^2 = share for t in [0, 1]
    time = f"if(slope = 0, {share}, (sqrt((1 - slope) * (1 - slope) + 4 * slope * {share}) - (1 - slope)) / (2 * slope))"
    return f"transform(filter(sequence(0, {int(most) - 1}), k -> k < {passes}), k -> {time})"


def curriculum(docs: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, most: float = MOST) -> DataFrame:
    """doc_id, mark (hash of the text), source, size, source_size, target, passes (times taken), taken, positions (array of training times).

    One row for each row of docs, sorted by the first position.
    """
    line = lines(docs, weights, slopes, most).withColumn("j", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("positions", F.expr(positions(most)))
    passes = F.size("positions").cast("long")
    out = line.select("doc_id", "mark", "source", "size", "source_size", "target", passes.alias("passes"), (F.col("size") * passes).alias("taken"), "positions")
    return out.withColumn("first", F.get("positions", F.lit(0))).repartitionByRange(F.col("first").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("first").asc_nulls_last(), "doc_id").drop("first")


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, most: float = MOST) -> DataFrame:
    """The rows of docs as the mix takes them, repeats included, range-sorted by training position; columns as before."""
    names = docs.columns
    id_ = lambda c: F.coalesce(c.cast("long"), F.lit(-(2**63))).alias("id")
    plan = lines(docs, weights, slopes, most).withColumn("p", F.expr(f"flatten(transform(sequence(0L, copies - 1), j -> {positions(most)}))"))
    plan = plan.where("size(p) > 0").select(id_(F.col("doc_id")), "mark", "row", "p")
    # rows alike in every column are one here, too: combined before the shuffle, each goes on as often as its copies are taken
    packed = docs.select(id_(F.col("doc_id")), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("all"))
    one = packed.groupBy("id", "mark", "row").agg(F.first("all").alias("all"))
    taken = one.join(plan, ["id", "mark", "row"]).select("all", F.explode("p").alias("at"))
    return taken.repartitionByRange("at").sortWithinPartitions("at").select("all.*")
