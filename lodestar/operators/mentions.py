"""Mentions in texts: dictionary scans by n-grams, longest match, unique resolution, candidate scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens
from ..storage import stored

LONGEST = 12
#: A name of more instances stays unresolved.
MOST_CANDIDATES = 20


#: First tokens of keys that are broadcast (some 40 bytes each); with more, runs are joined by a shuffle. Up to MOST_LISTED are looked up before runs are made.
MOST_BROADCAST = 200_000
MOST_LISTED = 1_000


def keyed(forms: DataFrame) -> DataFrame:
    return forms.distinct().withColumn("key", F.lower(F.array_join(tokens(F.col("surface")), " "))).where("key <> ''")


def dictionary(forms: DataFrame) -> DataFrame:
    """key, class, surface, n_instances from rows (class, surface, instance).

    The key is the surface's tokens in lower case, joined by blanks. Instances are only counted: candidates come from the
    whole table of instances, so a surface of very many stays one short row here.
    """
    return keyed(forms).groupBy("class", "key").agg(F.min("surface").alias("surface"), F.count_distinct("instance").alias("n_instances"))


def starts(words: DataFrame) -> DataFrame:
    """first, sizes: the first token of each key and the numbers of tokens of the keys that begin with it."""
    parts = F.split("key", " ")
    return words.groupBy(parts[0].alias("first")).agg(F.collect_set(F.size(parts)).alias("sizes"))


def placed(texts: DataFrame, longest: int = LONGEST, only: list[str] | None = None) -> DataFrame:
    """id, start_at, first, run, ends: each token of texts (id, text) with the `longest` tokens from it on and where they end, in code points.

    Places are running sums of the lengths of tokens and of what lies between them, all in JVM expressions. only: first tokens to keep.
    """
    parts = texts.select("id", tokens(F.col("text")).alias("w"), F.split("text", TOKEN, -1).alias("g"))
    ends = F.expr("slice(aggregate(zip_with(w, slice(g, 1, size(w)), (x, y) -> length(x) + length(y)), array(0), (acc, x) -> acc || array(element_at(acc, -1) + x)), 2, size(w))")
    kept = F.transform("w", lambda x, i: F.struct(i.alias("i"), F.lower(x).alias("first")))
    kept = kept if only is None else F.filter(kept, lambda x: x["first"].isin(only))
    each = F.expr(f"transform(k, x -> named_struct('start_at', e[x.i] - length(w[x.i]), 'first', x.first, 'run', slice(w, x.i + 1, {longest}), 'ends', slice(e, x.i + 1, {longest})))")
    return parts.withColumn("k", kept).where("size(k) > 0").withColumn("e", ends).select("id", F.explode(each).alias("t")).select("id", "t.*")


def grams(texts: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """id, start_at, end_at, key: runs of up to `longest` tokens of texts (id, text) that begin as a key of words begins and have as many tokens."""
    heads = stored(starts(words), "heads")
    n = heads.count()
    only = [r["first"] for r in heads.select("first").collect()] if n <= MOST_LISTED else None
    heads = F.broadcast(heads) if n <= MOST_BROADCAST else heads
    runs = F.expr("transform(filter(sizes, n -> n <= size(run)), n -> named_struct('end_at', ends[n - 1], 'key', lower(array_join(slice(run, 1, n), ' '))))")
    return placed(texts, longest, only).join(heads, "first").select("id", "start_at", F.explode(runs).alias("g")).select("id", "start_at", "g.*")


def scanned(texts: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """id, start_at, end_at, class, key, surface, n_instances: dictionary hits, the longest of those that overlap.

    Of hits in a text the longest goes first, then the leftmost; what it covers is out. Classes of one span all stay.
    """
    keys = words.select("key").distinct()
    hits = grams(texts, words, longest).join(keys, "key")
    found = hits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((F.col("start_at") - F.col("end_at")).alias("size"), "start_at", "end_at", "key"))).alias("h"))
    kept = F.expr("aggregate(h, filter(h, x -> false), (acc, x) -> if(exists(acc, y -> y.start_at < x.end_at and x.start_at < y.end_at), acc, concat(acc, array(x))))")
    return found.select("id", F.explode(kept).alias("x")).select("id", "x.start_at", "x.end_at", "x.key").join(words, "key")


def instances(forms: DataFrame) -> DataFrame:
    """class, key, instance: every instance of every surface."""
    return keyed(forms).select("class", "key", "instance").distinct()


def candidates(mentions: DataFrame, instances: DataFrame, most: int | None = MOST_CANDIDATES) -> DataFrame:
    """id, start_at, class, instance, score: an exact key's score is shared by its classes and instances.

    All instances of a mention are candidates; a name of more than `most` has none. Keys have no such limit (most None).
    """
    w = Window.partitionBy("id", "start_at", "end_at")
    scored = mentions.withColumn("classes", F.count("*").over(w))
    few = scored if most is None else scored.where(F.col("n_instances") <= most)
    return few.join(instances, ["class", "key"]).select("id", "start_at", "class", "instance", (1 / (F.col("classes") * F.col("n_instances"))).alias("score"))


def links(scored: DataFrame, threshold: float = 0.9, gap: float = 0.05, possible: int = 3) -> DataFrame:
    """id, start_at, instance, link: SameAs where the best score reaches the threshold and leads by more than the gap, else the first PossiblySameAs."""
    w = Window.partitionBy("id", "start_at").orderBy(F.desc("score"), "class", "instance")
    ranked = scored.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    sure = F.max(F.expr(f"rank = 1 and score >= {threshold} and score - coalesce(next, 0) > {gap}")).over(Window.partitionBy("id", "start_at"))
    ranked = ranked.withColumn("sure", sure).where(f"if(sure, rank = 1, rank <= {possible})")
    return ranked.select("id", "start_at", "class", "instance", F.when(F.col("sure"), "SameAs").otherwise("PossiblySameAs").alias("link"))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans (id, start_at, end_at) of a and b that intersect: an equi-join on the text and 64-character cells, then the range.

    Cells keep a long text with many spans from becoming all pairs; a pair is reported in the cell where the later of its spans begins.
    """
    cell = lambda df, x: df.select("id", F.col("start_at").alias(f"{x}_start"), F.col("end_at").alias(f"{x}_end"), F.explode(F.expr("sequence(cast(start_at div 64 as int), cast(greatest(end_at - 1, start_at) div 64 as int))")).alias("cell"))
    both = cell(a, "a").join(cell(b, "b"), ["id", "cell"])
    return both.where("a_start < b_end and b_start < a_end and cell = greatest(a_start, b_start) div 64").drop("cell")
