"""From mentions to cases, links and claims: each step of the reading chain as joins and aggregations over its whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cue_pattern

#: Order of cue strengths, the strongest first (fixed values).
STRENGTHS = ("strong", "medium", "weak")


def single(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """keys, name: the only value of each key, null where there are several.

    Least and greatest are enough to tell, so a key of very many rows is combined before the shuffle.
    """
    ends = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return ends.select(*keys, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias(name), F.lit(True).alias(f"has_{name}"))


# mentions
def confirmed(hits: DataFrame) -> DataFrame:
    """Accepted hits (asset, class, key, instance, deferred, partial), and the deferred ones that their asset confirms elsewhere.

    A whole name needs the same class and key accepted in the asset, a partial one an instance anchored there.
    """
    sure = hits.where("not deferred")
    names = sure.select("asset", "class", "key").distinct()
    anchored = sure.where("not partial").select("asset", "class", "instance").distinct()
    late = hits.where("deferred")
    whole = late.where("not partial").join(names, ["asset", "class", "key"], "left_semi")
    parts = late.where("partial").join(anchored, ["asset", "class", "instance"], "left_semi")
    return sure.unionByName(whole.select(*sure.columns)).unionByName(parts.select(*sure.columns))


def header_mentions(segments: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """id, start_at, surface, class: the value of each field that a rule names, where the segment's text (id, text, fields) holds it."""
    named = F.array(*[F.struct(F.lit(c).alias("class"), F.trim(F.col("fields")[f]).alias("surface")) for f, c in rules.items()])
    rows = segments.select("id", "text", F.explode(named).alias("r")).where("r.surface <> ''")
    found = rows.withColumn("start_at", F.expr("instr(text, r.surface) - 1"))
    return found.where("start_at >= 0").select("id", "start_at", "r.surface", "r.class")


# cases
def case_edges(identifiers: DataFrame, dates: DataFrame, window_days: int, most: int) -> DataFrame:
    """src, dst: assets that share an identifier (asset, name, value, strong) belong to one case.

    A strong one links all its assets, by a star to the least. A weak one of at most `most` assets links those whose dates (asset, day) are
    within the window: linking neighbours in date order gives the same cases as all pairs do.
    """
    rows = identifiers.select("asset", "name", "value", "strong").distinct()
    hub = rows.where("strong").groupBy("name", "value").agg(F.min("asset").alias("dst"))
    stars = rows.where("strong").join(hub, ["name", "value"]).select(F.col("asset").alias("src"), "dst")
    few = rows.where("not strong").groupBy("name", "value").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).drop("n")
    by_day = Window.partitionBy("name", "value").orderBy("day", "asset")
    near = rows.where("not strong").join(few, ["name", "value"]).join(dates, "asset").select("asset", "day", F.lag("asset").over(by_day).alias("dst"), F.lag("day").over(by_day).alias("before"))
    chain = near.where(F.datediff("day", "before") <= window_days).select(F.col("asset").alias("src"), "dst")
    return stars.where("src <> dst").unionByName(chain).distinct()


def constraints(readings: DataFrame) -> DataFrame:
    """cluster, class, instance from readings (cluster, class, instance, tier): exact keys where a class has any, else the rest."""
    each = readings.groupBy("cluster", "class", "instance").agg(F.max(F.col("tier") == "exact_key").alias("keyed"))
    best = each.groupBy("cluster", "class").agg(F.max("keyed").alias("any_keyed"))
    return each.join(best, ["cluster", "class"]).where("keyed = any_keyed").select("cluster", "class", "instance")


def queryable(found: DataFrame, lookups: DataFrame, least: int = 2) -> DataFrame:
    """Clusters with an exact lookup value (cluster, column, match), or constraints of at least `least` kinds."""
    kinds = found.select("cluster", F.concat(F.lit("class:"), "class").alias("kind"), F.lit(False).alias("exact"))
    kinds = kinds.unionByName(lookups.select("cluster", F.concat_ws(":", F.lit("column"), "column", "match").alias("kind"), (F.col("match") == "equals").alias("exact")))
    distinct = kinds.groupBy("cluster", "kind").agg(F.max("exact").alias("exact"))
    return distinct.groupBy("cluster").agg(F.count("*").alias("n"), F.max("exact").alias("exact")).where(F.col("exact") | (F.col("n") >= least)).select("cluster")


def decided(rows: DataFrame, dates: DataFrame, most: int) -> DataFrame:
    """cluster, row: the only row of a cluster (cluster, row, day), or of at most `most` the only one on a date that its documents (cluster, day) mention."""
    agreeing = rows.join(dates.distinct().withColumn("agrees", F.lit(True)), ["cluster", "day"], "left")
    each = agreeing.groupBy("cluster", "row").agg(F.coalesce(F.max("agrees"), F.lit(False)).alias("agrees"))
    both = each.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("agrees").alias("k"), F.min("row").alias("one"), F.min(F.when(F.col("agrees"), F.col("row"))).alias("agreed"))
    row = F.when(F.col("n") == 1, F.col("one")).when((F.col("n") <= most) & (F.col("k") == 1), F.col("agreed"))
    return both.select("cluster", row.alias("row")).where("row is not null")


# links
def promoted(readings: DataFrame, identified: DataFrame) -> DataFrame:
    """mention, target: readings (mention, cluster, instance) that can name an instance of the identified row (cluster, instance, preferred).

    The row's own instances go before those of related records, then the least.
    """
    hits = readings.join(identified, ["cluster", "instance"])
    return hits.groupBy("mention").agg(F.min_by("instance", F.struct(~F.col("preferred"), "instance")).alias("target"))


def contextual(phrases: DataFrame, links: DataFrame) -> DataFrame:
    """phrases (asset, cluster, class) with target: the one instance of the class in the asset, else, where it has none, in the cluster."""
    near, far = single(links, ["asset", "class"], "instance", "near"), single(links, ["cluster", "class"], "instance", "far")
    both = phrases.join(near, ["asset", "class"], "left").join(far, ["cluster", "class"], "left")
    target = F.when(F.col("has_near"), F.col("near")).otherwise(F.col("far"))
    return both.select(*phrases.columns, target.alias("target")).where("target is not null")


def about(links: DataFrame, cases: DataFrame, priority: Sequence[str]) -> DataFrame:
    """asset, about: the case's entity (asset, entity), else the target that a title names, else the most mentioned (asset, target, class, titled)."""
    place = F.coalesce(*[F.when(F.col("class") == c, F.lit(i)) for i, c in enumerate(priority)], F.lit(len(priority)))
    each = links.groupBy("asset", "target", "class").agg(F.count("*").alias("n"), F.max("titled").alias("titled")).withColumn("place", place)
    order = F.struct(~F.col("titled"), F.when(F.col("titled"), 0).otherwise(-F.col("n")), "place", "target")
    best = each.groupBy("asset").agg(F.min_by("target", order).alias("target"))
    return best.join(cases, "asset", "full").select("asset", F.coalesce("entity", "target").alias("about"))


def relationships(links: DataFrame, abouts: DataFrame) -> DataFrame:
    """type, src, dst, confidence: Mentions of every link (asset, target, confidence) and About, one of each with its highest confidence."""
    mentions = links.select(F.lit("Mentions").alias("type"), F.col("asset").alias("src"), F.col("target").alias("dst"), "confidence")
    of = abouts.select(F.lit("About").alias("type"), F.col("asset").alias("src"), F.col("about").alias("dst"), F.lit(1.0).alias("confidence"))
    return mentions.unionByName(of).groupBy("type", "src", "dst").agg(F.max("confidence").alias("confidence"))


def entity_book(forms: DataFrame) -> DataFrame:
    """class, instance, name, external_ids from forms (class, instance, kind, column, surface): the first display form, else the first; keys as column=value, sorted."""
    name = F.min_by("surface", F.struct(F.col("kind") != "display", "surface"))
    key = F.when(F.col("kind") == "key", F.concat_ws("=", "column", "surface"))
    return forms.groupBy("class", "instance").agg(name.alias("name"), F.array_sort(F.collect_set(key)).alias("external_ids"))


# claims
def strength(phrase: str, weak: Sequence[str] = ()) -> str:
    """Three words, a label or a gap: strong; one word of the weak list: weak; else medium."""
    words = phrase.split()
    if len(words) >= 3 or "*" in words or phrase.endswith(":"):
        return "strong"
    return "weak" if len(words) == 1 and phrase.lower() in weak else "medium"


def best_cues(units: DataFrame, cues: Mapping[str, Sequence[str]], weak: Sequence[str] = ()) -> DataFrame:
    """units (text and others) by predicate with the phrase and strength of its strongest cue; longer phrases first, then by code point."""

    def best(phrases: Sequence[str]) -> Column:
        order = sorted(phrases, key=lambda p: (STRENGTHS.index(strength(p, weak)), -len(p), p))
        return F.coalesce(*[F.when(F.col("text").rlike(cue_pattern(p)), F.struct(F.lit(p).alias("phrase"), F.lit(strength(p, weak)).alias("strength"))) for p in order])

    hits = F.array(*[F.struct(F.lit(p).alias("predicate"), best(of).alias("cue")) for p, of in sorted(cues.items())])
    rest = [c for c in units.columns if c != "text"]
    return units.select(*rest, F.explode(hits).alias("h")).where("h.cue is not null").select(*rest, "h.predicate", "h.cue.phrase", "h.cue.strength")


def role(units: DataFrame, steps: Sequence[tuple[Sequence[str], DataFrame]], name: str) -> DataFrame:
    """units with the entity of a role: the first step (keys, rows of keys and entity) that gives exactly one."""
    out = units
    for i, (keys, rows) in enumerate(steps):
        out = out.join(single(rows, keys, "entity", f"step{i}").drop(f"has_step{i}"), list(keys), "left")
    return out.select(*units.columns, F.coalesce(*[f"step{i}" for i in range(len(steps))]).alias(name))


def speaker(rules: Sequence[tuple[str, str | None, Sequence[str], str]]) -> Column:
    """The speaker of the first rule (segment, field, values, speaker) that fits columns segment and fields, else unknown."""

    def fits(segment: str, field: str | None, values: Sequence[str]) -> Column:
        is_segment = F.col("segment") == segment
        if field is None:
            return is_segment
        value = F.lower(F.coalesce(F.col("fields")[field], F.lit("")))
        return is_segment & (value != "") & (value.isin([v.lower() for v in values]) if values else F.lit(True))

    return F.coalesce(*[F.when(fits(s, f, v), F.lit(who)) for s, f, v, who in rules], F.lit("unknown"))


def reason(shapes: Mapping[str, tuple[Sequence[str], bool]]) -> Column:
    """Why a hit (predicate, voice, strength, named, subject, object) makes no claim, null where it makes one.

    shapes: predicate to (speakers that may not make it, whether an unknown speaker needs a strong cue); named: its unit names exactly one entity of the subject's class.
    """
    known = F.col("predicate").isin(list(shapes))
    blocked = reduce(lambda a, b: a | b, [(F.col("predicate") == p) & (F.col("voice").isin(list(who)) | (F.lit(strict) & (F.col("voice") == "unknown") & (F.col("strength") != "strong"))) for p, (who, strict) in shapes.items()])
    return (
        F.when(~known, "undefined")
        .when(blocked, "speaker")
        .when((F.col("strength") == "weak") & ~F.col("named"), "weak_cue")
        .when(F.col("subject").isNull(), "no_subject")
        .when(F.col("object").isNull(), "no_object")
    )


def claims(hits: DataFrame, confidence: Mapping[str, float]) -> DataFrame:
    """predicate, subject, object, confidence, n_evidence of the hits without a reason against them; units count once."""
    value = F.coalesce(*[F.when(F.col("strength") == s, F.lit(c)) for s, c in confidence.items()])
    each = hits.where("reason is null").groupBy("predicate", "subject", "object", "unit").agg(F.max(value).alias("confidence"))
    return each.groupBy("predicate", "subject", "object").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_evidence"))


def entity_claims(entities: DataFrame, made: DataFrame, needle: str, max_entities: int = 5, max_claims: int = 25) -> DataFrame:
    """Claims (claim, predicate, subject, object) of the entities (entity, name) that are called needle, or hold it in their names.

    Both limits belong to the lookup. The chosen entities are at most max_entities, so they are broadcast.
    """
    want = needle.strip().lower()
    rank = F.when((F.lower("name") == want) | (F.lower("entity") == want), 0).when(F.lower("name").contains(want), 1)
    chosen = entities.withColumn("rank", rank).where("rank is not null").orderBy("rank", "name", "entity").limit(max_entities).select("entity")
    ends = made.select("*", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"))
    return ends.join(F.broadcast(chosen), "entity", "left_semi").select(*made.columns).distinct().orderBy("predicate", "claim").limit(max_claims)


def shaped(raw: DataFrame, linked: DataFrame, shapes: Mapping[str, tuple[str, str]]) -> DataFrame:
    """predicate, subject, object of raw claims (predicate, source, target) whose ends both resolve (key, class, entity) to the classes of the shape."""
    end = lambda of, side: linked.select(F.col("key").alias(side), F.col("class").alias(f"{side}_class"), F.col("entity").alias(of))
    both = raw.join(end("subject", "source"), "source").join(end("object", "target"), "target")
    fits = reduce(lambda a, b: a | b, [(F.col("predicate") == p) & (F.col("source_class") == s) & (F.col("target_class") == o) for p, (s, o) in shapes.items()])
    return both.where(fits).select("predicate", "subject", "object").distinct()


def mapping_for(mappings: DataFrame, version: str) -> DataFrame:
    """The active mapping (mapping, version, active) of an ontology version, or of `name@version`, else the only active one."""
    live = mappings.where("active").withColumn("fits", (F.col("version") == version) | F.col("version").endswith(f"@{version}"))
    best = live.agg(F.count("*").alias("n"), F.min(F.when(F.col("fits"), F.col("mapping"))).alias("fitting"), F.min("mapping").alias("one"))
    return best.select(F.coalesce("fitting", F.when(F.col("n") == 1, F.col("one"))).alias("mapping")).where("mapping is not null")
