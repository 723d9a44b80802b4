"""What comes before and after the reading chain: segments of assets, passages, allocations, truth tables, typed loads, versions of graphs and models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug

#: What reads a declared type, and the size and stride of a window of chat messages.
ANALYZERS = {"application/pdf": "pdf", "message/rfc822": "email", "application/json": "chat", "text/plain": "text", "text/markdown": "text"}
WINDOW, STRIDE = 6, 3
#: Words with an underscore that an expression may hold beside columns (fixed values).
SQL_WORDS = ("group_concat", "date_trunc", "date_part", "date_add", "date_sub", "current_date", "current_timestamp", "is_null", "not_null", "if_null", "if_not")

MESSAGES = "array<struct<role string, text string>>"


def content_kind(data: Column) -> Column:
    """pdf, chat, email or text: what a text looks like; null for JSON without messages and for an empty one."""
    head = F.ltrim(data)
    header = data.rlike(r"\A[\w-]+:") & F.split(data, r"\r?\n\r?\n", 2)[0].rlike("(?im)^(from|subject):")
    return (
        F.when(head.startswith("%PDF-"), "pdf").when(head.startswith("{") & F.get_json_object(data, "$.messages").startswith("["), "chat")
        .when(head.startswith("{"), None).when(header, "email").when(head != "", "text")
    )


def analysed(assets: DataFrame) -> DataFrame:
    """id, status, segments (ordinal, type, text) of assets (id, mime, data).

    unsupported: nothing reads the declared type, pages as bytes included. type_mismatch: the data looks like another type. Else ok: an email gives its
    subject, its sender and its body, a chat its messages, a text its paragraphs. Null data looks like nothing.
    """
    declared = reduce(lambda w, kv: w.when(F.col("mime") == kv[0], kv[1]), ANALYZERS.items(), F.when(F.lit(False), None))
    status = F.when(F.col("declared").isNull() | (F.col("declared") == "pdf"), "unsupported").when(~F.col("declared").eqNullSafe(content_kind(F.col("data"))), "type_mismatch").otherwise("ok")
    rows = assets.withColumn("declared", declared).withColumn("status", status)
    one = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    part = F.split("data", r"\r?\n\r?\n", 2)
    header = lambda name: F.trim(F.regexp_extract(part[0], rf"(?im)^{name}:[ \t]*(.*)$", 1))
    email = F.array(one("email_subject", header("subject")), one("email_header", header("from")), one("email_body", F.trim(F.get(part, F.lit(1)))))
    messages = F.transform(F.from_json(F.get_json_object("data", "$.messages"), MESSAGES), lambda m: one("message", F.trim(m["text"])))
    paragraphs = F.transform(F.split("data", r"\n\s*\n"), lambda p: one("paragraph", F.trim(p)))
    found = F.when(F.col("status") != "ok", None).when(F.col("declared") == "email", email).when(F.col("declared") == "chat", messages).otherwise(paragraphs)
    kept = F.filter(F.coalesce(found, F.array().cast("array<struct<type string, text string>>")), lambda s: s["text"] != "")
    numbered = F.transform(kept, lambda s, i: F.struct(i.cast("long").alias("ordinal"), s["type"].alias("type"), s["text"].alias("text")))
    return rows.select("id", "status", numbered.alias("segments"))


def passages(segments: DataFrame) -> DataFrame:
    """asset, ordinal, type, text from segments (asset, ordinal, type, text, speaker): searchable pieces, blank ones left out.

    The email segments of an asset are one passage: subject and sender, then the bodies. Messages make windows of WINDOW every STRIDE, without a
    last one that holds nothing new; a message is in two windows at most, so a long chat only doubles. Any other segment is its own. The messages of one
    asset are numbered by one task, which spills.
    """
    filled = segments.withColumn("text", F.trim("text")).where("text <> ''")
    mail = filled.where("startswith(type, 'email_')").groupBy("asset").agg(
        F.expr("min_by(text, ordinal) filter (where type = 'email_subject')").alias("subject"),
        F.expr("min_by(text, ordinal) filter (where type = 'email_header')").alias("sender"),
        F.expr("array_sort(collect_list(struct(ordinal, text)) filter (where type = 'email_body'))").alias("bodies"),
        F.expr("coalesce(min(ordinal) filter (where type = 'email_body'), min(ordinal) filter (where type = 'email_subject'))").alias("ordinal"),
    )
    heading = F.concat_ws("\n", F.concat(F.lit("Subject: "), "subject"), F.concat(F.lit("From: "), "sender"))
    body = F.concat_ws("\n\n", F.col("bodies.text"))
    mail = mail.where("ordinal is not null").select("asset", "ordinal", F.lit("email").alias("type"), F.concat_ws("\n\n", *[F.nullif(x, F.lit("")) for x in (heading, body)]).alias("text"))
    in_order = Window.partitionBy("asset")
    chat = filled.where("type = 'message'").withColumn("i", F.row_number().over(in_order.orderBy("ordinal")) - 1).withColumn("n", F.count("*").over(in_order))
    last = F.floor(F.col("i") / STRIDE).cast("int")
    chat = chat.withColumn("w", F.explode(F.sequence(F.greatest(last - (WINDOW // STRIDE - 1), F.lit(0)), last))).where((F.col("w") == 0) | (F.col("w") * STRIDE < F.col("n") - (WINDOW - STRIDE)))
    line = F.concat_ws(": ", F.nullif("speaker", F.lit("")), "text")
    chat = chat.groupBy("asset", "w").agg(F.min("ordinal").alias("ordinal"), F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("lines"))
    chat = chat.select("asset", "ordinal", F.lit("chat").alias("type"), F.concat_ws("\n", F.col("lines.line")).alias("text"))
    rest = filled.where("type <> 'message' and not startswith(type, 'email_')").select("asset", "ordinal", "type", "text")
    return mail.unionByName(chat).unionByName(rest)


def allocated(targets: DataFrame, weights: DataFrame, supports: DataFrame) -> DataFrame:
    """artifact, scenario, n: each target (artifact, n) over the scenarios that support it, by weight (whole numbers), largest remainder, ties by name.

    A target that no scenario of positive weight supports stays in one row with scenario null. Whole-number division keeps ties exact.
    """
    of = Window.partitionBy("artifact")
    pairs = supports.join(weights.where("weight > 0"), "scenario").select("artifact", "scenario", "weight").distinct()
    rows = targets.where("n > 0").join(pairs, "artifact", "left").withColumn("whole", F.sum("weight").over(of))
    rows = rows.withColumn("base", F.expr("n * weight div whole")).withColumn("over", F.expr("n * weight % whole"))
    rank = F.row_number().over(of.orderBy(F.desc("over"), "scenario"))
    share = F.col("base") + (rank <= F.col("n") - F.sum("base").over(of)).cast("long")
    return rows.select("artifact", "scenario", F.when(F.col("scenario").isNull(), F.col("n")).otherwise(share).alias("n")).where("n > 0")


def truth_entities(refs: DataFrame) -> DataFrame:
    """entity, kind, key, name of source rows (scenario, kind, key, name): one a kind and key, named by its first scenario."""
    return refs.groupBy("kind", "key").agg(F.min_by("name", F.struct("scenario", "name")).alias("name")).select(F.sha2(F.to_json(F.array("kind", "key")), 256).alias("entity"), "kind", "key", "name")


def truth_edges(refs: DataFrame, relations: DataFrame) -> DataFrame:
    """source, predicate, target, scenario: relations (source_kind, predicate, target_kind) between the rows of a scenario; of equal ones the first scenario's.

    A scenario has few rows of a kind; relations are a short list that the story declares.
    """
    rows = refs.select("scenario", "kind", "key")
    end = lambda name: rows.join(F.broadcast(relations.select(F.col(f"{name}_kind").alias("kind")).distinct()), "kind", "left_semi").distinct().select("scenario", F.col("kind").alias(f"{name}_kind"), F.col("key").alias(f"{name}_key"))
    pairs = end("source").join(F.broadcast(relations), "source_kind").join(end("target"), ["scenario", "target_kind"])
    # names are hashed last: only kinds and keys are shuffled
    first = pairs.groupBy("source_kind", "source_key", "predicate", "target_kind", "target_key").agg(F.min("scenario").alias("scenario"))
    entity = lambda name: F.sha2(F.to_json(F.array(f"{name}_kind", f"{name}_key")), 256).alias(name)
    return first.select(entity("source"), "predicate", entity("target"), "scenario")


def truth_claims(edges: DataFrame, evidence: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims: claim, scenario, type, subject, object; evidence: claim, artifact) of evidence (scenario, artifact, type).

    kinds (type, predicate) tells which edge a claim type states; evidence of a scenario without that edge claims nothing. Edges are each there once, as
    truth_edges gives them. So nothing needs to be made distinct after the join, and both results join the same two tables.
    """
    stated = edges.select("scenario", "predicate", F.col("source").alias("subject"), F.col("target").alias("object")).join(F.broadcast(kinds.select("type", "predicate").distinct()), "predicate")
    claim = F.sha2(F.to_json(F.array(F.col("scenario").cast("string"), "type", "subject", "object")), 256).alias("claim")
    given = evidence.select("scenario", "type", "artifact").distinct()
    rows = stated.join(given, ["scenario", "type"]).select(claim, "artifact")
    return stated.join(given, ["scenario", "type"], "left_semi").select(claim, "scenario", "type", "subject", "object"), rows


def loaded(tables: Mapping[str, DataFrame], nodes: Mapping[str, str], edges: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """edge, merged, skipped of each edge (name, table, column of its start, of its end) between the nodes (table: key column) of typed tables.

    Keys are told apart by their values (a:1, m:1): an edge is merged once and only where both ends were loaded; a null end is no edge.
    """
    ids = reduce(DataFrame.unionByName, [tables[t].select(F.col(key).alias("id")) for t, key in nodes.items()]).distinct()
    ends = [tables[table].select(F.lit(name).alias("edge"), F.col(start).alias("src"), F.col(end).alias("dst")) for name, table, start, end in edges]
    # all edges meet the nodes together, so that these are read and shuffled once for each end
    whole = reduce(DataFrame.unionByName, ends).where("src is not null and dst is not null").distinct()
    found = whole.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("starts")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("stops")), "dst", "left")
    counts = found.groupBy("edge").agg(F.count("*").alias("n"), F.count_if(F.col("starts") & F.col("stops")).alias("merged"))
    names = tables[edges[0][1]].sparkSession.createDataFrame([(e[0],) for e in edges], "edge string").distinct()
    return names.join(counts, "edge", "left").select("edge", F.coalesce("merged", F.lit(0)).alias("merged"), F.coalesce(F.col("n") - F.col("merged"), F.lit(0)).alias("skipped"))


def content_hash(rows: DataFrame) -> DataFrame:
    """version, hash: of the distinct rows of each version in any order; rows are hashed where they are and only sums meet."""
    rest = [c for c in sorted(rows.columns) if c != "version"]
    each = rows.select("version", F.xxhash64(F.to_json(F.struct(*rest))).alias("h")).distinct()
    return each.groupBy("version").agg(F.concat_ws("-", F.count("*"), F.hex(F.bit_xor("h")), F.sum(F.col("h").cast("decimal(20,0)"))).alias("hash"))


def materialised(new: DataFrame, stored: DataFrame, states: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(version, status; the rows then stored). new and stored have version and the graph's columns, states (version, hash, complete) tells what was loaded.

    unchanged: loaded whole with the same hash, and not forced; its rows stay. replaced: known with another hash or half loaded; its old rows go. created: not known.
    """
    same = F.col("complete") & (F.col("old") == F.col("hash")) & F.lit(not force)
    known = states.select("version", F.col("hash").alias("old"), F.coalesce("complete", F.lit(False)).alias("complete"), F.lit(True).alias("known"))
    rows = content_hash(new).join(known, "version", "left")
    status = rows.select("version", F.when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("known"), "replaced").otherwise("created").alias("status"))
    changed = status.where("status <> 'unchanged'").select("version")
    return status, stored.join(changed, "version", "left_anti").unionByName(new.join(changed, "version", "left_semi").distinct())


def checked_metrics(metrics: DataFrame, columns: DataFrame) -> DataFrame:
    """name, slug, dataset, problem of proposed metrics (position, name, dataset, expression) over columns (dataset, column).

    foreign: it names a column that only other datasets have. unknown: a word with an underscore that is no column. duplicate: a sound one before it has
    the same slug. Null: it is kept. The words of all expressions meet the columns in one join.
    """
    words = metrics.select("position", "dataset", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("expression"), F.lit(r"\b[a-z][a-z0-9_]*\b"), 0))).alias("column"))
    anywhere = columns.groupBy("column").agg(F.collect_set("dataset").alias("owners"))
    met = words.join(anywhere, "column", "left")
    foreign = F.bool_or(F.coalesce(~F.array_contains("owners", F.col("dataset")), F.lit(False))).alias("foreign")
    unknown = F.bool_or(F.col("owners").isNull() & F.col("column").contains("_") & ~F.col("column").isin(*SQL_WORDS)).alias("unknown")
    rows = metrics.withColumn("slug", slug(F.col("name"))).join(met.groupBy("position").agg(foreign, unknown), "position", "left")
    rows = rows.withColumn("problem", F.when(F.col("foreign"), "foreign").when(F.col("unknown"), "unknown"))
    nth = F.row_number().over(Window.partitionBy("slug", F.col("problem").isNull()).orderBy("position"))
    rows = rows.withColumn("nth", nth)
    return rows.select("name", "slug", "dataset", F.coalesce("problem", F.when(F.col("nth") > 1, "duplicate")).alias("problem"))
