"""Scalar functions over texts, records and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .registry import query


@query("F01_slug", "select p_partkey, lower(trim(regexp_replace(p_type, '[^0-9A-Za-z]+', '_', 'g'), '_')) as slug from part")
def slug(t):
    return t.part.select("p_partkey", X.slug(F.col("p_type")).alias("slug"))


@query("F02_normalise", "select doc_id, regexp_replace(regexp_replace(lower(trim(text)), '[ \\t\\n\\r]+', ' ', 'g'), '[.,;:!?]+$', '') as norm from documents")
def normalise(t):
    return t.documents.select("doc_id", X.normalised(F.col("text")).alias("norm"))


@query("F03_token_spans", r"select doc_id, cast(coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[.@+-][\p{L}\p{N}]+)*|[^\s\v\x1c-\x1f\x85\p{Z}\p{L}\p{N}]')), 0) as bigint) as n_tokens from documents")
def tokens(t):
    return t.documents.select("doc_id", X.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query("F04_question_tokens", "select doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2))) as n from documents")
def question_tokens(t):
    return t.documents.select("doc_id", F.size(X.question_tokens(F.col("text"))).cast("long").alias("n"))


@query("F05_token_overlap", "select p_partkey, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: length(x) > 2)), ['large', 'steel', 'blue', 'ring'])) as score from part")
def overlap(t):
    words = F.array(*map(F.lit, ("large", "steel", "blue", "ring")))
    return t.part.select("p_partkey", X.overlap_score(F.concat_ws(" ", "p_name", "p_type"), words).cast("long").alias("score"))


@query("F06_weighted_doc_search", "select doc_id, cast(score as double) as score from (select doc_id, (case when lower(source) like '%web%' then 3 else 0 end) + 0.5 * least(len(string_split(lower(text), 'license')) - 1, 5) as score from documents) where score > 0 order by score desc, doc_id limit 50")
def doc_search(t):
    hits = F.size(F.split(F.lower("text"), "license")) - 1
    score = F.when(F.lower("source").contains("web"), 3).otherwise(0) + 0.5 * F.least(hits, F.lit(5))
    return t.documents.select("doc_id", score.cast("double").alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


@query("F07_statement_shape", "select p_partkey, 'select ? from part where size > ? and brand' || case when p_partkey % 2 = 0 then ' = ?' else ' in (?, ?)' end as shape from part")
def statement_shape(t):
    size, brand = F.col("p_size").cast("string"), F.concat(F.lit("'"), F.col("p_brand"), F.lit("'"))
    test = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" = "), brand)).otherwise(F.concat(F.lit(" IN ("), brand, F.lit(", 'other')")))
    sql = F.concat(F.lit("SELECT 1 /* a note\nof two lines */ FROM part  WHERE size > "), size, F.lit(" AND brand"), test, F.lit(" -- end"))
    return t.part.select("p_partkey", X.statement_shape(sql).alias("shape"))


@query("F08_shape", "select p_brand, regexp_replace(regexp_replace(p_brand, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') as shape, count(*) as n from part group by 1")
def shape(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", X.shape(F.col("p_brand")).alias("shape"), "n")


@query("F09_identifiers", r"select doc_id, len(regexp_extract_all(text, '\b[A-Za-z]{2,}-?[0-9]{3,}\b')) as n from documents")
def identifiers(t):
    return t.documents.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(X.IDENTIFIER), F.lit(0))).cast("long").alias("n"))


@query("F10_date_parse", "select o_orderkey, cast(o_orderdate as date) as d from orders where o_orderkey % 4 <> 3 union all select o_orderkey, null from orders where o_orderkey % 4 = 3")
def dates(t):
    forms = "case pmod(o_orderkey, 4) when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'dd/MM/yyyy') when 2 then date_format(o_orderdate, 'dd.MM.yyyy') else 'soon' end"
    return t.orders.select("o_orderkey", X.parsed_date(F.expr(forms)).alias("d"))


@query("F11_sentences")
def sentences(t):
    return t.documents.select("doc_id", F.explode(X.sentence_spans("text")).alias("s")).select("doc_id", "s.start_at", "s.end_at", "s.surface")


@query("F12_cues", r"select doc_id from documents where regexp_matches(text, '(?i)\bthe\s+(?:\w+\s+){0,3}of\b')")
def cues(t):
    return t.documents.where(F.col("text").rlike(X.cue_pattern("the * of"))).select("doc_id")


@query("F14_negated_cues", r"select doc_id, regexp_matches(regexp_extract(lower(text), '([^.;!?]*)\blicense\b', 1), '\b(not|no|never|without)\b') as negated from documents where regexp_matches(lower(text), '\blicense\b')")
def negated(t):
    before = F.regexp_extract(F.lower("text"), r"([^.;!?]*)\blicense\b", 1)
    return t.documents.where(F.lower("text").rlike(r"\blicense\b")).select("doc_id", before.rlike(r"\b(not|no|never|without)\b").alias("negated"))


@query("F16_fuzzy_ratio")
def fuzzy(t):
    names = t.part.select("p_brand", "p_type").distinct()
    return names.select("p_brand", "p_type", F.round(X.fuzzy_ratio(F.lower("p_brand"), F.lower("p_type")), 6).alias("ratio"))


@query("F17_template", "select s_suppkey, coalesce(s_name, '?') || ' of ' || coalesce(cast(nullif(s_nationkey, 3) as varchar), '?') as text, s_nationkey = 3 as partial from supplier")
def template(t):
    nation = F.expr("nullif(s_nationkey, 3)").cast("string")
    return t.supplier.select("s_suppkey", F.concat(F.coalesce("s_name", F.lit("?")), F.lit(" of "), F.coalesce(nation, F.lit("?"))).alias("text"), nation.isNull().alias("partial"))


@query("F18_low_specificity", "select p_name, length(p_name) < 4 or count(*) > 3 as low from part group by 1")
def low_specificity(t):
    return t.part.groupBy("p_name").agg((F.any_value(F.length("p_name") < 4) | (F.count("*") > 3)).alias("low"))


@query("F19_html_to_text")
def html_text(t):
    return t.pages.select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query("F20_sniff", "select page_id, case when lower(ltrim(html)) like '<!doctype html%' or lower(ltrim(html)) like '<html%' then 'text/html' when ltrim(html) like '{%' then 'application/json' when html like '%PDF-%' then 'application/pdf' else 'text/plain' end as kind from pages")
def sniff(t):
    head = F.lower(F.ltrim("html"))
    return t.pages.select("page_id", F.when(head.startswith("<!doctype html") | head.startswith("<html"), "text/html").when(head.startswith("{"), "application/json").when(F.col("html").contains("PDF-"), "application/pdf").otherwise("text/plain").alias("kind"))


@query("F21_json_path", "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.none.at.all') as missing from events")
def json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none.at.all").alias("missing"))


@query("F22_chat_messages", "select conv_id, turn, role, text from conversations")
def chat(t):
    threads = t.conversations.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))).alias("body"))
    return threads.select("conv_id", F.explode(F.from_json("body", "array<struct<turn: long, role: string, text: string>>")).alias("m")).select("conv_id", "m.turn", "m.role", "m.text")


@query("F25_truncated", "select doc_id, case when length(text) > 200 then left(text, 200) || ' [truncated]' else text end as text from documents")
def truncated(t):
    return t.documents.select("doc_id", F.when(F.length("text") > 200, F.concat(F.left("text", F.lit(200)), F.lit(" [truncated]"))).otherwise(F.col("text")).alias("text"))


@query("F26_stable_ids", "select l_orderkey, l_linenumber, sha256('line|' || l_orderkey || '|' || l_linenumber) as id from lineitem")
def stable_ids(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.sha2(F.concat_ws("|", F.lit("line"), "l_orderkey", "l_linenumber"), 256).alias("id"))


@query("F27_hash_parts", "select o_orderkey, sha256('[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]') as h from orders")
def hash_parts(t):
    return t.orders.select("o_orderkey", F.sha2(F.to_json(F.array("o_orderstatus", "o_orderpriority")), 256).alias("h"))


@query("F28_external_ids", "select c_custkey, 'shop:customer:c_custkey=' || c_custkey as external_id, cast(c_custkey as varchar) as back from customer")
def external_ids(t):
    made = t.customer.select("c_custkey", F.concat(F.lit("shop:customer:c_custkey="), F.col("c_custkey").cast("string")).alias("external_id"))
    return made.select("c_custkey", "external_id", F.str_to_map(F.substring_index("external_id", ":", -1), F.lit(","), F.lit("="))["c_custkey"].alias("back"))


@query("F29_canonical_json", "select n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' as j from nation")
def canonical(t):
    return t.nation.select("n_nationkey", F.to_json(F.struct(*sorted(t.nation.columns))).alias("j"))


@query("F31_surface_match", "select p_partkey, lower(p_type) = lower(p_name) or (length(p_name) >= 5 and length(p_type) >= 5 and (contains(lower(p_type), lower(p_name)) or contains(lower(p_name), lower(p_type)))) as same from part")
def surface_match(t):
    a, b = F.lower("p_type"), F.lower("p_name")
    return t.part.select("p_partkey", ((a == b) | ((F.length(a) >= 5) & (F.length(b) >= 5) & (F.contains(a, b) | F.contains(b, a)))).alias("same"))


@query("F35_role_hint", "select * from (values ('o_orderkey', 'key'), ('o_custkey', 'foreign key'), ('o_orderstatus', 'attribute'), ('o_totalprice', 'measure'), ('o_orderdate', 'time'), ('o_orderpriority', 'attribute')) v(column_name, role)")
def roles(t):
    rows = t.spark.createDataFrame(t.orders.dtypes, "column_name string, kind string")
    role = F.when(F.col("column_name") == "o_orderkey", "key").when(F.col("column_name").endswith("key"), "foreign key").when(F.col("kind").isin("timestamp", "timestamp_ntz", "date"), "time").when(F.col("kind").isin("double", "float"), "measure").otherwise("attribute")
    return rows.select("column_name", role.alias("role"))


@query("F37_normal_result", "select cast(n_nationkey as varchar) as n_nationkey, n_name from nation order by 1, 2")
def normal_result(t):
    return t.nation.select(F.col("n_nationkey").cast("string"), "n_name").orderBy("n_nationkey", "n_name")


@query("F38_grounding", "select conv_id, turn, contains(lower(text), 'the') or contains(lower(text), 'license') as grounded from conversations")
def grounding(t):
    terms = F.array(F.lit("the"), F.lit("license"))
    return t.conversations.select("conv_id", "turn", F.exists(terms, lambda x: F.contains(F.lower("text"), x)).alias("grounded"))


@query("F40_confidence", "select l_orderkey, l_linenumber, greatest(0.0, least(1.0, coalesce(nullif(l_discount, 0.05) * 20, 0.5))) as confidence from lineitem")
def confidence(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("nullif(l_discount, 0.05D) * 20"), F.lit(0.5)))).alias("confidence"))

