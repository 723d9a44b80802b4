"""Profiling candidates, segments and passages, allocation, truth tables, typed loads, versions, proposed metrics: beside their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import building as B
from ..operators import profile
from ..plans.retail import MODEL, TABLES
from ..plans.semantic import Relationship, Request, SemanticModel
from ..sources import catalog
from .registry import query

NAMES = (
    ("ss_customer_sk", "customer", "c_customer_sk", 1.0), ("ss_addr_sk", "customer_address", "ca_address_sk", 0.9), ("ss_promo_sk", "promotion", "p_promo_sk", 1.0), ("cs_bill_cdemo_sk", "customer_demographics", "cd_demo_sk", 0.8),
    ("ss_customer_sk", "customer_demographics", "cd_demo_sk", 0.7), ("wp_web_page_id", "catalog_page", "cp_catalog_page_sk", 0.7), ("l_orderkey", "orders", "o_orderkey", 1.0), ("o_custkey", "part", "p_partkey", 0.0),
)


@query("A12_name_scores", "select * from (values " + ", ".join(f"('{c}', '{t}', cast({s} as double))" for c, t, _, s in NAMES) + ") v(column_name, target, score)")
def name_scores(t):
    return t.spark.createDataFrame([(c, target, profile.name_score(c, target, key)) for c, target, key, _ in NAMES], "column_name string, target string, score double")


KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
NAMED = (("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"))


@query(
    "A13_candidates",
    "select * from (values " + ", ".join(f"('{t}', '{c}', '{k}', '{KEYS[k]}', cast(1 as double))" for t, c, k in NAMED) + ") v(fk_table, fk_column, pk_table, pk_column, score) union all "
    + " union all ".join(f"select 'events', 'user_id', '{k}', '{c}', 0 from {k} having count(*) >= (select count(distinct user_id) from events)" for k, c in KEYS.items()),
)
def candidates(t):
    """By name where there is one; users have no table here, so their ids go to every key with room for them."""
    found = profile.candidates(profile.catalogue_of({x: t[x] for x in (*TABLES, "events")}, KEYS | {"events": "event_id"}, exact=True))
    return t.spark.createDataFrame([x[:5] for x in found], "fk_table string, fk_column string, pk_table string, pk_column string, score double")


@query("J05_declared_default", "select s_name, count(*) as line_count from lineitem join supplier on s_suppkey = l_suppkey group by 1")
def declared_default(t):
    """Of two relationships to the supplier the declared one is taken, though the other's name comes first."""
    ways = [*MODEL.relationships.values(), Relationship("a_by_line_number", "lineitem", "supplier", (("l_linenumber", "s_suppkey"),))]
    ways = [Relationship(r.name, r.many, r.one, r.on, True) if r.name == "lineitem__l_suppkey__supplier" else r for r in ways]
    model = SemanticModel(MODEL.datasets, list(MODEL.fields.values()), list(MODEL.metrics.values()), ways)
    return model.compile(Request(metrics=["line_count"], dimensions=["supplier.s_name"]), t)


@query("S04_counts_of_tables", "select 'known' as asked, count(*) as n, 'statistics' as how from orders union all select 'plain', count(*), 'counted' from nation union all select 'missing', null, 'missing'")
def counts_of_tables(t):
    """A table written with statistics, one without and one that isn't there."""
    mark = uuid.uuid4().hex
    catalog.create_with_statistics(t.orders, f"orders_{mark}")
    t.nation.createOrReplaceTempView(f"nation_{mark}")
    found = [(asked, *catalog.row_count(t.spark, f"{name}_{mark}")) for asked, name in (("known", "orders"), ("plain", "nation"), ("missing", "nothing"))]
    t.spark.catalog.dropTempView(f"nation_{mark}")
    t.spark.sql(f"drop table orders_{mark}")
    return t.spark.createDataFrame(found, "asked string, n long, how string")


@query("S09_table_as_select", "select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem where l_quantity > 10 group by 1")
def table_as_select(t):
    name = f"lines_{uuid.uuid4().hex}"
    catalog.create_with_statistics(t.lineitem.where("l_quantity > 10"), name)
    return t.spark.table(name).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


TARGETS = (("chat", 50), ("email", 101), ("fax", 9), ("off", 0), ("page", 7))
SUPPORTS = "(artifact = 'email' or (artifact = 'chat' and length(source) % 2 = 0) or (artifact = 'page' and source >= 'n') or artifact = 'off')"


@query("F34_allocation", f"""with t as (select * from (values {", ".join(f"('{a}', {n})" for a, n in TARGETS)}) v(artifact, n) where n > 0), w as (select source, count(*) as weight from documents group by 1),
p as (select t.artifact, t.n, source, weight, sum(weight) over (partition by t.artifact) as whole from t left join w on {SUPPORTS.replace("artifact", "t.artifact")}),
b as (select *, n * weight // whole as base, n * weight % whole as rest from p), r as (select *, row_number() over (partition by artifact order by rest desc, source) as nth, n - sum(base) over (partition by artifact) as left_over from b)
select artifact, source as scenario, cast(case when source is null then n else base + case when nth <= left_over then 1 else 0 end end as bigint) as n from r where source is null or base > 0 or nth <= left_over""")
def allocation(t):
    """Fax has no supporting source: its target is reported whole, without one."""
    targets = t.spark.createDataFrame(TARGETS, "artifact string, n long")
    weights = t.documents.groupBy(F.col("source").alias("scenario")).agg(F.count("*").alias("weight"))
    each = weights.select(F.col("scenario").alias("source"), F.explode(F.array(*[F.lit(a) for a, _ in TARGETS])).alias("artifact"))
    return B.allocated(targets, weights, each.where(SUPPORTS).select("artifact", F.col("source").alias("scenario")))


MIME = "case when doc_id % 20 = 1 then 'application/json' when doc_id % 4 = 0 then 'message/rfc822' when doc_id % 4 = 1 then 'text/plain' when doc_id % 4 = 2 then 'application/json' else 'application/zip' end"
DATA = """case when doc_id % 4 = 0 then concat('From: a@b.example', chr(10), 'Subject: note ', doc_id, chr(10), chr(10), text) when doc_id % 4 = 2 then concat('{"messages": [{"role": "user", "text": "hello ', doc_id, '"}, {"role": "bot", "text": " "}]}') else text end"""


@query("K01_segments_of_assets", f"""with a as (select doc_id, text, {MIME} as mime, {DATA} as data from documents),
p as (select *, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '') as paragraphs,
case when ltrim(data) like '{{%' then null when regexp_matches(data, '\\A[\\w-]+:') and regexp_matches(regexp_split_to_array(data, '\\r?\\n\\r?\\n')[1], '(?im)^(from|subject):') then 'email' when ltrim(data) <> '' then 'text' end as kind from a)
select doc_id, case when doc_id % 20 = 1 then 'type_mismatch' when doc_id % 4 = 3 then 'unsupported' when doc_id % 4 = 1 and kind is distinct from 'text' then 'type_mismatch' else 'ok' end as status,
case when doc_id % 20 = 1 or doc_id % 4 = 3 then 0 when doc_id % 4 = 0 then 2 + (trim(text) <> '')::int when doc_id % 4 = 2 then 1 when kind is distinct from 'text' then 0 else len(paragraphs) end as n_segments,
case when doc_id % 20 = 1 or doc_id % 4 = 3 then null when doc_id % 4 = 0 then 'note ' || doc_id when doc_id % 4 = 2 then 'hello ' || doc_id when kind is distinct from 'text' then null else paragraphs[1] end as first_text from p""")
def segments_of_assets(t):
    """Mails, texts and chats made of the documents, every tenth text declared as JSON, every fourth document of a type that nothing reads."""
    assets = t.documents.select(F.col("doc_id").alias("id"), F.expr(MIME).alias("mime"), F.expr(DATA).alias("data"))
    return B.analysed(assets).select(F.col("id").alias("doc_id"), "status", F.size("segments").cast("long").alias("n_segments"), F.get("segments", F.lit(0))["text"].alias("first_text"))


@query("K27_passages", """with m as (select conv_id, role, trim(text) as text, turn, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from conversations where trim(text) <> ''),
w as (select *, unnest(range(0, 1 + n // 3)) as w from m)
select 'c' || conv_id as asset, min(turn) as ordinal, 'chat' as type, md5(string_agg(concat_ws(': ', nullif(role, ''), text), chr(10) order by i)) as text_md5 from w where i >= 3 * w and i < 3 * w + 6 and (w = 0 or 3 * w < n - 3) group by conv_id, w
union all select 'd' || doc_id, case when trim(text) <> '' then 2 else 0 end, 'email', md5('Subject: ' || source || chr(10) || 'From: ' || lang || case when trim(text) <> '' then chr(10) || chr(10) || trim(text) else '' end) from documents
union all select 'i' || item_id, 0, 'page', md5(trim(text)) from benchmark where trim(text) <> ''""")
def passages(t):
    """Conversations as windows, documents as mails of three segments, benchmark items as pages."""
    chat = t.conversations.selectExpr("concat('c', conv_id) asset", "turn ordinal", "'message' type", "text", "role speaker")
    part = "explode(array(struct(0L ordinal, 'email_subject' type, source text), struct(1L ordinal, 'email_header' type, lang text), struct(2L ordinal, 'email_body' type, text text))) s"
    mail = t.documents.selectExpr("concat('d', doc_id) asset", part).selectExpr("asset", "s.*", "cast(null as string) speaker")
    page = t.benchmark.selectExpr("concat('i', item_id) asset", "0L ordinal", "'page' type", "text", "cast(null as string) speaker")
    return B.passages(chat.unionByName(mail).unionByName(page)).select("asset", "ordinal", "type", F.md5("text").alias("text_md5"))


def scenario_refs(t):
    """Source rows of order scenarios: the order, its customer, the part of its first line."""
    named = t.orders.join(t.customer, F.expr("c_custkey = o_custkey"))
    kinds = "explode(array(struct('order' kind, cast(o_orderkey as string) key, o_orderstatus name), struct('customer' kind, cast(c_custkey as string) key, concat(c_name, ' ', o_orderkey % 7) name))) r"
    parts = t.lineitem.where("l_linenumber = 1").join(t.part, F.expr("p_partkey = l_partkey")).selectExpr("l_orderkey scenario", "'part' kind", "cast(p_partkey as string) key", "p_name name")
    return named.selectExpr("o_orderkey scenario", kinds).select("scenario", "r.*").unionByName(parts)


STORY = (("order", "PLACED_BY", "customer"), ("customer", "ASKS_ABOUT", "part"))


@query("K34_truth_entities", """select 'order' as kind, cast(o_orderkey as varchar) as key, o_orderstatus as name from orders union all select 'customer', cast(c_custkey as varchar), c_name || ' ' || (min(o_orderkey) % 7) from orders join customer on c_custkey = o_custkey group by c_custkey, c_name
union all select distinct 'part', cast(p_partkey as varchar), p_name from lineitem join part on p_partkey = l_partkey where l_linenumber = 1""")
def truth_entities(t):
    """A customer of several orders keeps the name of the first."""
    return B.truth_entities(scenario_refs(t)).select("kind", "key", "name")


@query("K34_truth_edges", """select 'PLACED_BY' as predicate, o_orderkey as scenario from orders union all
select 'ASKS_ABOUT', min(o_orderkey) from orders join lineitem on l_orderkey = o_orderkey where l_linenumber = 1 group by o_custkey, l_partkey""")
def truth_edges(t):
    return B.truth_edges(scenario_refs(t), t.spark.createDataFrame(STORY, "source_kind string, predicate string, target_kind string")).select("predicate", "scenario")


@query("K34_truth_claims", """with e as (select o_custkey, l_partkey, min(o_orderkey) as scenario from orders join lineitem on l_orderkey = o_orderkey where l_linenumber = 1 group by 1, 2)
select 'interest' as type, count(distinct (e.o_custkey, e.l_partkey)) as claims, count(distinct (e.o_custkey, e.l_partkey, l_linenumber)) as evidence from e join lineitem on l_orderkey = scenario where l_returnflag = 'R'""")
def truth_claims(t):
    """Returned lines are evidence that the customer asked about a part."""
    edges = B.truth_edges(scenario_refs(t), t.spark.createDataFrame(STORY, "source_kind string, predicate string, target_kind string"))
    evidence = t.lineitem.where("l_returnflag = 'R'").selectExpr("l_orderkey scenario", "concat(l_orderkey, '-', l_linenumber) artifact", "'interest' type")
    claims, rows = B.truth_claims(edges, evidence, t.spark.createDataFrame([("interest", "ASKS_ABOUT")], "type string, predicate string"))
    return claims.groupBy("type").agg(F.count("*").alias("claims")).join(rows.agg(F.count("*").alias("evidence")), F.lit(True))  # one row


@query("G04_typed_loads", """with s as (select distinct l_orderkey, l_linenumber, l_returnflag = 'R' as r from lineitem), e as (select p_partkey from part where p_size > 10),
m as (select distinct l_orderkey, l_linenumber, l_partkey from lineitem where l_returnflag = 'R'), k as (select distinct l_orderkey, l_linenumber from lineitem)
select 'HAS_SEGMENT' as edge, count(*) filter (where l_linenumber < 6) as merged, count(*) filter (where l_linenumber >= 6) as skipped from k
union all select 'FOUND_IN', count(*), 0 from s where r
union all select 'RESOLVES_TO', count(p_partkey), count(*) - count(p_partkey) from m left join e on p_partkey = l_partkey
union all select 'RELATED_TO', count(b.p_partkey), count(*) - count(b.p_partkey) from e a left join e b on b.p_partkey = a.p_partkey + 1
union all select 'SUBJECT', count(p_partkey), count(*) - count(p_partkey) from supplier left join e on p_partkey = s_suppkey
union all select 'OBJECT', count(p_partkey), count(*) - count(p_partkey) from (select * from supplier where s_suppkey % 2 = 1) left join e on p_partkey = s_suppkey + 1
union all select 'EVIDENCE_FOR', count(*), 0 from (select distinct l_orderkey, l_linenumber, l_suppkey from lineitem)""")
def typed_loads(t):
    """Assets, segments, mentions, entities, links, relationships, claims and evidence of the order tables; some ends aren't there."""
    segment = "concat('s:', l_orderkey, '-', l_linenumber)"
    mentions = t.lineitem.where("l_returnflag = 'R'").selectExpr(f"concat('m', {segment}) id", f"{segment} segment", "concat('e:', l_partkey) entity")
    tables = {
        "assets": t.orders.selectExpr("concat('a:', o_orderkey) id"),
        "segments": t.lineitem.selectExpr(f"{segment} id", "if(l_linenumber < 6, concat('a:', l_orderkey), concat('a:none-', l_linenumber)) asset"),
        "mentions": mentions.select("id", "segment"),
        "entities": t.part.where("p_size > 10").selectExpr("concat('e:', p_partkey) id"),
        "links": mentions.select("id", "entity"),
        "relationships": t.part.where("p_size > 10").selectExpr("concat('e:', p_partkey) source", "concat('e:', p_partkey + 1) target"),
        "claims": t.supplier.selectExpr("concat('c:', s_suppkey) id", "concat('e:', s_suppkey) subject", "if(s_suppkey % 2 = 1, concat('e:', s_suppkey + 1), null) object"),
        "evidence": t.lineitem.selectExpr(f"{segment} segment", "concat('c:', l_suppkey) claim"),
    }
    edges = [
        ("HAS_SEGMENT", "segments", "asset", "id"), ("FOUND_IN", "mentions", "id", "segment"), ("RESOLVES_TO", "links", "id", "entity"), ("RELATED_TO", "relationships", "source", "target"),
        ("SUBJECT", "claims", "id", "subject"), ("OBJECT", "claims", "id", "object"), ("EVIDENCE_FOR", "evidence", "segment", "claim"),
    ]
    return B.loaded(tables, {x: "id" for x in ("assets", "segments", "mentions", "entities", "claims")}, edges)


@query("G18_versions", "select n_regionkey as version, case n_regionkey when 0 then 'unchanged' when 1 then 'replaced' when 3 then 'replaced' else 'created' end as status, count(*) as n_stored from nation group by 1")
def versions(t):
    """Version 0 was loaded as it is, 1 with other rows, 3 half; 2 and 4 are new. After the load each holds its own rows alone."""
    new = t.nation.selectExpr("n_regionkey version", "n_name key")
    stored = new.where("version = 0 or (version = 3 and key < 'N')").unionByName(t.nation.where("n_regionkey = 1").selectExpr("n_regionkey version", "concat('old ', n_name) key"))
    states = B.content_hash(new.where("version in (0, 3)")).unionByName(B.content_hash(stored.where("version = 1"))).withColumn("complete", F.expr("version <> 3"))
    status, rows = B.materialised(new, stored, states)
    return status.join(rows.groupBy("version").agg(F.count("*").alias("n_stored")), "version", "left")


METRICS = (
    ("Total Price", "orders", "sum(o_totalprice)", "total_price", None), ("Quantity", "orders", "sum(l_quantity)", "quantity", "foreign"), ("Lost", "orders", "sum(o_nothing)", "lost", "unknown"), ("Month", "orders", "count(date_trunc('month', o_orderdate))", "month", None),
    ("total-price", "orders", "max(o_totalprice)", "total_price", "duplicate"), ("quantity", "lineitem", "sum(l_quantity)", "quantity", None), ("Nowhere", "nowhere", "sum(l_quantity)", "nowhere", "foreign"), ("Rows", "lineitem", "count(*)", "rows", None),
)


@query("M01_checked_metrics", "select * from (values " + ", ".join("('{}', '{}', '{}', {})".format(n, s, d, f"'{p}'" if p else "null") for n, d, _, s, p in METRICS) + ") v(name, slug, dataset, problem)")
def checked_metrics(t):
    proposed = t.spark.createDataFrame([(i, n, d, e) for i, (n, d, e, _, _) in enumerate(METRICS)], "position long, name string, dataset string, expression string")
    columns = t.spark.createDataFrame([(x, c) for x in ("orders", "lineitem", "part") for c in t[x].columns], "dataset string, column string")
    return B.checked_metrics(proposed, columns)
