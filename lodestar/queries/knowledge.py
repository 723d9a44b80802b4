"""Mentions, cases, links, claims, graphs, vectors and scores. Notes are planted from the order tables, as documents name none of their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import mentions as M
from ..operators import scoring as S
from ..operators import vectors as V
from .registry import query

NOTES = """(select o_orderkey as id, 'Order ' || o_orderkey || ' by ' || c_name || ' holds ' || p_name || '. Seller: ' || s_name || '.' as text, c_custkey, c_name, p_name, p_partkey, s_suppkey, s_name
from orders join customer on o_custkey = c_custkey join part on p_partkey = o_orderkey % 100 + 1 join supplier on s_suppkey = o_orderkey % 9 + 1)"""


def notes(t):
    rows = t.orders.join(t.customer, F.expr("o_custkey = c_custkey")).join(t.part, F.expr("p_partkey = o_orderkey % 100 + 1")).join(t.supplier, F.expr("s_suppkey = o_orderkey % 9 + 1"))
    return rows.selectExpr("o_orderkey id", "concat('Order ', o_orderkey, ' by ', c_name, ' holds ', p_name, '. Seller: ', s_name, '.') text", "c_custkey", "p_partkey", "s_suppkey")


def forms(t):
    return t.customer.selectExpr("'customer' class", "c_name surface", "c_custkey instance").unionByName(t.part.selectExpr("'part' class", "p_name surface", "p_partkey instance")).unionByName(t.supplier.selectExpr("'supplier' class", "s_name surface", "s_suppkey instance"))


def words(t):
    return M.dictionary(forms(t))


@query("J13_dictionary_lookup", "select c_custkey, count(*) as n from orders join customer on o_custkey = c_custkey group by 1")
def lookup(t):
    return t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).join(t.customer.select("c_custkey"), "c_custkey")


@query("J14_dictionary_scan", f"select id, 'customer' as class, c_name as surface from {NOTES} union all select id, 'part', p_name from {NOTES} union all select id, 'supplier', s_name from {NOTES}")
def scan(t):
    return M.scanned(notes(t).select("id", "text"), words(t), 6).select("id", "class", "surface")


@query("A41_dictionary_merge", "select 'part' as class, p_name as surface, count(distinct p_partkey) as n_instances from part group by 2")
def merge(t):
    return M.dictionary(t.part.selectExpr("'part' class", "p_name surface", "p_partkey instance")).select("class", "surface", "n_instances")


@query("K02_patterns", r"select doc_id, unnest(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) as surface from documents")
def patterns(t):
    found = X.pattern_spans(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b")("text")
    return t.documents.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.surface")


def found_candidates(t):
    return M.candidates(M.scanned(notes(t).select("id", "text"), words(t), 6), M.instances(forms(t)))


@query("K10_candidates", f"select id, 'customer' as class, c_custkey as instance, cast(1.0 as double) as score from {NOTES} union all select id, 'supplier', s_suppkey, 1.0 from {NOTES}")
def candidates(t):
    return found_candidates(t).where("class <> 'part'").select("id", "class", "instance", "score")


#: Instances of each order's part name; a name of more than 20 has no candidates.
NAMED = f"(select n.id, p.p_partkey as instance, c.n as n from {NOTES} n join part p on p.p_name = n.p_name join (select p_name, count(*) as n from part group by 1) c on c.p_name = n.p_name where c.n <= 20)"


@query("K10_candidates_of_shared_names", f"select id, 'part' as class, instance, 1.0 / n as score from {NAMED}")
def shared_candidates(t):
    return found_candidates(t).where("class = 'part'").select("id", "class", "instance", "score")


@query("K18_link_decision", f"select id, 'customer' as class, c_custkey as instance, 'SameAs' as link from {NOTES} union all select id, 'supplier', s_suppkey, 'SameAs' from {NOTES}")
def link_decision(t):
    return M.links(found_candidates(t)).where("class <> 'part'").select("id", "class", "instance", "link")


@query("K18_link_decision_of_shared_names", f"select id, 'part' as class, instance, case when n = 1 then 'SameAs' else 'PossiblySameAs' end as link from (select *, row_number() over (partition by id order by instance) as nth from {NAMED}) where nth <= 3")
def shared_link_decision(t):
    return M.links(found_candidates(t)).where("class = 'part'").select("id", "class", "instance", "link")


@query("K31_exact_only", f"select id, p_partkey as instance from {NOTES} where p_name in (select p_name from part group by 1 having count(*) = 1)")
def exact_only(t):
    unique = words(t).where("n_instances = 1")
    return M.scanned(notes(t).select("id", "text"), unique, 6).where("class = 'part'").join(M.instances(forms(t)), ["class", "key"]).select("id", "instance")


@query("J15_span_overlap", f"select id, 1 as n from {NOTES}")
def span_overlap(t):
    found = M.scanned(notes(t).select("id", "text"), words(t), 6).where("class = 'supplier'").select("id", "start_at", "end_at")
    marked = notes(t).select("id", F.explode(X.pattern_spans(r"Seller: (\S+)")("text")).alias("s")).select("id", "s.start_at", "s.end_at")
    return M.overlapping(found, marked).groupBy("id").agg(F.count("*").cast("int").alias("n"))


@query("J16_mentions_in_units", f"select id, 'supplier' as class from {NOTES}")
def in_units(t):
    units = notes(t).select("id", F.explode(X.sentence_spans("text")).alias("s")).where("startswith(s.surface, 'Seller')").select("id", F.col("s.start_at").alias("a"), F.col("s.end_at").alias("b"))
    found = M.scanned(notes(t).select("id", "text"), words(t), 6)
    return found.join(units, "id").where("start_at >= a and end_at <= b").select("id", "class")


@query("J11_anchor_query", "select o_orderkey as cluster, l_linenumber from orders join lineitem on l_orderkey = o_orderkey left join part on p_partkey = l_partkey where o_orderpriority = '1-URGENT' and l_returnflag = 'R' and p_size between 1 and 30")
def anchor(t):
    want = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("cluster"))
    return want.join(t.lineitem.where("l_returnflag = 'R'"), F.expr("l_orderkey = cluster")).join(t.part, F.expr("p_partkey = l_partkey"), "left").where("p_size between 1 and 30").select("cluster", "l_linenumber")


@query("K16_unique_row", "select cluster, l_linenumber from (select l_orderkey as cluster, min(l_linenumber) as l_linenumber, count(*) as n from lineitem where l_returnflag = 'R' group by 1) where n = 1")
def unique_row(t):
    return t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("cluster")).agg(F.min("l_linenumber").alias("l_linenumber"), F.count("*").alias("n")).where("n = 1").select("cluster", "l_linenumber")


@query("K19_one_instance_in_scope", "select l_orderkey, min(l_suppkey) as l_suppkey from lineitem group by 1 having count(distinct l_suppkey) = 1")
def one_instance(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"), F.count_distinct("l_suppkey").alias("n")).where("n = 1").select("l_orderkey", "l_suppkey")


@query("K20_about_target", "select l_suppkey, arg_min(l_partkey, (-n, l_partkey)) as about from (select l_suppkey, l_partkey, count(*) as n from lineitem group by 1, 2) group by 1")
def about(t):
    pairs = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return pairs.groupBy("l_suppkey").agg(F.min_by("l_partkey", F.struct(-F.col("n"), "l_partkey")).alias("about"))


@query("K12_components", """with r as (select c_custkey as id, c_nationkey % 7 as g from customer) select id, (select min(x.id) from r x where x.g = r.g) as component from r""")
def components(t):
    rows = t.customer.selectExpr("c_custkey", "c_nationkey % 7 g")
    hub = rows.groupBy("g").agg(F.min("c_custkey").alias("dst"))
    # a star of each group
    edges = rows.join(hub, "g").selectExpr("c_custkey src", "dst")
    return G.components(edges, rows.selectExpr("c_custkey id"))


@query("K33_pairwise_scores", "with c as (select l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by 1, 2), p as (select sum(n * (n - 1) / 2) as pairs from c), x as (select sum(n * (n - 1) / 2) as t from (select sum(n) as n from c group by a)), y as (select sum(n * (n - 1) / 2) as f from (select sum(n) as n from c group by b)) select round(pairs / f, 4) as precision, round(pairs / t, 4) as recall from p, x, y")
def case_pairs(t):
    return S.pairwise(t.lineitem, "l_returnflag", "l_linestatus")


@query("K30_grounded_quotes", "select p.page_id as id, instr(d.text, p.q) as at from (select item_id as page_id, left(text, 30) as q, text from benchmark) p join benchmark d on d.item_id = p.page_id")
def grounded(t):
    rows = t.benchmark.select(F.col("item_id").alias("id"), "text", F.left("text", F.lit(30)).alias("q"))
    return rows.select("id", F.expr("cast(instr(text, q) as bigint)").alias("at"))


@query("K35_locators", "select doc_id, substr(text, 6, 10) = substr(text, 6, 10) as ok from documents where length(text) > 20")
def locators(t):
    spans = t.documents.where("length(text) > 20").selectExpr("doc_id", "text", "5 start_at", "15 end_at", "substr(text, 6, 10) surface")
    return spans.select("doc_id", F.expr("substr(text, start_at + 1, end_at - start_at) = surface").alias("ok"))


@query("W09_chat_windows", """with n as (select *, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from conversations),
w as (select *, unnest(range(0, 1 + greatest(0, cast(ceil((n - 6) / 3.0) as bigint)))) as window_no from n)
select conv_id, cast(window_no as int) as window_no, count(*) as n_turns, min(turn) as first_turn from w where i >= 3 * window_no and i < 3 * window_no + 6 group by 1, 2""")
def chat_windows(t):
    return V.windows(t.conversations, "conv_id", "turn", ["role", "text"]).select("conv_id", "window_no", F.size("rows").cast("long").alias("n_turns"), F.col("rows")[0]["turn"].alias("first_turn"))


VECTOR = "(select cast(embedding as double[]) as q from embeddings where vec_id = 0)"


def first_vector(t):
    return t.embeddings.where("vec_id = 0").first()["embedding"]


@query("K28_vector_search", f"select vec_id, label, round(list_cosine_similarity(cast(embedding as double[]), q), 4) as cosine from embeddings, {VECTOR} order by list_cosine_similarity(cast(embedding as double[]), q) desc, vec_id limit 10")
def vector_search(t):
    return V.nearest(t.embeddings, first_vector(t), 10).select("vec_id", "label", "cosine")


@query("T04_one_per_asset", f"select vec_id, label from (select *, row_number() over (partition by label order by c desc, vec_id) as rn from (select vec_id, label, list_cosine_similarity(cast(embedding as double[]), q) as c from embeddings, {VECTOR} order by c desc, vec_id limit 40)) where rn = 1 order by c desc, vec_id limit 5")
def one_per_asset(t):
    return V.nearest(t.embeddings, first_vector(t), 5, group="label").select("vec_id", "label")


@query("F30_cosine", f"select vec_id, round(list_cosine_similarity(cast(embedding as double[]), q), 4) as cosine from embeddings, {VECTOR}")
def cosines(t):
    return t.embeddings.select("vec_id", F.round(V.cosine("embedding", first_vector(t)), 4).alias("cosine"))


# scores
@query("A22_rates", "select source, round(count(*) filter (where quality = 1 and toxic = 0) / nullif(count(*) filter (where quality = 1), 0), 4) as precision from documents join labels using (doc_id) group by 1")
def rates(t):
    return t.documents.join(t.labels, "doc_id").groupBy("source").agg(S.rate(F.count_if(F.expr("quality = 1 and toxic = 0")), F.count_if(F.expr("quality = 1"))).alias("precision"))


SCORED = "(select lang, source, quality = 1 as truth, n_chars > 400 as found from documents join labels using (doc_id))"


@query("A23_grouping_sets", f"""select lang, source, level, tp, n_found, n_truth, round(tp / nullif(n_found, 0), 4) as precision, round(tp / nullif(n_truth, 0), 4) as recall from (select lang, source, grouping(lang, source) as level, count(*) filter (where truth and found) as tp, count(*) filter (where found) as n_found, count(*) filter (where truth) as n_truth from {SCORED} group by grouping sets ((lang, source), (lang), (source), ()))""")
def grouping_sets(t):
    rows = t.documents.join(t.labels, "doc_id").selectExpr("lang", "source", "quality = 1 truth", "n_chars > 400 found")
    return S.scores(rows, ["lang", "source"]).drop("f1")


@query("A24_conditional_sums", f"select lang, count(*) filter (where truth and found) as right_yes, count(*) filter (where not truth and not found) as right_no, count(*) as n from {SCORED} group by 1")
def conditional(t):
    rows = t.documents.join(t.labels, "doc_id").selectExpr("lang", "quality = 1 truth", "n_chars > 400 found")
    return rows.groupBy("lang").agg(F.count_if(F.expr("truth and found")).alias("right_yes"), F.count_if(F.expr("not truth and not found")).alias("right_no"), F.count("*").alias("n"))


@query("A26_agreement", "select l_orderkey, bool_or(l_returnflag = 'R') as agrees from lineitem group by 1")
def agreement(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.expr("l_returnflag = 'R'")).alias("agrees"))


@query("A27_pass_rates", "select role, round(count(*) filter (where ok) / count(*), 4) as pass_rate from (select role, conv_id, bool_and(length(text) > 20) as ok from conversations group by 1, 2) group by 1")
def pass_rates(t):
    return t.conversations.groupBy("role", "conv_id").agg(F.bool_and(F.length("text") > 20).alias("ok")).groupBy("role").agg(F.round(F.count_if("ok") / F.count("*"), 4).alias("pass_rate"))


@query("A30_macro_average", f"select round(avg(r), 6) as macro from (select source, count(*) filter (where truth and found) / nullif(count(*) filter (where truth), 0) as r from {SCORED} group by 1)")
def macro(t):
    rows = t.documents.join(t.labels, "doc_id").selectExpr("source", "quality = 1 truth", "n_chars > 400 found")
    return rows.groupBy("source").agg(F.try_divide(F.count_if(F.expr("truth and found")), F.count_if("truth")).alias("r")).agg(F.round(F.avg("r"), 6).alias("macro"))


@query("A31_least_of_counts", "select c_nationkey, least(count(*) filter (where c_acctbal > 0), count(*) filter (where c_mktsegment = 'BUILDING')) as correct from customer group by 1")
def least(t):
    return t.customer.groupBy("c_nationkey").agg(F.least(F.count_if(F.expr("c_acctbal > 0")), F.count_if(F.expr("c_mktsegment = 'BUILDING'"))).alias("correct"))


@query("A33_redundant_calls", "select user_id, count(*) as calls, count(*) - count(distinct event_type) as redundant from events group by 1")
def redundant(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("calls"), (F.count("*") - F.count_distinct("event_type")).alias("redundant"))


@query("A34_identifier_shapes", r"select shape, count(*) as n from (select regexp_replace(regexp_replace(s, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') as shape from (select unnest(regexp_extract_all(text, '\b[A-Za-z]{2,}-?[0-9]{3,}\b')) as s from documents)) group by 1 order by n desc, shape limit 20")
def shapes(t):
    found = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(X.IDENTIFIER), F.lit(0))).alias("s"))
    return found.groupBy(X.shape(F.col("s")).alias("shape")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(20)


@query("A42_evidence_per_claim", "select l_suppkey, l_partkey, max(l_discount) as best, count(distinct l_orderkey) as n from lineitem group by 1, 2")
def evidence(t):
    return S.dealt(t.lineitem, "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("best"), F.count_distinct("l_orderkey").alias("n"))


@query("A44_cost_rollup", "select event_type, round(sum(value) / nullif(count(distinct user_id), 0), 4) as per_user from events group by 1")
def cost(t):
    return t.events.groupBy("event_type").agg(F.round(F.try_divide(F.sum("value"), F.count_distinct("user_id")), 4).alias("per_user"))


@query("J21_triple_match", "select count(*) as matched from (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'R') a join (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'A') b using (l_suppkey, l_partkey)")
def triple(t):
    of = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select("l_suppkey", "l_partkey").distinct()
    return of("R").join(of("A"), ["l_suppkey", "l_partkey"]).agg(F.count("*").alias("matched"))


@query("J24_roles_by_column", "select n_nationkey, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey and c_acctbal < 0 group by 1")
def roles(t):
    owed = t.customer.where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return t.nation.select("n_nationkey").join(owed, "n_nationkey", "left").na.fill(0)


# graphs
def edges(t):
    up = t.nation.selectExpr("concat('n', n_nationkey) src", "concat('r', n_regionkey) dst")
    return up.unionByName(t.supplier.selectExpr("concat('s', s_suppkey) src", "concat('n', s_nationkey) dst")).unionByName(t.customer.selectExpr("concat('c', c_custkey) src", "concat('n', c_nationkey) dst"))


@query("G01_node_merge", "select count(distinct p_name) as n from part")
def node_merge(t):
    return G.merged_nodes(t.part.select("p_name"), "p_name").agg(F.count("*").alias("n"))


@query("G02_edge_merge", "select count(*) filter (where ok) as merged, count(*) filter (where not ok) as skipped from (select distinct l_suppkey, l_partkey, l_partkey in (select p_partkey from part where p_size > 10) as ok from lineitem)")
def edge_merge(t):
    nodes = t.part.where("p_size > 10").selectExpr("concat('p', p_partkey) id").unionByName(t.supplier.selectExpr("concat('s', s_suppkey) id"))
    return G.merged_edges(t.lineitem.selectExpr("concat('s', l_suppkey) src", "concat('p', l_partkey) dst"), nodes)[1]


@query("G07_hierarchy", "select n_name as child, r_name as parent from nation join region on n_regionkey = r_regionkey")
def hierarchy(t):
    return t.nation.join(t.region, F.expr("n_regionkey = r_regionkey")).selectExpr("n_name child", "r_name parent")


@query("G08_two_hops", "select distinct s_suppkey, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def two_hops(t):
    return t.supplier.join(t.nation, F.expr("s_nationkey = n_nationkey")).join(t.region, F.expr("n_regionkey = r_regionkey")).select("s_suppkey", "r_name").distinct()


@query("G09_neighbourhood", "select 'r1' as id, 0 as distance union all select 'n' || n_nationkey, 1 from nation where n_regionkey = 1 union all select 's' || s_suppkey, 2 from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1 union all select 'c' || c_custkey, 2 from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1")
def neighbourhood(t):
    return G.neighbourhood(edges(t), t.spark.createDataFrame([("r1",)], "id string"), 2)


@query("G12_lens", "select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation")
def lens(t):
    return edges(t).where("startswith(src, 'n') and startswith(dst, 'r')")


@query("G14_hidden_neighbours", "select n_nationkey, count(*) as hidden from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1 group by 1")
def hidden(t):
    return t.customer.join(t.nation.where("n_regionkey = 1"), F.expr("c_nationkey = n_nationkey")).groupBy("n_nationkey").agg(F.count("*").alias("hidden"))


@query("G15_lineage", "select 'c5' as id, 0 as distance union all select 'n' || c_nationkey, 1 from customer where c_custkey = 5 union all select 'r' || n_regionkey, 2 from customer join nation on c_nationkey = n_nationkey where c_custkey = 5")
def lineage(t):
    return G.neighbourhood(edges(t), t.spark.createDataFrame([("c5",)], "id string"), 5, directed=True)


@query("A40_graph_counts", "select 'n' as kind, count(*) as n from nation union all select 's', count(*) from supplier union all select 'c', count(*) from customer")
def graph_counts(t):
    return edges(t).groupBy(F.left("src", F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


# governance
@query("M07_transitions", "select was, event_type, count(*) as n from (select lag(event_type) over (partition by user_id order by ts, event_id) as was, event_type from events) where was is not null group by 1, 2")
def transitions(t):
    from pyspark.sql import Window

    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select(was.alias("was"), "event_type").where("was is not null").groupBy("was", "event_type").agg(F.count("*").alias("n"))


@query("M10_one_allowing_reference", "select p_partkey from part join lineitem on l_partkey = p_partkey where l_returnflag = 'R' group by 1 having count(*) = 1")
def allowing(t):
    return t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n")).where("n = 1").select("p_partkey").join(t.part.select("p_partkey"), "p_partkey")


@query("M13_role_permissions", "select c_custkey, c_mktsegment in ('BUILDING', 'MACHINERY') and n_regionkey = 1 as allowed from customer join nation on c_nationkey = n_nationkey")
def permissions(t):
    grants = t.spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 1)], "c_mktsegment string, n_regionkey int").withColumn("granted", F.lit(True))
    rows = t.customer.join(t.nation, F.expr("c_nationkey = n_nationkey")).join(F.broadcast(grants), ["c_mktsegment", "n_regionkey"], "left")  # two rows
    return rows.select("c_custkey", F.coalesce("granted", F.lit(False)).alias("allowed"))
