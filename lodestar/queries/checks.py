"""Dictionary values, phrases, labels, anchors, evidence, permissions, requests and sinks, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serving as S
from ..sources.index import IndexStore
from ..storage import shared_dir
from .reading import Planted
from .registry import query

KINDS = {"c_name": "display", "c_custkey": "key", "c_mktsegment": "partial"}


def customer_forms(t):
    return S.forms_of(t.customer, "customer", "c_custkey", KINDS)


@query("K03_dictionary_build", " union all ".join(f"select '{k}' as kind, '{c}' as column_name, lower(cast({c} as varchar)) as key, count(distinct c_custkey) as n_instances from customer group by 3" for c, k in KINDS.items()))
def dictionary_build(t):
    return customer_forms(t).groupBy("kind", F.col("column").alias("column_name"), "key").agg(F.count_distinct("instance").alias("n_instances"))


@query("J13_values_of_columns", "select o_orderkey, o_custkey as instance from orders where o_orderkey % 3 = 1 and o_custkey in (select c_custkey from customer)")
def values_of_columns(t):
    """A third ask for a name in the names' column, a third for it in the keys' column, a third for a name that nobody has."""
    name = "case when o_orderkey % 3 < 2 then concat('  CUSTOMER#', lpad(o_custkey, 9, '0'), '. ') else 'nobody' end as value"
    asked = t.orders.selectExpr("o_orderkey", "case when o_orderkey % 3 = 0 then 'c_custkey' else 'c_name' end as column", name)
    return S.looked_up(asked, customer_forms(t)).select("o_orderkey", "instance")


PHRASES = {"order": ["this order", "the order"], "item": ["the item"]}
NOTE = "case o_orderkey % 4 when 0 then 'The order is late; this  Order again' when 1 then 'Take the item, the itemised bill' when 2 then 'Breathe order' else 'the item of the order' end"
PLACES = "(values (0, 'order', 0, 'The order'), (0, 'order', 19, 'this  Order'), (1, 'item', 5, 'the item'), (3, 'item', 0, 'the item'), (3, 'order', 12, 'the order')) v(k, class, start_at, surface)"


@query("K06_contextual_phrases", f"select o_orderkey as id, class, start_at, surface from orders join {PLACES} on k = o_orderkey % 4")
def contextual_phrases(t):
    return S.phrases(t.orders.selectExpr("o_orderkey id", f"{NOTE} text"), PHRASES).select("id", "class", "start_at", "surface")


@query("K32_rule_tryout", "select 1 as id, s as surface, instr('See the order today: THE ORDER', s) - 1 as start_at from (values ('the order'), ('THE ORDER')) v(s)")
def tryout(t):
    passages = t.spark.createDataFrame([(1, "See the order today: THE ORDER"), (2, "No orders"), (3, None)], "id int, text string")
    return S.phrases(passages, {"order": ["the order"]}).select("id", "surface", "start_at")


@query("K08_labelled_values", """select o_orderkey as id, 0 as line, 'Customer' as label, 'customer' as class, c_name as value from orders join customer on c_custkey = o_custkey
union all select o_orderkey, 3, 'STATUS', 'status', o_orderstatus from orders join customer on c_custkey = o_custkey where o_orderkey % 2 = 0""")
def labelled_values(t):
    """Labels with a rule in any case; not those of a plain value, without a rule or without a value."""
    text = "concat('Customer:  ', c_name, '\n', 'Total: ', o_totalprice, '\n', 'Mood: fine\n', case when o_orderkey % 2 = 0 then concat('STATUS: ', o_orderstatus) else 'Status: ' end) as text"
    rows = t.orders.join(t.customer, F.expr("c_custkey = o_custkey")).selectExpr("o_orderkey as id", text)
    return S.labelled(rows, {"customer": ("customer", "display"), "status": ("status", "key"), "total": ("total", "value")})


FLAGS = Planted("orders", "o_orderpriority = '1-URGENT'", cluster="o_orderkey", l_orderkey="o_orderkey", l_returnflag="case when o_orderkey % 2 = 0 then 'R' else 'A' end")
RATES = "(select l_partkey, l_suppkey, max(l_tax) as rate from lineitem where l_quantity > 30 group by 1, 2)"


@query("J11_anchor_left_join", f"""select cluster, l_linenumber, l_partkey, rate, nth from (select cluster, l_linenumber, l_partkey, rate, row_number() over (partition by cluster order by l_linenumber, l_partkey, l_suppkey) as nth
from {FLAGS.sql} join lineitem using (l_orderkey, l_returnflag) left join {RATES} using (l_partkey, l_suppkey)) where nth <= 2""")
def anchor_left_join(t):
    related = t.lineitem.where("l_quantity > 30").groupBy("l_partkey", "l_suppkey").agg(F.max("l_tax").alias("rate"))
    rows = S.anchored(FLAGS.of(t), t.lineitem.select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey"), related, ["l_partkey", "l_suppkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 1)
    return rows.select("cluster", "l_linenumber", "l_partkey", "rate", "nth")


TRUTH = Planted("lineitem", "l_returnflag = 'R'", claim="l_suppkey * 10 + l_linenumber", asset="l_orderkey % 40")
CRAWLED = Planted("lineitem", "l_returnflag = 'A'", claim="l_suppkey * 10 + l_linenumber", asset="l_orderkey % 50")


@query("A26_evidence_agreement", f"""with b as (select claim from {TRUTH.sql} intersect select claim from {CRAWLED.sql}), s as (select claim, asset from {TRUTH.sql} intersect select claim, asset from {CRAWLED.sql})
select (select count(*) from b) as n, (select count(distinct claim) from s) as agreeing""")
def evidence_agreement(t):
    return S.evidence_agreement(TRUTH.of(t), CRAWLED.of(t))


@query("J24_roles_of_fields", """select f.p_brand as field, coalesce(r.sizes, '') as sizes, coalesce(g.terms, '') as terms from (select distinct p_brand from part) f
left join (select p_brand, string_agg(distinct p_size::varchar, ',' order by p_size::varchar) as sizes from part where p_size > 45 group by 1) r using (p_brand)
left join (select p_brand, string_agg(distinct p_type, ',' order by p_type) as terms from part where p_retailprice < 950 group by 1) g using (p_brand)""")
def roles_of_fields(t):
    listed = lambda where, c, name: t.part.where(where).groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(name))
    rows = t.part.select("p_brand").distinct().join(listed("p_size > 45", "p_size", "sizes"), "p_brand", "left").join(listed("p_retailprice < 950", "p_type", "terms"), "p_brand", "left")
    return rows.na.fill("", ["sizes", "terms"]).withColumnRenamed("p_brand", "field")


ACTIONS = {"BUILDING": ["1-URGENT", "2-HIGH"], "MACHINERY": ["1-URGENT"], "FURNITURE": ["5-LOW"]}
GRANTS = Planted("customer", principal="c_custkey % 40", organisation="c_nationkey % 5", role="c_mktsegment", model="case when c_acctbal < 3000 then null else c_custkey % 3 end")
ASKED = Planted("orders", principal="o_custkey % 40", organisation="o_orderkey % 5", action="o_orderpriority", model="case when o_orderkey % 7 = 0 then null else o_orderkey % 3 end")


@query("M13_granted_actions", f"""select a.*, exists (select 1 from {GRANTS.sql} g join (values {', '.join(f"('{r}', '{x}')" for r, of in ACTIONS.items() for x in of)}) p(role, action) using (role)
where g.principal = a.principal and g.organisation = a.organisation and p.action = a.action and (g.model is null or g.model = a.model)) as allowed from {ASKED.sql} a""")
def granted_actions(t):
    return S.permitted(ASKED.of(t), GRANTS.of(t), ACTIONS)


REQUESTS = Planted("events", id="event_id", key="user_id", hash="event_type")
STORED = Planted("customer", "c_custkey % 2 = 0", key="c_custkey", hash="case when c_custkey % 4 = 0 then 'click' else 'signup' end")


@query("M16_request_outcomes", f"""select r.id, case when s.hash is null and r.id = f.id then 'new' when r.hash = coalesce(s.hash, f.hash) then 'existing' else 'conflict' end as outcome
from {REQUESTS.sql} r left join {STORED.sql} s on s.key = r.key join (select key, id, hash from {REQUESTS.sql} qualify row_number() over (partition by key order by id) = 1) f on f.key = r.key""")
def request_outcomes(t):
    return S.inserted(REQUESTS.of(t), STORED.of(t))


@query("M10_authorised_assets", "select p_partkey as asset, (select count(*) from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_discount > 0.05) = 1 as authorised from part")
def authorised_assets(t):
    return S.one_reference(t.part.selectExpr("p_partkey asset"), t.lineitem.selectExpr("l_partkey asset", "l_returnflag = 'R' and l_discount > 0.05 allows"))


@query("S25_newest_vectors_of_source", "select 'b' as run, label as source, count(*) as n from embeddings where label % 2 = 0 group by 2 union all select 'a', label, count(*) from embeddings where label % 2 = 1 group by 2")
def newest_vectors(t):
    """All sources are written in run a, the even ones again in run b, which takes the place of their older rows."""
    store = IndexStore.temporary(t.spark)
    rows = t.embeddings.select("vec_id", "embedding", F.col("label").alias("source"))
    store.replace_sources("vectors", rows.withColumn("run", F.lit("a")))
    store.replace_sources("vectors", rows.where("source % 2 = 0").withColumn("run", F.lit("b")))
    return store.read("vectors").groupBy("run", "source").agg(F.count("*").alias("n"))


@query("S27_glossary_round_trip", "select 'part' as table_name, 'p_type' as column_name, p_type as term, 'says \"' || p_type || '\", twice' as definition from part group by 3")
def glossary_round_trip(t):
    """Terms are written as CSV with a header, quotes and commas in them, read again and joined to the columns they are assigned to."""
    path = shared_dir(t.spark, "glossary")
    terms = t.part.select(F.col("p_type").alias("term"), F.expr("concat('says \"', p_type, '\", twice')").alias("definition"), F.lit("part").alias("table_name"), F.lit("P_TYPE").alias("column_name")).distinct()
    terms.write.option("header", True).option("escape", '"').csv(path)
    read = t.spark.read.schema(terms.schema).option("header", True).option("escape", '"').csv(path).withColumn("column_name", F.lower("column_name"))
    columns = t.spark.createDataFrame([(table, c) for table in ("part", "customer") for c in t[table].columns], "table_name string, column_name string")
    return read.join(columns, ["table_name", "column_name"]).select("table_name", "column_name", "term", "definition")
