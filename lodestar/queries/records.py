"""Sources, profiling, key checks, latest states, windows, sets and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import latest as L
from ..operators import profile
from ..plans.retail import TABLES
from .registry import query

TS = "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS')"
DUCK_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"


# sources and sinks
@query("S01_capped_sql", "select o_orderkey, o_orderstatus from orders order by o_orderkey limit 1000")
def capped_sql(t):
    return t.spark.sql("select o_orderkey, o_orderstatus from {orders} order by o_orderkey", orders=t.orders).limit(1000)


@query("S02_columns", "select 'nation' as table_name, unnest(['n_nationkey', 'n_name', 'n_regionkey']) as column_name, unnest(['int', 'string', 'int']) as column_type")
def columns(t):
    return t.spark.createDataFrame([("nation", c, kind) for c, kind in t.nation.dtypes], "table_name string, column_name string, column_type string")


@query("S04_row_count", "select count(*) as n_rows from lineitem")
def row_count(t):
    return t.lineitem.agg(F.count("*").alias("n_rows"))


ALL_TABLES = (*TABLES, "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("S05_catalog_snapshot", " union all ".join(f"select '{x}' as table_name, count(*) as n_rows from {x}" for x in ALL_TABLES))
def catalog_snapshot(t):
    out = None
    for x in ALL_TABLES:
        one = t[x].agg(F.count("*").alias("n_rows")).select(F.lit(x).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("S06_log_newest_first", f"select event_id, user_id, {DUCK_TS} as at from events where event_type = 'purchase' order by ts desc, event_id limit 200")
def log_newest(t):
    return t.events.where("event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").limit(200).selectExpr("event_id", "user_id", f"{TS} at")


@query("S07_statements_of_files", "select doc_id, trim(s) as statement from (select doc_id, unnest(string_split_regex(text, '\\. ')) as s from documents) where trim(s) <> ''")
def statements(t):
    return t.documents.select("doc_id", F.explode(F.split("text", r"\. ")).alias("s")).select("doc_id", F.expr("trim(s)").alias("statement")).where("statement <> ''")


@query("S08_parquet_staging", "select p_brand, count(*) as n from part group by 1")
def staging(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"))


@query("S11_globs", "select page_id, url from pages where url like 'http%' and not url like '%/0%'")
def globs(t):
    from ..sources.assets import in_scope

    return in_scope(t.pages, "url", include=["http*"], exclude=["*/0*"]).select("page_id", "url")


@query("S12_mime", "select page_id, case when lower(url) like '%.html' then 'text/html' when lower(url) like '%.json' then 'application/json' when lower(url) like '%.pdf' then 'application/pdf' when lower(url) like '%.txt' then 'text/plain' else 'application/octet-stream' end as mime from pages")
def mime(t):
    from ..sources.assets import mime_of

    return t.pages.select("page_id", mime_of("url").alias("mime"))


@query("S14_rows_as_documents", "select p_partkey as asset_key, 'p_name' as part, p_name as text, sha256(p_name || '|' || p_type) as version from part where p_size < 10 union all select p_partkey, 'p_type', p_type, sha256(p_name || '|' || p_type) from part where p_size < 10")
def rows_as_documents(t):
    from ..sources.assets import rows_as_documents as rows

    return rows(t.part.where("p_size < 10"), "p_partkey", ["p_name", "p_type"])


@query("S15_verified_fetch", "select doc_id, case when length(text) = n_chars then 'ok' else 'damaged' end as status, sha256(text) as sha256 from documents")
def fetch(t):
    return t.documents.select("doc_id", F.when(F.length("text") == F.col("n_chars"), "ok").otherwise("damaged").alias("status"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("S16_size_cap", "select doc_id, case when strlen(text) > 5000 then 'too_large' else 'ok' end as status from documents")
def size_cap(t):
    return t.documents.select("doc_id", F.when(F.octet_length("text") > 5000, "too_large").otherwise("ok").alias("status"))


@query("S17_incremental_plan", "select a.o_orderkey as asset_id, case when b.o_orderkey is null or b.v <> a.v then 'changed' else 'unchanged' end as status from (select o_orderkey, o_orderstatus as v from orders) a left join (select o_orderkey, case when o_orderkey % 10 = 0 then 'old' else o_orderstatus end as v from orders where o_orderkey % 7 <> 0) b on a.o_orderkey = b.o_orderkey")
def incremental(t):
    from ..sources.assets import incremental_plan

    now = t.orders.selectExpr("o_orderkey asset_id", "o_orderstatus version")
    before = t.orders.where("o_orderkey % 7 <> 0").selectExpr("o_orderkey asset_id", "if(o_orderkey % 10 = 0, 'old', o_orderstatus) version")
    return incremental_plan(now, before)


@query("S18_carry_forward", "select o_orderkey, 'new' as run from orders where o_orderkey % 7 = 0 union all select o_orderkey, 'carried' from orders where o_orderkey % 7 <> 0")
def carry_forward(t):
    fresh = t.orders.where("o_orderkey % 7 = 0").selectExpr("o_orderkey", "'new' run")
    return L.upserted(t.orders.selectExpr("o_orderkey", "'carried' run"), fresh, "o_orderkey").select("o_orderkey", "run")


@query("S19_append_and_read", "select n_nationkey, n_name, 'a' as run from nation union all select n_nationkey, n_name, 'b' from nation where n_regionkey = 1")
def append_and_read(t):
    from ..sources.index import IndexStore

    store = IndexStore.temporary(t.spark)
    store.append("nations", t.nation.selectExpr("n_nationkey", "n_name", "'a' run"))
    store.append("nations", t.nation.where("n_regionkey = 1").selectExpr("n_nationkey", "n_name", "'b' run"))
    return store.read("nations")


@query("S20_index_read", "select n_name from nation where n_regionkey = 2 and n_nationkey > -1")
def index_read(t):
    from ..sources.index import IndexStore

    store = IndexStore.temporary(t.spark)
    store.append("nations", t.nation.selectExpr("n_nationkey", "n_name", "n_regionkey", "'a' run"))
    return store.read("nations", {"n_regionkey": 2}, ["n_name"])


@query("S21_delete_run", "select n_nationkey, 'b' as run from nation")
def delete_run(t):
    from ..sources.index import IndexStore

    store = IndexStore.temporary(t.spark)
    for run in "ab":
        store.append("nations", t.nation.selectExpr("n_nationkey", f"'{run}' run"))
    store.delete_run("a", ["nations"])
    return store.read("nations")


@query("S23_group_count", "select lang, source, count(*) as n from documents group by 1, 2")
def group_count(t):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("S24_json_decode", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_decode(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("S26_ready_view", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1 and event_type = 'purchase'")
def ready_view(t):
    return L.latest(t.events, ["user_id"], F.desc("ts"), F.desc("event_id")).where("event_type = 'purchase'").select("user_id", "event_id")


# keys, profiles, joins
@query("J06_fk_overlap", "select count(*) as n_distinct, count(*) filter (where r.k is null) as n_unmatched from (select distinct o_custkey as k from orders) l left join (select c_custkey as k from customer where c_mktsegment <> 'BUILDING') r on l.k = r.k")
def fk_overlap(t):
    return profile.overlap(t.orders, "o_custkey", t.customer.where("c_mktsegment <> 'BUILDING'"), "c_custkey")


@query("J07_inner_and_left_joins", "select l_orderkey, l_linenumber, c_name, p_name, s_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey left join part on l_partkey = p_partkey and p_size > 25 left join supplier on l_suppkey = s_suppkey and s_acctbal > 0 where l_returnflag = 'R' and l_quantity > 45")
def damage_returns(t):
    rows = t.lineitem.where("l_returnflag = 'R' and l_quantity > 45").join(t.orders, F.expr("l_orderkey = o_orderkey")).join(t.customer, F.expr("o_custkey = c_custkey"))
    rows = rows.join(t.part.where("p_size > 25"), F.expr("l_partkey = p_partkey"), "left").join(t.supplier.where("s_acctbal > 0"), F.expr("l_suppkey = s_suppkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "c_name", "p_name", "s_name")


@query("J09_dimension_in_two_roles", "select o_orderkey, l_linenumber, cn.n_name as buyer, sn.n_name as seller from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join nation cn on c_nationkey = cn.n_nationkey join nation sn on s_nationkey = sn.n_nationkey where l_quantity = 50")
def two_roles(t):
    buyer, seller = t.nation.selectExpr("n_nationkey c_nationkey", "n_name buyer"), t.nation.selectExpr("n_nationkey s_nationkey", "n_name seller")
    rows = t.lineitem.where("l_quantity = 50").join(t.orders, F.expr("l_orderkey = o_orderkey")).join(t.customer, F.expr("o_custkey = c_custkey")).join(t.supplier, F.expr("l_suppkey = s_suppkey"))
    return rows.join(buyer, "c_nationkey").join(seller, "s_nationkey").select("o_orderkey", "l_linenumber", "buyer", "seller")


@query("J12_suffix_lookup", "select a.tail, count(*) as n from (select distinct o_orderkey % 1000 as tail from orders where o_orderstatus = 'P') a join orders o on o.o_orderkey % 1000 = a.tail group by 1")
def suffix_lookup(t):
    tails = t.orders.where("o_orderstatus = 'P'").selectExpr("pmod(o_orderkey, 1000) tail").distinct()
    return t.orders.withColumn("tail", F.expr("pmod(o_orderkey, 1000)")).join(tails, "tail").groupBy("tail").agg(F.count("*").alias("n"))


@query("J17_semi_join", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.expr("o_custkey = c_custkey"), "left_semi").select("c_custkey")


@query("J18_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def anti(t):
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.expr("o_custkey = c_custkey"), "left_anti").select("c_custkey")


@query("J19_integrity_checks", "select 'orders' as check_name, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_custkey > 10) union all select 'lineitem', count(*) from lineitem where l_partkey not in (select p_partkey from part where p_size > 3)")
def integrity(t):
    one = t.orders.join(t.customer.where("c_custkey > 10"), F.expr("o_custkey = c_custkey"), "left_anti").agg(F.count("*").alias("n")).selectExpr("'orders' check_name", "n")
    return one.unionByName(t.lineitem.join(t.part.where("p_size > 3"), F.expr("l_partkey = p_partkey"), "left_anti").agg(F.count("*").alias("n")).selectExpr("'lineitem' check_name", "n"))


@query("J20_anti_on_two_columns", "select c_custkey from customer c where not exists (select 1 from orders where o_custkey = c.c_custkey and o_orderstatus = 'P') and not exists (select 1 from nation where n_nationkey = c.c_nationkey and n_regionkey = 0)")
def anti_two(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.expr("o_custkey = c_custkey"), "left_anti").join(t.nation.where("n_regionkey = 0"), F.expr("n_nationkey = c_nationkey"), "left_anti").select("c_custkey")


@query("A08_column_stats", " union all ".join(f"select 'orders' as table_name, '{c}' as column_name, count(*) as n_rows, count({c}) as non_null, count(distinct {c}) as ndv, round((count(*) - count({c})) / count(*), 4) as null_rate from orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def column_stats(t):
    return profile.column_stats(t.orders, "orders", exact=True).drop("lo", "hi")


@query("A08_least_and_greatest", " union all ".join(f"select '{c}' as column_name, cast(min({c}) as varchar) as lo, cast(max({c}) as varchar) as hi from orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def least_and_greatest(t):
    """Numbers with a fraction and times are left out: their text differs between engines."""
    return profile.column_stats(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "orders").select("column_name", "lo", "hi")


@query("A09_approximate_ndv")
def approximate_ndv(t):
    return profile.column_stats(t.lineitem, "lineitem")


@query("A10_exact_distinct", "select count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem")
def exact_distinct(t):
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("A11_primary_keys", "select 'orders' as table_name, 'o_orderkey' as column_name, cast(0.8 as double) as confidence")
def primary_keys(t):
    return profile.primary_keys(t.orders, "orders")


@query("A14_foreign_keys", """select * from (values ('lineitem', 'l_orderkey', 'orders', 'o_orderkey'), ('lineitem', 'l_partkey', 'part', 'p_partkey'), ('lineitem', 'l_suppkey', 'supplier', 's_suppkey'), ('orders', 'o_custkey', 'customer', 'c_custkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('supplier', 's_nationkey', 'nation', 'n_nationkey'), ('nation', 'n_regionkey', 'region', 'r_regionkey')) v(fk_table, fk_column, pk_table, pk_column) where fk_table <> 'supplier' or (select count(*) > count(distinct s_nationkey) from supplier)""")
def foreign_keys(t):
    """A column without repeats is a key of its own table and refers to none, as the supplier's nation may be where suppliers are few."""
    return profile.foreign_keys({x: t[x] for x in TABLES}).where("score > 0").select("fk_table", "fk_column", "pk_table", "pk_column")


@query("A15_key_uniqueness", "select count(*) as n_rows, count(distinct (l_orderkey, l_linenumber)) as n_keys from lineitem")
def key_uniqueness(t):
    return t.lineitem.agg(F.count("*").alias("n_rows"), F.count_distinct("l_orderkey", "l_linenumber").alias("n_keys"))


@query("A16_merge_by_lower_name", "select lower(p_name) as term, count(distinct p_brand) as n_brands, max(p_retailprice) as top from part group by 1")
def merge_terms(t):
    return t.part.groupBy(F.lower("p_name").alias("term")).agg(F.count_distinct("p_brand").alias("n_brands"), F.max("p_retailprice").alias("top"))


@query("A17_pivot_counts", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p from orders group by 1")
def pivot(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0).toDF("o_orderpriority", "f", "o", "p")


@query("A18_session_rollup", f"select user_id, min({DUCK_TS}) as first_at, max({DUCK_TS}) as last_at, count(*) as n, max(event_type) as top from events group by 1 order by n desc, user_id limit 50")
def sessions(t):
    return t.events.withColumn("at", F.expr(TS)).groupBy("user_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"), F.max("event_type").alias("top")).orderBy(F.desc("n"), "user_id").limit(50)


@query("A19_total_and_page", "select event_id, (select count(*) from events where event_type = 'click') as total from events where event_type = 'click' order by event_id limit 20 offset 40")
def page(t):
    rows = t.events.where("event_type = 'click'")
    return rows.orderBy("event_id").offset(40).limit(20).select("event_id", F.lit(rows.count()).alias("total"))


@query("A20_status_counters", "select event_type, count(*) as n from events group by 1")
def counters(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("A21_documents_per_entity", "select l_suppkey, count(distinct l_orderkey) as n from lineitem group by 1 order by n desc, l_suppkey")
def per_entity(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("n")).orderBy(F.desc("n"), "l_suppkey")


@query("A35_fingerprint")
def fingerprint(t):
    return L.fingerprint(t.orders)


@query("A36_table_identity", "select 'orders' as table_name, count(*) as n_rows from orders")
def identity(t):
    return L.fingerprint(t.orders).select(F.lit("orders").alias("table_name"), "n_rows")


@query("A37_latest_decisive_mark", "select user_id, arg_max(event_type, event_id) as status from events where event_type in ('purchase', 'click') group by 1")
def marks(t):
    return L.latest_columns(t.events.where("event_type in ('purchase', 'click')"), ["user_id"], ["event_id"], ["event_type"]).toDF("user_id", "status")


@query("A38_review_summary", "select coalesce(cast(quality as varchar), 'unreviewed') as status, count(*) as n from documents left join labels using (doc_id) group by 1")
def review_summary(t):
    return t.documents.join(t.labels, "doc_id", "left").groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unreviewed")).alias("status")).agg(F.count("*").alias("n"))


@query("A39_counts_as_map", "select source, to_json(map_from_entries(list((lang, n) order by lang))) as counts from (select source, lang, count(*) as n from documents group by 1, 2) group by 1")
def count_map(t):
    pairs = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("p"))
    return pairs.select("source", F.to_json(F.map_from_entries("p")).alias("counts"))


# windows and latest states
@query("W01_latest_lifecycle", f"select user_id, event_type, {DUCK_TS} as at from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def lifecycle(t):
    return L.latest(t.events, ["user_id"], F.desc("ts"), F.desc("event_id")).selectExpr("user_id", "event_type", f"{TS} at")


@query("W02_latest_state_max_by", "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1")
def latest_state(t):
    return L.latest_columns(t.events, ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query("W03_latest_successful", "select user_id, max(event_id) as event_id from events where event_type = 'purchase' group by 1")
def latest_successful(t):
    return L.latest_columns(t.events.where("event_type = 'purchase'").withColumn("e", F.col("event_id")), ["user_id"], ["event_id"], ["e"]).toDF("user_id", "event_id")


@query("W04_active_joined", "select c_custkey, c_name, o_orderkey from customer join (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1) on o_custkey = c_custkey")
def active(t):
    last = L.latest_columns(t.orders.withColumn("k", F.col("o_orderkey")), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["k"])
    return t.customer.join(last, F.expr("o_custkey = c_custkey")).selectExpr("c_custkey", "c_name", "k o_orderkey")


@query("W06_gap_to_runner_up", "select l_orderkey, best, best - coalesce(second, 0) as gap from (select l_orderkey, max(l_quantity) filter (where rn = 1) as best, max(l_quantity) filter (where rn = 2) as second from (select l_orderkey, l_quantity, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) as rn from lineitem) group by 1)")
def runner_up(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    rows = t.lineitem.select("l_orderkey", "l_quantity", F.row_number().over(w).alias("rn"), F.lead("l_quantity").over(w).alias("second"))
    return rows.where("rn = 1").selectExpr("l_orderkey", "l_quantity best", "l_quantity - coalesce(second, 0) gap")


@query("W07_top_k", "select l_orderkey, l_linenumber, rank from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rank from lineitem) where rank <= 3")
def top_k(t):
    return L.top_n(t.lineitem, ["l_orderkey"], 3, F.desc("l_extendedprice"), F.col("l_linenumber")).selectExpr("l_orderkey", "l_linenumber", "cast(rank as bigint) rank")


@query("W08_distinct_per_group", "select l_suppkey, l_partkey from (select l_suppkey, l_partkey, row_number() over (partition by l_suppkey order by n desc, l_partkey) as rn from (select l_suppkey, l_partkey, count(*) as n from lineitem group by 1, 2)) where rn <= 12")
def twelve(t):
    pairs = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return L.top_n(pairs, ["l_suppkey"], 12, F.desc("n"), F.col("l_partkey")).select("l_suppkey", "l_partkey")


@query("W10_lead_recovery", "select user_id, count(*) as recovered from (select user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events) where event_type = 'error' and nxt is not null and nxt <> 'error' group by 1")
def recovery(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("nxt", F.lead("event_type").over(w)).where("event_type = 'error' and nxt is not null and nxt <> 'error'").groupBy("user_id").agg(F.count("*").alias("recovered"))


@query("W12_earliest_date", "select o_orderkey, cast(coalesce(min(l_shipdate), min(o_orderdate)) as date) as first_date from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 30 group by 1")
def earliest(t):
    ship = t.lineitem.where("l_quantity > 30").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("d"))
    return t.orders.join(ship, F.expr("l_orderkey = o_orderkey"), "left").selectExpr("o_orderkey", "cast(coalesce(d, o_orderdate) as date) first_date")


@query("W13_sequence_numbers", "select event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events")
def sequence_numbers(t):
    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))


@query("W14_as_of_state", "select p.event_id, m.event_type as as_of from (select event_id, user_id, ts from events where event_type = 'purchase') p asof left join (select user_id, ts, max(event_type) as event_type from events where event_type in ('view', 'click') group by 1, 2) m on p.user_id = m.user_id and p.ts >= m.ts")
def as_of_state(t):
    marks_ = t.events.where("event_type in ('view', 'click')").groupBy("user_id", "ts").agg(F.max("event_type").alias("mark"))
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return L.as_of(left, marks_, "user_id", "ts", "ts", "mark").select("event_id", "as_of")


@query("W15_first_terminal_wins", """with e as (select *, min(case when event_type = 'purchase' then (ts, event_id) end) over (partition by user_id) as fin from events)
select user_id, arg_max(event_type, (ts, event_id)) as state, count(*) as n_events, bool_or(event_type = 'purchase') as ended from e where fin is null or (ts, event_id) <= fin group by 1""")
def terminal(t):
    return L.folded(t.events, "user_id", "ts", "event_id", "event_type", ["purchase"])


@query("W16_current_then_top_by_hash", "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by sha256(cast(p_partkey as varchar))) as rn from (select * from (select *, row_number() over (partition by p_name, p_brand order by p_size desc, p_partkey) as cur from part) where cur = 1)) where rn <= 2")
def pilot(t):
    now = L.latest(t.part, ["p_name", "p_brand"], F.desc("p_size"), F.col("p_partkey"))
    return L.top_n(now, ["p_brand"], 2, F.sha2(F.col("p_partkey").cast("string"), 256).asc()).select("p_brand", "p_partkey")


# sets
@query("U01_union", "select c_nationkey as k from customer union all select s_nationkey from supplier")
def union(t):
    return t.customer.selectExpr("c_nationkey k").unionByName(t.supplier.selectExpr("s_nationkey k"))


@query("U02_distinct", "select distinct l_partkey, l_suppkey from lineitem")
def distinct(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("U03_dedup_by_normal_text", "select text_key, min(doc_id) as doc_id, count(*) as n from (select doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) as text_key from documents) group by 1")
def dedup_text(t):
    key = F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))).alias("text_key")
    return t.documents.select("doc_id", key).groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("U05_highest_wins", "select l_partkey, l_suppkey, max(l_discount) as confidence from lineitem group by 1, 2")
def highest(t):
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("confidence"))


@query("U06_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def intersect(t):
    return t.customer.selectExpr("c_nationkey k").intersect(t.supplier.selectExpr("s_nationkey k"))


@query("U07_difference", "select c_nationkey as k from customer except select s_nationkey from supplier")
def difference(t):
    return t.customer.selectExpr("c_nationkey k").subtract(t.supplier.selectExpr("s_nationkey k"))


@query("U08_merged_streams", f"select 'event' as kind, event_id as id, {DUCK_TS} as at from events where event_type = 'purchase' union all select 'order', o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%g') from orders")
def streams(t):
    return t.events.where("event_type = 'purchase'").selectExpr("'event' kind", "event_id id", f"{TS} at").unionByName(t.orders.selectExpr("'order' kind", "o_orderkey id", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss.SSS') at")).orderBy("at", "kind", "id")


@query("U09_baseline_diff", "select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' when a.v = b.v then 'same' else 'changed' end as status from (select p_partkey as k, p_size as v from part where p_partkey % 9 <> 0) a full join (select p_partkey as k, case when p_partkey % 4 = 0 then 0 else p_size end as v from part where p_partkey % 5 <> 0) b on a.k = b.k")
def baseline_diff(t):
    return L.changes(t.part.where("p_partkey % 9 <> 0").selectExpr("p_partkey k", "p_size v"), t.part.where("p_partkey % 5 <> 0").selectExpr("p_partkey k", "if(p_partkey % 4 = 0, 0, p_size) v"), "k", "v")


@query("U10_upsert", "select s_suppkey, case when s_suppkey % 3 = 0 then 'new' else s_name end as s_name from supplier")
def upsert(t):
    return L.upserted(t.supplier.select("s_suppkey", "s_name"), t.supplier.where("s_suppkey % 3 = 0").selectExpr("s_suppkey", "'new' s_name"), "s_suppkey").select("s_suppkey", "s_name")


# order and samples
@query("T07_offset_page", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 30 offset 60")
def offset_page(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(60).limit(30).select("o_orderkey")


@query("T08_hash_sample", "select p_partkey from part order by sha256('seed-1|' || p_partkey) limit 40")
def hash_sample(t):
    return t.part.orderBy(F.sha2(F.concat(F.lit("seed-1|"), F.col("p_partkey").cast("string")), 256)).limit(40).select("p_partkey")


@query("T09_bounded_purge", "select event_id from events where event_id not in (select event_id from events where ts < timestamp '2024-01-15' order by ts, event_id limit 100)")
def purge(t):
    old = t.events.where("ts < timestamp'2024-01-15'").orderBy("ts", "event_id").limit(100).select("event_id")
    return t.events.join(old, "event_id", "left_anti").select("event_id")


@query("T11_searched_sorted_page", "select p_partkey, p_name from part where lower(p_name) like '%a%' or lower(p_type) like '%steel%' order by p_name desc, p_partkey limit 25 offset 5")
def term_list(t):
    return t.part.where("contains(lower(p_name), 'a') or contains(lower(p_type), 'steel')").orderBy(F.desc("p_name"), "p_partkey").offset(5).limit(25).select("p_partkey", "p_name")


@query("F33_largest_remainder", "with s as (select source, count(*) * 1.0 / (select count(*) from documents) * 137 as share from documents group by 1), r as (select source, floor(share) as base, row_number() over (order by share - floor(share) desc, source) as rn from s) select source, cast(base + case when rn <= 137 - (select sum(base) from r) then 1 else 0 end as bigint) as n from r")
def largest_remainder(t):
    from ..operators.sampling import apportioned

    return apportioned(t.documents.groupBy("source").agg(F.count("*").alias("weight")), "source", "weight", 137)


@query("M09_full_outer_summary", "select coalesce(a.k, b.k) as nation, coalesce(a.n, 0) as customers, coalesce(b.n, 0) as suppliers from (select c_nationkey as k, count(*) as n from customer where c_nationkey > 3 group by 1) a full join (select s_nationkey as k, count(*) as n from supplier group by 1) b on a.k = b.k")
def outer_summary(t):
    a = t.customer.where("c_nationkey > 3").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return a.join(t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers")), "nation", "full_outer").na.fill(0, ["customers", "suppliers"])


@query("M16_idempotent_insert", "select r.event_id, case when o.o_orderkey is null then 'inserted' when o.o_custkey = r.user_id then 'existing' else 'conflict' end as outcome from events r left join orders o on o.o_orderkey = r.event_id")
def idempotent(t):
    rows = t.events.join(t.orders.select("o_orderkey", "o_custkey"), F.expr("o_orderkey = event_id"), "left")
    return rows.select("event_id", F.when(F.col("o_orderkey").isNull(), "inserted").when(F.expr("o_custkey = user_id"), "existing").otherwise("conflict").alias("outcome"))
