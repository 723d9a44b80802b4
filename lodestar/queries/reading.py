"""The reading chain from mentions to claims. What the notes say is planted from the order tables by `Planted`, so both engines read the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import cue_pattern
from ..operators import cases as C
from ..operators import graph as G
from .registry import query


class Planted:
    """Rows of one table under other names, for Spark and as a subquery for DuckDB."""

    def __init__(self, table: str, where: str = "true", **columns: str):
        self.table, self.where, self.columns = table, where, [f"{x} as {name}" for name, x in columns.items()]

    def of(self, t):
        return t[self.table].where(self.where).selectExpr(*self.columns)

    @property
    def sql(self) -> str:
        return f"(select {', '.join(self.columns)} from {self.table} where {self.where})"


ASSET = "l_orderkey * 2 + l_linenumber % 2"
CLASS = "case when l_linenumber % 3 = 0 then 'supplier' else 'part' end"
INSTANCE = "case when l_linenumber % 3 = 0 then l_suppkey else l_partkey % 5 end"
MENTION = "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber"

HITS = Planted("lineitem", **{"asset": "l_orderkey", "class": CLASS, "key": "l_partkey % 4", "instance": INSTANCE, "deferred": "l_returnflag = 'R'", "partial": "l_linestatus = 'F'"})


@query("K05_confirmed_hits", f"""with h as {HITS.sql} select * from h where not deferred
union all select * from h where deferred and not partial and exists (select 1 from h x where not x.deferred and x.asset = h.asset and x.class = h.class and x.key = h.key)
union all select * from h where deferred and partial and exists (select 1 from h x where not x.deferred and not x.partial and x.asset = h.asset and x.class = h.class and x.instance = h.instance)""")
def confirmed_hits(t):
    return C.confirmed(HITS.of(t))


@query("K09_partial_names_unlocked", f"""with h as {HITS.sql}, sure as (select distinct asset, class, instance from h where not deferred and not partial)
select asset, class, count(*) as n from h join sure using (asset, class, instance) where deferred and partial group by 1, 2""")
def unlocked(t):
    return C.confirmed(HITS.of(t)).where("deferred and partial").groupBy("asset", "class").agg(F.count("*").alias("n"))


@query("K07_header_mentions", "select conv_id * 100 + turn as id, 6 as start_at, role as surface, 'speaker' as class from conversations where role <> 'system'")
def headers(t):
    text, fields = "concat('From: ', role, ' <x@y.z>') as text", "map('from', if(role = 'system', '', concat(role, ' ')), 'cc', 'nobody') as fields"
    found = C.header_mentions(t.conversations.selectExpr("conv_id * 100 + turn as id", text, fields), {"from": "speaker", "cc": "speaker"})
    return found.select("id", "start_at", "surface", "class")


@query("K11_case_identifiers", """with recursive r as (select o_orderkey as asset, o_custkey as c, cast(o_orderdate as date) as day from orders where o_orderkey % 2 = 0),
few as (select c from r group by c having count(*) between 2 and 12),
gaps as (select c, asset, day, case when date_diff('day', lag(day) over w, day) <= 60 then 0 else 1 end as fresh from r join few using (c) window w as (partition by c order by day, asset)),
runs as (select c, asset, sum(fresh) over (partition by c order by day, asset) as run from gaps)
select asset as id, coalesce(min(asset) over (partition by c, run), asset) as component from runs union all select asset, asset from r where c not in (select c from few)""")
def case_identifiers(t):
    rows = t.orders.where("o_orderkey % 2 = 0")
    weak = rows.selectExpr("o_orderkey asset", "'customer' name", "cast(o_custkey as string) value", "false strong")
    return G.components(C.case_edges(weak, rows.selectExpr("o_orderkey asset", "to_date(o_orderdate) day"), 60, 12), rows.selectExpr("o_orderkey id"))


READINGS = Planted("lineitem", **{"mention": MENTION, "asset": ASSET, "cluster": "l_orderkey", "class": CLASS, "instance": INSTANCE, "tier": "case when l_quantity > 40 then 'exact_key' else 'alias' end"})
LOOKUPS = Planted("lineitem", "l_discount > 0.08", **{"cluster": "l_orderkey", "column": "'l_tax'", "match": "case when l_tax > 0.06 then 'equals' else 'suffix' end"})
FOUND = f"(select distinct cluster, class, instance from {READINGS.sql} r where tier = 'exact_key' or not exists (select 1 from {READINGS.sql} x where x.cluster = r.cluster and x.class = r.class and x.tier = 'exact_key'))"


@query("K14_constraints", f"select * from {FOUND}")
def constraints(t):
    return C.constraints(READINGS.of(t))


@query("K15_queryable", f"""select distinct cluster from (select cluster from {FOUND} group by 1 having count(distinct class) >= 2
union all select cluster from {LOOKUPS.sql} where match = 'equals' union all select cluster from {LOOKUPS.sql} group by 1 having count(distinct match) = 2
union all select cluster from {LOOKUPS.sql} where cluster in (select cluster from {FOUND}))""")
def queryable(t):
    return C.queryable(C.constraints(READINGS.of(t)), LOOKUPS.of(t))


ROWS = Planted("lineitem", "l_quantity > 25", **{"cluster": "l_orderkey", "row": "l_linenumber", "day": "cast(l_shipdate as date)"})
DATES = Planted("lineitem", "l_returnflag = 'R'", **{"cluster": "l_orderkey", "day": "cast(l_shipdate as date)"})


@query("K16_decided_rows", f"""with r as (select cluster, "row", bool_or(exists (select 1 from {DATES.sql} d where d.cluster = r.cluster and d.day = r.day)) as agrees from {ROWS.sql.replace(' as row', ' as "row"')} r group by 1, 2),
n as (select cluster, count(*) as n, count(*) filter (where agrees) as k from r group by 1)
select cluster, "row" from r join n using (cluster) where n = 1 or (n <= 4 and k = 1 and agrees)""")
def decided_rows(t):
    return C.decided(ROWS.of(t), DATES.of(t), 4)


IDENTIFIED = Planted("orders", **{"cluster": "o_orderkey", "instance": "o_custkey % 5", "preferred": "o_orderstatus = 'F'"})
RELATED = Planted("orders", **{"cluster": "o_orderkey", "instance": "(o_custkey + 1) % 5", "preferred": "o_orderstatus <> 'F'"})


@query("K17_promoted", f"""with i as (select * from {IDENTIFIED.sql} union all select * from {RELATED.sql}), h as (select mention, instance, preferred from {READINGS.sql} join i using (cluster, instance))
select mention, coalesce(min(instance) filter (where preferred), min(instance)) as target from h group by 1""")
def promoted(t):
    return C.promoted(READINGS.of(t), IDENTIFIED.of(t).unionByName(RELATED.of(t)))


PHRASES = Planted("lineitem", "l_returnflag = 'R'", **{"asset": ASSET, "cluster": "l_orderkey", "class": CLASS})
LINKS = Planted("lineitem", "l_returnflag <> 'R'", **{"asset": ASSET, "cluster": "l_orderkey", "class": CLASS, "instance": INSTANCE})


@query("K19_contextual", f"""with k as {LINKS.sql}, p as {PHRASES.sql}, a as (select asset, class, list_distinct(list(instance)) as found from k group by 1, 2), c as (select cluster, class, list_distinct(list(instance)) as found from k group by 1, 2)
select p.*, coalesce(a.found, c.found)[1] as target from p left join a using (asset, class) left join c using (cluster, class) where len(coalesce(a.found, c.found)) = 1""")
def contextual(t):
    return C.contextual(PHRASES.of(t), LINKS.of(t))


TARGETS = Planted("lineitem", **{"asset": "l_orderkey", "target": "concat(case when l_linenumber % 3 = 0 then 's' else 'p' end, l_suppkey % 3)", "class": CLASS, "titled": "l_quantity > 45", "confidence": "case when l_tax > 0.04 then 1.0 else 0.5 end"})
OWNERS = Planted("orders", "o_orderpriority = '1-URGENT'", **{"asset": "o_orderkey", "entity": "concat('case', o_custkey)"})
ABOUT = f"""(with n as (select asset, target, class, count(*) as n, bool_or(titled) as titled from {TARGETS.sql} group by all), r as (select asset, target, row_number() over (partition by asset order by titled desc, case when titled then 0 else -n end, class = 'part', target) as nth from n)
select coalesce(r.asset, o.asset) as asset, coalesce(entity, target) as about from (select * from r where nth = 1) r full join {OWNERS.sql} o on o.asset = r.asset)"""


@query("K20_about", f"select * from {ABOUT}")
def about(t):
    return C.about(TARGETS.of(t), OWNERS.of(t), ["supplier", "part"])


@query("K21_relationships", f"select 'Mentions' as type, asset as src, target as dst, cast(max(confidence) as double) as confidence from {TARGETS.sql} group by 2, 3 union all select 'About', asset, about, 1.0 from {ABOUT}")
def relationships(t):
    links = TARGETS.of(t).withColumn("confidence", F.col("confidence").cast("double"))
    return C.relationships(links, C.about(TARGETS.of(t), OWNERS.of(t), ["supplier", "part"]))


@query("K22_entity_book", """select 'customer' as class, c_custkey as instance, c_name as name, 'c_custkey=' || c_custkey as external_ids from customer
union all select 'part', p_partkey, least(p_name, p_brand), 'p_partkey=' || p_partkey || ',p_type=' || p_type from part""")
def entity_book(t):
    form = lambda df, of, key, kind, column: df.selectExpr(f"'{of}' class", f"{key} instance", f"'{kind}' kind", f"'{column}' column", f"cast({column} as string) surface")
    named = [("customer", "c_custkey", "display", "c_name"), ("customer", "c_custkey", "key", "c_custkey"), ("part", "p_partkey", "display", "p_name")]
    named += [("part", "p_partkey", "display", "p_brand"), ("part", "p_partkey", "key", "p_partkey"), ("part", "p_partkey", "key", "p_type")]
    forms = None
    for of, *rest in named:
        forms = form(t[of], of, *rest) if forms is None else forms.unionByName(form(t[of], of, *rest))
    return C.entity_book(forms).withColumn("external_ids", F.array_join("external_ids", ","))


TEXT = "case o_orderkey % 6 when 0 then 'It was late because of the carrier' when 1 then 'A full refund was sent today' when 2 then 'They got a refund' when 3 then 'Refund due, late again' when 4 then 'Refunds later' else 'All fine' end"
UNITS = Planted("orders", **{"unit": "o_orderkey", "asset": "o_custkey", "cluster": "o_custkey % 40", "text": TEXT})
CUES = {"delayed": ["late", "late * carrier"], "refunded": ["refund", "full refund", "refund was sent"], "praised": ["fine"]}
WEAK = ("refund", "late")


def cue_sql(predicate):
    order = sorted(CUES[predicate], key=lambda p: (C.STRENGTHS.index(C.strength(p, WEAK)), -len(p), p))
    whens = " ".join(f"when regexp_matches(text, '{cue_pattern(p)}') then '{p}|{C.strength(p, WEAK)}'" for p in order)
    return f"select unit, asset, cluster, '{predicate}' as predicate, case {whens} end as cue from {UNITS.sql}"


CUED = f"(select unit, asset, cluster, predicate, split_part(cue, '|', 1) as phrase, split_part(cue, '|', 2) as strength from ({' union all '.join(map(cue_sql, CUES))}) where cue is not null)"


@query("K23_best_cues", f"select * from {CUED}")
def best_cues(t):
    return C.best_cues(UNITS.of(t), CUES, WEAK)


IN_UNIT = Planted("lineitem", "l_linenumber <= 2", unit="l_orderkey", entity="l_suppkey % 3")
IN_ASSET = Planted("orders", "o_orderstatus = 'P'", asset="o_custkey", entity="o_orderkey % 4")
IN_CASE = Planted("orders", "o_totalprice > 150000", cluster="o_custkey % 40", entity="o_custkey % 2")
ONE = "case when min(entity) = max(entity) then min(entity) end as e"
ROLES = f"""(select u.unit, coalesce(a.e, b.e, c.e) as subject from {UNITS.sql} u left join (select unit, {ONE} from {IN_UNIT.sql} group by 1) a on a.unit = u.unit
left join (select asset, {ONE} from {IN_ASSET.sql} group by 1) b on b.asset = u.asset left join (select cluster, {ONE} from {IN_CASE.sql} group by 1) c on c.cluster = u.cluster)"""


def with_subject(t, units):
    return C.role(units, [(["unit"], IN_UNIT.of(t)), (["asset"], IN_ASSET.of(t)), (["cluster"], IN_CASE.of(t))], "subject")


@query("K24_roles", f"select unit, subject from {ROLES}")
def roles(t):
    return with_subject(t, UNITS.of(t)).select("unit", "subject")


SPEAKERS = [("message", "from", ["Building", "machinery"], "customer"), ("message", "from", [], "agent"), ("page", None, [], "author")]
VOICE = "case when o_orderkey % 3 = 2 then 'author' when o_orderkey % 3 = 1 then 'unknown' when c_mktsegment in ('BUILDING', 'MACHINERY') then 'customer' else 'agent' end"


def voices(t):
    segment = "case o_orderkey % 3 when 0 then 'message' when 2 then 'page' else 'header' end as segment"
    rows = t.orders.join(t.customer, F.expr("o_custkey = c_custkey")).selectExpr("o_orderkey as unit", segment, "map('from', c_mktsegment) as fields")
    return rows.select("unit", C.speaker(SPEAKERS).alias("voice"))


@query("K25_speakers", f"select o_orderkey as unit, {VOICE} as voice from orders join customer on o_custkey = c_custkey")
def speakers(t):
    return voices(t)


SHAPES = {"delayed": (["author"], True), "refunded": (["agent"], False)}
NAMED = f"(select unit from {IN_UNIT.sql} group by 1 having count(distinct entity) = 1)"
JUDGED = f"""(select h.unit, predicate, strength, subject, cast(case when o_orderkey % 10 < 8 then o_custkey end as bigint) as object, case when predicate = 'praised' then 'undefined'
when (predicate = 'delayed' and (voice = 'author' or (voice = 'unknown' and strength <> 'strong'))) or (predicate = 'refunded' and voice = 'agent') then 'speaker'
when strength = 'weak' and h.unit not in {NAMED} then 'weak_cue' when subject is null then 'no_subject' when o_orderkey % 10 >= 8 then 'no_object' end as reason
from {CUED} h join {ROLES} r on r.unit = h.unit join (select o_orderkey, o_custkey, {VOICE} as voice from orders join customer on o_custkey = c_custkey) v on v.o_orderkey = h.unit)"""


def judged(t):
    hits = with_subject(t, C.best_cues(UNITS.of(t), CUES, WEAK)).join(voices(t), "unit")
    hits = hits.join(C.single(IN_UNIT.of(t), ["unit"], "entity", "one"), "unit", "left").withColumn("named", F.col("one").isNotNull())
    return hits.withColumn("object", F.expr("case when unit % 10 < 8 then asset end")).withColumn("reason", C.reason(SHAPES))


@query("K26_dropped", f"select coalesce(reason, 'made') as reason, count(*) as n from {JUDGED} group by 1")
def dropped(t):
    return judged(t).groupBy(F.coalesce("reason", F.lit("made")).alias("reason")).agg(F.count("*").alias("n"))


@query("K26_claims", f"select predicate, subject, object, max(case strength when 'strong' then 0.9 when 'medium' then 0.7 else 0.4 end)::double as confidence, count(distinct unit) as n_evidence from {JUDGED} where reason is null group by 1, 2, 3")
def claims(t):
    return C.claims(judged(t), {"strong": 0.9, "medium": 0.7, "weak": 0.4})


MADE = Planted("lineitem", **{"claim": MENTION, "predicate": "case when l_returnflag = 'R' then 'returned' else 'bought' end", "subject": "concat('o', l_orderkey)", "object": "concat('p', l_partkey)"})


@query("K29_entity_claims", f"""with e as (select 'p' || p_partkey as entity from part where contains(lower(p_name), 'blue widget') order by lower(p_name) <> 'blue widget', p_name, 1 limit 5)
select distinct claim, predicate, subject, object from {MADE.sql} where object in (select entity from e) or subject in (select entity from e) order by predicate, claim limit 25""")
def entity_claims(t):
    return C.entity_claims(t.part.selectExpr("concat('p', p_partkey) entity", "p_name name"), MADE.of(t), " Blue Widget ")


RAW = Planted("lineitem", predicate="case when l_linenumber % 2 = 0 then 'sells' else 'owns' end", source="concat('s', l_suppkey)", target="concat(case when l_returnflag = 'R' then 's' else 'p' end, l_partkey)")


@query("K36_shaped_claims", f"select distinct 'sells' as predicate, cast(substr(source, 2) as bigint) as subject, cast(substr(target, 2) as bigint) as object from {RAW.sql} where predicate = 'sells' and target like 'p%' and cast(substr(target, 2) as bigint) in (select p_partkey from part where p_size > 10)")
def shaped_claims(t):
    linked = t.part.where("p_size > 10").selectExpr("concat('p', p_partkey) key", "'part' class", "cast(p_partkey as bigint) entity")
    linked = linked.unionByName(t.supplier.selectExpr("concat('s', s_suppkey) key", "'supplier' class", "cast(s_suppkey as bigint) entity"))
    return C.shaped(RAW.of(t), linked, {"sells": ("supplier", "part"), "owns": ("part", "supplier")})


@query("M06_mapping_choice", "select 'fits' as asked, max(n_name) as mapping from nation where n_nationkey = 7 union all select 'sole', n_name from nation where n_nationkey = 3")
def mapping_choice(t):
    rows = t.nation.selectExpr("n_name mapping", "concat(case when n_regionkey % 2 = 0 then 'retail@' else '' end, 'v', n_nationkey) version", "n_nationkey <> 9 active")
    ask = lambda df, version, asked: C.mapping_for(df, version).select(F.lit(asked).alias("asked"), "mapping")
    return ask(rows, "v7", "fits").unionByName(ask(rows.where("mapping = 'NATION_3'"), "v99", "sole")).unionByName(ask(rows, "v99", "several")).unionByName(ask(rows, "v9", "retired"))
