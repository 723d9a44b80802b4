"""Searches, rankings, lists and checks that serve a console: more rows of the inventory, each beside its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import mentions as M
from ..operators import scoring as S
from ..plans.retail import MODEL
from ..plans.semantic import Field, Filter, FilterTypeError, Metric, Relationship, Request, RequestError, SemanticModel
from .registry import query

AGGREGATE = r"\b(sum|count|avg|min|max)\s*\("


# catalogues
@query("S13_published_views", "select p_brand || '.' || p_type as view_name, min(p_partkey) as first_part from part where p_brand = 'Brand#1' group by 1 order by 1")
def published_views(t):
    return t.part.where("p_brand = 'Brand#1'").groupBy(F.concat_ws(".", "p_brand", "p_type").alias("view_name")).agg(F.min("p_partkey").alias("first_part")).orderBy("view_name")


@query("P13_operator_whitelist", "select * from (values ('=', true), ('like', true), ('not in', true), ('~', false), ('exists', false)) v(op, allowed)")
def whitelist(t):
    def allowed(op):
        try:
            MODEL.compile(Request(dimensions=["orders.o_orderstatus"], filters=[Filter("orders.o_orderstatus", op, "F")]), t)
        except RequestError:
            return False
        return True

    return t.spark.createDataFrame([(op, allowed(op)) for op in ("=", "like", "not in", "~", "exists")], "op string, allowed boolean")


@query("P12_value_errors", "select * from (values ('lineitem.l_quantity', false), ('orders.o_orderkey', false), ('orders.order_date', false), ('part.p_name', true)) v(field, fits)")
def value_errors(t):
    """The value 'ten' as each type has it: numbers, integers and dates refuse it."""

    def fits(name):
        try:
            MODEL.compile(Request(dimensions=[name], filters=[Filter(name, "=", "ten")]), t)
        except FilterTypeError:
            return False
        return True

    return t.spark.createDataFrame([(f, fits(f)) for f in ("lineitem.l_quantity", "orders.o_orderkey", "orders.order_date", "part.p_name")], "field string, fits boolean")


@query("P16_useful_statements", f"""with log as (select event_id, case event_id % 4 when 0 then 'select count(*) from orders' when 1 then 'show tables' when 2 then 'select o_orderkey from orders' else 'select sum(x) from elsewhere' end as sql from events) select event_id from log where not regexp_matches(lower(sql), '^(show|describe|set|use|explain)') and regexp_matches(lower(sql), '{AGGREGATE}') and regexp_matches(lower(sql), '\\b(orders|lineitem)\\b')""")
def useful_statements(t):
    log = t.events.select("event_id", F.expr("case event_id % 4 when 0 then 'select count(*) from orders' when 1 then 'show tables' when 2 then 'select o_orderkey from orders' else 'select sum(x) from elsewhere' end").alias("sql"))
    sql = F.lower("sql")
    return log.where(~sql.rlike("^(show|describe|set|use|explain)") & sql.rlike(AGGREGATE) & sql.rlike(r"\b(orders|lineitem)\b")).select("event_id")


@query("P17_scope_globs", "select page_id from pages where url like 'https://%' and url not like '%9%'")
def scope(t):
    return t.pages.where(F.col("url").like("https://%") & ~F.col("url").like("%9%")).select("page_id")


SCOPES = (("%widget%", "hardware"), ("%blue%", "colour"), ("%", "other"))


@query("P18_first_matching_scope", "select p_partkey, case " + " ".join(f"when lower(p_name) like '{p}' then '{c}'" for p, c in SCOPES) + " end as class from part")
def first_scope(t):
    name = F.lower("p_name")
    return t.part.select("p_partkey", F.coalesce(*[F.when(name.like(p), F.lit(c)) for p, c in SCOPES]).alias("class"))


@query("P19_optional_filters", "select event_id from events where user_id = 5 and ts >= timestamp '1990-01-01' and event_type is not null")
def optional_filters(t):
    """Filters that are given hold, those that are None are left out."""
    given = {"user_id": 5, "event_type": None, "event_id": None}
    tests = [F.col(c) == v for c, v in given.items() if v is not None] + [F.col("ts") >= F.lit("1990-01-01").cast("timestamp")]
    return t.events.where(reduce(lambda a, b: a & b, tests)).select("event_id")


# joins
@query("J04_pinned_of_two", "select n_name, count(*) as line_count from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1")
def pinned_of_two(t):
    """A second relationship leads straight to nation here, and would be the shorter; the pinned one is taken."""
    extra = Relationship("a_lines_by_order_parity", "lineitem", "nation", (("l_linenumber", "n_nationkey"),))
    model = SemanticModel(MODEL.datasets, list(MODEL.fields.values()), list(MODEL.metrics.values()), [*MODEL.relationships.values(), extra])
    via = {"nation": "supplier__s_nationkey__nation"}
    return model.compile(Request(metrics=["line_count"], dimensions=["nation.n_name"], via=via), t)


@query("J10_four_inner_one_left", """select l_orderkey, l_linenumber, c_name, coalesce(late.n, 0) as others from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey
left join (select l_orderkey as k, l_suppkey as s, count(*) as n from lineitem where l_returnflag = 'R' group by 1, 2) late on late.k = l_orderkey and late.s = l_suppkey where l_quantity < 3""")
def complaints(t):
    returned = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    lines = t.lineitem.where("l_quantity < 3").join(t.orders, F.expr("o_orderkey = l_orderkey")).join(t.customer, F.expr("c_custkey = o_custkey")).join(t.supplier, F.expr("s_suppkey = l_suppkey")).join(t.part, F.expr("p_partkey = l_partkey"))
    return lines.join(returned, ["l_orderkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "c_name", F.coalesce("n", F.lit(0)).alias("others"))


@query("J22_claim_match", """with a as (select distinct l_returnflag as predicate, l_suppkey as subject, nullif(l_partkey, 7) as object, cast(l_quantity as bigint) as value from lineitem where l_linestatus = 'F'),
b as (select distinct l_returnflag as predicate, l_suppkey as subject, nullif(l_partkey, 7) as object, cast(l_quantity as bigint) as value from lineitem where l_linestatus = 'O')
select count(*) as matched from a where exists (select 1 from b where a.predicate = b.predicate and a.subject = b.subject and (a.object = b.object or (a.object is null and b.object is null and a.value = b.value)))""")
def claim_match(t):
    """A claim's object key decides; where there is none, its value. One equi-join on a coalesced key, no `or`."""
    claims = t.lineitem.select("l_linestatus", F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").alias("subject"), F.expr("nullif(l_partkey, 7)").alias("o"), F.col("l_quantity").cast("long").alias("v"))
    key = F.coalesce(F.concat(F.lit("k"), F.col("o").cast("string")), F.concat(F.lit("v"), F.col("v").cast("string"))).alias("what")
    of = lambda s: claims.where(F.col("l_linestatus") == s).select("predicate", "subject", "o", "v", key).distinct()
    return of("F").join(of("O"), ["predicate", "subject", "what"], "left_semi").agg(F.count("*").alias("matched"))


@query("J23_model_membership", "select column_name, dataset from (values ('o_orderkey', 'orders'), ('p_name', 'part'), ('nothing', null)) v(column_name, dataset)")
def membership(t):
    asked = t.spark.createDataFrame([("o_orderkey",), ("p_name",), ("nothing",)], "column_name string")
    fields = t.spark.createDataFrame([(f.name, f.dataset) for f in MODEL.fields.values()], "column_name string, dataset string")
    return asked.join(fields, "column_name", "left")


# scores
@query("A25_segment_coverage", "select source, round(count(*) filter (where l.doc_id is not null) / count(*), 4) as coverage from documents d left join (select distinct doc_id from labels) l using (doc_id) group by 1")
def coverage(t):
    marked = t.labels.select("doc_id").distinct().withColumn("hit", F.lit(True))
    return t.documents.select("doc_id", "source").join(marked, "doc_id", "left").groupBy("source").agg(S.rate(F.count_if("hit"), F.count("*")).alias("coverage"))


def found_edges(t):
    """Edges of orders' lines by flag: those with status F are the truth, those with a discount are found."""
    return t.lineitem.selectExpr("l_returnflag kind", "l_suppkey a", "l_partkey b", "l_linestatus = 'F' truth", "l_discount > 0.03D found")


EDGES = "(select l_returnflag as kind, l_suppkey as a, l_partkey as b, bool_or(l_linestatus = 'F') as truth, bool_or(l_discount > 0.03) as found from lineitem group by 1, 2, 3)"


@query("A28_relationship_scores", f"select kind, round(count(*) filter (where truth and found) / nullif(count(*) filter (where found), 0), 4) as precision, round(count(*) filter (where truth and found) / nullif(count(*) filter (where truth), 0), 4) as recall from {EDGES} group by 1")
def relationship_scores(t):
    edges = found_edges(t).groupBy("kind", "a", "b").agg(F.bool_or("truth").alias("truth"), F.bool_or("found").alias("found"))
    both = F.count_if(F.col("truth") & F.col("found"))
    return edges.groupBy("kind").agg(S.rate(both, F.count_if("found")).alias("precision"), S.rate(both, F.count_if("truth")).alias("recall"))


@query("A29_claim_scores", "select predicate, round(count(*) filter (where truth and found) / nullif(count(*) filter (where truth), 0), 4) as recall from (select l_shipmode as predicate, l_orderkey, bool_or(l_linestatus = 'F') as truth, bool_or(l_discount > 0.03) as found from lineitem group by 1, 2) group by 1".replace("l_shipmode", "l_returnflag"))
def claim_scores(t):
    claims = t.lineitem.groupBy(F.col("l_returnflag").alias("predicate"), "l_orderkey").agg(F.bool_or(F.expr("l_linestatus = 'F'")).alias("truth"), F.bool_or(F.expr("l_discount > 0.03D")).alias("found"))
    return claims.groupBy("predicate").agg(S.rate(F.count_if(F.col("truth") & F.col("found")), F.count_if("truth")).alias("recall"))


@query("A32_variant_aggregates", "select event_type, count(*) as n, round(avg(case when value > 50 then 1.0 else 0.0 end), 4) as accuracy, round(sum(value) / nullif(count(*) filter (where value > 50), 0), 4) as cost_per_right from events group by 1")
def variant_aggregates(t):
    right = F.count_if(F.col("value") > 50)
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), S.rate(right, F.count("*")).alias("accuracy"), S.rate(F.sum("value"), right).alias("cost_per_right"))


# windows and rankings
@query("W11_next_line", "select conv_id, turn, text as label, lead(text) over (partition by conv_id order by turn) as value from conversations qualify role = 'user' and value is not null")
def next_line(t):
    value = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("value", value).where("role = 'user' and value is not null").select("conv_id", "turn", F.col("text").alias("label"), "value")


@query("T02_clamped_limit", "select o_orderkey from orders order by 1 limit 1000")
def clamped(t):
    """A limit asked for is held to 1..1000."""
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(max(1, min(1000, 5000)))


@query("T03_keyword_score", "select p_partkey, cast(score as int) as score from (select p_partkey, p_name, 2 * (contains(lower(p_name), 'blue')::int + contains(lower(p_name), 'widget')::int) + contains(lower(p_type), 'steel')::int as score from part) where score > 0 order by score desc, p_name, p_partkey limit 15")
def keyword_score(t):
    has = lambda c, w: F.lower(c).contains(w).cast("int")
    score = 2 * (has("p_name", "blue") + has("p_name", "widget")) + has("p_type", "steel")
    return t.part.select("p_partkey", "p_name", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_name", "p_partkey").limit(15).select("p_partkey", "score")


@query("T05_most_documented", "select p_name, count(distinct l_orderkey) as n from lineitem join part on p_partkey = l_partkey group by 1 order by n desc, p_name limit 20")
def most_documented(t):
    return t.lineitem.join(t.part, F.expr("p_partkey = l_partkey")).groupBy("p_name").agg(F.count_distinct("l_orderkey").alias("n")).orderBy(F.desc("n"), "p_name").limit(20)


@query("T06_document_order", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority = '1-URGENT' desc, n desc, o_orderdate, o_orderkey) as place from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey")
def document_order(t):
    passages = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.expr("o_orderpriority = '1-URGENT'")), F.desc("n"), "o_orderdate", "o_orderkey")
    return t.orders.join(passages, F.expr("l_orderkey = o_orderkey")).select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("T10_sample_rows", "select count(*) as n, true as known from (select * from part limit 10)")
def sample_rows(t):
    """Any 10 rows of a table; which ones is not told, that they are the table's is checked."""
    some = t.part.limit(10)
    return some.join(t.part.select("p_partkey").withColumn("hit", F.lit(True)), "p_partkey", "left").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("hit", F.lit(False))).alias("known"))


FACTS = "lower(concat_ws(' ', o_orderkey, o_orderstatus, o_orderpriority, o_totalprice::bigint))"


@query("T12_scenario_list", f"select o_orderkey, total from (select o_orderkey, count(*) over () as total from orders where o_orderstatus = 'F' and contains({FACTS}, 'urgent')) order by o_orderkey limit 10 offset 5")
def scenario_list(t):
    facts = F.lower(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("long").cast("string")))
    hits = t.orders.where(F.col("o_orderstatus") == "F").where(facts.contains("urgent")).select("o_orderkey")
    page = hits.orderBy("o_orderkey").offset(5).limit(10)
    return page.join(F.broadcast(hits.agg(F.count("*").alias("total"))), F.lit(True))  # one row


@query("U04_classified_wins", "select l_orderkey, l_returnflag as class from lineitem qualify row_number() over (partition by l_orderkey order by l_returnflag = 'N', l_linenumber, l_returnflag) = 1")
def classified_wins(t):
    """Of mentions with one id the classified (not N) one stays, then the first."""
    return t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct(F.expr("l_returnflag = 'N'"), "l_linenumber", "l_returnflag")).alias("class"))


# text and records
@query("F13_cue_strength", r"select doc_id, case when regexp_matches(text, '(?i)\blicense\s+(?:granted|agreement)\b') then 'strong' when regexp_matches(text, '(?i)\blicense\b') then 'medium' when regexp_matches(text, '(?i)\blicens') then 'weak' end as strength from documents where strength is not null")
def cue_strength(t):
    text = F.col("text")
    strength = F.when(text.rlike(r"(?i)\blicense\s+(?:granted|agreement)\b"), "strong").when(text.rlike(r"(?i)\blicense\b"), "medium").when(text.rlike(r"(?i)\blicens"), "weak")
    return t.documents.select("doc_id", strength.alias("strength")).where("strength is not null")


@query("F15_cue_distance", "select item_id, abs(instr(text, 'the') - instr(text, ' of ')) as distance from benchmark where instr(text, 'the') > 0 and instr(text, ' of ') > 0 and abs(instr(text, 'the') - instr(text, ' of ')) <= 40")
def cue_distance(t):
    """Characters between the first cue and the first context word, where they are within 40."""
    at = lambda w: F.instr("text", w)
    found = t.benchmark.where((at("the") > 0) & (at(" of ") > 0)).select("item_id", F.abs(at("the") - at(" of ")).cast("long").alias("distance"))
    return found.where("distance <= 40")


@query("F23_email_split", "select conv_id, turn, 'note ' || turn as subject, replace(text, chr(10), ' ') as body from conversations")
def email_split(t):
    """Messages made of the turns, split again: headers to the first empty line, the subject, the plain body."""
    mail = F.concat(F.lit("From: a@b.example\nSubject: note "), F.col("turn").cast("string"), F.lit("\nX-Kind: chat\n\n"), F.regexp_replace("text", "\n", " "))
    parts = F.split(mail, "\n\n", 2)
    return t.conversations.select("conv_id", "turn", F.regexp_extract(parts[0], r"(?im)^subject:[ \t]*(.*)$", 1).alias("subject"), parts[1].alias("body"))


@query("F24_label_value_pairs", "select o_orderkey, 'Status' as label, o_orderstatus as value from orders union all select o_orderkey, 'Priority', o_orderpriority from orders")
def label_value_pairs(t):
    """Page text in lines of `label: value`; lines without a value are passed over."""
    page = F.concat(F.lit("Order sheet\nStatus: "), "o_orderstatus", F.lit("\n\nPriority:   "), "o_orderpriority", F.lit("\nNotes:\n"))
    lines = t.orders.select("o_orderkey", F.explode(F.split(page, "\n")).alias("line"))
    pair = lambda k: F.regexp_extract("line", r"^([A-Za-z ]{1,40}):\s*(\S.*)$", k)
    return lines.select("o_orderkey", pair(1).alias("label"), pair(2).alias("value")).where("label <> ''")


@query("F32_locator_part", "select event_id, case event_id % 3 when 0 then 'p' || event_id when 1 then 'h' else 'm' end as part from events")
def locator_part(t):
    """The first of part, header, message id and page that a locator has."""
    locator = F.expr("to_json(named_struct('part', if(event_id % 3 = 0, concat('p', event_id), null), 'header', if(event_id % 3 <= 1, 'h', null), 'message_id', 'm', 'page', 1))")
    return t.events.select("event_id", F.coalesce(*[F.get_json_object(locator, f"$.{k}") for k in ("part", "header", "message_id", "page")]).alias("part"))


@query("F36_qualified_expression", "select * from (values ('sum(orders.o_totalprice * 2)'), ('count(orders.o_orderkey) / max(orders.o_custkey)')) v(expression)")
def qualified(t):
    """Bare column names of a dataset get its name before them, by pattern; words after a dot and function names are left."""
    names = "|".join(sorted((f.name for f in MODEL.fields.values() if f.dataset == "orders"), key=len, reverse=True))
    rows = t.spark.createDataFrame([("sum(o_totalprice * 2)",), ("count(orders.o_orderkey) / max(o_custkey)",)], "e string")
    return rows.select(F.regexp_replace("e", rf"(?<![\w.])({names})\b(?!\s*\()", "orders.$1").alias("expression"))


@query("F39_headline", "select s_suppkey, s_name || ' in ' || case when s_nationkey % 5 = 0 then '?' else cast(s_nationkey as varchar) end || ', ' || printf('%.1f', s_acctbal) as headline from supplier".replace("printf('%.1f', s_acctbal)", "cast(cast(floor(s_acctbal) as bigint) as varchar)"))
def headline(t):
    nation = F.coalesce(F.expr("if(s_nationkey % 5 = 0, null, cast(s_nationkey as string))"), F.lit("?"))
    return t.supplier.select("s_suppkey", F.concat("s_name", F.lit(" in "), nation, F.lit(", "), F.floor("s_acctbal").cast("string")).alias("headline"))


# mentions and evidence
@query("K04_longest_of_overlapping", "select id, surface from (values (1, 'red lamp shade'), (2, 'red lamp'), (2, 'lamp black'), (3, 'lamp')) v(id, surface) where not (id = 2 and surface = 'red lamp')")
def longest_of_overlapping(t):
    """Keys inside and across one another: the longest wins, then the leftmost."""
    names = ["red lamp", "red lamp shade", "lamp", "lamp black"]
    forms = t.spark.createDataFrame([("thing", n, i) for i, n in enumerate(names)], "class string, surface string, instance long")
    texts = t.spark.createDataFrame([(1, "A red lamp shade."), (2, "The red lamp black"), (3, "No LAMP, this")], "id long, text string")
    return M.scanned(texts, M.dictionary(forms)).select(F.col("id").cast("int").alias("id"), "surface")


@query("K13_owned_ids", "select o_clerk_id as doc_key, min(o_orderkey) as owner from (select o_orderkey, o_custkey % 500 as o_clerk_id from orders) group by 1 having count(*) = 1")
def owned_ids(t):
    """Document ids that one asset alone bears; those of several are ambiguous and owned by none."""
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 500).alias("doc_key"))
    return rows.groupBy("doc_key").agg(F.min("o_orderkey").alias("owner"), F.count("*").alias("n")).where("n = 1").select("doc_key", "owner")


@query("K30_grounded_repeats", """with q as (select item_id, text, split_part(text, ' ', 3) as quote from benchmark), u as (select item_id, text, quote, unnest(range(1, 3)) as nth from q where quote <> '')
select item_id, nth, case when nth = 1 then nullif(instr(text, quote), 0) else case when instr(substr(text, instr(text, quote) + length(quote)), quote) > 0 then instr(text, quote) + length(quote) - 1 + instr(substr(text, instr(text, quote) + length(quote)), quote) end end as at from u""")
def grounded_repeats(t):
    """The first and second time that a quote stands in its text; a repeat is looked for behind the one before, and may be missing."""
    rows = t.benchmark.select("item_id", "text", F.split_part("text", F.lit(" "), F.lit(3)).alias("quote")).where("quote <> ''")
    one = "nullif(locate(quote, text), 0)"
    two = f"nullif(locate(quote, text, {one} + length(quote)), 0)"
    return rows.select("item_id", F.posexplode(F.expr(f"array({one}, {two})")).alias("i", "at")).select("item_id", (F.col("i") + 1).cast("long").alias("nth"), F.col("at").cast("long").alias("at"))


@query("K35_checked_locators", "select doc_id, doc_id % 3 <> 0 as ok from documents where length(text) > 20")
def checked_locators(t):
    """Recorded surfaces against the text at their place; every third was recorded with a changed letter."""
    wrong = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 6, 9), F.lit("\u0001"))).otherwise(F.substring("text", 6, 10))
    spans = t.documents.where("length(text) > 20").select("doc_id", "text", wrong.alias("surface"), F.lit(5).alias("start_at"), F.lit(15).alias("end_at"))
    return spans.select("doc_id", F.expr("substr(text, start_at + 1, end_at - start_at) = surface").alias("ok"))


# graphs
def edges(t):
    up = t.nation.selectExpr("concat('n', n_nationkey) src", "concat('r', n_regionkey) dst")
    return up.unionByName(t.supplier.selectExpr("concat('s', s_suppkey) src", "concat('n', s_nationkey) dst"))


@query("G03_instance_of", "select count(*) filter (where r_name is not null) as linked, count(*) filter (where r_name is null) as unmatched from supplier left join (select * from nation join region on n_regionkey = r_regionkey where r_regionkey < 3) on s_nationkey = n_nationkey")
def instance_of(t):
    """Edges from instances to the classes of a version, and how many instances have none there."""
    classes = t.nation.join(t.region.where("r_regionkey < 3"), F.expr("n_regionkey = r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    return t.supplier.join(classes, "s_nationkey", "left").agg(F.count("r_name").alias("linked"), F.count_if(F.col("r_name").isNull()).alias("unmatched"))


@query("G05_drop_run", "select n_regionkey as run, count(*) as edges from nation where n_regionkey <> 2 group by 1")
def drop_run(t):
    """Nodes of a run go, and the edges at either end of them."""
    gone = t.nation.where("n_regionkey = 2").select("n_nationkey")
    return t.nation.join(gone, "n_nationkey", "left_anti").groupBy(F.col("n_regionkey").alias("run")).agg(F.count("*").alias("edges"))


@query("G06_classes", "select p_brand, p_size from part where p_brand = 'Brand#2' group by 1, 2")
def classes(t):
    """Classes of a layer and a kind, each of which may be left open."""
    asked = {"p_brand": "Brand#2", "p_size": None}
    tests = [F.col(c) == v for c, v in asked.items() if v is not None]
    return reduce(lambda df, test: df.where(test), tests, t.part.select("p_brand", "p_size").distinct())


@query("G10_class_detail", "select r_name, n_name from region left join nation on n_regionkey = r_regionkey and n_nationkey % 2 = 0")
def class_detail(t):
    return t.region.join(t.nation.where("n_nationkey % 2 = 0"), F.expr("n_regionkey = r_regionkey"), "left").select("r_name", "n_name")


@query("G11_broken_mappings", "select l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 10) group by 1")
def broken(t):
    return t.lineitem.select("l_partkey").distinct().join(t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")


@query("G13_bounded_focus", "select id, distance from (select 'r1' as id, 0 as distance union all select 'n' || n_nationkey, 1 from nation where n_regionkey = 1 union all select 's' || s_suppkey, 2 from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1) order by distance, id limit 12")
def bounded_focus(t):
    """A neighbourhood held to 12 nodes, nearest first, then by id."""
    return G.neighbourhood(edges(t), t.spark.createDataFrame([("r1",)], "id string"), 2).orderBy("distance", "id").limit(12)


@query("G16_authorised_graph", "select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation where n_regionkey in (1, 3)")
def authorised(t):
    """Edges whose two ends a reader may see."""
    seen = t.nation.where("n_regionkey in (1, 3)").selectExpr("concat('n', n_nationkey) id").unionByName(t.region.where("r_regionkey in (1, 3)").selectExpr("concat('r', r_regionkey) id"))
    return edges(t).join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


# models and governance
@query("M02_dangling_parts", "select * from (values ('relationship lost: no dataset nowhere'), ('field nowhere.x: no dataset nowhere'), ('metric m: no dataset nowhere')) v(problem)")
def dangling(t):
    model = SemanticModel(["orders"], [Field("nowhere", "x", "x", "string")], [Metric("m", "nowhere", "count(*)")], [Relationship("lost", "orders", "nowhere", (("a", "b"),))])
    return t.spark.createDataFrame([(p,) for p in model.problems()], "problem string")


@query("M03_review", "select l_orderkey, l_linenumber, case when l_discount >= 0.08 or l_linenumber = 1 then 'accepted' when l_returnflag = 'R' then 'rejected' else 'pending' end as decision from lineitem")
def review(t):
    """A decision by hand wins, else what is confident enough is accepted in bulk, else an automatic rejection, else pending."""
    by_hand, bulk, rule = F.when(F.col("l_linenumber") == 1, "accepted"), F.when(F.expr("l_discount >= 0.08D"), "accepted"), F.when(F.col("l_returnflag") == "R", "rejected")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(by_hand, bulk, rule, F.lit("pending")).alias("decision"))


@query("M05_mapping_validation", "select l_suppkey, l_partkey, 'unknown part' as problem from lineitem where l_partkey % 50 = 0 group by 1, 2")
def mapping_validation(t):
    known = t.part.where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.select("l_suppkey", "l_partkey").distinct().join(known, "l_partkey", "left_anti").select("l_suppkey", "l_partkey", F.lit("unknown part").alias("problem"))


@query("M08_superseded", "select o_custkey, o_orderkey, lead(o_orderkey) over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) as superseded_by from orders")
def superseded(t):
    """Versions of one configuration: each is superseded by the next."""
    return t.orders.select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")).alias("superseded_by"))


@query("M14_purge", "select 'orders' as kept, count(*) as n from orders where o_custkey <> 7 union all select 'lineitem', count(*) from lineitem join orders on l_orderkey = o_orderkey where o_custkey <> 7 union all select 'audit', count(*) from events")
def purge(t):
    """What is left after a customer's rows are purged, children before parents; the audit log stays whole."""
    left = t.orders.where("o_custkey <> 7")
    lines = t.lineitem.join(left.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n")
    return count(left, "orders").unionByName(count(lines, "lineitem")).unionByName(count(t.events, "audit"))


@query("M15_glossary_search", "select p_type as term, count(*) as columns from part where lower(p_type) like '%steel%' group by 1 order by columns desc, term")
def glossary_search(t):
    return t.part.where(F.lower("p_type").like("%steel%")).groupBy(F.col("p_type").alias("term")).agg(F.count("*").alias("columns")).orderBy(F.desc("columns"), "term")
