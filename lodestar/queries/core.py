"""Requests over the semantic model: joins, filters, aggregates, order and limit."""

from __future__ import annotations

from ..plans.retail import MODEL
from ..plans.semantic import Filter, Measure, Request
from .registry import query

REVENUE = "round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue"


def asked(name: str, sql: str, **request) -> None:
    query(name, sql)(lambda t: MODEL.compile(Request(**request), t))


asked("J01_star_join", f"select p_brand, {REVENUE} from lineitem join part on l_partkey = p_partkey group by 1", metrics=["revenue"], dimensions=["part.p_brand"])
asked("J02_join_path", f"select n_name, {REVENUE} from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1", metrics=["revenue"], dimensions=["nation.n_name"])
asked(
    "J03_snowflake_revenue_by_region",
    f"select r_name, {REVENUE} from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where cast(o_orderdate as date) between date '1994-01-01' and date '1997-12-31' group by 1 order by revenue desc limit 10",
    metrics=["revenue"], dimensions=["region.r_name"], filters=[Filter("orders.order_date", "between", ["1994-01-01", "1997-12-31"])], order_by=["-revenue"], limit=10,
)
asked(
    "J04_role_playing_customer_region",
    f"select r_name, {REVENUE} from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1",
    metrics=["revenue"], dimensions=["region.r_name"], via={"nation": "customer__c_nationkey__nation"},
)
asked("J05_default_relationship", "select c_mktsegment, count(*) as order_count from orders join customer on o_custkey = c_custkey group by 1", metrics=["order_count"], dimensions=["customer.c_mktsegment"])
asked("P01_dimension_projection", "select c_name, c_mktsegment from customer", dimensions=["customer.c_name", "customer.c_mktsegment"])
asked("P02_derived_field", "select cast(year(o_orderdate) as int) as order_year, count(*) as order_count from orders group by 1", metrics=["order_count"], dimensions=["orders.order_year"])
_ROWS = dict(dimensions=["orders.o_orderkey", "orders.o_orderstatus", "orders.o_totalprice"])
for name, flt, where in (
    ("P03_equals", Filter("orders.o_orderstatus", "=", "F"), "o_orderstatus = 'F'"),
    ("P04_not_equals", Filter("orders.urgent_status", "!=", "F"), "nullif(o_orderstatus, 'P') <> 'F'"),
    ("P05_comparison", Filter("orders.o_totalprice", ">=", 150000), "o_totalprice >= 150000"),
    ("P06_in_scalar", Filter("orders.o_orderpriority", "in", "1-URGENT"), "o_orderpriority in ('1-URGENT')"),
    ("P07_not_in_nulls", Filter("orders.urgent_status", "not in", ["F"]), "nullif(o_orderstatus, 'P') not in ('F')"),
    ("P08_between", Filter("orders.o_totalprice", "between", [1000, 90000]), "o_totalprice between 1000 and 90000"),
    ("P09_like", Filter("orders.o_orderpriority", "like", "%IGH"), "o_orderpriority like '%IGH'"),
    ("P10_is_null", Filter("orders.urgent_status", "is null", "ignored"), "nullif(o_orderstatus, 'P') is null"),
    ("P12_typed_date_value", Filter("orders.order_date", ">", "1996-06-30"), "cast(o_orderdate as date) > date '1996-06-30'"),
):
    asked(name, f"select o_orderkey, o_orderstatus, o_totalprice from orders where {where}", filters=[flt], **_ROWS)
asked("P10_is_not_null", "select o_orderstatus, count(*) as order_count from orders where nullif(o_orderstatus, 'P') is not null group by 1", metrics=["order_count"], dimensions=["orders.o_orderstatus"], filters=[Filter("orders.urgent_status", "is not null")])
asked(
    "P11_filters_are_anded", "select l_returnflag, count(*) as line_count from lineitem join part on l_partkey = p_partkey where l_quantity > 10 and p_size < 20 and l_linestatus <> 'O' group by 1",
    metrics=["line_count"], dimensions=["lineitem.l_returnflag"], filters=[Filter("lineitem.l_quantity", ">", 10), Filter("part.p_size", "<", 20), Filter("lineitem.l_linestatus", "<>", "O")],
)
asked(
    "A01_measures", "select l_returnflag, round(sum(l_quantity), 2) as q, min(l_extendedprice) as lo, max(l_extendedprice) as hi, count(l_quantity) as n from (select l_returnflag, l_quantity, l_extendedprice from lineitem) group by 1",
    measures=[Measure("lineitem.l_quantity", "sum", "q"), Measure("lineitem.l_extendedprice", "min", "lo"), Measure("lineitem.l_extendedprice", "max", "hi"), Measure("lineitem.l_quantity", "count", "n")], dimensions=["lineitem.l_returnflag"],
)
asked("A02_count_distinct", "select o_orderstatus, count(distinct o_custkey) as customers from orders group by 1", measures=[Measure("orders.o_custkey", "count_distinct", "customers")], dimensions=["orders.o_orderstatus"])
asked("A03_additive_metrics", "select cast(year(l_shipdate) as int) as ship_year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(sum(l_quantity), 2) as quantity, count(*) as line_count from lineitem group by 1", metrics=["revenue", "quantity", "line_count"], dimensions=["lineitem.ship_year"])
asked(
    "A04_ratio_metrics", "select p_brand, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) as discount_share, round(sum(case when l_returnflag = 'R' then l_quantity else 0 end) / nullif(sum(l_quantity), 0), 6) as return_share from lineitem join part on l_partkey = p_partkey group by 1",
    metrics=["discount_share", "return_share"], dimensions=["part.p_brand"],
)
asked("A05_group_by_several", "select l_returnflag, l_linestatus, count(*) as line_count from lineitem group by 1, 2", metrics=["line_count"], dimensions=["lineitem.l_returnflag", "lineitem.l_linestatus"])
asked("A06_global_aggregate", "select count(*) as order_count, round(sum(o_totalprice), 2) as order_value from orders", metrics=["order_count", "order_value"])
asked("A07_dimensions_keep_duplicates", "select o_orderstatus from orders", dimensions=["orders.o_orderstatus"])
asked("T01_order_by_several", "select p_brand, p_size, count(*) as line_count from lineitem join part on l_partkey = p_partkey group by 1, 2 order by line_count desc, p_brand, p_size limit 25", metrics=["line_count"], dimensions=["part.p_brand", "part.p_size"], order_by=["-line_count", "p_brand", "p_size"], limit=25)
asked("T02_limit_zero_is_none", "select s_name from supplier", dimensions=["supplier.s_name"], limit=0)


@query("M04_describe_model")
def describe_model(t):
    return t.spark.createDataFrame(MODEL.describe(), "kind string, dataset string, name string, expression string")


@query("M02_model_problems", "select * from (select '' as problem) where false")
def model_problems(t):
    return t.spark.createDataFrame([(p,) for p in MODEL.problems()], "problem string")
