"""Eligibility predicates, searches, detail counts and the newest row of a key pair."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from ..operators import latest as L
from .registry import query

PHRASES = ("widget", "cold", "large")


@query("P14_any_substring", "select p_partkey, p_name from part where " + " or ".join(f"lower(p_name) like '%{x}%'" for x in PHRASES))
def any_substring(t):
    return t.part.where(reduce(or_, [F.lower("p_name").contains(x) for x in PHRASES])).select("p_partkey", "p_name")


@query("P15_low_stock", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity is not null and l_quantity < 5")
def low_stock(t):
    return t.lineitem.where("l_quantity is not null and l_quantity < 5").select("l_orderkey", "l_linenumber", "l_quantity")


@query("P20_search_columns", "select p_partkey from part where contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'widget brand#1')")
def search_columns(t):
    return t.part.where(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("widget brand#1")).select("p_partkey")


@query("J08_low_stock_facts", "select l_orderkey, l_linenumber, l_quantity, p_brand, s_name, o_orderpriority from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey where l_quantity < 5")
def low_stock_facts(t):
    lines = t.lineitem.where("l_quantity < 5")
    joined = lines.join(t.part, F.expr("p_partkey = l_partkey")).join(t.supplier, F.expr("s_suppkey = l_suppkey")).join(t.orders, F.expr("o_orderkey = l_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_quantity", "p_brand", "s_name", "o_orderpriority")


@query("W05_latest_of_pair", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def latest_of_pair(t):
    return L.latest(t.events, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


@query("A43_detail_counts", "select 'status' as kind, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'priority', o_orderpriority, count(*) from orders group by 2")
def detail_counts(t):
    both = F.explode(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")).alias("kind", "value")
    return t.orders.select(both).groupBy("kind", "value").agg(F.count("*").alias("n"))
