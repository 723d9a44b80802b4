"""A semantic model of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .semantic import Field, Metric, Relationship, SemanticModel

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _fields(dataset: str, **kinds: str) -> list[Field]:
    return [Field(dataset, name, name, kind) for name, kind in kinds.items()]


def _edge(many: str, one: str, *on: tuple[str, str]) -> Relationship:
    return Relationship(f"{many}__{on[0][0]}__{one}", many, one, on)


FIELDS = [
    *_fields("region", r_regionkey="integer", r_name="string"),
    *_fields("nation", n_nationkey="integer", n_name="string"),
    *_fields("customer", c_custkey="integer", c_name="string", c_mktsegment="string", c_acctbal="number"),
    *_fields("supplier", s_suppkey="integer", s_name="string"),
    *_fields("part", p_partkey="integer", p_name="string", p_brand="string", p_type="string", p_size="integer"),
    *_fields("orders", o_orderkey="integer", o_custkey="integer", o_orderstatus="string", o_totalprice="number", o_orderpriority="string"),
    *_fields("lineitem", l_orderkey="integer", l_quantity="number", l_extendedprice="number", l_returnflag="string", l_linestatus="string", l_shipdate="timestamp"),
    Field("orders", "order_date", "cast(o_orderdate as date)", "date"),
    Field("orders", "order_year", "year(o_orderdate)", "integer"),
    Field("orders", "urgent_status", "nullif(o_orderstatus, 'P')", "string"),
    Field("lineitem", "ship_year", "year(l_shipdate)", "integer"),
    Field("part", "brand_family", "substr(p_brand, 1, 7)", "string"),
]
METRICS = [
    Metric("revenue", "lineitem", "round(sum(l_extendedprice * (1 - l_discount)), 2)"),
    Metric("charge", "lineitem", "round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2)"),
    Metric("quantity", "lineitem", "round(sum(l_quantity), 2)"),
    Metric("line_count", "lineitem", "count(*)"),
    Metric("discount_share", "lineitem", "round(try_divide(sum(l_extendedprice * l_discount), sum(l_extendedprice)), 6)"),
    Metric("return_share", "lineitem", "round(try_divide(sum(case when l_returnflag = 'R' then l_quantity else 0 end), sum(l_quantity)), 6)"),
    Metric("order_count", "orders", "count(*)"),
    Metric("order_value", "orders", "round(sum(o_totalprice), 2)"),
]
RELATIONSHIPS = [
    _edge("nation", "region", ("n_regionkey", "r_regionkey")), _edge("customer", "nation", ("c_nationkey", "n_nationkey")), _edge("supplier", "nation", ("s_nationkey", "n_nationkey")), _edge("orders", "customer", ("o_custkey", "c_custkey")),
    _edge("lineitem", "orders", ("l_orderkey", "o_orderkey")), _edge("lineitem", "part", ("l_partkey", "p_partkey")), _edge("lineitem", "supplier", ("l_suppkey", "s_suppkey")),
]
MODEL = SemanticModel(TABLES, FIELDS, METRICS, RELATIONSHIPS)
