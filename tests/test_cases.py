"""The reading chain on small tables: cases over chains of dates, single entities, deciding rows, reasons."""

import datetime

from lodestar.operators import cases as C
from lodestar.operators import graph as G


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_cases(spark):
    """Weak identifiers link along dates, whole chains of them; hubs and far dates don't; strong ones always do."""
    weak = [(i, "phone", "1", False) for i in range(6)] + [(i, "phone", "2", False) for i in range(6, 9)] + [(i, "phone", "hub", False) for i in range(20, 29)]
    strong = [(i, "order", "7", True) for i in (8, 10, 11, 11)]
    dates = [(i, day(i * 5)) for i in range(6)] + [(6, day(0)), (7, day(100)), (8, day(104))] + [(i, day(0)) for i in range(20, 29)]
    edges = C.case_edges(spark.createDataFrame(weak + strong, "asset long, name string, value string, strong boolean"), spark.createDataFrame(dates, "asset long, day date"), 5, 8)
    ids = [*range(12), *range(20, 29)]
    got = {r.id: r.component for r in G.components(edges, spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    want = {i: i for i in ids} | {i: 0 for i in range(6)} | {7: 7, 8: 7, 10: 7, 11: 7}
    assert got == want


def test_single(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k long, v string")
    assert sorted((r.k, r.one) for r in C.single(rows, ["k"], "v", "one").collect()) == [(1, "a"), (2, None)]


def test_contextual_stops_at_an_ambiguous_asset(spark):
    """Several instances in the asset: the cluster's only one of another asset doesn't help."""
    phrases = spark.createDataFrame([("a1", "c", "part"), ("a2", "c", "part"), ("a3", "d", "part")], "asset string, cluster string, class string")
    links = spark.createDataFrame([("a1", "c", "part", 1), ("a1", "c", "part", 2), ("a4", "d", "part", 3)], "asset string, cluster string, class string, instance int")
    assert [(r.asset, r.target) for r in C.contextual(phrases, links).collect()] == [("a3", 3)]


def test_decided(spark):
    """One row; several settled by one date; two that agree; more than the limit; none."""
    rows = [(1, 1, day(0)), (2, 1, day(0)), (2, 2, day(1)), (3, 1, day(0)), (3, 2, day(0))] + [(4, i, day(i)) for i in range(5)]
    dates = [(2, day(1)), (2, day(1)), (3, day(0)), (4, day(2))]
    got = C.decided(spark.createDataFrame(rows, "cluster long, row long, day date"), spark.createDataFrame(dates, "cluster long, day date"), 3)
    assert sorted((r.cluster, r.row) for r in got.collect()) == [(1, 1), (2, 2)]


def test_strength():
    assert [C.strength(p, ("refund",)) for p in ("a b c", "Status:", "late * carrier", "two words", "refund", "late")] == ["strong"] * 3 + ["medium", "weak", "medium"]


def test_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    assert C.about(empty("asset long, target string, class string, titled boolean"), empty("asset long, entity string"), ["x"]).count() == 0
    assert C.mapping_for(empty("mapping string, version string, active boolean"), "v1").count() == 0
    assert C.constraints(empty("cluster long, class string, instance long, tier string")).count() == 0
