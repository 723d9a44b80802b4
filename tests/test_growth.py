"""Steps whose time, memory or shuffled bytes would outgrow their tables."""

from lodestar.operators import building as B
from lodestar.operators import mentions as M
from lodestar.operators import profile
from lodestar.operators import scoring as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_truth_edges_shuffle_no_hashes(spark):
    refs = spark.createDataFrame([(s, k, key, "n") for s in (2, 1, 1) for k, key in (("a", "1"), ("b", "2"), ("c", None), ("d", "9"))], "scenario long, kind string, key string, name string")
    edges = B.truth_edges(refs, spark.createDataFrame([("a", "AB", "b"), ("a", "AC", "c"), ("b", "BX", "x")], "source_kind string, predicate string, target_kind string"))
    assert sorted((r.predicate, r.scenario) for r in edges.collect()) == [("AB", 1), ("AC", 1)]
    assert "sha2" not in plan(edges).split("Aggregate", 1)[1].split("\n", 1)[1]
    evidence = spark.createDataFrame([(1, "p", "t"), (1, "p", "t"), (1, "q", "t"), (2, "p", "t"), (1, "p", "none")], "scenario long, artifact string, type string")
    claims, rows = B.truth_claims(edges, evidence, spark.createDataFrame([("t", "AB"), ("t", "AB"), ("u", "AC")], "type string, predicate string"))
    assert [(r.scenario, r.type) for r in claims.collect()] == [(1, "t")]
    assert sorted(r.artifact for r in rows.collect()) == ["p", "q"] and {r.claim for r in rows.collect()} == {r.claim for r in claims.collect()}


def test_typed_loads_meet_the_nodes_once_an_end(spark):
    nodes = {x: spark.createDataFrame([(f"{x}{i}",) for i in (1, 1, 2)], "id string") for x in "ab"}
    links = spark.createDataFrame([("a1", "b1"), ("a1", "b1"), ("a1", "b3"), ("a3", "b1"), (None, "b1"), ("a2", None), ("a2", "b2")], "x string, y string")
    got = B.loaded(nodes | {"links": links, "none": links.where("x is null")}, {"a": "id", "b": "id"}, [("L", "links", "x", "y"), ("R", "links", "y", "x"), ("N", "none", "x", "y"), ("S", "a", "id", "id")])
    assert sorted(map(tuple, got.collect())) == [("L", 2, 2), ("N", 0, 0), ("R", 2, 2), ("S", 2, 0)]
    assert plan(got).count("Join ") == 3


def test_values_are_counted_exactly_only_where_it_matters(spark, monkeypatch):
    tables = {"thing": spark.range(300).selectExpr("id thing_key", "'x' label"), "visit": spark.range(900).selectExpr("id visit_key", "id % 300 thing_key", "id % 250 user_id", "id note")}
    counted, stats = [], profile.column_stats
    monkeypatch.setattr(profile, "column_stats", lambda df, table, exact=False: (counted.append((table, df.columns)) if exact else None) or stats(df, table, exact))
    found = profile.candidates(profile.catalogue_of(tables, {"thing": "thing_key", "visit": "visit_key"}, exact=True))
    assert found == [("visit", "thing_key", "thing", "thing_key", 1.0, 300), ("visit", "user_id", "thing", "thing_key", 0.0, 300)]
    assert counted == [("visit", ["user_id"])]


def test_runs_have_as_many_tokens_as_keys(spark):
    words = M.dictionary(spark.createDataFrame([("c", "red hot lamp", 1), ("c", "red", 2)], "class string, surface string, instance long"))
    texts = spark.createDataFrame([(1, "A Red hot lamp, red.")], "id long, text string")
    assert sorted(tuple(r) for r in M.grams(texts, words).collect()) == [(1, 2, 5, "red"), (1, 2, 14, "red hot lamp"), (1, 16, 19, "red")]
    assert [r.surface for r in M.scanned(texts, words).orderBy("start_at").collect()] == ["red hot lamp", "red"]


def test_parts_grow_with_the_table(spark):
    rows = spark.range(1000).selectExpr("id % 90 k", "id v")
    parts = S.dealt(rows, "k", part_rows=50)
    assert parts.rdd.getNumPartitions() == 21 and S.dealt(rows.where("v < 0"), "k", part_rows=50).rdd.getNumPartitions() == 8
    grouped = parts.groupBy("k").agg({"v": "max"})
    assert grouped._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1 and grouped.count() == 90
