"""Grants, requests, references and sources on small tables."""

import pytest

from lodestar.operators import serving as S
from lodestar.sources.index import IndexStore


def test_grants(spark):
    """A grant without a model covers the organisation; one of a model covers neither others nor a request for none."""
    schema = "principal string, organisation string, {} string, model string"
    grants = spark.createDataFrame([("ann", "x", "reader", None), ("bob", "x", "reader", "m"), ("bob", "x", "reader", "m"), ("cy", "y", "writer", None)], schema.format("role"))
    asked = [("ann", "x", "read", "m"), ("ann", "x", "read", None), ("ann", "y", "read", "m"), ("ann", "x", "write", "m"), ("bob", "x", "read", "m"), ("bob", "x", "read", "n"), ("bob", "x", "read", None), ("cy", "y", "write", "m")]
    got = S.permitted(spark.createDataFrame(asked, schema.format("action")), grants, {"reader": ["read"], "writer": ["read", "write"]})
    assert {tuple(r)[:4] for r in got.collect() if r.allowed} == {asked[0], asked[1], asked[4], asked[7]}
    assert got.count() == len(asked)


def test_requests(spark):
    rows = [(1, "k", "a"), (2, "k", "a"), (3, "k", "b"), (4, "old", "z"), (5, "old", "y")]
    got = S.inserted(spark.createDataFrame(rows, "id long, key string, hash string"), spark.createDataFrame([("old", "z")], "key string, hash string"))
    assert [r.outcome for r in got.orderBy("id").collect()] == ["new", "existing", "conflict", "existing", "conflict"]


def test_one_reference(spark):
    references = spark.createDataFrame([(1, True), (2, True), (2, True), (3, False), (1, None)], "asset long, allows boolean")
    got = S.one_reference(spark.createDataFrame([(i,) for i in range(1, 5)], "asset long"), references)
    assert [r.authorised for r in got.orderBy("asset").collect()] == [True, False, False, False]


def test_newer_run_replaces_its_sources(spark):
    store = IndexStore.temporary(spark)
    rows = lambda *r: spark.createDataFrame(list(r), "id long, source string, run string")
    store.replace_sources("v", rows((1, "s", "a"), (2, "t", "a")))
    store.replace_sources("v", rows((3, "s", "b"), (4, "s", "b")))
    assert sorted((r.id, r.source, r.run) for r in store.read("v").collect()) == [(2, "t", "a"), (3, "s", "b"), (4, "s", "b")]
    with pytest.raises(ValueError):
        store.read("v", {"nothing": 1})
