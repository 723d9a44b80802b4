"""Segments, passages, allocation, versions and metrics on rows made for their edges: nulls, blanks, ties, nothing at all."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import building as B
from lodestar.operators import profile
from lodestar.plans.semantic import Relationship, RequestError, SemanticModel


def test_assets_of_every_status(spark):
    rows = [
        (1, "message/rfc822", "Subject: a\nFrom: x@y.example\n\nbody\n\nmore"), (2, "message/rfc822", "no headers"), (3, "application/json", '{"messages": [{"role": "u", "text": "hi"}, {"text": null}]}'),
        (4, "application/json", '{"rows": 1}'), (5, None, "text"), (6, "text/plain", None), (7, "text/plain", ""), (8, "text/plain", "one\n\n \n\ntwo"), (9, "application/pdf", "%PDF-1"), (10, "application/json", '{"messages": []}'),
    ]
    got = {r["id"]: (r["status"], [s["text"] for s in r["segments"]]) for r in B.analysed(spark.createDataFrame(rows, "id long, mime string, data string")).collect()}
    bad, unread = ("type_mismatch", []), ("unsupported", [])
    assert got == {1: ("ok", ["a", "x@y.example", "body\n\nmore"]), 2: bad, 3: ("ok", ["hi"]), 4: bad, 5: unread, 6: bad, 7: bad, 8: ("ok", ["one", "two"]), 9: unread, 10: ("ok", [])}


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 8, 9, 10, 12, 13, 31])
def test_chat_windows_leave_out_what_is_not_new(spark, n):
    rows = [("a", i, "message", f"m{i}", None) for i in range(n)] + [("a", 900, "message", "  ", "u"), ("a", 901, "message", None, "u")]
    got = sorted(B.passages(spark.createDataFrame(rows, "asset string, ordinal long, type string, text string, speaker string")).select("ordinal", "text").collect())
    want = [range(s, min(s + 6, n)) for s in range(0, max(n, 1), 3) if n and (s == 0 or n - s > 3)]
    assert [tuple(r) for r in got] == [(w[0], "\n".join(f"m{i}" for i in w)) for w in want]


def test_mail_without_subject_sender_or_body(spark):
    rows = [("s", 0, "email_subject", "only", None), ("b", 2, "email_body", "x", None), ("b", 3, "email_body", "y", None), ("h", 1, "email_header", "nobody", None), ("p", 0, "page", " text ", None)]
    got = {r["asset"]: (r["ordinal"], r["type"], r["text"]) for r in B.passages(spark.createDataFrame(rows, "asset string, ordinal long, type string, text string, speaker string")).collect()}
    assert got == {"s": (0, "email", "Subject: only"), "b": (2, "email", "x\n\ny"), "p": (0, "page", "text")}


def test_allocation_gives_every_target_out(spark):
    targets = spark.createDataFrame([("a", 10), ("b", 1), ("c", 0), ("d", 5)], "artifact string, n long")
    weights = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1), ("none", 0)], "scenario string, weight long")
    supports = spark.createDataFrame([("a", s) for s in "xyz"] + [("b", "y"), ("b", "z"), ("d", "none"), ("a", "x")], "artifact string, scenario string")
    got = {(r["artifact"], r["scenario"]): r["n"] for r in B.allocated(targets, weights, supports).collect()}
    assert got == {("a", "x"): 4, ("a", "y"): 3, ("a", "z"): 3, ("b", "y"): 1, ("d", None): 5}


def test_versions_in_any_order_and_by_force(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "b", 2), (1, "b", 2)], "version long, key string, x long")
    state = B.content_hash(rows.orderBy(F.desc("key"))).withColumn("complete", F.lit(True))
    for force, status in ((False, "unchanged"), (True, "replaced")):
        told, after = B.materialised(rows, rows.distinct(), state, force)
        assert [r["status"] for r in told.collect()] == [status]
        assert after.count() == 2


def test_nothing_at_all(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert B.analysed(none("id long, mime string, data string")).count() == 0
    assert B.passages(none("asset string, ordinal long, type string, text string, speaker string")).count() == 0
    assert B.allocated(none("artifact string, n long"), none("scenario string, weight long"), none("artifact string, scenario string")).count() == 0
    assert B.checked_metrics(none("position long, name string, dataset string, expression string"), none("dataset string, column string")).count() == 0
    assert B.truth_edges(none("scenario long, kind string, key string, name string"), none("source_kind string, predicate string, target_kind string")).count() == 0


def test_candidates_are_held_to_a_number_and_a_type():
    rows = [("fact", f"x{i}_id", "bigint", 100, 10, False) for i in range(30)] + [(f"dim{i}", "thing_sk", "int", 50, 50, True) for i in range(20)] + [("text", "thing_sk", "string", 50, 50, True)]
    found = profile.candidates(rows)
    assert len(found) == 400 and {x[4] for x in found} == {0.0} and "text" not in {x[2] for x in found}
    named = profile.candidates([("fact", "f_thing_sk", "int", 9, 9, False), *[(f"dim{i}", "d_thing_sk", "int", 50 - i, 50 - i, True) for i in range(9)]])
    assert [(x[2], x[4]) for x in named] == [("dim8", 1.0), ("dim7", 1.0), ("dim6", 1.0)]


def test_a_declared_default_gives_way_to_a_pin_alone():
    ways = [Relationship("a", "f", "d", (("x", "k"),)), Relationship("b", "f", "d", (("y", "k"),), default=True)]
    model = SemanticModel(["f", "d"], [], [], ways)
    assert [r.name for r, _ in model.join_path("f", "d")] == ["b"]
    assert [r.name for r, _ in model.join_path("f", "d", {"d": "a"})] == ["a"]
    assert SemanticModel(["f", "d"], [], [], ways[:1]).join_path("f", "d")[0][0].name == "a"
    with pytest.raises(RequestError):
        model.join_path("f", "d", {"d": "none"})
