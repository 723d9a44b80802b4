"""Candidates of names that many rows share."""

from lodestar.operators import mentions as M


def test_shared_names(spark):
    sizes = {"lone wolf": 1, "red lamp": 15, "grey hat": 20, "blue cup": 25}
    forms = spark.createDataFrame([("thing", name, 100 * k + i) for k, (name, n) in enumerate(sizes.items()) for i in range(n)], "class string, surface string, instance long")
    texts = spark.createDataFrame([(k, f"The {name} here.") for k, name in enumerate(sizes)], "id long, text string")
    found, all_ = M.scanned(texts, M.dictionary(forms)), M.instances(forms)
    want = lambda most: sorted((k, 100 * k + i, 1 / n) for k, n in enumerate(sizes.values()) if n <= most for i in range(n))
    rows = lambda df: sorted((r.id, r.instance, r.score) for r in df.collect())
    assert rows(M.candidates(found, all_)) == want(20)
    assert rows(M.candidates(found, all_, None)) == want(25)
    links = sorted((r.id, r.instance, r.link) for r in M.links(M.candidates(found, all_)).collect())
    assert links == [(0, 0, "SameAs")] + [(k, 100 * k + i, "PossiblySameAs") for k in (1, 2) for i in range(3)]


def test_places_in_code_points(spark):
    """Accented and wide letters are in words; places count code points, whatever lies between tokens."""
    text = "  Zoë  Müller-Lüdenscheid,\t東京 café!! 😀 naïve\u00a0x@y.z "
    got = [(r.start_at, r.run[0]) for r in M.placed(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")).orderBy("start_at").collect()]
    assert [w for _, w in got] == ["Zoë", "Müller-Lüdenscheid", ",", "東京", "café", "!", "!", "😀", "naïve", "x@y.z"]
    assert all(text[at : at + len(w)] == w for at, w in got)
