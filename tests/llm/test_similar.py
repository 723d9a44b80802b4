"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import random

from corpus_pipeline import near_duplicates
from lodestar.llm import similar

from . import plain


def shingles(text):
    words = plain.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """The first (doc_id, text) of each component of pairs at 0.8 or more."""
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [r for i, r in enumerate(rows) if find(i) == i]


def edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_go(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    texts = [None, "", " \n", "a b c", "A  b\nc", "a b c d", "a b c e", "one", "one two"]
    for n in (40, 120, 300):
        for _ in range(4):
            base = prose(n)
            # copies on both sides of 0.8, of each other too, and a chain of copies of copies
            texts += [base, base.upper(), *[edited(rng, base, k) for k in range(1, n // 25 + 1)], base + " " + prose(n // 8), base + " " + prose(n // 3)]
            chain = base
            for _ in range(6):
                texts.append(chain := edited(rng, chain, max(1, n // 60)))
    base = prose(200)
    texts += [edited(rng, base, rng.randrange(1, 9)) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = kept(rows)
    assert 20 < len(want) < len(rows) / 2
    assert plain.as_rows(near_duplicates(spark, docs, ""), "doc_id", "text") == sorted(want, key=plain.key)


def test_pairs_among_many_unlike_sets_are_found(spark):
    """All share most shingles at some 0.76; twins, at 0.81, share hardly a bucket with few others."""
    common = " ".join(f"c{i}" for i in range(104))
    rows = [(2 * k + i, f"{common} " + " ".join([f"t{k}x{j}" for j in range(4)] + [f"o{k}x{i}x{j}" for j in range(12)])) for k in range(60) for i in (0, 1)]
    assert [r[0] for r in kept(rows)] == list(range(0, 120, 2))
    got = similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 120, 2))


def test_rare_shingles_lose_no_similar_pair(spark):
    rng = random.Random(8)
    groups = [rng.sample(range(4000), 120) for _ in range(12)]
    sets = [sorted({*rng.sample(g, rng.randrange(90, 121)), *rng.sample(range(4000, 9000), rng.randrange(12))}) for g in groups for _ in range(12)] + [[1], [1], [2], [2, 3]]
    names = spark.createDataFrame([(k, k) for k in range(len(sets))], "name long, root long")
    found = {tuple(r) for r in similar.sharing_rare(names, spark.createDataFrame(list(enumerate(sets)), "name long, values array<long>")).collect()}
    want = {(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if 9 * len({*x} & {*y}) >= 4 * (len(x) + len(y))}
    assert len(want) > 100 and want <= found


def test_shared_docs(docs, none):
    rows = plain.as_rows(docs, "doc_id", "text")
    assert similar.one_of_each(docs).count() == len(kept(rows))
    assert similar.one_of_each(none).isEmpty() and similar.one_of_each(none).columns == none.columns
