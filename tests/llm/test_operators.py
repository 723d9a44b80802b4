"""Each operator against its plain version, an exact round trip, or held-out accuracy."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, gam, grammar, media, mixing, pseudonyms, ratio, repeats, simhash, transducer

from . import plain

JSON, RANKS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_repair_shards(docs, rows):
    got = plain.as_rows(grammar.written_and_read(docs, JSON), "start", "doc_id", "n_tokens", "ids_crc32")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((start, r[0], len(ids), zlib.crc32(plain.id_digest(ids))))
        start += len(ids)
    assert got == sorted(want, key=plain.key)


def test_repair_random_access():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.tile([5, 6, 7, 8], 400), rng.integers(1, 50, 900), np.full(77, 9)]).astype(np.uint16)
    lengths = np.array([1000, 1, len(ids) - 1001])
    shard = grammar.Shard(grammar.pack(np.array([1, 2, 3]), np.array([True, True, False]), lengths, ids, 50257))
    assert len(shard.rules) and len(shard.symbols) < len(ids) and (shard.ids() == ids).all()
    for lo, hi in ((0, 1), (3, 9), (990, 1010), (len(ids) - 5, len(ids)), (0, len(ids))):
        assert (shard.ids_between(lo, hi) == ids[lo:hi]).all()


def test_ratio_base_rules(docs, rows, labels):
    got = plain.as_rows(ratio.judged(docs, labels), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((r[0], *plain.base_rules(r[1])) for r in rows), key=plain.key)


def test_ratio_verdict(docs, labels):
    judged = ratio.judged(docs, labels).toPandas()
    assert (judged.kept == (~judged.base_failed & (judged.score >= ratio.THRESHOLD))).all()
    again = ratio.judged(docs.repartition(7), labels).toPandas()
    assert sorted(judged.score) == pytest.approx(sorted(again.score))


def test_ratio_prefers_the_target():
    raw, own = np.full(ratio.BUCKETS, 10.0), np.full(ratio.BUCKETS, 10.0)
    own[5], own[6] = 90, 0
    r = ratio.log_ratio(raw, own)
    assert r[5] > 0 > r[6]
    assert not ratio.log_ratio(raw, np.zeros(ratio.BUCKETS)).any()


def test_gam_on_held_out_rows(spark, docs):
    good = [(i, "The council met on Tuesday and agreed to repair the old bridge before winter. " * 6 + f"Item {i}.", 1) for i in range(0, 400, 2)]
    bad = [(i, f"BUY NOW!!! $$$ {i} *** CLICK >>> " * 9, 0) for i in range(1, 400, 2)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    got = gam.classified(table, table.select("doc_id", "quality")).join(table.select("doc_id", "quality"), "doc_id").toPandas()
    held = got[got.held_out]
    assert list(got.held_out) == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert len(held) > 60 and (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()
    flipped = table.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert gam.classified(table, flipped.select("doc_id", "quality")).toPandas().set_index("doc_id").score.equals(gam.classified(table, table.select("doc_id", "quality")).toPandas().set_index("doc_id").score)


def test_gam_every_row_scored(docs, rows, labels):
    got = gam.classified(docs, labels).toPandas()
    assert len(got) == len(rows) and got.score.notna().all() and (got.predicted == (got.score >= 0.5)).all()
    kept = gam.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == int(got.predicted.sum())


def test_transducer_counts(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = plain.as_rows(transducer.count_tokens(docs, PIECES), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in rows), key=plain.key)


def test_mix(docs, rows):
    got = mixing.curriculum(docs).toPandas()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(plain.WORD.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names])))
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    for s in names:
        part = got[got.source.isna()] if s is None else got[got.source == s]
        assert set(part.source_size) == {sizes[s]} and part.target.iloc[0] == pytest.approx(goal[s])
        assert abs(part.taken.sum() - goal[s]) <= part["size"].max()
    rerun = mixing.curriculum(docs.repartition(5)).toPandas()
    assert sorted(zip(got.doc_id.fillna(-9), got["size"], got.taken)) == sorted(zip(rerun.doc_id.fillna(-9), rerun["size"], rerun.taken))
    assert [len(p) for p in got.positions] == list(got.passes)


def demanded(slope, t, steps=4000):
    """The share of a source's target that training asks for by t: its schedule, summed in small steps."""
    w = 1 + slope * (2 * (np.arange(steps) + 0.5) / steps - 1)
    return w[: round(t * steps)].sum() / w.sum()


@pytest.mark.parametrize("bucket_rows", [1, 3, 2000])
def test_mix_positions(docs, monkeypatch, bucket_rows):
    """Each document's time is when the demand, summed in small steps, reaches its middle of the line; stretches tile the line."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(mixing, "GROUP", 4)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 1)
    line = mixing.lines(docs, mixing.WEIGHTS, mixing.SLOPES, mixing.MOST).toPandas()
    ends = {}
    for r in line.sort_values(["begin", "size"]).itertuples():
        name = r.source or ""
        assert r.begin == ends.get(name, 0)
        ends[name] = r.begin + r.size * r.copies
        assert ends[name] <= r.source_size
    assert all(ends[r.source or ""] == r.source_size for r in line.itertuples())
    middle = {(r.doc_id, r.mark): [r.begin + (j + 0.5) * r.size for j in range(r.copies)] for r in line.itertuples() if r.copies == 1}
    slope = {r.source or "": r.slope for r in line.itertuples()}
    seen = 0
    for r in mixing.curriculum(docs).collect():
        if r["size"] and (r.doc_id, r.mark) in middle:
            (m,) = middle[r.doc_id, r.mark]
            want = [m + k * r.source_size for k in range(3) if m + k * r.source_size <= r.target]
            assert [demanded(slope[r.source or ""], t) * r.target for t in r.positions] == pytest.approx(want, abs=r.target / 500)
            seen += len(want)
    assert seen > 30


def test_mix_of_many_equal_rows(spark):
    """A third of all rows alike in id and text: the replay takes each as planned, in time that grows with their number."""
    rows = [(None, "one two", "web", "en")] * 4000 + [(None, "one two", "web", "de")] * 50 + [(i, f"text {i} of the books", "books", "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    plan = mixing.curriculum(docs)
    assert plan.count() == len(rows)
    got = {r.source: r.n for r in mixing.mixed_rows(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got == {r.source: r.n for r in plan.groupBy("source").agg(F.sum("passes").alias("n")).collect()}


def test_mix_targets():
    assert mixing.targets([100, 100, 100], (5, 2, 1)) == pytest.approx([187.5, 75, 37.5])
    capped = mixing.targets([10, 1000, 1000], (5, 2, 1))
    assert capped[0] == 30 and sum(capped) == pytest.approx(2010) and capped[1] == pytest.approx(2 * capped[2])


def test_mixed_rows(docs):
    plan = mixing.curriculum(docs).agg(F.sum("passes")).first()[0]
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.count() == plan and out.exceptAll(docs.unionAll(docs).unionAll(docs)).isEmpty()


def test_media_archive(docs, rows):
    got = media.stored_and_read(docs)
    assert plain.as_rows(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(((r[0], *plain.payload(r[1])) for r in rows), key=plain.key)
    assert got.groupBy("payload_sha256", "n_bytes").agg(F.count_distinct("media_sha256", "media_bytes", "feature").alias("k")).where("k <> 1").isEmpty()


def test_repeated_strings(docs, rows):
    """Rows equal in id and text are one document, and give equal rows."""
    once = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = {(w[0], w[1], w[4]): w for w in plain.removed(once)}
    first = {(i, len((t or "").encode())): w for (i, t), w in zip(once, want.values())}
    got = plain.as_rows(repeats.repeats_removed(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted((first[r[0], len((r[1] or "").encode())] for r in rows), key=plain.key)


def test_simhash_fingerprints(docs, rows):
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    prints = [(r[0], plain.fingerprint(r[1])) for r in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, plain.groups(prints))), key=plain.key)
    assert plain.as_rows(got, "doc_id", "f", "component_id") == want


@pytest.mark.parametrize("shard_rows", [20_000, 100, 8])
def test_simhash_links_are_exact(spark, shard_rows):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 250, dtype=np.uint64)
    base[:150] = (base[:150] & np.uint64(0xFFFFFFFFFF000000)) | np.uint64(0xABCDE)  # a crowded block
    flips = [base]
    for _ in range(3):
        flips.append(base ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)))
    fps = np.unique(np.concatenate(flips))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.fp: r.root for r in simhash.components(simhash.links(table, shard_rows=shard_rows)).collect()}
    got = defaultdict(set)
    for x in fps.view(np.int64).tolist():
        got[roots.get(x, x)].add(x)
    want = defaultdict(set)
    for x, c in zip(fps.view(np.int64).tolist(), plain.groups(list(enumerate(fps.tolist())))):
        want[c].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_bpe_round_trip(docs, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = plain.as_rows(bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(ids := library.encode_ordinary(r[1] or "")), sha(plain.id_digest(ids)), sha((r[1] or "").encode())) for r in rows]
    assert got == sorted(want, key=plain.key)


def test_empty_tables(none, labels):
    for df in (
        grammar.written_and_read(none, JSON), ratio.judged(none, labels), gam.classified(none, labels), gam.accepted(none, labels), pseudonyms.pseudonym_rows(none, 'k'), pseudonyms.pseudonymised(none, 'k'), transducer.count_tokens(none, PIECES), mixing.curriculum(none),
        mixing.mixed_rows(none), media.stored_and_read(none), repeats.repeats_removed(none), simhash.near_duplicates(none), bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN),
    ):
        assert df.isEmpty()


def test_gam_sample_is_the_same_in_any_order(spark):
    """Ids with many different rows: the bounded sample doesn't depend on how rows lie."""
    rows = [(i % 40, f"word{i} " * (i % 23 + 1) + "!" * (i % 5)) for i in range(900)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    score = lambda d: sorted((r.doc_id, r.score) for r in gam.classified(d, labels, fit_rows=60).collect())
    assert score(docs.repartition(1)) == score(docs.repartition(6)) == score(docs.orderBy(F.desc("text")))


def test_gam_with_labels_of_one_class_or_none(docs, rows, spark):
    for marks, share in (([(r[0], 1) for r in rows if r[0] is not None], 0.999), ([], 0.5)):
        got = gam.classified(docs, spark.createDataFrame(marks, "doc_id long, quality int")).toPandas()
        assert len(got) == len(rows) and got.score.tolist() == pytest.approx([share] * len(rows))


def test_gam_on_the_tables(spark):
    """Held-out rows of the synthetic tables, against always saying 1."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = gam.classified(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert len(held) > 50 and (held.predicted == held.quality).mean() > max(0.97, held.quality.mean())
