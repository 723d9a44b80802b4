"""Operator 2: quality by the likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Words and word pairs of every text are hashed into `BUCKETS` buckets. The raw multinomial counts all documents;
the target multinomial counts trusted ones: all rows whose doc_id has a label of quality 1. A document's score is the sum over its n-grams of
log(target / raw), over their number plus NEUTRAL; it is kept if the score reaches `threshold` and no base rule fails. Nothing is
drawn at random. The bucket table has a fixed size, so collecting and sending it is bounded for any corpus.

Nulls: a null text has no words and fails the base rules; null doc_ids are never trusted. Repeated rows each count
and each give a row. Without a trusted document the target equals the raw corpus and scores are 0. Empty table:
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, offsets, slices
from .textstats import IS_SYMBOL, Texts, per_text

BUCKETS = 1 << 16
#: Scores under this are rejected. At 0 a text is as likely under the target as under the raw corpus.
THRESHOLD = -0.06
#: Neutral n-grams added to a text's own when its score is normalised by length: a few odd words don't condemn a short text.
NEUTRAL = 32
#: Added to each bucket's count, as parts of a uniform count.
SMOOTHING = 4.0
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and word pair."""
    at, pairs = texts.grams(2)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate((texts.row, texts.row[at])), np.concatenate((texts.words, pairs)) >> shift


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text) with trusted: whether the doc_id has a label of quality 1. Repeated rows stay, each once."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # merged at any size: a broadcast of the ids would only do for small tables
    return docs.join(ids.withColumn("trusted", F.lit(True)).hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))


def bucket_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all documents and over the trusted ones."""

    def count(batches):
        raw, own = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                row, at = buckets(Texts(*offsets(part.column("text"))))
                raw += np.bincount(at.astype(np.int64), minlength=BUCKETS)
                inside = part.column("trusted").to_numpy(zero_copy_only=False)
                own += np.bincount(at[inside[row]].astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "raw": pa.array(raw[used]), "own": pa.array(own[used])})

    parts = docs.mapInArrow(count, "bucket int, raw long, own long")
    got = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).toPandas()  # BUCKETS rows at most
    raw, own = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got["bucket"]], own[got["bucket"]] = got["raw"], got["own"]
    return raw, own


def log_ratio(raw: np.ndarray, own: np.ndarray) -> np.ndarray:
    if not own.sum():
        return np.zeros(BUCKETS)
    # both are smoothed by the same prior, the raw corpus mixed with a uniform count
    prior = (raw + SMOOTHING) / (raw + SMOOTHING).sum()
    strength = SMOOTHING * BUCKETS
    p = (own + strength * prior) / (own.sum() + strength)
    return np.log(p / prior)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    ratio = log_ratio(*bucket_counts(marked(rows, labels)))

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = Texts(*offsets(part.column("text")))
            row, at = buckets(texts)
            n = np.bincount(row, minlength=texts.n)
            score = np.bincount(row, weights=ratio[at.astype(np.int64)], minlength=texts.n) / (n + NEUTRAL)
            again = texts.repeat_words()
            failed = (texts.n_words < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * texts.n_words)
            whole = lambda x: pa.array(np.asarray(x, np.int64))
            return pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "n_words": whole(texts.n_words), "word_chars": whole(texts.word_chars()), "n_symbols": whole(per_text(IS_SYMBOL[texts.body], texts.at)),
                 "n_dup_lines": whole(texts.dup_lines()[1]), "n_repeat_words": whole(again), "base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= threshold)), "score": pa.array(score)}
            )

        return step

    return map_slices(rows, make, SCHEMA)
