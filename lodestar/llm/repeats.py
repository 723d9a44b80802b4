"""Operator 8: exact removal of repeated 100-byte strings, by sampled induced sorting.

Sorting every suffix of the corpus externally would write some five bytes for each byte of text several times over,
more than the disk allows (README). What is sorted here is a sample of suffixes from which the rest is induced:

* Sampling. Every 100-byte window picks one anchor inside it, by its content alone: the leftmost of its 32-byte
  grams with the smallest hash. Equal windows pick equal anchors at equal offsets, so repeats are found among
  suffixes at anchors, one in about 36.
* Sorting. A tuple (name of the anchor's gram, name of all that its windows cover, document, position) goes through
  Spark's spilling sort, the disk-backed queue; equal neighbours share a prefix as long as all those windows, so all
  but the first are repeats. A gram with one name is done.
* Recursion. The firsts of grams with several names agree only in part. Their windows are cut at fixed distances
  from the anchor into ranges of at most 8 and sorted again by their common core, then into single windows, whose
  common prefix of 100 bytes or not decides.

Equal tuples within a slice of texts are decided before the shuffle, so a passage in a third of all documents
reaches the sort once a slice. Names are 64-bit hashes (chance of a false match below 1e-6 at 10**7 names).

Nulls: a null text is empty; a null doc_id sorts before all ids. Rows that share a doc_id are told apart by their
texts' checksums; rows equal in both are one document and give equal rows. Texts under 100 bytes are kept whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, offsets, powers, prefix_hash, slices, span_hash, stored

WINDOW, GRAM, STEP = 100, 32, 8
#: Longer texts are sampled part by part; parts overlap by a window.
PART = 1 << 23
#: Bits of the filter that spares documents without repeats the shuffle of their texts; a fixed size for any corpus.
FILTER_BITS = 1 << 25
ROWS = "key long, full long, doc long, tie long, pos long, dup boolean"


def packed(a: np.ndarray, anchor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A range of window starts a..b and its anchor in one number that sorts by a."""
    return (a << 14) | ((anchor - a) << 7) | (b - a)


def unpacked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = pos >> 14
    return a, a + ((pos >> 7) & 127), a + (pos & 127)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    n = len(values)
    whole = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[:n] = values
    rows = whole.reshape(-1, width)
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    head = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def sampled(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, anchor, b, row, gram name, full name) of the ranges of window starts that share an anchor."""
    if len(body) < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    sums = prefix_hash(body)
    grams = np.arange(len(body) - GRAM + 1)
    hashes = span_hash(sums, grams, grams + GRAM)
    least = smallest((hashes & ~np.uint64((1 << 24) - 1)) | grams.astype(np.uint64), WINDOW - GRAM + 1)
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(len(least))
    row = np.searchsorted(at, start, "right") - 1
    inside = start + WINDOW <= at[row + 1]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    border = np.flatnonzero(new | ~inside)
    a = np.flatnonzero(new & inside)
    b = np.append(border[1:], len(start))[np.searchsorted(border, a)] - 1
    anchor, row = anchor[a], row[a]
    full = mixed(span_hash(sums, a, b + WINDOW) + packed(np.zeros_like(a), anchor - a, b - a).astype(np.uint64))
    return a - at[row], anchor - at[row], b - at[row], row, hashes[anchor], full


def settled(key: np.ndarray, full: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray, extra: dict | None = None) -> pa.RecordBatch:
    """Rows for the sort: of equal tuples within the batch all but the first are repeats, and scattered; rows met twice count once."""
    order = np.lexsort((pos, tie, doc, full, key))
    now, before = order[1:], order[:-1]
    same, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    same[now] = (key[now] == key[before]) & (full[now] == full[before])
    twice[now] = same[now] & (doc[now] == doc[before]) & (tie[now] == tie[before]) & (pos[now] == pos[before])
    key = np.where(same, mixed(full + pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + doc.astype(np.uint64)), key)
    columns = {"key": key.view(np.int64), "full": full.view(np.int64), "doc": doc, "tie": tie, "pos": pos, "dup": same} | (extra or {})
    out = pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    return out.filter(pa.array(~twice)) if twice.any() else out


def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(body, at, doc, tie, base) of slices of a batch; base: where a part of a long text begins in it."""
    for part in slices(batch, limit=1 << 21):
        body, at = offsets(part.column("text"))
        doc, tie = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
        if len(body) <= PART or len(part) > 1:
            yield body, at, doc, tie, 0
        else:
            for base in range(0, len(body) - WINDOW + 1, PART):
                piece = body[base : base + PART + WINDOW - 1]
                yield piece, np.array([0, len(piece)]), doc, tie, base


def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body, at, doc, tie, base in parts(batch):
            a, anchor, b, row, key, full = sampled(body, at)
            if len(a):
                yield settled(key, full, doc[row], tie[row], packed(a + base, anchor + base, b + base))


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From tuples in order: repeats, and firsts of grams with several names (dup false). One row is held back at most."""
    last = None  # key, full, doc, tie and pos of the row before
    alone = None  # the one first of the current key, while it is the only one
    for batch in batches:
        if not batch.num_rows:
            continue
        names = ("key", "full", "doc", "tie", "pos")
        every = [batch.column(c).to_numpy() for c in names]
        twice = np.append(last is not None and all(x[0] == y for x, y in zip(every, last)), np.all([x[1:] == x[:-1] for x in every], axis=0))
        if twice.any():
            batch = batch.filter(pa.array(~twice))
            if not batch.num_rows:
                continue
            every = [x[~twice] for x in every]
        key, full, dup = every[0], every[1], batch.column("dup").to_numpy(zero_copy_only=False)
        new_key, new_full = np.ones(len(key), bool), np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_full[1:] = new_key[1:] | (full[1:] != full[:-1])
        if last is not None:
            new_key[0] = key[0] != last[0]
            new_full[0] = new_key[0] or full[0] != last[1]
        first = new_full & ~dup
        # group number of each row; group 0 goes on from the batch before
        group = np.cumsum(new_key)
        several = np.bincount(group[first], minlength=group[-1] + 1)
        carried = last is not None and not new_key[0]
        if carried and several[0]:  # a second first: the one held back is open, too
            if alone is not None:
                yield alone
            alone, several[0] = None, 2
        if not carried or group[-1] > 0:  # the batch ends in a new key
            tail = np.flatnonzero(first & (group == group[-1]))
            alone = batch.slice(int(tail[0]), 1) if len(tail) == 1 else None
        out = ~first | (several[group] > 1)
        last = [x[-1] for x in every]
        marked = batch.set_column(batch.schema.get_field_index("dup"), "dup", pa.array(~first))
        if out.any():
            yield marked.filter(pa.array(out))


def sorted_out(rows: DataFrame, name: str, extra: str = "") -> DataFrame:
    ordered = rows.repartition("key").sortWithinPartitions("key", "full", "doc", "tie", "pos")
    return stored(ordered.mapInArrow(neighbours, ROWS + extra), name)


def ranges_of_eight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of firsts, cut at multiples of STEP before the anchor: named by core and content, with their bytes."""
    for batch in batches:
        for part in slices(batch):
            body, at = offsets(part.column("text"))
            lists = part.column("found")
            bounds = np.asarray(lists.offsets)
            pos = np.asarray(lists.values)[bounds[0] : bounds[-1]]
            row = np.repeat(np.arange(len(part)), np.diff(bounds))
            if not len(pos):
                continue
            a, anchor, b = unpacked(pos)
            # one range for each block of offsets (anchor - start) // STEP
            low, high = (anchor - b) // STEP, (anchor - a) // STEP
            n = high - low + 1
            i = np.repeat(np.arange(len(pos)), n)
            block = low[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            lo = np.maximum(a[i], anchor[i] - block * STEP - STEP + 1)
            hi = np.minimum(b[i], anchor[i] - block * STEP)
            anchor, row = anchor[i], row[i]
            sums, base = prefix_hash(body), at[row]
            core = span_hash(sums, base + anchor - block * STEP, base + anchor - block * STEP - STEP + 1 + WINDOW)
            key = mixed(core + block.astype(np.uint64))
            full = mixed(span_hash(sums, base + lo, base + hi + WINDOW) + packed(np.zeros_like(lo), anchor - lo, hi - lo).astype(np.uint64))
            raw = body.tobytes()
            held = pa.array([raw[x:y] for x, y in zip((base + lo).tolist(), (base + hi + WINDOW).tolist())], pa.binary())
            doc, tie = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "tie"))
            yield settled(key, full, doc, tie, packed(lo, anchor, hi), {"bytes": held})


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of firsts that the ranges of eight left open."""
    for batch in batches:
        if not batch.num_rows:
            continue
        body, at = offsets(batch.column("bytes"))
        a, _, b = unpacked(batch.column("pos").to_numpy(zero_copy_only=False))
        n = b - a + 1
        i = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        name = span_hash(prefix_hash(body), at[i] + k, at[i] + k + WINDOW)
        doc, tie = (batch.column(c).to_numpy(zero_copy_only=False)[i] for c in ("doc", "tie"))
        yield settled(name, name, doc, tie, packed(a[i] + k, a[i] + k, a[i] + k))


def filter_of(rows: DataFrame):
    """A broadcast bitmap of (doc, tie) hashes: FILTER_BITS bits, whatever the corpus."""
    at = F.pmod(F.xxhash64("doc", "tie"), F.lit(FILTER_BITS))
    words = rows.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return rows.sparkSession.sparkContext.broadcast(bits)


def passing(docs: DataFrame, chosen) -> DataFrame:
    """(doc_id, doc, tie, n_bytes, text, sha): text where the filter may have the document, else the digest of its text."""

    def run(batches):
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            hit = (chosen.value[at >> 6] >> (at & 63)) & 1 == 1
            texts = batch.column("text").to_pylist()
            raw = [t.encode() for t in texts]
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in ("doc_id", "doc", "tie")}
                | {"n_bytes": pa.array([len(r) for r in raw], pa.int64()), "text": pa.array([t if h else None for t, h in zip(texts, hit)], pa.string()), "sha": pa.array([None if h else hashlib.sha256(r).hexdigest() for r, h in zip(raw, hit)], pa.string())}
            )

    at = F.pmod(F.xxhash64("doc", "tie"), F.lit(FILTER_BITS)).alias("at")
    return docs.select("doc_id", "doc", "tie", "text", at).mapInArrow(run, "doc_id long, doc long, tie long, n_bytes long, text string, sha string")


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, n, text, sha, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "text", "sha", "found"))):
            removed = spans = 0
            if text is not None:
                raw = np.frombuffer(text.encode(), np.uint8)
                if found:
                    a, _, b = unpacked(np.array(found, np.int64))
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b + WINDOW, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    raw = raw[~gone]
                sha = hashlib.sha256(raw.tobytes()).hexdigest()
            out.append((doc_id, n, removed, spans, sha))
        ids, n, removed, spans, sha = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def repeats_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    powers(1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("tie", F.crc32(F.col("text").cast("binary")))
    first = sorted_out(rows.select("doc", "tie", "text").mapInArrow(tuples, ROWS), "anchors")
    open_ = first.where("not dup").groupBy("doc", "tie").agg(F.collect_list("pos").alias("found"))
    texts = passing(rows, filter_of(first.where("not dup"))).where("text is not null").select("doc", "tie", "text").dropDuplicates(["doc", "tie"])
    second = sorted_out(texts.join(open_, ["doc", "tie"]).mapInArrow(ranges_of_eight, ROWS + ", bytes binary"), "ranges", ", bytes binary")
    third = sorted_out(second.where("not dup").mapInArrow(windows, ROWS), "windows")
    repeats = first.where("dup").select("doc", "tie", "pos").union(second.where("dup").select("doc", "tie", "pos")).union(third.where("dup").select("doc", "tie", "pos"))
    base = passing(rows, filter_of(repeats))
    found = repeats.groupBy("doc", "tie").agg(F.collect_list("pos").alias("found"))
    return base.join(found, ["doc", "tie"], "left").select("doc_id", "n_bytes", "text", "sha", "found").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
