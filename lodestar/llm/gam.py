"""Operator 3: a quality classifier, as a generalised additive model with pairwise interactions.

Every text is reduced to `FEATURES`. Each feature is cut into quantile bins; cyclic boosting visits the features in
turn and adds a shrunken shallow tree over the feature's bins to its lookup table, round after round, so a table is
a sum of trees on one feature. The pairs that explain most of what is left get two-dimensional tables, boosted the
same way. A score is the logistic of a sum of table entries: one vectorised gather for each table.

Fitting takes a bounded sample of labelled rows: at most `fit_rows` ids, first by hash, ids with crc32(id) mod 3 = 1
held out, and of their rows with different features at most `fit_rows`, again first by hash. Features and scores cover
all documents. The model is a few thousand numbers.

Nulls: a null text is empty and is scored; rows without a doc_id are scored and never used to learn; null labels are
ignored; of several labels of an id the smallest counts. Without labels of both kinds every score is the share of 1
among them (0.5 with none). Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, offsets, slices
from .textstats import IS_DIGIT, IS_PUNCT, IS_SYMBOL, IS_UPPER, Texts, per_text

FEATURES = ("log_words", "word_length", "symbols", "punctuation", "upper", "digits", "non_ascii", "dup_lines", "repeat_words", "distinct", "line_words", "short_words", "bangs")
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, MIN_LEAF, RIDGE = 150, 60, 0.15, 4, 8, 1.0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def features(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    t = Texts(body, at)
    n, chars = np.maximum(t.n_words, 1), np.maximum(np.diff(at), 1)
    lines, dup = t.dup_lines()
    distinct, _ = t.distinct_words()
    length = t.hi - t.lo
    count = lambda flags: per_text(flags, at)
    return np.column_stack(
        (
            np.log1p(t.n_words), np.bincount(t.row, weights=length, minlength=t.n) / n, count(IS_SYMBOL[body]) / n, count(IS_PUNCT[body]) / n, count(IS_UPPER[body]) / chars, count(IS_DIGIT[body]) / chars,
            count(body >= 0x80) / chars, dup / np.maximum(lines, 1), t.repeat_words() / n, distinct / n, t.n_words / np.maximum(lines, 1), np.bincount(t.row[length <= 3], minlength=t.n) / n, count(body == 33) / n,
        )
    ).astype(np.float32)


def tree(grad: np.ndarray, weight: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values by bin of a best-first tree with few leaves on bins in order, from sums of gradients and curvatures."""
    g, h = np.concatenate(([0.0], np.cumsum(grad))), np.concatenate(([0.0], np.cumsum(weight)))
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)

    def split(a: int, b: int) -> tuple[float, int]:
        cuts = np.arange(a + 1, b)
        cuts = cuts[(h[cuts] - h[a] >= MIN_LEAF / 4) & (h[b] - h[cuts] >= MIN_LEAF / 4)]
        if not len(cuts):
            return 0.0, a
        gain = value(a, cuts) + value(cuts, b) - value(a, b)
        best = int(np.argmax(gain))
        return float(gain[best]), int(cuts[best])

    parts = [(0, len(grad))]
    while len(parts) < leaves:
        gains = [split(*p) for p in parts]
        best = max(range(len(parts)), key=lambda i: gains[i][0])
        if gains[best][0] <= 1e-9:
            break
        a, b = parts[best]
        parts[best : best + 1] = [(a, gains[best][1]), (gains[best][1], b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def pair_tree(grad: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values of a depth-2 tree on a table: the axis order with the greater gain; grad and weight are 2-D sums by cell."""
    best, found = -1.0, np.zeros_like(grad)
    for axis in (0, 1):
        g, h = (grad, weight) if axis == 0 else (grad.T, weight.T)
        for cut in range(1, len(g)):
            out, gain = np.zeros_like(g), 0.0
            for part in (slice(0, cut), slice(cut, len(g))):
                side = tree(g[part].sum(0), h[part].sum(0), 2)
                out[part] = side
                gain += float((side * g[part].sum(0)).sum())
            if gain > best:
                best, found = gain, out if axis == 0 else out.T
    return found


@dataclass
class Model:
    edges: list[np.ndarray]
    start: float
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Additions of looked-up bins, then the logistic."""
        total = np.full(len(x), self.start)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        if self.pairs:
            coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for k in {k for i, j, _ in self.pairs for k in (i, j)}}
            for i, j, table in self.pairs:
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on rows x with labels y (0 or 1), rows in a fixed order."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    width = len(FEATURES)
    edges, pair_edges = [cuts(x[:, k], BINS) for k in range(width)], [cuts(x[:, k], PAIR_BINS) for k in range(width)]
    model = Model(edges, start, [np.zeros(len(e) + 1) for e in edges], pair_edges, [])
    if len(y) < 2 or y.min() == y.max():
        return model
    codes = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(pair_edges)]
    total = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = slopes()
            n = len(model.tables[k])
            add = RATE * tree(np.bincount(codes[k], g, n), np.bincount(codes[k], h, n))
            model.tables[k] += add
            total += add[codes[k]]

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        m = len(pair_edges[j]) + 1
        return np.bincount(coarse[i] * m + coarse[j], v, (len(pair_edges[i]) + 1) * m).reshape(-1, m)

    g, h = slopes()
    gain = {}
    for i in range(width):
        for j in range(i + 1, width):
            gg, hh = cells(i, j, g), cells(i, j, h)
            gain[i, j] = float((pair_tree(gg, hh) * gg).sum())
    chosen = sorted(gain, key=lambda p: (-gain[p], p))[:PAIRS]
    model.pairs = [(i, j, np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            add = RATE * pair_tree(cells(i, j, g), cells(i, j, h))
            table += add
            total += add[coarse[i], coarse[j]]
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from labelled rows outside the held-out third. Only the sampled rows' texts are read into features."""
    marked = labels.where("doc_id is not null and quality is not null").where(remainder(F.col("doc_id")) != 1)
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()
    known = np.array(sorted((r["doc_id"], int(r["y"] == 1)) for r in marked), np.int64).reshape(-1, 2)

    def step(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-(2**62)).to_numpy(zero_copy_only=False)
            picked = batch.filter(pa.array(np.isin(ids, known[:, 0])))
            for part in slices(picked) if len(picked) else ():
                x = features(*offsets(part.column("text")))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "x": pa.array(x.tolist(), pa.list_(pa.float32()))})

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    # equal rows have equal features and count once; the sample is the first fit_rows by hash, in one job
    got = rows.mapInArrow(step, "doc_id long, x array<float>").distinct().orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(fit_rows).toPandas()
    x = np.array(got["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    ids = got["doc_id"].to_numpy(np.int64)
    order = np.lexsort((*x.T, ids))
    at = np.searchsorted(known[:, 0], ids[order]) if len(known) else np.zeros(0, np.int64)
    return fit(x[order], known[at, 1].astype(float) if len(known) else np.zeros(0))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            s = model.score(features(*offsets(part.column("text"))))
            return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

        return step

    held = F.coalesce(remainder(F.col("doc_id").cast("long")) == 1, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))
    return map_slices(rows, make, SCHEMA)


def classified(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    return scored(docs, train(docs, labels, fit_rows))


def accepted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that the classifier predicts 1 for, with all their columns."""
    model = train(docs, labels, fit_rows)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch.rename_columns([str(i) for i in range(batch.num_columns)]), str(at)):
                s = model.score(features(*offsets(part.column(at).cast(pa.string()))))
                yield part.filter(pa.array(s >= 0.5)).rename_columns(names)

    return docs.mapInArrow(run, docs.schema)
