"""Operator 9: SimHash near-duplicates by vantage-point trees over fingerprints.

A fingerprint bit is 1 if set in over half the XXH64 values (seed 42) of a text's lower-cased 3-word shingles.
Two fingerprints link at `radius` or fewer differing bits. Only distinct fingerprints are searched; copies share
one. The search has two layers:

* Shards. The 64 bits are cut into radius + 1 blocks; a linked pair agrees on at least one, so each fingerprint goes
  to radius + 1 shards, keyed by a hash of (block, its bits) modulo a number that makes shards of about `shard_rows`.
  A shard that is crowded all the same is parted by vantage points: a row goes to the half its Hamming distance to the
  vantage point puts it in, and to the other half too where it lies within `radius` of the border, so boundary pairs
  meet somewhere. Vantage points and borders come from histograms of distances, made by Spark for all shards at once.
* Trees. Each shard builds a vantage-point tree and answers its fingerprints in it, skipping a branch when the
  triangle bound puts all of it out of reach.

A shard reports links as edges to a spanning forest of its own links, never all pairs of a group. Components come
from rounds of smallest-neighbour contraction over a checkpointed edge table.

Nulls: a null text has no words, so fingerprint zero, linked like any other. Repeated rows each give a row; null
doc_ids never become a component's id unless all are null. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_slices, stored, word_spans

SEED = 42
RADIUS = 2
#: Fingerprints in a shard, about; one of CROWDED times as many is parted by vantage points first.
SHARD_ROWS, CROWDED = 8_192, 4
#: Vantage points tried on a shard that the ones before don't part, and rounds of parting.
VANTAGES, SPLITS = 3, 40
LEAF = 24


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, mark (a hash of the text, which tells rows of one id apart), fp (the fingerprint's bits as a signed long)."""

    def make():
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            from .common import offsets

            body, at = offsets(part.column("text"))
            body = lower[body]
            raw = body.tobytes()
            lo, hi, row = word_spans(body, at)
            n = np.bincount(row, minlength=len(part))
            first = np.concatenate(([0], np.cumsum(n)))
            # one shingle for each start with `words` words in its text; shorter texts: all their words
            size = np.minimum(n, words)
            make_at = np.arange(len(lo))
            last = make_at + size[row] - 1
            ok = last < first[row + 1]
            make_at, last, row = make_at[ok], last[ok], row[ok]
            # words parted by single blanks are a slice of the text; others are joined
            gap_ok = np.concatenate((((lo[1:] - hi[:-1]) == 1) & (body[hi[:-1]] == 32), [True])) if len(lo) else np.zeros(0, bool)
            run = np.concatenate(([0], np.cumsum(~gap_ok)))
            plain = run[last] == run[make_at]
            digest = xxhash.xxh64_intdigest
            starts, ends = lo[make_at].tolist(), hi[last].tolist()
            hashes = np.fromiter(
                (digest(raw[a:b], SEED) if p else digest(b" ".join(raw[a:b].split()), SEED) for a, b, p in zip(starts, ends, plain.tolist())), np.uint64, len(starts)
            )
            counts = np.bincount(row, minlength=len(part))
            out = np.zeros(len(part), np.uint64)
            if len(hashes):
                filled = np.flatnonzero(counts)
                edges = np.concatenate(([0], np.cumsum(counts[filled])[:-1]))
                for bit in range(64):
                    ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), edges)
                    out[filled] |= (2 * ones > counts[filled]).astype(np.uint64) << np.uint64(bit)
            return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "mark": part.column("mark"), "fp": pa.array(out.view(np.int64))})

        return step

    return map_slices(docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) mark", "cast(text as string) text"), make, "doc_id long, mark long, fp long")


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """Exact radius search over distinct 64-bit fingerprints."""

    def __init__(self, fps: np.ndarray, leaf: int = LEAF):
        self.fps = fps
        self.nodes: list[tuple] = []
        self.root = self._grow(np.arange(len(fps)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        root = len(self.nodes)
        self.nodes.append(())
        todo = [(root, rows)]
        while todo:
            at, rows = todo.pop()
            d = hamming(self.fps[rows], self.fps[rows[0]]) if len(rows) > leaf else None
            cut = int(np.median(d[1:])) if d is not None else 0
            inside = d <= cut if d is not None else None
            if d is None or inside.all() or not inside.any():
                self.nodes[at] = ("leaf", rows)
                continue
            near, far = rows[inside], rows[~inside]
            kids = len(self.nodes), len(self.nodes) + 1
            self.nodes += [(), ()]
            self.nodes[at] = ("split", self.fps[rows[0]], cut, *kids)
            todo += [(kids[0], near), (kids[1], far)]
        return root

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (i, j), i < j, of linked rows; all rows walk down together, each branch with those that may reach it."""
        todo = [(self.root, np.arange(len(self.fps)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if node[0] == "leaf":
                members = node[1]
                for lo in range(0, len(rows), 4096):
                    near = np.bitwise_count(self.fps[rows[lo : lo + 4096], None] ^ self.fps[None, members]) <= radius
                    i, j = np.nonzero(near)
                    i, j = rows[lo + i], members[j]
                    yield i[i < j], j[i < j]
                continue
            _, vantage, cut, near, far = node
            d = hamming(self.fps[rows], vantage)
            if (left := rows[d - radius <= cut]).size:
                todo.append((near, left))
            if (right := rows[d + radius > cut]).size:
                todo.append((far, right))


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, its group's root) of a spanning forest of the links among fps."""
    parent = np.arange(len(fps))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in VantageTree(fps).links(radius):
        if not len(i):
            continue
        # drop links already within one group, a block at a time
        open_ = parent[i] != parent[j]
        for a, b in zip(i[open_].tolist(), j[open_].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([find(i) for i in range(len(fps))], dtype=np.int64)
    moved = roots != np.arange(len(fps))
    return fps[moved], fps[roots[moved]]


def blocks(parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of each block of 64 bits cut into parts."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def parted(rows: DataFrame, limit: int, radius: int) -> DataFrame:
    """rows (shard, leaf, fp) with shards above the limit cut into leaves by vantage points, border rows in both halves."""
    for _ in range(SPLITS):
        tries = F.length("leaf") - F.length(F.rtrim(F.col("leaf"), F.lit("~")))
        sizes = rows.groupBy("shard", "leaf").agg(F.count("*").alias("n"), *[F.min_by("fp", F.xxhash64("fp", F.lit(i))).alias(f"v{i}") for i in range(VANTAGES)])
        crowded = sizes.where((F.col("n") > limit) & (tries < VANTAGES)).select("shard", "leaf", "n", F.get(F.array(*[f"v{i}" for i in range(VANTAGES)]), tries).alias("vantage"))
        crowded = stored(crowded, "crowded")
        if crowded.isEmpty():
            discard(crowded)
            return rows
        distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
        counts = rows.join(crowded, ["shard", "leaf"]).groupBy("shard", "leaf", "vantage", "n", distance.alias("d")).agg(F.count("*").alias("c"))
        side = lambda test: f"aggregate(filter(h, x -> {test}), 0L, (s, x) -> s + x.c)"
        best = F.expr(f"array_min(transform(sequence(0, 63), t -> named_struct('worst', greatest({side(f'x.d <= t + {radius}')}, {side(f'x.d > t - {radius}')}), 'cut', t)))")
        plans = counts.groupBy("shard", "leaf", "vantage", "n").agg(F.collect_list(F.struct("d", "c")).alias("h")).withColumn("best", best)
        # a vantage point that leaves over nine tenths in a half is of no use: another is tried
        plans = stored(plans.select("shard", "leaf", "vantage", F.when(F.col("best.worst") <= 0.9 * F.col("n"), F.col("best.cut")).alias("cut"), F.lit(True).alias("planned")), "plans")
        halves = F.expr(f"filter(array(if(d <= cut + {radius}, concat(leaf, 'n'), null), if(d > cut - {radius}, concat(leaf, 'f'), null)), x -> x is not null)")
        to = F.when(F.col("planned").isNull(), F.array("leaf")).when(F.col("cut").isNull(), F.array(F.concat("leaf", F.lit("~")))).otherwise(halves)
        moved = rows.join(plans, ["shard", "leaf"], "left").withColumn("d", distance).select("shard", F.explode(to).alias("leaf"), "fp")
        rows = stored(moved, "parted")
    return rows


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links within the radius."""
    shards = max(1, fps.count() // shard_rows)
    keys = [F.pmod(F.xxhash64(F.lit(i), F.expr(f"shiftrightunsigned(fp, {shift}) & {(1 << bits) - 1}L")), F.lit(shards)) + i * shards for i, (shift, bits) in enumerate(blocks(radius + 1))]
    placed = fps.select("fp", F.explode(F.array(*keys)).alias("shard")).select("shard", F.lit("").alias("leaf"), "fp")
    sharded = parted(placed, CROWDED * shard_rows, radius)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by shard: a shard's rows are gathered, fingerprints alone in theirs are passed over
        held_name, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            fp = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            if len(fp) > 1:
                a, b = forest(fp, radius)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("name").dictionary_encode()
            code, fp = np.asarray(coded.indices), np.asarray(batch.column("fp")).view(np.uint64)
            edge = np.flatnonzero(np.diff(code)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(code)]):
                name = coded.dictionary[int(code[lo])].as_py()
                if name != held_name:
                    yield from flush()
                    held_name, held = name, []
                held.append(fp[lo:hi])
        yield from flush()

    named = sharded.select(F.concat_ws(":", "shard", "leaf").alias("name"), "fp")
    return named.repartition("name").sortWithinPartitions("name").mapInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every end of an edge: root is its component's smallest end, unsigned order aside.

    Each round points every vertex at the smallest vertex among itself and its neighbours, then contracts the
    edges to these pointers; the number of live vertices at least halves. Rounds are tables in the shared folder.
    """
    live = stored(edges.where("a <> b").selectExpr("a", "b").distinct(), "edges")
    hops = []
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        to = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("to")), "pointers")
        hops.append(to)
        x, y = to.toDF("a", "x"), to.toDF("b", "y")
        live = stored(live.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if len(hops) > 60:
            raise RuntimeError("contraction doesn't end")
    if not hops:
        return edges.select(F.col("a").alias("fp"), F.col("b").alias("root")).limit(0)
    # follow the pointers: within a round until they stand still, then into the next round
    out = None
    for to in reversed(hops):
        to = _flattened(to)
        out = to if out is None else to.join(out.toDF("to", "next"), "to", "left").select("v", F.coalesce("next", "to").alias("to"))
        out = stored(out, "roots")
    discard(*hops)
    return out.toDF("fp", "root")


def _flattened(to: DataFrame) -> DataFrame:
    """Pointers to the end of each chain of pointers (v above to, so chains end)."""
    while True:
        two = to.join(to.toDF("to", "next"), "to", "left").select("v", F.coalesce("next", "to").alias("far"), F.col("to"))
        two = stored(two, "chains")
        if two.where("far <> to").isEmpty():
            return two.select("v", F.col("far").alias("to"))
        to = two.select("v", F.col("far").alias("to"))


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """fp, component_id of each distinct fingerprint: copies meet here as one row, combined before the shuffle."""
    each = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = stored(components(links(each.select("fp"), radius)), "components")
    least = roots.join(each, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(least, "root").select("fp", "component_id")
    # a table of its own, so that a join with it can split a hot fingerprint
    return stored(each.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "ids")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    prints = stored(fingerprints(docs, words), "prints")
    return prints.join(classes(prints, radius), "fp").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The row of docs that is the first of each root in rows (doc_id, mark, root): by doc_id, then by a hash of the text."""
    names = docs.columns
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("k"))
    keep = first.select(F.coalesce("k.doc_id", F.lit(-(2**63))).alias("id"), F.col("k.mark").alias("mark")).distinct()
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id")
    packed = docs.select(id_, F.expr("xxhash64(cast(text as string))").alias("mark"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("all"))
    # rows equal in id and text become one before the shuffle, however many there are
    one = packed.groupBy("id", "mark").agg(F.min_by("all", F.xxhash64("all")).alias("all"))
    return one.join(keep, ["id", "mark"], "left_semi").select("all.*")
