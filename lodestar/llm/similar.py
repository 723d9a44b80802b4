"""The pipeline's near-duplicates: texts whose sets of lower-cased 5-word shingles have a Jaccard similarity of 0.8 or more.

Operator 9 gives the first candidates: sets whose SimHash fingerprints are equal or which its vantage-point trees link.
At 0.8 two fingerprints of 64 bits differ in 3 to 16 bits, where no branch of such a tree can be pruned, so further
candidates are those that share one of `BANDS` bands of `ROWS` min-hashes and a class of size; a pair at 0.8 shares none
with probability (1 - 0.8**4)**24 < 4e-6, a closer pair with less. Each candidate pair is held against its two whole
sets, so links are exact. Of each distinct shingle set one is searched.

A bucket of up to `SMALL` sets is compared pair by pair. In a larger one every set is compared with a lead, what isn't
like it with a second lead, and so on for `LEADS` rounds. Up to `SMALL` sets that this leaves outside the bucket's
largest component are compared with the whole bucket. The sets of buckets with more outside, mostly unlike ones, meet
by their rarest shingles: two of a similarity of 0.8 share one among the rarest fifth of each, so no pair is missed.

Shorter texts are one shingle of all their words. Nulls: a null text has no words; texts without words are linked.
Repeated rows are one document. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import map_slices, mixed, offsets, stored
from .simhash import components, first_of_each
from .textstats import Texts

WORDS = 5
BANDS, ROWS = 24, 4
#: Sets of a size within a factor of this share a class; a set is in two.
CLASS = 1.25
SMALL, LEADS = 8, 3
#: Sets with a shingle that one task compares with the others that have it, about.
DEALT = 2000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(col: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(n, values): the distinct shingles' number for each text, and their hashes text by text, ascending in each."""
    body, at = offsets(col)
    texts = Texts(LOWER[body], at)
    first, value = texts.grams(words)
    row = texts.row[first]
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < words))
    if len(short):
        begin = np.searchsorted(texts.row, short)
        whole = texts.words[begin]
        for k in range(1, words - 1):
            more = texts.n_words[short] > k
            whole[more] = mixed(whole[more] * np.uint64(0xFF51AFD7ED558CCD | 1) + texts.words[begin[more] + k])
        row, value = np.concatenate((row, short)), np.concatenate((value, whole + texts.n_words[short].astype(np.uint64)))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))[: len(row)]
    return np.bincount(row[new], minlength=texts.n), value[new]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), name (a hash of its shingle set), fp (its SimHash), keys (one for each band and each of its two classes)."""

    def make():
        odd = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            n, values = shingle_sets(part.column("text"))
            name, keys = np.zeros(len(n), np.uint64), np.zeros((len(n), BANDS), np.uint64)
            sort = np.floor(np.log(np.maximum(n, 1)) / np.log(CLASS)).astype(np.uint64)
            bits = np.zeros(len(n), np.uint64)
            filled = np.flatnonzero(n)
            if len(filled):
                edges = np.cumsum(n[filled]) - n[filled]
                for bit in range(64):
                    ones = np.add.reduceat(((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), edges)
                    bits[filled] |= (2 * ones > n[filled]).astype(np.uint64) << np.uint64(bit)
                name[filled] = mixed(np.add.reduceat(mixed(values), edges) + n[filled].astype(np.uint64))
                for k, m in enumerate(odd):
                    least = np.minimum.reduceat((values ^ (m >> np.uint64(7))) * m, edges)
                    keys[filled, k // ROWS] = mixed(keys[filled, k // ROWS] * np.uint64(0xFF51AFD7ED558CCD) + least)
            keys = np.concatenate([mixed(keys + (sort + np.uint64(k))[:, None]) for k in (0, 1)], axis=1)
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, 2 * BANDS, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
            return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "mark": part.column("mark"), "name": pa.array(name.view(np.int64)), "fp": pa.array(bits.view(np.int64)), "keys": flat})

        return step

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) mark", "cast(text as string) text")
    return map_slices(rows, make, "doc_id long, mark long, name long, fp long, keys array<long>")


def sets(docs: DataFrame, prints: DataFrame, names: DataFrame) -> DataFrame:
    """name, values (the shingle set) of the given names, each from one of its texts."""

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            n, values = shingle_sets(part.column("text"))
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            return pa.RecordBatch.from_pydict({"name": part.column("name"), "values": pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64)))})

        return step

    one = prints.join(names, "name", "left_semi").groupBy("name").agg(F.min("mark").alias("mark"))
    texts = docs.select(F.expr("xxhash64(cast(text as string))").alias("mark"), F.col("text").cast("string").alias("text"))
    return map_slices(texts.join(one, "mark").dropDuplicates(["name"]), make, "name long, values array<long>")


def similar(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) of a similarity of 0.8 or more: 9 times the common shingles are at least 4 times both sizes' sum."""
    x, y = shingles.toDF("a", "x"), shingles.toDF("b", "y")
    return pairs.join(y, "b").join(x, "a").where("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select("a", "b")


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Edges (a, b) between names whose components are those of all linked candidates."""
    each = stored(prints.groupBy("name").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")), "each")
    leads = stored(each.groupBy("fp").agg(F.min("name").alias("lead")), "leads")
    alike = each.join(leads, "fp").where("name <> lead").select(F.col("lead").alias("a"), F.col("name").alias("b"))
    x, y = leads.toDF("x", "a"), leads.toDF("y", "b")
    linked = stored(simhash.links(leads.select("fp")).toDF("x", "y").join(x, "x").join(y, "y").select("a", "b").union(alike), "linked")
    placed = stored(each.select("name", F.posexplode("keys").alias("at", "key")).select("name", F.expr(f"at % {BANDS}").alias("band"), "key"), "bands")
    order = F.struct(F.xxhash64("band", "name").alias("h"), "name")
    crowds = placed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.sum(F.xxhash64("name").cast("decimal(38,0)")).alias("who")).where("n > 1")
    # buckets of the same members are one
    crowds = crowds.groupBy("n", "who").agg(F.min(F.struct("band", "key", "first.name")).alias("k")).select("n", "k.band", "k.key", F.col("k.name").alias("lead"))
    members = stored(placed.join(crowds, ["band", "key"]), "members")
    named = members.select("name").union(linked.select("a")).union(linked.select("b")).distinct()
    shingles = stored(sets(docs, prints, named), "sets")
    small = stored(in_pairs(members.where(f"n <= {SMALL}")).union(ordered(linked, "a", "b")).distinct(), "pairs")
    near = stored(similar(small, shingles), "near")
    left = members.where(f"n > {SMALL}").select("band", "key", "name", "lead")
    found = near
    for _ in range(LEADS):
        stars = ordered(left.where("name <> lead"), "lead", "name").distinct()
        one = stored(similar(stars, shingles), "near")
        found = found.union(one)
        # who isn't like the lead goes on, with another one
        known = one.union(one.select("b", "a")).toDF("lead", "name")
        rest = left.where("name <> lead").join(known, ["lead", "name"], "left_anti").select("band", "key", "name")
        leads = rest.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").select("band", "key", "n", F.col("first.name").alias("lead"))
        left = stored(rest.join(leads, ["band", "key"]), "left")
        if left.isEmpty():
            break
    roots = components(found).toDF("name", "root")
    parted = members.where(f"n > {SMALL}").select("band", "key", "name", "n").join(roots, "name", "left").select("band", "key", "name", "n", F.coalesce("root", "name").alias("root"))
    parted = stored(parted, "parted")
    most = parted.groupBy("band", "key", "n", "root").agg(F.count("*").alias("c")).groupBy("band", "key", "n").agg(F.max(F.struct("c", "root")).alias("m"))
    few = most.where(f"n - m.c between 1 and {SMALL}").select("band", "key", F.col("m.root").alias("main"))
    whole = stored(parted.drop("n").join(few, ["band", "key"]), "whole")
    outside = whole.where("root <> main").select("band", "key", F.col("name").alias("x"), F.col("root").alias("r"))
    rest = ordered(outside.join(whole, ["band", "key"]).where("root <> r"), "x", "name").distinct()
    unlike = most.where(f"n - m.c > {SMALL}").select("band", "key")
    crowd = stored(parted.join(unlike, ["band", "key"], "left_semi").select("name", "root").distinct(), "crowd")
    if not crowd.isEmpty():
        rest = rest.union(sharing_rare(crowd, shingles))
    return found.union(similar(stored(rest, "rest"), shingles))


def sharing_rare(crowd: DataFrame, shingles: DataFrame) -> DataFrame:
    """(a, b), a < b, of all pairs of the crowd (name, root) in different roots that can be of a similarity of 0.8 or more.

    A set's shingles are ordered by how many sets have them. Of n shingles a similar set has 0.8 n or more, so the first
    that both have is among the n - 0.8 n + 1 first of each, and enough shingles follow it in both. A shingle of many sets
    is dealt over several tasks.
    """
    each = crowd.join(shingles, "name").where("size(values) > 0").select("name", "root", F.explode("values").alias("value"))
    often = each.groupBy("value").agg(F.count("*").alias("c"))
    sorted_ = each.join(often, "value").groupBy("name", "root").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("all"))
    n = F.size("all")
    first = F.slice("all", F.lit(1), n - F.expr("(4 * size(all) + 4) div 5").cast("int") + 1)
    rare = stored(sorted_.select("name", "root", n.alias("n"), F.posexplode(first).alias("at", "s")).select("name", "root", "n", "at", "s.value", "s.c").where("c > 1"), "rare")
    parts = F.expr(f"1 + c div {DEALT}")
    one = rare.select(F.col("name").alias("a"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("at").alias("i"), "value", F.pmod(F.xxhash64("name"), parts).alias("part"))
    other = rare.select(F.col("name").alias("b"), "root", "n", "at", "value", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    pairs = one.join(other, ["value", "part"]).where("a < b and r <> root and 9 * least(m - i, n - at) >= 4 * (m + n)")
    return pairs.select("a", "b").distinct()


def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def in_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b, of the names in each bucket of at most SMALL, so of less than SMALL a name."""
    buckets = members.groupBy("band", "key").agg(F.array_sort(F.collect_set("name")).alias("all"))
    pairs = "flatten(transform(all, (a, i) -> transform(slice(all, i + 2, size(all)), b -> named_struct('a', a, 'b', b))))"
    return buckets.select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, mark, root (a shingle set's name that names the component)."""
    prints = stored(signatures(docs), "signatures")
    roots = components(links(docs, prints)).toDF("name", "root")
    return prints.join(roots, "name", "left").select("doc_id", "mark", F.coalesce("root", "name").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their group, by doc_id and then by a hash of the text; of equal rows one."""
    return first_of_each(docs, grouped(docs))
