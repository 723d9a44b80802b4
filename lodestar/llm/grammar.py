"""Operator 1: token ids in Re-Pair grammar-compressed shards with random access.

Documents are range-partitioned by doc_id and encoded in that order; a shard holds about `SHARD_IDS` ids. In a shard
the frequent pairs of neighbouring symbols are replaced by nonterminals, round after round, each round the most
frequent pairs that don't overlap, until none is left that pays or the format's 16-bit symbols are used up. The file
stores the rules, each rule's expansion length and the remaining symbols, all as 16-bit numbers where they fit; sums of expansion lengths lead from an id's position to its symbol,
so any range of ids decodes without the rest. Pairs never span two documents.

A shard is one row of a Parquet table in the shared folder: Spark writes and commits the files wherever the cluster
keeps them, and a lost executor costs only its shards.

Nulls: a null text is empty: just the end id. Null doc_ids come first. Rows that share a doc_id go by text; repeated
rows each have their ids. Empty table: no shards, empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets, prefix_hash, shared_dir, slices, span_hash, stored

SHARD_IDS = 1 << 20
END = 0
MAGIC = b"RPG1"
#: A rule takes 8 bytes and saves 2 at each place, so it pays from 5 on; a round takes pairs down to 1/FALL of its most frequent.
PER_ROUND, LEAST, FALL = 3000, 5, 4
#: Pieces of text that a worker remembers the ids of.
KNOWN = 1_000_000
#: Shards whose starting positions are broadcast (some 24 bytes each); with more they are joined by a shuffle.
MOST_BROADCAST = 1_000_000


#: White space of two and three bytes in UTF-8, in any library's eyes (fixed values).
WIDE_SPACES = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
BLANK, POINT, ODD, LETTER, LEAD = (np.zeros(256, bool) for _ in range(5))
BLANK[[32, 10]] = True
POINT[[44, 46]] = True
ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
LETTER[[c for c in range(128) if chr(c).isalnum()]] = True
LEAD[[c[0] for c in WIDE_SPACES]] = True


def piece_starts(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, whether its text has odd white space) of pieces that a byte-level pre-tokenizer never joins.

    A piece is a run of blanks and newlines with the word after it, cut before the word's first full stop or comma where
    that follows a letter or digit. A text with other white space is one piece.
    """
    n = len(body)
    blank = BLANK[body]
    new = blank.copy()
    new[1:] &= ~blank[:-1]
    point = np.flatnonzero(POINT[body])
    if len(point):
        word = np.cumsum(new)[point]
        first = np.append(True, word[1:] != word[:-1])
        first[1:] |= np.searchsorted(at, point[1:], "right") != np.searchsorted(at, point[:-1], "right")
        point = point[first & (point > 0)]
        before = body[point - 1]
        fine = LETTER[before]
        for i in np.flatnonzero(before >= 0x80).tolist():
            end = int(point[i])
            fine[i] = body[max(0, end - 4) : end].tobytes().decode(errors="ignore")[-1:].isalnum()
        new[point[fine]] = True
    odd = ODD[body]
    lead = np.flatnonzero(LEAD[body[: n - 1]])
    for space in WIDE_SPACES if len(lead) else ():
        here = lead[lead + len(space) <= n]
        for k, byte in enumerate(space):
            here = here[body[here + k] == byte]
        odd[here] = True
    texts = at[:-1][np.diff(at) > 0]
    new[texts] = True
    starts = np.flatnonzero(new)
    row = np.searchsorted(at, starts, "right") - 1
    whole = np.zeros(len(at) - 1, bool)
    whole[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = True
    keep = ~whole[row] | (starts == at[row])
    return starts[keep], whole[row[keep]]


class Tokens:
    """Ids by the tokenizers library. Pieces met before are remembered; new ones go to the library joined, many at once.

    The memory is a table of arrays, sorted by a hash of the piece; a hit's bytes are compared with the piece's, so
    equal hashes can't give wrong ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores
        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        #: Bytes of each id's text: a byte-level vocabulary writes each byte as one character.
        self.width = np.array([len(self.library.id_to_token(i) or "") for i in range(size)])
        self.first_rule = size
        self._forget()

    def _forget(self) -> None:
        #: Hash of each known piece, ascending; where its ids and bytes are in the pools, and how many.
        self.hash = np.zeros(0, np.uint64)
        self.where = np.zeros((0, 4), np.int64)
        self.ids, self.raw = np.zeros(0, np.uint16), np.zeros(0, np.uint8)
        self.used = np.zeros(0, bool)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, new: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's begin, how many) of pieces of `size` bytes; one that begins with white space and ends without is encoded alike wherever it stands."""
        joinable = np.array([p[0] in " \n" and p[-1] not in " \n" for p in new], bool)
        together, alone = np.flatnonzero(joinable), np.flatnonzero(~joinable)
        group = (np.cumsum(size[together]) - size[together]) >> 16
        groups = np.split(together, np.flatnonzero(np.diff(group)) + 1) if len(together) else []
        found, n = [], []
        for pieces, ids in zip(groups, self._library(["".join([new[i] for i in g.tolist()]) for g in groups])):
            cut = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size[pieces]), "left") + 1
            n.append(np.diff(cut[:-1], prepend=0, append=len(ids)))
            found.append(ids)
        rest = self._library([new[i] for i in alone.tolist()]) if len(alone) else []
        n = np.concatenate((*n, np.array([len(x) for x in rest], np.int64)))
        to = np.empty((2, len(new)), np.int64)
        to[:, np.concatenate((together, alone))] = np.cumsum(n) - n, n
        return np.concatenate((*found, *rest)), to[0], to[1]

    def _trim(self) -> None:
        """Forget what wasn't used since the last time, and all if that isn't enough."""
        if self.used.sum() > KNOWN // 2:
            return self._forget()
        begin, n, raw, size = self.where[self.used].T
        spread = lambda at, k: np.repeat(at - (np.cumsum(k) - k), k) + np.arange(k.sum())
        self.ids, self.raw = self.ids[spread(begin, n)], self.raw[spread(raw, size)]
        self.where = np.column_stack((np.cumsum(n) - n, n, np.cumsum(size) - size, size))
        self.hash = self.hash[self.used]
        self.used = np.zeros(len(self.hash), bool)
        return None

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text)."""
        body, at = offsets(column)
        if not len(body):
            return np.zeros(0, np.uint16), np.zeros(len(column), np.int64)
        if len(self.hash) > KNOWN:
            self._trim()
        starts, whole = piece_starts(body, at)
        ends = np.append(starts[1:], len(body))
        size = ends - starts
        key = span_hash(prefix_hash(body), starts, ends)
        short = (size <= 64) & ~whole
        order = np.argsort(key)  # ascending keys are looked up in order
        found = np.empty(len(key), np.int64)
        found[order] = np.searchsorted(self.hash, key[order])
        np.minimum(found, max(0, len(self.hash) - 1), out=found)
        hit = short & (self.hash[found] == key) if len(self.hash) else np.zeros(len(key), bool)
        fresh = np.flatnonzero(short & ~hit)
        if len(fresh):
            hashes, first = np.unique(key[fresh], return_index=True)
            first = fresh[first]
            text = body.tobytes()
            m = size[first]
            ids, begin, n = self._learned([text[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())], m)
            where = np.column_stack((len(self.ids) + begin, n, len(self.raw) + np.cumsum(m) - m, m))
            self.ids = np.concatenate((self.ids, ids))
            self.raw = np.concatenate((self.raw, body[np.repeat(starts[first] - (np.cumsum(m) - m), m) + np.arange(m.sum())]))
            to = np.searchsorted(self.hash, hashes)
            self.hash, self.where = np.insert(self.hash, to, hashes), np.insert(self.where, to, where, axis=0)
            self.used = np.insert(self.used, to, True)
            shift = np.cumsum(np.bincount(to, minlength=len(self.hash)))
            found += shift[found]  # of what was known before
            found[~short] = 0
            found[fresh] = np.searchsorted(self.hash, key[fresh])
        begin, n = self.where[found, 0], self.where[found, 1]
        self.used[found[short]] = True
        # the bytes of what was looked up are those of the piece
        ok = short & (self.where[found, 3] == size)
        bad = np.zeros(len(key), bool)
        if len(self.raw):
            here = np.repeat((np.where(ok, self.where[found, 2], 0) - starts).astype(np.int32), size)
            here += np.arange(len(body), dtype=np.int32)
            differs = np.flatnonzero(self.raw.take(here, mode="clip") != body)
            bad[np.searchsorted(starts, differs, "right") - 1] = True
        alone = np.flatnonzero(~ok | bad)
        pool = self.ids
        if len(alone):
            text = body.tobytes()
            ids = self._library([text[a:b].decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist())])
            n[alone] = [len(x) for x in ids]
            begin[alone] = len(pool) + np.cumsum(n[alone]) - n[alone]
            pool = np.concatenate((pool, *ids))
        out = pool[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return out, np.bincount(np.searchsorted(at, starts, "right") - 1, weights=n, minlength=len(column)).astype(np.int64)


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


#: An odd multiplier for each try to place a round's pairs in a table of LOOKUP bits without two in one place.
LOOKUP = 20


def placed(chosen: np.ndarray) -> tuple[np.ndarray, np.uint32]:
    """(table, multiplier): 1 + the number of each chosen pair at its place; pairs are looked up there and compared."""
    rng = np.random.default_rng(len(chosen))
    while True:
        by = np.uint32(rng.integers(0, 1 << 32) | 1)
        at = np.sort((chosen * by) >> np.uint32(32 - LOOKUP))
        if (at[1:] != at[:-1]).all():
            break
    table = np.zeros(1 << LOOKUP, np.uint16)
    table[(chosen * by) >> np.uint32(32 - LOOKUP)] = np.arange(1, len(chosen) + 1)
    return table, by


def compress(ids: np.ndarray, lengths: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules (n, 2), symbols of each document): rule k is symbol first_rule + k."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    rules: list[np.ndarray] = []
    count = 0
    while True:
        room = min(PER_ROUND, (1 << 16) - first_rule - count)
        if len(symbols) < 2 or room <= 0:
            break
        pair = symbols[:-1] << np.uint32(16)
        pair |= symbols[1:]
        ordered = pair[~last[:-1]]
        ordered.sort()
        edge = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
        edge = np.concatenate(([0], edge, [len(ordered)]))
        n = np.diff(edge)
        often = np.flatnonzero(n >= LEAST)
        if not len(ordered) or not len(often):
            break
        often = often[n[often] >= n[often].max() / FALL]
        best = often[np.argsort(-n[often], kind="stable")[:room]]
        chosen = np.sort(ordered[edge[best]])
        table, by = placed(chosen)
        place = pair * by
        place >>= np.uint32(32 - LOOKUP)
        found = table.take(place)
        at = np.flatnonzero(found)
        found = found[at].astype(np.int64) - 1
        hit = (chosen[found] == pair[at]) & ~last[at]
        at, found = at[hit], found[hit]
        # of occurrences that overlap in a row every other one counts
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.append(True, np.diff(at) != 1), np.arange(len(at)), 0))
        at, found = at[run % 2 == 0], found[run % 2 == 0]
        rules.append(np.column_stack((chosen >> 16, chosen & 0xFFFF)))
        symbols[at] = first_rule + count + found
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        count += len(chosen)
    of_doc = np.diff(np.append(0, np.flatnonzero(last) + 1))
    return symbols.astype(np.uint16), np.concatenate(rules).astype(np.uint16) if rules else np.zeros((0, 2), np.uint16), of_doc


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for: every rule's expansion is laid out once, then gathered."""
    sizes = expansion_lengths(rules, first_rule) if sizes is None else sizes.astype(np.int64)
    flat = np.empty(int(sizes.sum()), np.int32)
    begin = np.cumsum(sizes) - sizes
    bounds = list(zip(begin.tolist(), (begin + sizes).tolist()))
    for (lo, hi), (left, right) in zip(bounds, rules.tolist()):
        at = lo
        for x in (left, right):
            if x < first_rule:
                flat[at] = x
                at += 1
            else:
                a, b = bounds[x - first_rule]
                flat[at : at + b - a] = flat[a:b]
                at += b - a
    symbols = symbols.astype(np.int32)
    rule = symbols - np.int32(first_rule)
    deep = rule >= 0
    if not deep.any():
        return symbols
    size = np.where(deep, sizes[np.maximum(rule, 0)], 1)
    out = np.repeat(symbols, size)
    whole = np.repeat(deep, size)
    # within an expansion: where it begins in flat, plus the distance from its first id
    ends = np.cumsum(size)
    source = np.repeat(np.where(deep, begin[np.maximum(rule, 0)], 0) - (ends - size), size) + np.arange(len(out))
    out[whole] = flat[source[whole]]
    return out


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    out = np.ones(len(rules), np.int64)
    for k, pair in enumerate(rules.tolist()):  # a rule refers to earlier ones only
        out[k] = sum(int(out[x - first_rule]) if x >= first_rule else 1 for x in pair)
    return out


def pack(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray, first_rule: int) -> bytes:
    """A shard's file: header, documents (id, whether it has one, ids, symbols), rules, expansion lengths, symbols."""
    symbols, rules, of_doc = compress(ids, lengths, first_rule)
    head = MAGIC + struct.pack("<5I", len(doc_ids), len(ids), len(rules), len(symbols), first_rule)
    arrays = (doc_ids.astype("<i8"), known.astype("u1"), lengths.astype("<u4"), of_doc.astype("<u4"), rules.astype("<u2"), expansion_lengths(rules, first_rule).astype("<u4"), symbols.astype("<u2"))
    return head + b"".join(a.tobytes() for a in arrays)


class Shard:
    """A file read back: all ids, or any range of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        docs, self.n_ids, rules, symbols, self.first_rule = struct.unpack_from("<5I", data, 4)
        at = 24
        fields = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", docs), ("<u2", 2 * rules), ("<u4", rules), ("<u2", symbols)):
            fields.append(np.frombuffer(data, kind, n, at))
            at += fields[-1].nbytes
        self.doc_ids, self.known, self.lengths, self.of_doc, flat, self.sizes, self.symbols = fields
        self.rules = flat.reshape(-1, 2).astype(np.int64)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.first_rule, self.sizes)

    def ids_between(self, lo: int, hi: int) -> np.ndarray:
        """Ids at positions lo..hi-1 of the shard; only symbols that reach into the range are expanded."""
        size = np.where(self.symbols >= self.first_rule, self.sizes[np.maximum(self.symbols.astype(np.int64) - self.first_rule, 0)] if len(self.sizes) else 1, 1)
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.rules, self.first_rule)[lo - before : hi - before]


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs in ascending doc_id order and write their shards under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc_ids, known, lengths, ids = map(np.concatenate, zip(*held))
            data = pack(doc_ids, known, lengths, ids, t.first_rule)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([data], pa.binary())})

        for batch in batches:
            for rows in slices(batch):
                ids, lengths = t.encode(rows.column("text"))
                doc_id = rows.column("doc_id")
                known = doc_id.is_valid().to_numpy(zero_copy_only=False)
                held.append((doc_id.fill_null(0).to_numpy(zero_copy_only=False), known, lengths + 1, np.insert(ids, np.cumsum(lengths), END)))
                size += len(held[-1][3])
                if size >= shard_ids:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "part int, number int, n_ids long, payload binary").write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards under path."""
    shards = spark.read.schema("part int, number int, n_ids long, payload binary").parquet(path)
    # ids before a shard: those of the parts before, and of the part's shards before
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    inner = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(shards.select("part", "number", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("skip")).join(parts, "part").select("part", "number", (F.col("base") + F.col("skip")).alias("start")), "starts")
    starts = F.broadcast(starts) if starts.count() <= MOST_BROADCAST else starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, start in zip(batch.column("payload"), batch.column("start").to_pylist()):
                shard = Shard(payload.as_py())
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.lengths, dtype=np.int64)
                begins = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids, mask=shard.known == 0), "start": pa.array(begins + start), "n_tokens": pa.array(shard.lengths.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.select("part", "number", "payload").join(starts, ["part", "number"]).select("payload", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = shared_dir(docs.sparkSession, "ids")
    write_shards(docs, path, tokenizer)
    return read_shards(docs.sparkSession, path)
