"""Operator 10: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list. Every adjacent pair that has a merge rank is filed in the
bucket of that rank; a bitmap of bitmaps over ranks tells the lowest non-empty bucket by find-first-set.
Positions in a bucket come leftmost first; an entry whose pair has changed since is stale and skipped. A
pre-token of n bytes thus costs O(n log n) however long it is.

Nulls: a null text is empty: no ids, digests of the empty string. Repeated rows each give a row. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, map_slices, pieces

#: Entries of each generation of the memo of pieces, and of that of pre-tokens, which pieces share: a worker
#: keeps two generations of each while it lives, whatever it runs next.
KNOWN = 360_000
KNOWN_TOKENS = 120_000
#: Each bit of a word.
BIT = [1 << k for k in range(256)]
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_token(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token, merging the lowest rank first and the leftmost pair of a rank first.

    The queue: buckets[rank] holds positions (one, or a heap of them), words[rank >> 8] has a bit for each
    non-empty bucket and top a bit for each non-zero word; x & -x finds the first set bit.
    """
    rank_of = ranks.get
    r = rank_of(data)
    if r is not None:
        return [r]
    n = len(data)
    end = list(range(1, n + 1))  # where the symbol that starts at i ends; 0: no longer a start
    before = list(range(-1, n - 1))
    pair = [rank_of(data[i : i + 2]) for i in range(n - 1)]
    pair.append(None)
    live = len(pair) - pair.count(None)  # pairs that can be merged: without one all that is still filed is stale
    buckets: dict[int, int | list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    todo = enumerate(pair)
    while live:
        for i, r in todo:  # file what is new
            if r is None:
                continue
            if r in buckets:
                bucket = buckets[r]
                if bucket.__class__ is list:
                    heappush(bucket, i)
                else:
                    buckets[r] = [bucket, i] if bucket < i else [i, bucket]
            else:
                buckets[r] = i
                word = r >> 8
                if word in words:
                    words[word] |= BIT[r & 255]
                else:
                    words[word] = BIT[r & 255]
                    top |= BIT[word] if word < 256 else 1 << word
        todo = ()
        low = top & -top
        word = low.bit_length() - 1
        bits = words[word]
        first = bits & -bits
        r = word << 8 | first.bit_length() - 1
        i = buckets[r]
        if i.__class__ is list and len(i) > 1:
            i = heappop(i)
        else:
            if i.__class__ is list:
                i = i[0]
            del buckets[r]
            if bits == first:
                del words[word]
                top ^= low
            else:
                words[word] = bits ^ first
        if pair[i] != r:
            continue  # stale
        j = end[i]
        end[i] = k = end[j]
        end[j] = 0
        live -= 1
        if pair[j] is not None:
            live -= 1
            pair[j] = None
        h = before[i]
        if k < n:
            before[k] = i
            pair[i] = r = rank_of(data[i : end[k]])
            if r is not None:
                live += 1
                todo = ((i, r),)
        else:
            pair[i] = None
        if h >= 0:
            if pair[h] is not None:
                live -= 1
            pair[h] = r = rank_of(data[h:k])
            if r is not None:
                live += 1
                todo += ((h, r),)
    return [ranks[data[i:e]] for i, e in enumerate(end) if e]


class Codec:
    """Encoder and decoder for a ranks file and a pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.memo = Memo(self._piece, KNOWN)
        self.token_memo = Memo(self._token, KNOWN_TOKENS)

    def _piece(self, text: str) -> bytes:
        found = self.pattern.findall(text)
        return self.token_memo[found[0]] if len(found) == 1 else b"".join(map(self.token_memo.__getitem__, found))

    def _token(self, text: str) -> bytes:
        ids = encode_token(text.encode(), self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a worker process, with its memo, for all tasks that it runs."""
    key = (ranks_path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]."""

    def make():
        c = codec(ranks_path, pattern)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            count, digest, back, kept = [], [], [], []
            for text in part.column("text").to_pylist():
                ids = c.encode(text or "")
                count.append(len(ids) // 4)
                digest.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(c.decode(ids)).hexdigest())
                kept.append(ids)
            cols = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(digest), "decoded_sha256": pa.array(back)}
            return pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(kept, pa.binary())} if with_ids else {}))

        return step

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return map_slices(rows, make, SCHEMA + (", ids binary" if with_ids else ""))
