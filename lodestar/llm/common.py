"""What the corpus operators share: reading tables, cutting Arrow batches, bounded memos, the shared folder.

Texts travel to Python as Arrow batches and are handled in slices of a few megabytes, so a task's memory
follows the slice and its longest text, not the partition.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, shared_dir, stored

__all__ = ["discard", "documents", "map_slices", "shared_dir", "stored"]

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 2 << 20
#: ASCII white space, as the word definition `[^\x20\x09-\x0D]+` has it.
SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string or binary column without a copy; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    at = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut by rows so that each part holds about `limit` bytes of text, or one text."""
    _, at = offsets(batch.column(column))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str = "text") -> DataFrame:
    """Apply make()(slice) to each slice; make runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, column):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


#: A run of blanks and newlines with the word after it, or such a run at the end.
PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: The same, with full stops and commas apart from the word before them.
FINE = re.compile(r"[ \n]*[^ \n.,]+|[ \n]*[.,][^ \n]*|[ \n]+")
#: White space in any library's eyes, other than blank and newline.
ODD_SPACE = re.compile(r"[^\S \n]")
#: A full stop or comma after a character that is neither letter nor digit: these may be one pre-token.
ODD_POINT = re.compile(r"[^\w\s.,][.,]|_[.,]")


def pieces(text: str) -> list[str]:
    """Parts that a pre-tokenizer which keeps white space before words never joins; whole where other white space is in it."""
    if ODD_SPACE.search(text):
        return [text]
    return (PIECE if ODD_POINT.search(text) else FINE).findall(text)


class Memo(dict):
    """A dict of at most `limit` entries with one older generation: what is still asked for moves on, the rest is forgotten.

    Keys over 64 characters aren't kept.
    """

    def __init__(self, of: Callable[[str], object], limit: int = 450_000):
        super().__init__()
        self.of, self.limit, self.old = of, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def word_spans(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of the texts that lie one after another in body."""
    blank = (body == 32) | ((body >= 9) & (body <= 13))
    inside = np.concatenate(([False], ~blank, [False]))
    starts_text = np.zeros(len(body) + 1, bool)
    starts_text[at[:-1]] = True
    starts_text[at[1:]] = True
    word = inside[1:-1]
    begin = word & (~inside[:-2] | starts_text[:-1])
    finish = word & (~inside[2:] | starts_text[1:])
    lo, hi = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return lo, hi, np.searchsorted(at, lo, "right") - 1


#: An odd multiplier for polynomial hashes modulo 2**64, its inverse, and the finaliser's multipliers (fixed values).
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 1024)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def prefix_hash(body: np.ndarray, base: int = BASE) -> np.ndarray:
    """n + 1 prefix sums; the hash of body[a:b] is (sum[b] - sum[a]) / base**a, see span_hash."""
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(len(body), base)[:-1], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal bytes anywhere."""
    inverse = powers(len(sums), pow(base, -1, 1 << 64))
    return mixed((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def counted(df: DataFrame, by: list[str], *sums: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(x).alias(x) for x in sums])
