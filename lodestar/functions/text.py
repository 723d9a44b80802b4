"""Text functions: normal forms, shapes, HTML to text, spans by Arrow UDF, indel ratio, JSON paths."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What looks like an identifier: letters, then digits, with dashes (fixed value).
IDENTIFIER = r"\b[A-Za-z]{2,}-?[0-9]{3,}\b"
#: Abbreviations that don't end a sentence (fixed values).
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "st", "no", "vs", "etc", "e.g", "i.e")
#: Type of spans: code points start_at to end_at and what is there.
SPANS = T.ArrayType(T.StructType([T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType()), T.StructField("surface", T.StringType())]))
#: White space and word characters of any script, for both Python's and Java's patterns (fixed values).
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}]"
#: A word with inner . @ + or -, or one character that is neither in a word nor white space.
TOKEN = rf"{WORD}+(?:[.@+-]{WORD}+)*|[^{SPACE}\p{{L}}\p{{N}}]"


def slug(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "[^0-9A-Za-z]+", "_"), F.lit("_")))


def normalised(c: Column) -> Column:
    """Trimmed, lower case, single blanks, no punctuation at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[ \\t\\n\\r]+", " "), "[.,;:!?]+$", "")


def shape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[A-Za-z]", "A"), "[0-9]", "9")


def statement_shape(c: Column) -> Column:
    """SQL without comments, literals as ?, single blanks, lower case."""
    for pattern, to in (("(?s)/\\*.*?\\*/", " "), ("--[^\\n]*", " "), ("'[^']*'", "?"), ("\\b[0-9]+(\\.[0-9]+)?\\b", "?"), ("\\s+", " ")):
        c = F.regexp_replace(c, pattern, to)
    return F.lower(F.trim(c))


def question_tokens(c: Column) -> Column:
    """Distinct lower-case tokens of over two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: F.length(x) > 2))


def overlap_score(c: Column, words: Column) -> Column:
    return F.size(F.array_intersect(question_tokens(c), words))


def parsed_date(c: Column, formats: Sequence[str] = ("dd/MM/yyyy", "dd.MM.yyyy", "MMM d, yyyy")) -> Column:
    """An ISO date at the start, else the first format that fits, else null."""
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(iso, *[F.try_to_date(c, f) for f in formats])


def html_to_text(c: Column) -> Column:
    """No scripts and styles, a line for each br, p and div, no tags; entities are resolved by an Arrow UDF only where there are any."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)<br\s*/?>|</(p|div)\s*>", "\n"), r"(?s)<[^>]*>", "")
    return F.when(bare.contains("&"), unescaped(bare)).otherwise(bare)


@F.pandas_udf(T.StringType())
def unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def tokens(c: Column) -> Column:
    """Words (with inner . @ + -) and single punctuation marks; null has none."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.array())


def token_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0))


def pattern_spans(pattern: str):
    """An Arrow UDF of the spans of a pattern's first group, or of all of it."""

    @F.pandas_udf(SPANS)
    def spans(s: pd.Series) -> pd.Series:
        find = re.compile(pattern)
        group = min(find.groups, 1)
        return s.map(lambda t: [(m.start(group), m.end(group), m.group(group)) for m in find.finditer(t or "")])

    return spans


def _units(text: str) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for m in re.finditer(r"[.!?]+(?=\s|$)", text):
        word = text[at : m.start()].rsplit(None, 1)[-1:] or [""]
        if m.group() == "." and (word[0].lower().lstrip("(\"'") in ABBREVIATIONS or re.fullmatch(r"[A-Z]", word[0])):
            continue
        out.append((at, m.end()))
        at = m.end()
    out.append((at, len(text)))
    trimmed = []
    for a, b in out:
        part = text[a:b]
        a += len(part) - len(part.lstrip())
        b -= len(part) - len(part.rstrip())
        if a < b:
            trimmed.append((a, b, text[a:b]))
    return trimmed


@F.pandas_udf(SPANS)
def sentence_spans(s: pd.Series) -> pd.Series:
    """Sentences; abbreviations and initials don't end one."""
    return s.map(lambda t: _units(t or ""))


def indel_ratio(a: str, b: str) -> float:
    """1 - insertions and deletions / both lengths, by the longest common subsequence."""
    if not a and not b:
        return 1.0
    # bits of `row`: positions of b where the subsequence doesn't grow
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for c in a:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    common = len(b) - row.bit_count()
    return 2 * common / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b)])


def cue_pattern(phrase: str, gap_words: int = 3) -> str:
    """A phrase as a pattern with word bounds; * is up to gap_words words."""
    words = [rf"(?:\w+\s+){{0,{gap_words}}}" if w == "*" else re.escape(w) + r"\s+" for w in phrase.split()]
    return r"(?i)\b" + "".join(words).removesuffix(r"\s+") + r"\b"
