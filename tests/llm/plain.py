"""Plain single-process versions of the operators' contracts."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return tuple((v is None, v) for v in row)


def as_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def id_digest(ids):
    return b"".join(struct.pack("<I", i) for i in ids)


def base_rules(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, again = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), again, n < 10 or 100 * again > 20 * n


def fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=2):
    """The smallest id reachable for each (id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        ids = least.setdefault(find(i), [])
        if doc_id is not None:
            ids.append(doc_id)
    return [min(least[find(i)], default=None) for i in range(len(prints))]


def removed(docs, size=100):
    """(doc_id, bytes, removed, spans, sha256 of the rest) of documents in order; equal strings that start earlier count."""
    seen, out = set(), []
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if (s := raw[i : i + size]) in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(s)
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


def payload(text):
    raw = (text or "").encode()
    data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])
