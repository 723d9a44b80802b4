"""Operator 5: token counts from a compiled finite-state transducer over a SentencePiece BPE vocabulary.

Merging by score tokenizes every prefix of a string as a prefix of one chain: the last token of a prefix is the
one vocabulary suffix that is compatible with the last token before it (two tokens are compatible if merging
their concatenation gives just these two). So a left-to-right reader needs only the last tokens at those
positions where a token may still begin, which makes a finite state. Transitions carry the change in the number
of emitted tokens. States and transitions are interned as they are met, so a worker compiles what its texts use.

No piece of the vocabulary continues from another character into a word mark (checked when compiling), so a mark
after another character leads from every state where it leads from the start. A blank and a mark in the text itself are
one symbol to the library; texts are cut into units at runs of either. Units of short texts are remembered.

A long text is cut into chunks of `CHUNK` characters, whatever stands at their ends. The map of a chunk takes any state
to the state and the count behind the chunk: it keeps the run from the start state, and a run from another state is
followed only until it meets that one. Maps compose associatively (`Composed`), also inside one unbroken word; `scan`
composes them pairwise, level by level, as a prefix scan does.

Nulls: a null text is empty and has no tokens. Repeated rows each give a row. Other columns are ignored. Empty table:
empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, map_slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
MARK = "▁"
#: Characters of a text in one chunk of the scan.
CHUNK = 1 << 16
#: Chunks of one scan.
CHUNKS = 16
#: A run of word marks and the characters up to the next mark.
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Pairs of tokens that are remembered as compatible or not; beyond it remembering starts anew.
MOST_PAIRS = 1_000_000


class Transducer:
    """Counts the tokens of a BPE vocabulary with byte fallback."""

    def __init__(self, scores: dict[str, float], most: int = 250_000):
        """most: states that are kept compiled; beyond it compiling starts anew."""
        self.scores = scores
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        self.longest = max(map(len, scores), default=1)
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece has a word mark after another character: words aren't independent")
        self.units = Memo(self._unit)
        self.most = most
        self._reset()

    def _reset(self) -> None:
        #: A state: the longest suffix that a token may begin with, and for each cut where one may still begin (longest
        #: suffix first, the end last) the token before the cut and the tokens up to it, against the count at the end.
        start = ("", (("", 0),))
        self.states: dict[tuple, int] = {start: 0}
        self.content: list[tuple] = [start]
        #: (state, character) to (next state, tokens emitted)
        self.next: dict[int, int] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """The tokens of a short string by definition: always merge the best scored neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if not a:
            return True
        if (a, b) not in self.fits:
            if len(self.fits) >= MOST_PAIRS:
                self.fits.clear()
            self.fits[a, b] = self.merge(a + b) == [a, b]
        return self.fits[a, b]

    def step(self, state: int, char: str) -> tuple[int, int]:
        """(next state, tokens emitted) of reading a character; emitted can be negative, when tokens join."""
        if char == MARK and not self.content[state][0].endswith(MARK):
            state = 0  # a mark after another character: as from the start
        held, cuts = self.content[state]
        text, size = held + char, len(held) + 1
        live = [i for i in range(size - 1) if held[i:] in self.prefixes] + [size - 1]
        # the token that ends here begins at a live cut, is in the vocabulary (or one character) and fits what is before it
        for i, (before, emitted) in zip(live, cuts):
            token = text[i:]
            if (len(token) == 1 or token in self.scores) and self.compatible(before, token):
                break
        emitted += 1 if token in self.scores else len(char.encode())  # else byte fallback
        still = [(i, c) for i, c in zip(live, cuts) if text[i:] in self.prefixes]
        to = (text[still[0][0] :] if still else "", (*[(t, n - emitted) for _, (t, n) in still], (token, 0)))
        return self.known(to), emitted

    def known(self, content: tuple) -> int:
        """The number of a state."""
        if content not in self.states:
            self.states[content] = len(self.content)
            self.content.append(content)
        return self.states[content]

    def trimmed(self, state: int) -> int:
        """The state, after compiling has started anew if too many are kept."""
        if len(self.content) > self.most:
            content = self.content[state]
            self._reset()
            state = self.known(content)
        return state

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """(state, tokens) after reading text from a state; text has word marks for blanks."""
        count, known = 0, self.next
        for code in map(ord, text):
            key = state << 21 | code
            got = known.get(key)
            if got is None:
                to, n = self.step(state, chr(code))
                got = known[key] = to << 8 | n + 64
            state = got >> 8
            count += (got & 255) - 64
        return state, count

    def _unit(self, text: str) -> int:
        return self.run(text)[1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        state, count = self.trimmed(0), 0
        text = MARK + text.replace(" ", MARK)  # the model's dummy prefix
        if len(text) <= CHUNK:
            return sum(map(self.units.__getitem__, UNIT.findall(text)))
        # states keep their numbers within a scan of some chunks, so memory is bounded for any text
        for lo in range(0, len(text), CHUNK * CHUNKS):
            state, n = scan([ChunkMap(self, text[i : i + CHUNK]) for i in range(lo, min(len(text), lo + CHUNK * CHUNKS), CHUNK)])(state)
            state, count = self.trimmed(state), count + n
        return count


class ChunkMap:
    """From any state before a chunk to (state, tokens) behind it.

    From a unit's end on every run is the same; within the first unit (the head) a run from another state is read on only
    until it is in the state of the run from the start, which is kept: `path` has its state and count before each character.
    """

    def __init__(self, by: Transducer, text: str):
        self.by = by
        units = UNIT.findall(text)
        self.head, rest = units[0], units[1:]
        self.path = [(0, 0)]
        for char in self.head:
            state, n = by.run(char, self.path[-1][0])
            self.path.append((state, self.path[-1][1] + n))
        # units before the last are closed: the mark that follows them forgets what they end in
        self.rest = (by.run(rest[-1])[0], sum(map(by.units.__getitem__, rest))) if rest else None

    def __call__(self, state: int) -> tuple[int, int]:
        at, count = 0, 0
        while at < len(self.head) and state != self.path[at][0]:
            state, n = self.by.run(self.head[at], state)
            count += n
            at += 1
        if state == self.path[at][0]:
            state, count = self.path[-1][0], count + self.path[-1][1] - self.path[at][1]
        return (self.rest[0], count + self.rest[1]) if self.rest else (state, count)


class Composed:
    """The map of two neighbouring stretches of text, from their maps."""

    def __init__(self, first, second):
        self.first, self.second = first, second

    def __call__(self, state: int) -> tuple[int, int]:
        state, a = self.first(state)
        state, b = self.second(state)
        return state, a + b


def scan(maps: list):
    """The composition of all maps, by pairs, level by level."""
    while len(maps) > 1:
        maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


_COMPILED: dict[str, Transducer] = {}


def compiled(model_path: str) -> Transducer:
    """The transducer of a SentencePiece BPE model file; one a worker process."""
    if model_path not in _COMPILED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        _COMPILED[model_path] = Transducer({sp.id_to_piece(i): sp.get_score(i) for i in plain})
    return _COMPILED[model_path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text."""

    def make():
        t = compiled(model_path)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in part.column("text").to_pylist()]
            n = [t.count(x) for x in texts]
            return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n])})

        return step

    return map_slices(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), make, SCHEMA)
