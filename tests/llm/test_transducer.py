"""Operator 5 against the library on texts that its units and chunks make hard."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lodestar.llm import transducer

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
PARTS = ["▁", " ", "  ", "▁ ", "\n", "\t", "a", "the", "ing", "s", "é", "日", "😀", ".", ",", ">", "|", "0", "12", "\0", "\1", "<s>", "<unk>", "\u200b", "\xa0", "ﬁ"]


def mixtures(n, seed, longest=24):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(longest))) for _ in range(n)] + ["▁ ", ".>▁ ", "▁", " ▁", "a▁ b ▁c▁▁ d"]


def test_literal_marks_and_controls():
    t, texts = transducer.compiled(PIECES), mixtures(20_000, 3)
    assert [t.count(x) for x in texts] == [len(x) for x in LIBRARY.encode(texts, num_threads=1)]


@pytest.mark.parametrize("size", [1, 3, 17, 64])
def test_chunks_cut_anywhere(monkeypatch, size):
    t, texts = transducer.compiled(PIECES), [*mixtures(1500, size, 40), "some words " * 20 + "w" * 300 + "   and  blanks   " * 9 + " " * 90 + "日本 語 " * 9]
    monkeypatch.setattr(transducer, "CHUNK", size)
    assert [t.count(x) for x in texts] == [len(x) for x in LIBRARY.encode(texts, num_threads=1)]


def test_maps_compose_associatively():
    t = transducer.compiled(PIECES)
    rng = random.Random(1)
    text = "".join(rng.choice(["▁", "a", "b", "in", "g", "th", "e", "日"]) for _ in range(400))
    maps = [transducer.ChunkMap(t, text[i : i + 9]) for i in range(0, len(text), 9)]
    join = transducer.Composed
    left = maps[0]
    for m in maps[1:]:
        left = join(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = join(m, right)
    # entered in every state that the text itself leads to, not from the start alone
    states = {t.run(text[:i])[0] for i in range(len(text))}
    for s in states:
        assert left(s) == right(s) == transducer.scan(maps)(s) == t.run(text, s)


def test_few_states_are_kept(monkeypatch):
    t = transducer.Transducer(transducer.compiled(PIECES).scores, most=50)
    monkeypatch.setattr(transducer, "CHUNK", 30)
    monkeypatch.setattr(transducer, "MOST_PAIRS", 40)
    texts = mixtures(200, 8, 900)
    assert [t.count(x) for x in texts] == [len(x) for x in LIBRARY.encode(texts, num_threads=1)]


def test_unbroken_text_through_spark(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(1_000_000)), "ab▁" * 300_000, "a" * 200_001]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = transducer.count_tokens(docs, PIECES).orderBy("doc_id").select("n_tokens", F.col("over_limit")).collect()
    assert [tuple(r) for r in got] == [(len(LIBRARY.encode(x)), True) for x in texts]
