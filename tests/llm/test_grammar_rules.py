"""Operator 1's grammar goes on until no pair pays or the symbols are used up."""

from collections import Counter

import numpy as np
import pytest

from lodestar.llm import grammar

FIRST = 50_257


def often(symbols, of_doc, least):
    """Pairs inside documents found `least` times or more."""
    docs = np.split(symbols, np.cumsum(of_doc)[:-1])
    return [p for p, n in Counter(p for d in docs for p in zip(d.tolist(), d[1:].tolist())).items() if n >= least]


@pytest.mark.parametrize("copies", [9, 3000])
def test_copies_shrink(copies):
    rng = np.random.default_rng(2)
    passage = rng.integers(1, FIRST, 200)
    ids = np.concatenate([np.append(passage, grammar.END) for _ in range(copies)])
    symbols, rules, of_doc = grammar.compress(ids, np.full(copies, 201), FIRST)
    assert (grammar.expand(symbols, rules, FIRST) == ids).all()
    assert len(symbols) == copies and (of_doc == 1).all()


def test_no_paying_pair_is_left():
    rng = np.random.default_rng(4)
    ids, lengths = rng.zipf(1.3, 20_000) % 3000, np.full(200, 100)
    symbols, rules, of_doc = grammar.compress(ids, lengths, FIRST)
    assert (grammar.expand(symbols, rules, FIRST) == ids).all() and len(rules) < (1 << 16) - FIRST
    assert not often(symbols, of_doc, 8)
