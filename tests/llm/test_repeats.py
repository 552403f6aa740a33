"""Repeated passages against brute force, for words and bytes, and the automaton itself."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusforge.llm.repeats import bytes_of, regions
from corpusforge.llm.substring_dedup import SuffixAutomaton, automaton_runs, deduplicated_words
from corpusforge.llm.suffix_dedup import deduplicated_bytes, suffix_ranks, suffix_runs
from tests.llm.conftest import rows_of


def covered(strings, window):
    """Per string: which symbols lie in a window that starts in two places or more."""
    places = Counter(tuple(s[i:i + window]) for s in strings for i in range(len(s) - window + 1))
    for s in strings:
        marks = [False] * len(s)
        for i in range(len(s) - window + 1):
            if places[tuple(s[i:i + window])] > 1:
                marks[i:i + window] = [True] * window
        yield marks


def passages(seed):
    """Texts of few words with shared passages, repeats inside a text, periodic text, and copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta ü".split())
    shared = [[word() for _ in range(rng.randint(30, 80))] for _ in range(4)]
    texts = []
    for _ in range(25):
        parts = [[word() for _ in range(rng.randint(0, 60))]]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), [word() for _ in range(rng.randint(0, 20))]]
        texts.append(" ".join(w for p in parts for w in p))
    return [*texts, texts[0], texts[1] + " tail", "a b " * 60, "x", "", None, "  ", "y" * 900, "y" * 450 + "z" + "y" * 300]


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, documents, seed):
    texts = passages(seed)
    found = deduplicated_words(documents(*texts))
    split = [(t or "").split() for t in texts]
    want = []
    for i, (words, marks) in enumerate(zip(split, covered(split, 35), strict=True)):
        kept = " ".join(w for w, gone in zip(words, marks, strict=True) if not gone)
        want.append((i, len(words), sum(marks), kept.encode()))
    assert rows_of(found, "doc_id", "n", "n_removed", "kept") == sorted(want, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes(spark, documents, seed):
    texts = passages(seed)
    found = deduplicated_bytes(documents(*texts))
    strings = [(t or "").encode() for t in texts]
    want = []
    for i, (data, marks) in enumerate(zip(strings, covered(strings, 200), strict=True)):
        spans = sum(m and not before for m, before in zip(marks, [False, *marks], strict=False))
        want.append((i, len(data), sum(marks), spans, bytes(b for b, gone in zip(data, marks, strict=True) if not gone)))
    assert rows_of(found, "doc_id", "n", "n_removed", "n_spans", "kept") == sorted(want, key=str)


def test_repeated_and_null_ids(documents):
    long = " ".join(f"w{i}" for i in range(50))
    found = deduplicated_words(documents((1, long), (1, long), (None, "short"), (None, long + " x"), (None, None)))
    assert rows_of(found, "doc_id", "n_removed") == sorted([(1, 50), (1, 50), (None, 0), (None, 50), (None, 0)], key=str)


def test_empty_table_and_extra_columns(documents, clashing):
    assert deduplicated_words(documents().limit(0)).count() == 0
    assert deduplicated_bytes(documents().limit(0)).count() == 0
    assert rows_of(deduplicated_words(clashing("a b")), "doc_id", "n", "n_removed") == [(0, 2, 0)]


def test_every_window_has_one_region():
    rng = np.random.default_rng(5)
    data = [rng.integers(97, 99, n).astype(np.uint8) for n in (0, 5, 200, 300)]
    bounds = np.cumsum([0, *[len(d) for d in data]])
    text, start, length, anchor, region = regions(np.concatenate(data), bounds, 40, 6)
    windows = Counter((int(t), s) for t, a, n in zip(text, start, length, strict=True) for s in range(a, a + n - 39))
    assert windows == Counter((t, s) for t, d in enumerate(data) for s in range(len(d) - 39))
    assert bytes_of.__name__ == "bytes_of" and len(anchor) == len(region)


@pytest.mark.parametrize("index", [automaton_runs, suffix_runs])
def test_indexes_against_brute_force(index):
    rng = np.random.default_rng(6)
    for _ in range(30):
        strings = [rng.integers(0, 3, rng.integers(1, 40)) for _ in range(rng.integers(1, 6))]
        weights = rng.integers(1, 3, len(strings)).tolist()
        window = int(rng.integers(2, 6))
        places = Counter()
        for s, w in zip(strings, weights, strict=True):
            for i in range(len(s) - window + 1):
                places[tuple(s[i:i + window])] += w
        for s, runs in zip(strings, index(strings, weights, window), strict=True):
            want = {k for i in range(len(s) - window + 1) if places[tuple(s[i:i + window])] > 1 for k in range(i, i + window)}
            assert {k for a, b in runs for k in range(a, b)} == want


def test_automaton_counts():
    automaton = SuffixAutomaton([[1, 2, 1, 2], [1, 2]], [1, 3])
    state = 0
    for symbol in (1, 2):
        state = automaton.steps[state][symbol]
    assert automaton.count[state] == 5
    assert automaton.repeats([9, 1, 2, 9], 2) == [[1, 3]]


def test_suffix_ranks_order():
    text = np.frombuffer(b"banana", np.uint8)
    assert np.argsort(suffix_ranks(text, 6)).tolist() == [5, 3, 1, 0, 4, 2]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
