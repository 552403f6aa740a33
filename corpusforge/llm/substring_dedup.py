"""Substring dedup over words: suffix automata of reference shards, matching statistics, maximal spans removed.

A shard is the distinct regions of some anchors (see ``repeats``).  Its automaton is not broadcast to all documents: only
regions of the same anchors can match in it, so they are brought to it instead, and no text meets every shard.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.repeats import kept_words, repeated_runs, without_repeats, words_of

WINDOW, GRAM = 35, 8


class SuffixAutomaton:
    """All substrings of weighted strings, with the number of places where each ends."""

    def __init__(self, strings: list[list[int]], weights: list[int]):
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for string, weight in zip(strings, weights, strict=True):
            last = 0
            for symbol in string:
                last = self._extend(last, symbol)
                self.count[last] += weight
        for state in np.argsort(-np.array(self.length), kind="stable").tolist()[:-1]:
            self.count[self.link[state]] += self.count[state]

    def _extend(self, last: int, symbol: int) -> int:
        steps, link, length = self.steps, self.link, self.length
        known = steps[last].get(symbol)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, symbol, known)
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.count.append(0)
        at = last
        while at >= 0 and symbol not in steps[at]:
            steps[at][symbol] = new
            at = link[at]
        if at >= 0:
            known = steps[at][symbol]
            link[new] = known if length[known] == length[at] + 1 else self._split(at, symbol, known)
        return new

    def _split(self, at: int, symbol: int, state: int) -> int:
        """A state of its own for the substrings of ``state`` that are one longer than those of ``at``."""
        clone = len(self.steps)
        self.steps.append(self.steps[state].copy())
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[state])
        self.count.append(0)
        self.link[state] = clone
        while at >= 0 and self.steps[at].get(symbol) == state:
            self.steps[at][symbol] = clone
            at = self.link[at]
        return clone

    def repeats(self, string: list[int], least: int) -> list[list[int]]:
        """Maximal runs of a streamed string that substrings of ``least`` symbols or more with two places cover."""
        steps, link, length, count = self.steps, self.link, self.length, self.count
        state = matched = 0
        runs: list[list[int]] = []
        for i, symbol in enumerate(string):
            while state and symbol not in steps[state]:
                state = link[state]
                matched = length[state]
            if symbol in steps[state]:
                state, matched = steps[state][symbol], matched + 1
                while state and count[state] < 2:
                    state = link[state]
                    matched = length[state]
            if matched >= least:
                begin = i + 1 - matched
                while runs and runs[-1][1] >= begin:
                    begin = min(begin, runs.pop()[0])
                runs.append([begin, i + 1])
        return runs


def automaton_runs(strings: list[np.ndarray], weights: list[int], window: int) -> list[list[list[int]]]:
    numbers = np.unique(np.concatenate(strings), return_inverse=True)[1]
    cuts = np.cumsum([0, *[len(s) for s in strings]])
    plain = [numbers[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
    automaton = SuffixAutomaton(plain, weights)
    return [automaton.repeats(s, window) for s in plain]


def deduplicated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n (words), n_removed, n_spans, kept (bytes: words joined by one space).

    A word goes when a run of ``window`` words that covers it also starts anywhere else, in any text; all runs are judged on
    the input.  Null and empty texts, and texts under ``window`` words, lose nothing; repeated rows lose all their runs.
    """
    runs = repeated_runs(docs, words_of, window, gram, automaton_runs)
    return without_repeats(docs, runs, words_of, kept_words)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicated_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
