"""Suffix-array dedup over bytes: ranks of all suffixes of a shard up to the window's depth, and what ranks share."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.repeats import bytes_of, kept_bytes, repeated_runs, without_repeats

WINDOW, GRAM = 200, 32


def suffix_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` symbols; equal ranks are equal prefixes.

    Ranks at twice a depth come from sorting pairs of ranks; beyond the end comes rank 0.
    """
    ranks, have = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1, 1
    while have < depth:
        step = min(have, depth - have)
        later = np.zeros_like(ranks)
        later[:-step or None] = ranks[step:]
        ranks = np.unique(ranks * (len(ranks) + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        have += step
    return ranks


def suffix_runs(strings: list[np.ndarray], weights: list[int], window: int) -> list[list[list[int]]]:
    """Runs of every string that windows with two places, by the strings' weights, cover."""
    cuts = np.cumsum([0, *[len(s) for s in strings]])
    ranks = suffix_ranks(np.concatenate(strings), window)
    owner = np.repeat(np.arange(len(strings)), np.diff(cuts))
    starts = np.flatnonzero(np.arange(len(ranks)) + window <= cuts[1:][owner])
    places = np.bincount(ranks[starts], np.array(weights)[owner[starts]], len(ranks) + 2)
    hit = starts[places[ranks[starts]] >= 2]
    marks = np.zeros(len(ranks) + 1, np.int64)
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + window, -1)
    gone = np.cumsum(marks[:-1]) > 0
    first, last = gone.copy(), gone.copy()
    first[1:] &= ~gone[:-1] | (owner[1:] != owner[:-1])
    last[:-1] &= ~gone[1:] | (owner[1:] != owner[:-1])
    out: list[list[list[int]]] = [[] for _ in strings]
    for a, b in zip(np.flatnonzero(first), np.flatnonzero(last) + 1, strict=True):
        base = int(cuts[owner[a]])
        out[owner[a]].append([int(a) - base, int(b) - base])
    return out


def deduplicated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n (bytes), n_removed, n_spans (maximal removed runs), kept (bytes that stay).

    A byte of the UTF-8 text goes when a run of ``window`` bytes that covers it also starts anywhere else, in any text; all
    runs are judged on the input.  Null and empty texts lose nothing; repeated rows lose all their runs.
    """
    runs = repeated_runs(docs, bytes_of, window, gram, suffix_runs)
    return without_repeats(docs, runs, bytes_of, kept_bytes)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
