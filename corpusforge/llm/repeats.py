"""Passages of at least T symbols that occur more than once: how the corpus is cut into pieces that can be compared.

Every window of T symbols is given to its anchor, the smallest of its k-gram hashes (the first of equal ones).  Windows of
one anchor are consecutive, so a text is cut into regions: the stretch of all windows of one anchor occurrence.  Each
window lies in exactly one region, and equal windows lie in regions of equal anchors.  So windows of different anchors
need no comparison, equal regions need to be carried only once with their number, and a region whose anchor occurs once
has nothing that repeats.  What is left is compared by the operator's own index, a few anchors' regions at a time.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrow_text import SpanHasher, Words, _buffers, chunks, worker_path
from corpusforge.session import shuffle_partitions, stored

#: Symbols of distinct regions that one index is meant to hold.
SHARD_SYMBOLS = 400_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the bounds of each text."""
    found = Words(texts)
    return found.hashes().view(np.int64), found.first


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return _buffers(texts)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    low, have = values, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def regions(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """(text, start, length, anchor hash, region hash) of every region of the texts; starts are in the text."""
    none = np.zeros(0, np.int64)
    if len(symbols) < window:
        return none, none, none, none, none
    spans = SpanHasher(symbols.astype(np.uint64))
    at = np.arange(len(symbols) - gram + 1)
    grams = spans(at, at + gram)
    chosen = _sliding_min(grams & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64), window - gram + 1)
    anchor = (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(anchor)]
    starts = np.flatnonzero(np.arange(len(anchor)) + window <= bounds[1:][text])
    if not len(starts):
        return none, none, none, none, none
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(anchor[starts]) != 0) | (np.diff(text[starts]) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    low, high = starts[first], starts[last] + window
    return (text[low], low - bounds[text[low]], high - low, grams[anchor[low]].view(np.int64), spans(low, high).view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """id and h name a text: rows that agree in both have the same text and so the same repeats."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"),
                       F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_runs(docs: DataFrame, symbols_of: Callable, window: int, gram: int, index: Callable) -> DataFrame:
    """(id, h, runs): runs of symbols [start, stop) of each text that repeated windows cover, in no order.

    ``index(strings, weights, window)`` gets distinct regions as arrays with their numbers of occurrences, and gives for
    each the runs that windows with two or more occurrences cover.
    """
    spark = docs.sparkSession
    worker_path(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                text, start, length, anchor, region = regions(*symbols_of(batch.column("text")), window, gram)
                owner = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(owner), batch.column("h").take(owner), pa.array(start.astype(np.int32)),
                     pa.array(length.astype(np.int32)), pa.array(anchor), pa.array(region)],
                    names=["id", "h", "start", "length", "anchor", "region"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                symbols, bounds = symbols_of(batch.column("text"))
                picks = batch.column("picks")
                owner = np.repeat(np.arange(batch.num_rows), picks.value_lengths().to_numpy())
                flat = picks.flatten()
                low = flat.field("start").to_numpy() + bounds[owner]
                strings = [symbols[a:b].tobytes() for a, b in zip(low, low + flat.field("length").to_numpy(), strict=True)]
                yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("region"), flat.field("weight"),
                                                  pa.array(strings, pa.binary())], names=["anchor", "region", "weight", "string"])

    def compare(table: pa.Table) -> pa.Table:
        # A text that stands in several rows of one id may have been fetched more than once.
        rows = {(a, r): (w, s) for a, r, w, s in zip(*[table.column(c).to_pylist() for c in (
            "anchor", "region", "weight", "string")], strict=True)}
        kind = np.uint8 if symbols_of is bytes_of else np.int64
        found = index([np.frombuffer(s, kind) for _, s in rows.values()], [w for w, _ in rows.values()], window)
        out = [(a, r, runs) for (a, r), runs in zip(rows, found, strict=True) if runs]
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                         pa.array([o[2] for o in out], pa.list_(pa.list_(pa.int32())))], names=["anchor", "region", "runs"])

    texts = _keyed(docs).select("id", "h", "text")
    every = stored(texts.mapInArrow(cut, "id long, h long, start int, length int, anchor long, region long"), "repeat-regions")
    common = stored(every.groupBy("anchor").count().filter("count > 1").select("anchor"), "repeat-anchors")
    occurrences = stored(every.join(common, "anchor", "left_semi"), "repeat-occurrences")
    wanted = stored(occurrences.groupBy("anchor", "region").agg(F.count("*").alias("weight"), F.min(F.struct(
        "id", "h", "start", "length")).alias("first")), "repeat-wanted")
    picks = wanted.groupBy("first.id", "first.h").agg(F.collect_list(F.struct(
        "anchor", "region", "weight", "first.start", "first.length")).alias("picks"))
    strings = texts.join(picks, ["id", "h"]).select("text", "picks").mapInArrow(
        fetch, "anchor long, region long, weight long, string binary")
    size = wanted.agg(F.sum(F.col("first.length").cast("long"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-size // SHARD_SYMBOLS))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard")
    found = stored(strings.groupBy(shard).applyInArrow(compare, "anchor long, region long, runs array<array<int>>"), "repeat-found")
    placed = occurrences.join(found, ["anchor", "region"]).select("id", "h", F.transform(
        "runs", lambda run: F.transform(run, lambda x: x + F.col("start"))).alias("runs"))
    return placed.groupBy("id", "h").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def without_repeats(docs: DataFrame, runs: DataFrame, symbols_of: Callable, keep: Callable) -> DataFrame:
    """Every row of (doc_id, text) with n, n_removed, n_spans and kept (bytes of what is left, by ``keep``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                units = keep(batch.column("text"))
                spans, out = batch.column("runs").to_pylist(), []
                for k in range(batch.num_rows):
                    n, join = units(k)
                    marks = np.zeros(n + 1, np.int64)
                    if spans[k]:
                        ends = np.array(spans[k], np.int64)
                        np.add.at(marks, ends[:, 0], 1)
                        np.add.at(marks, ends[:, 1], -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    out.append((n, int(gone.sum()), int((gone & ~np.insert(gone[:-1], 0, False)).sum()) if n else 0, join(gone)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([o[i] for o in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], names=["doc_id", "n", "n_removed", "n_spans", "kept"])

    worker_path(docs.sparkSession)
    return _keyed(docs).join(runs, ["id", "h"], "left").select(F.col("doc_id").cast("long"), "text", "runs").mapInArrow(
        run, "doc_id long, n long, n_removed long, n_spans long, kept binary")


def kept_words(texts: pa.Array):
    """Of text k: its number of words, and the words not marked, joined by one space."""
    words = Words(texts)

    def unit(k: int):
        a, b = words.first[k], words.first[k + 1]

        def join(gone: np.ndarray) -> bytes:
            left = np.flatnonzero(~gone) + a
            return b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[left], words.stops[left], strict=True))
        return int(b - a), join
    return unit


def kept_bytes(texts: pa.Array):
    data, bounds = _buffers(texts)

    def unit(k: int):
        mine = data[bounds[k]:bounds[k + 1]]
        return len(mine), lambda gone: mine[~gone].tobytes()
    return unit


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
