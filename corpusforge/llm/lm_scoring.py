"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation.

The model predicts one of ``WORDS`` frequent words, the end, or a class of the other words from the word before; within its
class a word has its add-one share.  So every text has a normalised probability.  Word and word-pair counts come from
all training documents; scores read normalised log-probabilities from one table made by matrix products.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrow_text import LOWER, Words, chunks, worker_path
from corpusforge.session import stored

WORDS, CLASSES, SIZE = 1024, 32, 24
#: Words whose counts are broadcast; those of all other words are joined.
FREQUENT = 1 << 17
STEPS, NOISE, RATE = 250, 10.0, 0.05
#: Distinct words or pairs that a task gathers before it passes them on.
GATHER = 1_000_000
SEED = 11


def held_out(doc_id):
    """Documents that nothing is learnt from; those without id are learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


class _Gathered:
    """Sums by key of many small arrays."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * GATHER:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([p[1] for p in self.parts]), len(keys)).astype(np.int64)
        self.parts, self.size = [(keys, counts)], len(keys)
        return keys, counts


def _sums(docs: DataFrame, key_of) -> DataFrame:
    """(key, n): how often ``key_of`` (a function of Words that gives a key array) finds each key in the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, got = key_of(), _Gathered()

        def rows() -> pa.RecordBatch:
            keys, counts = got.merge()
            got.parts, got.size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

        for whole in batches:
            for batch in chunks(whole, "text"):
                keys, counts = np.unique(find(Words(batch.column("text"), fold=LOWER)), return_counts=True)
                got.add(keys, counts)
                if got.size > GATHER:
                    yield rows()
        if got.parts:
            yield rows()

    worker_path(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _word_keys():
    """Word hashes whose lowest bits are the word's class: its last byte."""
    def find(words: Words) -> np.ndarray:
        last = words.data[words.stops - 1] if len(words.stops) else np.zeros(0, np.uint8)
        return (words.hashes() & ~np.uint64(CLASSES - 1) | (last & np.uint8(CLASSES - 1)).astype(np.uint64)).view(np.int64)
    return find


def _model_ids(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Model numbers of words: their place in ``known`` for frequent ones, then classes."""
    place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    hit = known[place] == keys if len(known) else np.zeros(len(keys), bool)
    return np.where(hit, place, WORDS + (keys & (CLASSES - 1)))


END = WORDS + CLASSES
OUTPUTS = END + 1


def _sequence(words: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Previous and next model number at every token, ends included; a text begins after an end."""
    n = len(words.first) - 1
    tokens = np.insert(ids, words.first[1:], END)
    before = np.concatenate([[END], tokens[:-1]]) if n else tokens
    return before, tokens


def _pair_keys(known):
    def make():
        word_keys = _word_keys()

        def find(words: Words) -> np.ndarray:
            before, tokens = _sequence(words, _model_ids(word_keys(words), known.value))
            return before * OUTPUTS + tokens
        return find
    return make


def fit(pairs: np.ndarray) -> np.ndarray:
    """Log10 probabilities [word before, word] of the log-bilinear model fitted to pair counts.

    The score of a word is (vector of the word before @ bilinear matrix) . (vector of the word) + bias.  Noise-contrastive
    estimation tells counted pairs from NOISE times as many pairs with a word drawn by frequency; as all pairs are in one
    matrix, the noise is taken by its expectation.  At the end every row is normalised over all outputs.
    """
    rng, total = np.random.default_rng(SEED), max(pairs.sum(), 1.0)
    unigram = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * len(pairs))
    data = (pairs / total).astype(np.float32)
    noise = (NOISE * data.sum(1, keepdims=True) * unigram).astype(np.float32)
    shift = np.log(NOISE * unigram).astype(np.float32)
    names = {"context": rng.normal(0, 0.1, (len(pairs), SIZE)), "bilinear": np.eye(SIZE),
             "word": rng.normal(0, 0.1, (len(pairs), SIZE)), "bias": np.log(unigram)}
    w = {k: v.astype(np.float32) for k, v in names.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for t in range(1, STEPS + 1):
        predicted = w["context"] @ w["bilinear"]
        score = predicted @ w["word"].T + w["bias"] - shift
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        g = p * (data + noise) - data
        to_predicted = g @ w["word"]
        grads = {"context": to_predicted @ w["bilinear"].T, "bilinear": w["context"].T @ to_predicted,
                 "word": g.T @ predicted, "bias": g.sum(0)}
        for k, grad in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            step = RATE * (1 - t / (STEPS + 1)) * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.99 ** t)) + 1e-12)
            w[k] = w[k] - step
    score = (w["context"] @ w["bilinear"] @ w["word"].T + w["bias"]).astype(np.float64)
    score -= score.max(1, keepdims=True)
    return ((score - np.log(np.exp(score).sum(1, keepdims=True))) / math.log(10)).astype(np.float32)


def train(docs: DataFrame) -> dict:
    """Counts and model from all rows of (text); null texts are empty.  ``vocabulary`` is a table (key, n) on disk."""
    spark = docs.sparkSession
    vocabulary = stored(_sums(docs, _word_keys), "lm-words")
    ends = docs.count()
    whole = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Counts by size: at most a few hundred bands, whatever the corpus.
    band = F.floor(F.log2("n") * 8)
    bands = vocabulary.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect()
    least, size = None, 0
    for row in bands:
        size += row["count"]
        if size > FREQUENT:
            break
        least = row["band"]
    frequent = vocabulary.filter(band >= least) if least is not None else vocabulary.limit(0)
    rows = frequent.select("key", "n").toPandas().sort_values("key")
    keys, counts = rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    top = np.lexsort((keys, -counts))[:WORDS]
    known = np.sort(keys[top])
    pairs = _sums(docs, _pair_keys(spark.sparkContext.broadcast(known))).toPandas()  # at most OUTPUTS ** 2 rows
    matrix = np.zeros(OUTPUTS * OUTPUTS)
    matrix[pairs["key"].to_numpy(np.int64)] = pairs["n"].to_numpy(float)
    masses = vocabulary.groupBy(F.col("key").bitwiseAND(F.lit(CLASSES - 1)).alias("c")).agg(F.sum(F.col("n") + 1).alias("m")).collect()
    mass = np.ones(CLASSES)
    for row in masses:
        mass[row["c"]] += row["m"]
    np.subtract.at(mass, keys[top] & (CLASSES - 1), counts[top] + 1)
    return {"vocabulary": vocabulary, "n": int(whole[0]) + ends, "v": int(whole[1]) + (ends > 0), "ends": ends, "keys": keys,
            "counts": counts, "known": known, "table": fit(matrix.reshape(OUTPUTS, OUTPUTS)), "log_mass": np.log10(mass)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_tokens, n_known, base_score and score (log10 probabilities).

    The base is add-one unigrams.  Counts of frequent words and the model (bounded by FREQUENT and OUTPUTS) are broadcast;
    rarer words of a text are counted in its row and joined with the vocabulary.  Null and empty texts are one end.
    """
    spark = docs.sparkSession
    worker_path(spark)
    shared = spark.sparkContext.broadcast({k: model[k] for k in ("keys", "counts", "known", "table", "log_mass", "ends")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, word_keys = shared.value, _word_keys()
        log_counts = np.log10(m["counts"] + 1.0)
        for whole in batches:
            for batch in chunks(whole, "text"):
                words, n = Words(batch.column("text"), fold=LOWER), batch.num_rows
                keys = word_keys(words)
                owner = np.repeat(np.arange(n), np.diff(words.first))
                place = np.minimum(np.searchsorted(m["keys"], keys), max(len(m["keys"]) - 1, 0))
                hit = m["keys"][place] == keys if len(m["keys"]) else np.zeros(len(keys), bool)
                logs = np.where(hit, log_counts[place], 0.0) if len(m["keys"]) else np.zeros(len(keys))
                ids = _model_ids(keys, m["known"])
                before, tokens = _sequence(words, ids)
                ended = np.repeat(np.arange(n), np.diff(words.first) + 1)
                other = ids >= WORDS
                model_part = (np.bincount(ended, m["table"][before, tokens], n)
                              + np.bincount(owner[other], logs[other] - m["log_mass"][keys[other] & (CLASSES - 1)], n))
                rare = np.flatnonzero(~hit)
                rare_keys, rare_first = keys[rare], np.searchsorted(owner[rare], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(words.first) + 1),
                     pa.array(np.bincount(owner[hit], minlength=n) + (m["ends"] > 0)),
                     pa.array(np.bincount(owner, logs, n) + math.log10(m["ends"] + 1)), pa.array(model_part),
                     pa.ListArray.from_arrays(rare_first, pa.array(rare_keys))],
                    names=["doc_id", "n_tokens", "known", "base_part", "model_part", "rare"])

    parts = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, known long, base_part double, model_part double, rare array<long>").withColumn(
        "row", F.monotonically_increasing_id()), "lm-parts")
    rare = parts.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    found = rare.join(model["vocabulary"], "key").groupBy("row").agg(
        F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("_logs"))
    logs = F.coalesce("_logs", F.lit(0.0))
    return parts.drop("rare").join(found, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base_part") + logs - F.col("n_tokens") * F.lit(math.log10(model["n"] + model["v"] + 1))).alias("base_score"),
        (F.col("model_part") + logs).alias("score"))


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"),
        "base_score", "score")
