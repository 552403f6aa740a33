"""Document quality by supervised subword embeddings.

Every word, pair of neighbouring words and run of NGRAMS bytes inside a word has a vector, found by its hash; pairs of one
word twice share a vector, so that stuttering text is known in any language.  A document is the mean of the vectors of all its
features, repeats counted, and a softmax over that mean gives its label's probability.
Vectors and output weights are learnt together by stochastic gradient descent in numpy, one labelled document at a time.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrow_text import SpanHasher, Words, chunks, mixed, worker_path
from corpusforge.session import stored

#: Labelled documents that the model is fitted on at most (lowest hashes of their ids), and the greatest size of such a text.
MAX_LABELLED, MAX_BYTES = 4000, 1 << 16
#: Vectors and their length.
BUCKETS, SIZE = 1 << 17, 10
NGRAMS = (2, 3, 4)
EPOCHS, RATE = 3, 1.0
#: How much faster a feature's vector moves than its share of a document, which is small.
SPREAD = 30.0
#: Lowest score that is predicted as label 1.
THRESHOLD = 0.3
SEED = 5
_SALTS = {n: np.uint64(0x9FB21C651E98DF25 * (n + 1) % (1 << 64)) for n in (0, 1, *NGRAMS)}


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Vector numbers of hashes; kinds (word: 0, word pair: 1, n-gram: n) have different ones."""
    return (mixed(hashes ^ _SALTS[kind]) % np.uint64(BUCKETS)).astype(np.int64)


class _Features:
    """Features of a chunk of texts: those inside a word once per distinct word, and word pairs where they stand."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        spans = SpanHasher(words.data)
        hashes = spans(words.starts, words.stops)
        values, at, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        starts, stops = words.starts[at], words.stops[at]
        owner, bucket = [np.arange(len(at))], [_bucket(values, 0)]
        for n in NGRAMS:
            many = np.maximum(stops - starts - n + 1, 0)
            begin = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
            owner.append(np.repeat(np.arange(len(at)), many))
            bucket.append(_bucket(spans(begin, begin + n), n))
        owner, bucket = np.concatenate(owner), np.concatenate(bucket)
        order = np.argsort(owner, kind="stable")
        #: Features of distinct word k: ``bucket[first[k]:first[k + 1]]``.
        self.bucket, self.first = bucket[order], np.searchsorted(owner[order], np.arange(len(at) + 1))
        self.size = len(texts)
        self.text = np.repeat(np.arange(self.size), np.diff(words.first))
        beside = np.flatnonzero(self.text[1:] == self.text[:-1]) if len(self.text) else np.zeros(0, np.int64)
        self.pair_text = self.text[beside]
        pair = hashes[beside] * np.uint64(3) + mixed(hashes[beside + 1])
        self.pair = _bucket(np.where(hashes[beside] == hashes[beside + 1], np.uint64(0), pair), 1)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct vector numbers of every text: bounds by text, numbers, how often each."""
        many = np.diff(self.first)[self.word]
        flat = np.repeat(self.first[:-1][self.word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        keys, n = np.unique(np.concatenate([np.repeat(self.text, many) * BUCKETS + self.bucket[flat],
                                            self.pair_text * BUCKETS + self.pair]), return_counts=True)
        return np.searchsorted(keys // BUCKETS, np.arange(self.size + 1)), keys % BUCKETS, n

    def means(self, vectors: np.ndarray) -> np.ndarray:
        """Mean vector of every text; zeros for a text without words."""
        inner = _sums(vectors[self.bucket], self.first)
        sums = _sums(inner[self.word], np.searchsorted(self.text, np.arange(self.size + 1)))
        sums += _sums(vectors[self.pair], np.searchsorted(self.pair_text, np.arange(self.size + 1)))
        many = np.bincount(self.text, np.diff(self.first)[self.word], self.size) + np.bincount(self.pair_text, minlength=self.size)
        return sums / np.maximum(many, 1)[:, None]


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows by segment; an empty segment has zeros."""
    out = np.zeros((len(first) - 1, rows.shape[1]))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(rows, first[full], axis=0, dtype=np.float64)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def fit(first: np.ndarray, features: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict:
    """Vectors, output weights and constants from documents with ``features[first[k]:first[k + 1]]`` and labels 0 or 1.

    Documents come in a new random order every epoch and the rate falls to zero.  Without documents of both labels there is
    nothing to learn: the constants then give the smoothed share of each label.
    """
    rng, n = np.random.default_rng(SEED), len(labels)
    share = (np.bincount(labels, minlength=2) + 1) / (n + 2)
    vectors, weights, constants = np.zeros((BUCKETS, SIZE), np.float32), np.zeros((SIZE, 2)), np.log(share)
    if n and 0 < labels.sum() < n:
        vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
        part = (counts / np.add.reduceat(counts, first[:-1]).repeat(np.diff(first))).astype(np.float32)
        for step in range(EPOCHS * n):
            if step % n == 0:
                order = rng.permutation(n)
            k, rate = order[step % n], RATE * (1 - step / (EPOCHS * n))
            own, mine = features[first[k]:first[k + 1]], part[first[k]:first[k + 1]]
            mean = mine @ vectors[own]
            slope = _softmax(mean @ weights + constants)
            slope[labels[k]] -= 1
            back = weights @ slope
            weights -= rate * np.outer(mean, slope)
            constants -= rate * 0.1 * slope
            vectors[own] -= np.outer(mine * np.float32(rate * SPREAD), back.astype(np.float32))
    return {"vectors": vectors, "weights": weights, "constants": constants}


def train_quality(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on the documents of ``docs(doc_id, text)`` that ``labels(doc_id, label)`` marks with 0 or 1.

    Null ids and labels are left out; a repeated id counts once, as 1 if it is so marked anywhere, with its greatest text.
    Texts without words or over MAX_BYTES bytes are not learnt from.
    """
    worker_path(docs.sparkSession)
    marked = labels.dropna(subset=["doc_id", "label"]).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    wanted = docs.select("doc_id", "text").filter(F.octet_length("text") <= MAX_BYTES).filter(F.col("text").rlike("[^ \t-\r]"))
    # Only ids, so that the sample is drawn from documents that can be learnt from.
    sample = wanted.select("doc_id").join(marked, "doc_id").dropDuplicates(["doc_id"]).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    sample = stored(sample, "quality-sample")
    # At most MAX_LABELLED narrow rows are broadcast; a repeated id gives one document.
    learnt = wanted.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                first, features, n = _Features(batch.column("text")).counts()
                lists = [pa.ListArray.from_arrays(first.astype(np.int32), pa.array(v.astype(np.int32))) for v in (features, n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists],
                                                 names=["doc_id", "label", "features", "counts"])

    rows = stored(learnt.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(
        extract, "doc_id long, label int, features array<int>, counts array<int>"), "quality-features")
    # MAX_LABELLED documents of MAX_BYTES bytes at most.
    got = rows.toArrow().combine_chunks().sort_by("doc_id")
    lists = got.column("features").combine_chunks()
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]) if len(got) else np.zeros(1, np.int64)
    flat = [got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("features", "counts")]
    return fit(first, *flat, got.column("label").to_numpy().astype(np.int64))


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` as one struct column ``row``, and ``score``: the probability of label 1.

    Every row is scored by its whole text; null, empty and blank texts get the constants' score.  The broadcast model has
    BUCKETS vectors of SIZE numbers.
    """
    worker_path(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in chunks(whole, "_text"):
                means = _Features(batch.column("_text")).means(m["vectors"])
                p = _softmax(means @ m["weights"] + m["constants"])[:, 1]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p)], names=["row", "score"])

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("_text"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from; those without an id have no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op13_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from the labels of documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = train_quality(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score_quality(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
