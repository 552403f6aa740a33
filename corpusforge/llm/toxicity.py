"""Toxicity by a classifier chain: linear models in turn, each fed with the probabilities of the categories before it.

Features are the distinct words of a text and their beginnings.  Statistics and models come from labelled documents;
every text is scored whole.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrow_text import LOWER, SpanHasher, Words, chunks, worker_path
from corpusforge.session import stored

#: Labelled documents that the chain is fitted on at most: those with the lowest hashes of their ids.
MAX_LABELLED = 20_000
#: Features kept per category, all of at least LEAST_Z standard deviations and LEAST_DOCS documents.
FEATURES, LEAST_Z, LEAST_DOCS = 2048, 6.0, 4
FOLDS = 5
#: Weight of recall against precision where thresholds are chosen: clean documents should stay.
BETA = 0.5
PREFIXES = (3, 4, 5, 6, 7, 8)
_GAPS = np.ones(256, bool)
_GAPS[97:123] = _GAPS[128:] = False
_SALTS = {n: np.uint64(0xA0761D6478BD642F * n % (1 << 64)) for n in PREFIXES}


def _features(texts: pa.Array, selected: np.ndarray | None = None):
    """(document, feature, count) of a chunk; features are hashes, or places in the sorted ``selected`` ones."""
    words = Words(texts, _GAPS, LOWER)
    spans = SpanHasher(words.data)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    _, at, word = np.unique(spans(words.starts, words.stops), return_index=True, return_inverse=True)
    starts, stops = words.starts[at], words.stops[at]
    kinds = [(np.arange(len(at)), spans(starts, stops))]
    for n in PREFIXES:
        longer = np.flatnonzero(stops - starts > n)
        kinds.append((longer, spans(starts[longer], starts[longer] + n) ^ _SALTS[n]))
    index = np.concatenate([k[0] for k in kinds])
    value = np.concatenate([k[1] for k in kinds]).view(np.int64)
    if selected is not None:
        place = np.minimum(np.searchsorted(selected, value), max(len(selected) - 1, 0))
        hit = selected[place] == value if len(selected) else np.zeros(len(value), bool)
        index, value = index[hit], place[hit]
    order = np.argsort(index, kind="stable")
    index, value = index[order], value[order]
    first = np.searchsorted(index, np.arange(len(at) + 1))
    many = np.diff(first)[word]
    docs = np.repeat(owner, many)
    flat = np.repeat(first[:-1][word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    values, codes = np.unique(value[flat], return_inverse=True)
    pairs, counts = np.unique(docs * max(len(values), 1) + codes, return_counts=True)
    return pairs // max(len(values), 1), values[pairs % max(len(values), 1)] if len(pairs) else value[:0], counts


def _select(labelled: DataFrame, categories: list[str]) -> np.ndarray:
    """Sorted hashes of the features that tell documents of some category from the others."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                docs, values, _ = _features(batch.column("text"))
                feature, code = np.unique(values, return_inverse=True)
                marks = [np.bincount(code, weights=batch.column(c).to_numpy()[docs], minlength=len(feature)) for c in categories]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(feature), pa.array(np.bincount(code, minlength=len(feature)))]
                    + [pa.array(m.astype(np.int64)) for m in marks], names=["feature", "n", *categories])

    schema = ", ".join(f"{c} long" for c in ["feature", "n", *categories])
    # All documents of a feature count, whatever chunks they are in; features without one inside a category can't be chosen.
    sums = labelled.select("text", *categories).mapInArrow(count, schema).groupBy("feature").agg(
        *[F.sum(c).alias(c) for c in ["n", *categories]]).filter(
        (F.col("n") >= LEAST_DOCS) & (F.greatest(*[F.col(c) for c in categories], F.lit(0)) > 0))
    whole = labelled.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    sums, chosen = stored(sums, "toxicity-features"), []
    for c in categories:
        inside, outside = max(whole[c] or 0, 1), max(whole["n"] - (whole[c] or 0), 1)
        rate = F.col("n") / F.lit(max(whole["n"], 1))
        spread = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) * F.lit(1 / inside + 1 / outside))
        z = F.try_divide(F.col(c) / F.lit(inside) - (F.col("n") - F.col(c)) / F.lit(outside), spread)
        best = sums.withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(FEATURES)
        chosen += [r["feature"] for r in best.select("feature").collect()]
    return np.unique(np.array(chosen, np.int64))


class _Rows:
    """Sparse rows: value ``v`` at (row ``r``, column ``c``), and dense columns to the right."""

    def __init__(self, r, c, v, n_rows: int, n_columns: int, dense: np.ndarray):
        self.r, self.c, self.v, self.n, self.m, self.dense = r, c, v, n_rows, n_columns, dense

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.r, self.v * w[self.c], self.n) + self.dense @ w[self.m:]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.c, self.v * g[self.r], self.m), g @ self.dense])

    def some(self, keep: np.ndarray) -> "_Rows":
        at, inside = np.cumsum(keep) - 1, keep[self.r]
        return _Rows(at[self.r[inside]], self.c[inside], self.v[inside], int(keep.sum()), self.m, self.dense[keep])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(x: _Rows, y: np.ndarray, steps: int = 400, rate: float = 0.3, penalty: float = 2.0) -> np.ndarray:
    """L2-regularised logistic regression by Adam steps on all rows; the last dense column is the constant."""
    w, m, s = (np.zeros(x.m + x.dense.shape[1]) for _ in range(3))
    free = np.ones(len(w))
    free[-1] = 0
    for t in range(1, steps + 1):
        g = (x.back(_sigmoid(x.times(w)) - y) + penalty * free * w) / max(x.n, 1)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - rate / np.sqrt(t) * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
    return w


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str]) -> dict:
    """Fit the chain on labelled documents: selected features, one weight vector per category, and its threshold.

    ``labels`` has doc_id and a 0/1 column per category; rows with a null are left out and repeated ids count as positive
    if one is.  A category's model sees the features and the out-of-fold log-odds of the categories before it; its
    threshold is the one with the best F-score out of fold, of those that are right in half of the cases or more.  Without such a threshold, labelled or positive rows a category is never found.
    """
    worker_path(docs.sparkSession)
    sample = (labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*[F.max(c).cast("long").alias(c) for c in categories])
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    # At most MAX_LABELLED narrow rows.
    labelled = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "toxicity-labelled")
    selected = _select(labelled, categories)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                rows, columns, counts = _features(batch.column("text"), selected)
                cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int64))) for v in (columns, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in categories], *lists],
                                                 names=["doc_id", *categories, "columns", "counts"])

    schema = ", ".join(["doc_id long", *[f"{c} long" for c in categories], "columns array<long>, counts array<long>"])
    got = labelled.select(F.col("doc_id").cast("long"), "text", *categories).mapInArrow(extract, schema).orderBy("doc_id").collect()
    n = len(got)
    model = {"selected": selected, "categories": categories, "weights": [], "thresholds": []}
    r = np.repeat(np.arange(n), [len(g["columns"]) for g in got])
    c = np.array([i for g in got for i in g["columns"]], np.int64)
    v = np.log1p(np.array([i for g in got for i in g["counts"]], float))
    folds, earlier = np.arange(n) % FOLDS, np.zeros((n, 0))
    for name in categories:
        y = np.array([g[name] for g in got], float)
        x = _Rows(r, c, v, n, len(selected), np.hstack([earlier, np.ones((n, 1))]))
        if not 0 < y.sum() < n or n < 2 * FOLDS:
            model["weights"].append(np.concatenate([np.zeros(x.m + earlier.shape[1]), [-30.0]]))
            model["thresholds"].append(0.5)
            earlier = np.hstack([earlier, np.full((n, 1), _logit(np.zeros(1)))])
            continue
        held = np.zeros(n)
        for k in range(FOLDS):
            held[folds == k] = x.some(folds == k).times(_fit(x.some(folds != k), y[folds != k]))
        held = _sigmoid(held)
        order = np.argsort(-held, kind="stable")
        hits = np.cumsum(y[order])
        quality = (1 + BETA ** 2) * hits / (np.arange(1, n + 1) + BETA ** 2 * y.sum())
        quality[:-1][held[order][:-1] == held[order][1:]] = 0  # equal scores stay on one side
        quality[hits * 2 < np.arange(1, n + 1)] = 0  # wrong more often than right
        best = int(np.argmax(quality))
        below = held[order][best + 1] if best + 1 < n else 0.0
        model["weights"].append(_fit(x, y))
        model["thresholds"].append(float((held[order][best] + below) / 2) if quality[best] else 2.0)
        earlier = np.hstack([earlier, _logit(held)[:, None]])
    return model


def score_chain(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` as one struct column ``row``, with p_<category> and is_<category>.

    Null and empty texts have no features and get the models' constants.  The broadcast model has at most FEATURES weights
    per category.
    """
    worker_path(docs.sparkSession)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), model["categories"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for whole in batches:
            for batch in chunks(whole, "_text"):
                rows, columns, counts = _features(batch.column("_text"), chain["selected"])
                n, earlier, out = batch.num_rows, np.zeros((batch.num_rows, 0)), []
                for weights, threshold in zip(chain["weights"], chain["thresholds"], strict=True):
                    x = _Rows(rows, columns, np.log1p(counts), n, len(chain["selected"]), np.hstack([earlier, np.ones((n, 1))]))
                    p = _sigmoid(x.times(weights))
                    out += [pa.array(p), pa.array(p >= threshold)]
                    earlier = np.hstack([earlier, _logit(p)[:, None]])
                yield pa.RecordBatch.from_arrays([batch.column("row"), *out], names=[
                    "row", *[f"{k}_{name}" for name in names for k in ("p", "is")]])

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("_text"))
    row = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, ", ".join([f"row {row}", *[f"p_{name} double, is_{name} boolean" for name in names]]))


#: The categories that the labels table has, in the order of the chain.
CHAIN = ["low_quality", "toxic"]


def categories_of(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the chain, trained on those with labels, doesn't call toxic."""
    return score_chain(docs, train_chain(docs, categories_of(labels), CHAIN)).filter("not is_toxic").select("row.*")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document with the probability of each category and whether it is rejected as toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = categories_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_chain(docs, train_chain(docs, labels, CHAIN))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))
