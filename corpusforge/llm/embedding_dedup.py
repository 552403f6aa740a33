"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrow_text import log2_ceil, worker_path
from corpusforge.llm.components import components
from corpusforge.session import stored

COSINE = 0.95
#: Share of pairs right at the threshold that meet in some table.
RECALL = 0.998
#: Rows of one bucket that a task compares at once with as many others.
BLOCK = 2000
#: Buckets up to this size are compared pair by pair in one go, larger ones as matrices.
SMALL = 32
SEED = 20240607


def tables_and_bits(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """About one row per bucket for unrelated vectors, and as many tables as the recall takes."""
    bits = max(8, log2_ceil(n))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree)), bits


def _matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) of every vector length; unusable vectors are left out."""
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        m = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
        with np.errstate(all="ignore"):
            scale = np.abs(m).max(1)
        good = np.isfinite(scale) & (scale > 0)
        m = m[good] / scale[good, None]
        yield rows[good], m / np.sqrt((m * m).sum(1))[:, None]


def _coded(vectors: DataFrame, column: str, tables: int, bits: int) -> DataFrame:
    """vec_id, v and codes (one per table) of the usable vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for rows, m in _matrices(batch.column("v")):
                size = m.shape[1]
                if size not in planes:
                    planes[size] = np.random.default_rng([SEED, size]).standard_normal((size, tables * bits))
                for k in range(0, len(rows), 2000):
                    part, taken = m[k:k + 2000], pa.array(rows[k:k + 2000])
                    codes = (part @ planes[size] > 0).reshape(len(part), tables, bits) @ powers
                    cuts = np.arange(0, codes.size + 1, tables, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(taken), batch.column("v").take(taken),
                         pa.ListArray.from_arrays(cuts, pa.array(codes.ravel()))], names=["vec_id", "v", "codes"])

    worker_path(vectors.sparkSession)
    kind = vectors.schema[column].dataType.simpleString()
    return vectors.select(F.col("vec_id").cast("long"), F.col(column).alias("v")).filter(
        "vec_id is not null").mapInArrow(run, f"vec_id long, v {kind}, codes array<long>")


def _pairs(unit: np.ndarray, code: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with equal codes, of both sides where there are two, that reach the cosine."""
    found = [np.zeros((2, 0), np.int64)]
    if side.any():
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = np.nonzero(unit[left] @ unit[right].T >= cosine)
        return left[a], right[b]
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.insert(np.diff(code[order]) != 0, 0, True)) if len(code) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(code)))
    for at, size in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        rows = order[at:at + size]
        a, b = np.nonzero(np.triu(unit[rows] @ unit[rows].T >= cosine, 1))
        found.append(np.vstack([rows[a], rows[b]]))
    small = np.repeat(sizes <= SMALL, sizes)
    ends = np.repeat(first + sizes, sizes)
    for step in range(1, min(SMALL, int(sizes.max(initial=0)))):
        at = np.flatnonzero(small & (np.arange(len(code)) + step < ends))
        for k in range(0, len(at), 100_000):
            a, b = order[at[k:k + 100_000]], order[at[k:k + 100_000] + step]
            good = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            found.append(np.vstack([a[good], b[good]]))
    return tuple(np.hstack(found))


def _compare(cosine: float):
    """Links within a group's buckets: the number per vector, and links to the first vector that each is joined with.

    A pair that met in an earlier table already is left to that table.
    """
    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, code, side = (rows.column(c).to_numpy() for c in ("vec_id", "code", "side"))
        earlier = rows.column("t")[0].as_py()
        codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[:, :earlier]
        counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at, unit in _matrices(rows.column("v").combine_chunks()):
            a, b = _pairs(unit, code[at], side[at], cosine)
            a, b = at[a], at[b]
            new = np.ones(len(a), bool)
            for k in range(0, len(a) if earlier else 0, 100_000):
                new[k:k + 100_000] = ~(codes[a[k:k + 100_000]] == codes[b[k:k + 100_000]]).any(1)
            a, b = a[new], b[new]
            counts += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            while True:
                low = np.minimum(label[a], label[b])
                before = label.copy()
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
                label = label[label]
                if (label == before).all():
                    break
        some, joined = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(np.concatenate([ids[some], ids[joined]])),
                         "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[label[joined]])]),
                         "n": pa.array(np.concatenate([counts[some], np.zeros(len(joined), np.int64)]))})
    return compare


def near_vectors(vectors: DataFrame, column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row of (vec_id, vector): vec_id, n_links, component_id, kept.

    Links are the pairs that share a bucket of some table and whose cosine, in double precision, reaches the threshold.
    Null, empty and zero vectors, those with a null or non-finite component, and those of another length link with
    nothing.  Equal vectors link like any others.  A bucket is cut into blocks and its pairs of blocks into tasks.  A row
    without id has no links and is kept; ids are taken as unique.
    """
    whole = vectors.select(F.col("vec_id").cast("long"))
    n = vectors.count()
    tables, bits = tables_and_bits(n, cosine)
    usable = vectors.filter(F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull()))
    coded = stored(_coded(usable, column, tables, bits), "vector-codes")
    entries = coded.select("vec_id", F.posexplode("codes").alias("t", "code"))
    full = stored(entries.groupBy("t", "code").count().filter("count > 1").select(
        "t", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "vector-buckets")
    met = entries.join(full, ["t", "code"]).withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "t"), F.col("blocks")).cast("int"))
    # Small buckets go to tasks together; of a larger one, block i takes part in every pair (i, j), the lower number as side 0.
    together = max(1, -(-n // BLOCK))
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("code"), F.lit(together))).otherwise(-1 - F.col("code"))
    pairs = met.select("vec_id", "t", "code", "block", group.alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = pairs.select("vec_id", "t", "code", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                          (F.col("block") > F.col("other")).cast("int").alias("side"))
    found = stored(placed.join(coded, "vec_id").groupBy("t", "bucket", "i", "j").applyInArrow(
        _compare(cosine), "a long, b long, n long"), "vector-links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    grouped = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "vec_id")
    component = F.coalesce("component", "vec_id")
    return (whole.join(counts.withColumnRenamed("node", "vec_id"), "vec_id", "left").join(grouped, "vec_id", "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
