"""Content-addressed reuse: results keyed by content hash, file type, level and (model levels only) model.

The file type is part of the key because the same text reduces differently under different types.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import paths
from corpusforge.functions.scale import lookup
from corpusforge.operators.reduce import normalise_level, reduce_corpus
from corpusforge.session import checkpointed, stored

KEY = ["content_sha256", "file_type", "level", "model"]
RESULT = ["reduced", "method", "reduced_size", "tokens"]
_SAME = ["content_sha256", "file_type"]


def fingerprinted(files: DataFrame, level: str, model: str | None = None) -> DataFrame:
    """Narrow rows: corpus_id, path and cache key (the model is '' where the level uses none)."""
    level = normalise_level(level)
    used = model or "" if level in ("semantic", "smart") else ""
    return files.select("corpus_id", "path", F.sha2(F.col("content"), 256).alias("content_sha256"),
                        paths.file_type(F.col("path")).alias("file_type"), F.lit(level).alias("level"),
                        F.lit(used).alias("model"))


def lookup_cached(keyed: DataFrame, cache: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """Keyed rows with stored result columns and a ``cached`` flag; a hit's method gets one suffix.

    The keys are stored first: hot ones are sought among them and then joined, and the texts behind them are hashed once.
    """
    keyed = checkpointed(keyed)
    known = cache.select(*KEY, *RESULT, F.lit(True).alias("_hit"))
    rows = lookup(keyed, known, KEY, ["corpus_id", "path"], "left", hot_rows)
    return (rows.withColumn("cached", F.coalesce("_hit", F.lit(False)))
            .withColumn("method", F.concat(F.col("method"), F.lit(" (cached)"))).drop("_hit"))


def misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keys without a stored result.  Copies collapse map-side before anything is compared."""
    return keyed.select(*KEY).distinct().join(cache.select(*KEY), KEY, "left_anti")


def upsert(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The next version of the cache: new results replace stored ones of the same key.

    Of several new results of one key, the one that sorts first by its columns enters.
    """
    columns = KEY + RESULT
    first = results.groupBy(*KEY).agg(F.min(F.struct(*RESULT)).alias("_first")).select(*KEY, "_first.*")
    kept = cache.select(*columns).join(first.select(*KEY), KEY, "left_anti")
    return kept.unionByName(first.select(*columns))


def save_cache(cache: DataFrame, folder: str, version: str) -> str:
    """Write a new version directory; readers of the old one are not disturbed."""
    target = f"{folder.rstrip('/')}/version={version}"
    cache.write.mode("errorifexists").parquet(target)
    return target


def update_cache(results: DataFrame, folder: str, digits: int = 2) -> list[str]:
    """Put new results into a stored cache and rewrite only the buckets they fall into; gives those buckets.

    A bucket holds the keys whose content hash begins with the same ``digits`` hexadecimal digits, so there are 16 ** digits of
    them, about equal, whatever the corpus.  All calls for a folder use the same number.  The new rows are complete in the shared folder before any bucket is replaced.
    """
    spark = results.sparkSession
    bucket = F.substring("content_sha256", 1, digits).alias("bucket")
    fresh = stored(results.select(*KEY, *RESULT, bucket), "cache-fresh")
    # At most 16 ** digits values.
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        there = read_cache(spark, folder).filter(F.col("bucket").isin(touched))
    else:
        there = fresh.limit(0)
    merged = stored(upsert(there, fresh).select("*", bucket), "cache-merged")
    # Buckets are split over tasks by their size.
    (merged.hint("rebalance", "bucket").sortWithinPartitions("content_sha256").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder))
    return touched


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """A cache that ``update_cache`` wrote, with its buckets."""
    kinds = {"reduced_size": "bigint", "tokens": "bigint"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in [*KEY, *RESULT, "bucket"])
    return spark.read.schema(schema).parquet(folder)


def reduce_distinct(files: DataFrame, level: str, hot_rows: int = 100_000) -> DataFrame:
    """Reduce each distinct (content, file type) once and give every copy the result.

    Copies collapse in a partial aggregate, so a group that holds a third of all rows crosses the shuffle as one row
    per task; the narrow path rows are joined back with hot contents split.
    """
    keyed = checkpointed(fingerprinted(files, level).select("corpus_id", "path", *_SAME))
    distinct = (files.select(F.sha2(F.col("content"), 256).alias("content_sha256"),
                             paths.file_type(F.col("path")).alias("file_type"), "path", "content")
                .groupBy(*_SAME).agg(F.any_value("content").alias("content"), F.min("path").alias("path")))
    # The smallest path stands for its group: it has the right type, and hash plus type make it unique.
    unique = distinct.select(F.concat_ws("/", *_SAME).alias("corpus_id"), "path", "content")
    reduced = reduce_corpus(unique, level)
    results = reduced.select(F.substring_index("corpus_id", "/", 1).alias("content_sha256"), "file_type", "level",
                             "method", "reduced", "original_size", "reduced_size", "tokens", "ratio")
    return lookup(keyed, results, _SAME, ["corpus_id", "path"], "inner", hot_rows)
