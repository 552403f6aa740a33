"""Aggregations over corpora and archives; every one is a partial plus final hash aggregate."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.paths import suffix


def archive_totals(entries: DataFrame, by: str = "archive_id") -> DataFrame:
    return entries.groupBy(by).agg(
        F.count("*").alias("total_files"), F.sum("original_size_bytes").alias("total_original_size_bytes"),
        F.sum("compressed_size_bytes").alias("total_compressed_size_bytes"),
        F.sum("estimated_tokens").alias("total_estimated_tokens"))


def corpus_stats(requested: DataFrame, sizes: DataFrame) -> DataFrame:
    """Requested files, and total, largest and smallest size of the readable ones (0 when there are none)."""
    rows = requested.join(sizes.select("corpus_id", "path", "size_bytes"), ["corpus_id", "path"], "left")
    return rows.groupBy("corpus_id").agg(
        F.count("*").alias("total_files"), *[F.coalesce(f("size_bytes"), F.lit(0)).alias(n) for n, f in [
            ("total_size_bytes", F.sum), ("largest_file_size", F.max), ("smallest_file_size", F.min)]])


def extension_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("corpus_id", suffix(F.col("path")).alias("extension")).agg(F.count("*").alias("n_files"))


def compression_summary(reduced: DataFrame) -> DataFrame:
    """Totals by level and file type."""
    return reduced.groupBy("level", "file_type").agg(
        F.count("*").alias("n_files"), F.sum("original_size").alias("original_bytes"),
        F.sum("reduced_size").alias("reduced_bytes"), F.sum("tokens").alias("tokens"))


def method_summary(reduced: DataFrame, waits: DataFrame) -> DataFrame:
    """Files per method with total and average wait."""
    rows = reduced.select("corpus_id", "path", "method").join(waits, ["corpus_id", "path"], "left")
    waited = F.coalesce("waited_s", F.lit(0.0))
    return rows.groupBy("method").agg(F.count("*").alias("n_files"), F.sum(waited).alias("total_wait"),
                                      F.avg(waited).alias("avg_wait"))


def cache_stats(lookups: DataFrame) -> DataFrame:
    """Hits, misses, lookups and hit rate of ``cache.lookup_cached`` rows."""
    rows = lookups.agg(F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"),
                       F.count("*").alias("total_lookups"))
    return rows.withColumn("hit_rate_percent", F.when(
        F.col("total_lookups") == 0, 0.0).otherwise(F.col("hits") / F.col("total_lookups") * 100))


def audit_counts(entries: DataFrame, plan: DataFrame, pattern: str) -> DataFrame:
    """Per archive: entries matching a listing pattern, entries to extract, all entries."""
    listed = entries.groupBy("archive_id").agg(F.count_if(F.col("path").rlike(pattern)).alias("matched"),
                                               F.count("*").alias("total"))
    extracted = plan.groupBy("archive_id").agg(F.count_if(F.col("action") == "write").alias("extracted"))
    return listed.join(extracted, "archive_id")
