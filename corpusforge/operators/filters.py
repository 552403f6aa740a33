"""Corpus filters, availability checks and listings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions import paths
from corpusforge.functions.text import splitlines


def by_extension(files: DataFrame, extensions: list[str] | None) -> DataFrame:
    return files.filter(paths.has_extension(F.col("path"), extensions))


def by_regex(files: DataFrame, pattern: str | None) -> DataFrame:
    """Paths in which the pattern occurs anywhere."""
    return files.filter(F.col("path").rlike(pattern)) if pattern else files


def by_wildcard(files: DataFrame, pattern: str) -> DataFrame:
    """Paths matching a shell wildcard, whole or by base name; an empty pattern keeps all."""
    return files.filter(paths.matches_wildcard(F.col("path"), pattern))


def available(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested (corpus_id, path) rows whose file is in the same corpus."""
    return requested.join(files.select("corpus_id", "path"), ["corpus_id", "path"], "left_semi")


def missing(requested: DataFrame, files: DataFrame) -> DataFrame:
    return requested.join(files.select("corpus_id", "path"), ["corpus_id", "path"], "left_anti")


def union_targets(*scans: DataFrame) -> DataFrame:
    """Set union of scans by (corpus_id, path); equal paths are the same file."""
    union = scans[0]
    for scan in scans[1:]:
        union = union.unionByName(scan)
    return union.dropDuplicates(["corpus_id", "path"])


def list_archive(entries: DataFrame, archives: DataFrame, pattern: str | None = None) -> DataFrame:
    """One row per matching entry with the matched and total counts and the archive's totals.

    Counts are partial aggregates joined back (one row per archive), not a window over a whole archive.
    """
    hit = F.col("path").rlike(pattern) if pattern else F.lit(True)
    counts = entries.groupBy("archive_id").agg(F.count_if(hit).alias("matched"), F.count("*").alias("total"))
    per_archive = archives.select("archive_id", "total_original_size_bytes", "total_compressed_size_bytes",
                                  "total_estimated_tokens").join(counts, "archive_id")
    return entries.filter(hit).select("archive_id", "path").join(per_archive, "archive_id")


def list_archive_detailed(entries: DataFrame, pattern: str | None = None) -> DataFrame:
    """Sizes, ratio to one decimal, tokens, method and the first lines of each matching entry."""
    lines = splitlines(F.col("content"))

    def shorten(line):
        return F.concat(F.left(line, F.lit(fv.PREVIEW_CHARS)),
                        F.when(F.length(line) > fv.PREVIEW_CHARS, "...").otherwise(""))

    rows = by_regex(entries, pattern)
    return rows.select("archive_id", "path", "original_size_bytes", "compressed_size_bytes",
                       F.round("compression_ratio", 1).alias("ratio"), "estimated_tokens", "compression_method",
                       F.array_join(F.transform(F.slice(lines, 1, fv.PREVIEW_LINES), shorten), "\n").alias("preview"),
                       (F.size(lines) > fv.PREVIEW_LINES).alias("more"))
