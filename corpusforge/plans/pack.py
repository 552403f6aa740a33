"""End-to-end plans: pack a corpus into archives, and carry a snapshot's changes into another corpus."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators import budget, compare, edits, filters, reduce
from corpusforge.session import stored
from corpusforge.sources import archives


def pack(files: DataFrame, level: str, extensions: list[str] | None = None, max_tokens: int = 0,
         created: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Filter, reduce, rank, fit the token budget; returns archive entries and archive metadata."""
    reduced = reduce.reduce_corpus(filters.by_extension(files, extensions), level)
    if max_tokens:
        # Ranking needs the token counts and packing the text: reduce once, read twice.
        reduced = stored(reduced, "reduced")
        kept = budget.budget_fit(reduced, max_tokens).select("corpus_id", "path", "importance_score")
        reduced = reduced.join(kept, ["corpus_id", "path"])
    else:
        reduced = reduced.withColumn("importance_score", budget.importance(F.col("path")))
    entries = archives.archive_entries(reduced)
    return entries, archives.archive_metadata(entries, reduce.normalise_level(level), max_tokens, created)


def carry_edits(old: DataFrame, new: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Generate the edits between two snapshots and apply them to ``target``; returns new corpus and report."""
    scripts = compare.generate_edits(old, new, whole_path=True).withColumn(
        "corpus_id", F.expr("left(script_id, length(script_id) - length(file) - 1)"))
    applied = stored(edits.apply_edits(scripts, target), "applied")
    return edits.patched_corpus(target, applied), edits.apply_report(applied)
