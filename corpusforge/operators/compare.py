"""Method-level comparison of two snapshots and the edit instructions that turn one into the other."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions.paths import basename
from corpusforge.functions.text import join_lines, lstrip, newline_split, splitlines, starts_with_any, strip
from corpusforge.operators.structure import KEYS, definitions
from corpusforge.session import stored


def _normalised(source: Column) -> Column:
    lines = F.transform(splitlines(source), lambda line: strip(line))
    return strip(join_lines(F.filter(lines, lambda line: line != "")))


def changed_files(old: DataFrame, new: DataFrame, how: str = "full_outer") -> DataFrame:
    """corpus_id, path, old_content, new_content of the files whose content differs, stored.

    Both snapshots are read once; unchanged files are dropped here, before anything is parsed.  A file of one snapshot only has
    a null on the other side (left out with ``how`` inner).
    """
    before = old.select(*KEYS, F.col("content").alias("old_content"))
    after = new.select(*KEYS, F.col("content").alias("new_content"))
    pairs = before.join(after, KEYS, how)
    return stored(pairs.filter(~F.col("old_content").eqNullSafe(F.col("new_content"))), "changed-files")


def _compared(pairs: DataFrame) -> DataFrame:
    """Added, removed and modified definitions of ``changed_files``, with the line where the old one's search for the following
    definition starts.

    Both versions of all files go through one pass of the parser, as files of a corpus each.  There is one definition per name,
    file and version: the last in walk order (deepest, then lowest); the end line is that of the first.
    """
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_content").alias("content")) for side in ("old", "new")])
    tagged = F.concat("x.side", F.lit(":"), F.coalesce("corpus_id", F.lit("")))
    files = pairs.select(*KEYS, F.explode(sides).alias("x")).filter("x.content is not null").select(
        tagged.alias("corpus_id"), "path", "x.content")
    place, is_old = F.struct("indent", "start_line"), F.col("corpus_id").startswith("old:")
    found = definitions(files).select(F.substring("corpus_id", 5, 1 << 30).alias("corpus_id"), "path", "name", "source", "signature", "end_line",
                                      F.when(is_old, place).alias("old"), F.when(~is_old, place).alias("new"))
    rows = found.groupBy(*KEYS, F.col("name").alias("method_name")).agg(
        *[F.max_by(value, side).alias(f"{side}_{value}") for value in ("signature", "source") for side in ("old", "new")],
        F.min_by("end_line", "old").alias("end_line"))
    change = (F.when(F.col("old_source").isNull(), "added").when(F.col("new_source").isNull(), "removed")
              .when(_normalised(F.col("old_source")) != _normalised(F.col("new_source")), "modified"))
    return rows.withColumn("change_type", change).filter(F.col("change_type").isNotNull())


def compare_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and modified definitions per file."""
    return _compared(changed_files(old, new)).select(
        *KEYS, "change_type", "method_name", "old_signature", "new_signature", "old_source", "new_source")


def next_definition(files: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of ``ends`` (with corpus_id, path, end_line) plus ``following``: the first later line that opens a
    definition, stripped; '' if there is none.

    Ends and definition lines share one pass from the bottom of each file upwards (a forward as-of match).
    """
    lines = F.transform(splitlines(F.col("content")), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    heads = F.filter(lines, lambda x: starts_with_any(lstrip(x.line), fv.DEFINITION_STARTS))
    opened = files.select(*KEYS, F.explode(heads).alias("x")).select(
        *KEYS, F.col("x.line_no").alias("end_line"), strip(F.col("x.line")).alias("_head"))
    asked = ends.withColumn("_asked", F.lit(1))
    upwards = Window.partitionBy(*KEYS).orderBy(F.desc("end_line"), F.desc("_asked"))
    found = F.last("_head", ignorenulls=True).over(upwards.rowsBetween(Window.unboundedPreceding, 0))
    return (asked.unionByName(opened, allowMissingColumns=True).withColumn("following", F.coalesce(found, F.lit("")))
            .filter("_asked = 1").drop("_asked", "_head"))


def generate_edits(old: DataFrame, new: DataFrame, whole_path: bool = False) -> DataFrame:
    """Edit instructions per file: script_id, seq, file, section, find_method, until_exclude, replace_with.

    A file is named by its base name, or by its path for scripts that address whole trees.  Order within a script is
    by change type and name.  Files present in only one snapshot give no instructions.
    """
    pairs = changed_files(old, new, "inner")
    rows = next_definition(pairs.withColumnRenamed("old_content", "content"), _compared(pairs))
    added, removed = F.col("change_type") == "added", F.col("change_type") == "removed"
    order = Window.partitionBy(*KEYS).orderBy("change_type", "method_name")
    return rows.select(
        F.concat_ws(":", *KEYS).alias("script_id"), F.row_number().over(order).alias("seq"),
        (F.col("path") if whole_path else basename(F.col("path"))).alias("file"),
        F.lit(None).cast("string").alias("section"),
        F.when(added, "").otherwise(F.col("old_signature")).alias("find_method"),
        F.when(added, "").otherwise(F.col("following")).alias("until_exclude"),
        F.when(removed, "").otherwise(F.col("new_source")).alias("replace_with"))


def render_edit_scripts(instructions: DataFrame) -> DataFrame:
    """script_id, script: the text form of each script (bounded by the edits of one file)."""
    step = F.concat(F.lit("FILE: "), "file", F.lit("\nFIND_METHOD: "), "find_method", F.lit("\nUNTIL_EXCLUDE: "),
                    "until_exclude", F.lit("\nREPLACE_WITH:\n"), "replace_with", F.lit("\n"))
    return (instructions.withColumn("step", step).groupBy("script_id")
            .agg(F.expr("listagg(step, '') within group (order by seq)").alias("script")))
