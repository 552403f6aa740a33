"""Data-quality checks: archive documents and edit scripts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions.text import bind, json_items, json_member, json_members, json_outline, strip

#: Bytes of the documents that tests call large.  No rule reads it: every document takes the same way.
LARGE = 20_000_000


def audit_archives(documents: DataFrame) -> DataFrame:
    """(archive_id, document) -> one row per violation: archive_id, entry (0 = document), violation, is_first.

    Documents are read as outlines, so any JSON shape of any size can be inspected.  Every violation is reported; the first one
    in reading order is marked.  A valid archive gives no row.  Of members with one name the first counts.
    """
    def flaws(members, i):
        keys = F.array_compact(F.array(*[F.when(json_member(members, k).isNull(), f"missing {k}") for k in fv.REQUIRED_ENTRY_KEYS]))
        problems = F.when(members.isNotNull(), keys).otherwise(F.array(F.lit("entry not an object")))
        return F.transform(problems, lambda p: F.struct((i + 1).alias("entry"), p.alias("violation")))

    def found(doc, top, items):
        meta, files = json_member(top, "metadata"), json_member(top, "files")
        whole = (F.when(doc.isNull(), F.array(F.lit("bad json")))
                 .when(meta.isNull() | files.isNull(), F.array(F.lit("missing metadata or files")))
                 .otherwise(F.array_compact(F.array(
                     F.when(json_member(json_members(meta), fv.VERSION_KEY).isNull(), "missing format version"),
                     F.when(items.isNull(), "files not a list")))))
        entries = F.transform(items, lambda entry, i: bind(json_members(entry), lambda m: flaws(m, i)))
        return F.concat(F.transform(whole, lambda v: F.struct(F.lit(0).alias("entry"), v.alias("violation"))),
                        F.coalesce(F.flatten(entries),
                                   F.array().cast("array<struct<entry:int,violation:string>>")))

    # Bound, not columns: each row that holds them would be another copy of the outline.
    rows = bind(json_outline(F.col("document")), lambda doc: bind(json_members(doc), lambda top: bind(
        json_items(json_member(top, "files")), lambda items: found(doc, top, items))))
    return (documents.select("archive_id", F.posexplode(rows).alias("place", "v"))
            .select("archive_id", "v.entry", "v.violation", (F.col("place") == 0).alias("is_first")))


def audit_edit_scripts(scripts: DataFrame, instructions: DataFrame) -> DataFrame:
    """Per script: instruction count, instructions without a file, unknown sections (a warning) and validity.

    An empty script is valid; a script with text but no instruction is not.
    """
    no_file = strip(F.coalesce("file", F.lit(""))) == ""
    odd = F.col("section").isNotNull() & ~F.col("section").isin("METHOD", fv.PREAMBLE_SECTION, "")
    counts = instructions.groupBy("script_id").agg(
        F.count("*").alias("n"), F.count_if(no_file).alias("bad"), F.count_if(odd).alias("odd"))
    rows = scripts.select("script_id", (F.col("script") == "").alias("empty")).join(counts, "script_id", "left")
    zero = F.lit(0)
    return rows.select(
        "script_id", F.coalesce("n", zero).alias("n_instructions"), F.coalesce("bad", zero).alias("without_file"),
        F.coalesce("odd", zero).alias("unknown_sections"),
        F.when(F.col("n").isNull(), F.col("empty")).otherwise(F.col("bad") == 0).alias("valid"))
