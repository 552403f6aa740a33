"""Edit-script text to instruction rows, many scripts at once."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.fixed_values import DIRECTIVES
from corpusforge.functions.text import splitlines, strip

_VALUES = ["file", "section", "find_method", "until_exclude"]


def parse_edit_scripts(scripts: DataFrame) -> DataFrame:
    """(script_id, script) -> script_id, seq, file, section, find_method, until_exclude, replace_with.

    Lines before a body are directives (the last one of a kind wins); a body runs to the next FILE line, whatever it
    holds.  Directives before the first FILE line form an instruction without a file.  Windows are per script, whose
    size is that of one text.
    """
    order = Window.partitionBy("script_id").orderBy("pos")
    inside = Window.partitionBy("script_id", "block").orderBy("pos")
    bare = strip(F.col("line"))
    directive = F
    for name, mark in DIRECTIVES.items():
        directive = directive.when(F.col("bare").startswith(mark), name)
    lines = (scripts.select("script_id", F.posexplode(splitlines(F.col("script"))).alias("pos", "line"))
             .withColumn("bare", bare).withColumn("directive", directive)
             .withColumn("block", F.sum(F.when(F.col("directive") == "file", 1).otherwise(0)).over(order))
             .withColumn("body_start", F.min(F.when(F.col("directive") == "replace_with", F.col("pos")))
                         .over(Window.partitionBy("script_id", "block"))))
    value = strip(F.regexp_extract("bare", r"^[A-Z_]+:(?s:(.*))\z", 1))
    head = F.coalesce(F.col("pos") < F.col("body_start"), F.lit(True)) & F.col("directive").isNotNull()
    blocks = lines.withColumn("value", value).groupBy("script_id", "block").agg(
        *[F.max_by("value", F.when(head & (F.col("directive") == name), F.col("pos"))).alias(name) for name in _VALUES],
        F.expr("listagg(line, '\n') within group (order by pos) filter (where pos > body_start)").alias("body"),
        F.count("body_start").alias("has_body"), F.count_if(head).alias("n_directives"))
    found = blocks.filter((F.col("n_directives") > 0) | (F.col("has_body") > 0))
    replaced = F.when(F.col("has_body") > 0, F.coalesce("body", F.lit("")))
    seq = F.row_number().over(Window.partitionBy("script_id").orderBy("block"))
    return found.select("script_id", seq.alias("seq"), *_VALUES, replaced.alias("replace_with"))
