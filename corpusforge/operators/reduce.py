"""Text reduction levels over a file corpus: files(corpus_id, path, content) -> reduced rows with measures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions import paths
from corpusforge.functions.text import (
    bind, count_of, is_blank, join_lines, lstrip, newline_split, rstrip, strip, unify_breaks,
    utf8_size,
)
from corpusforge.functions.tokens import add_tokens, keyword_count
from corpusforge.operators.signatures import signatures
from corpusforge.operators.structure import structure_skeleton
from corpusforge.session import shuffle_partitions, stored

KEYS = ["corpus_id", "path"]


def light(content: Column) -> Column:
    """Right-strip lines, squeeze blank runs to one line, drop outer blank lines."""
    lines = F.transform(F.split(unify_breaks(content), "\n"), lambda line: rstrip(line))
    squeezed = bind(join_lines(lines), lambda text: F.when(
        text.contains("\n\n\n"), F.regexp_replace(text, "\n{3,}", "\n\n")).otherwise(text))
    return strip(squeezed, "\n")


def _drop_blank_lines(text: Column) -> Column:
    return join_lines(F.filter(newline_split(text), lambda line: lstrip(line) != ""))


def _without_comments(content: Column, marker: str | None) -> Column:
    def cut(line):
        bare, gone = lstrip(line), F.lit(None).cast("string")
        head = F.substring_index(line, marker, 1)
        balanced = (count_of(head, '"') % 2 == 0) & (count_of(head, "'") % 2 == 0)
        # A null line disappears in the join.
        return (F.when((bare == "") | bare.startswith(marker), gone)
                .when(line.contains(marker) & balanced, rstrip(head)).otherwise(line))

    text = unify_breaks(content)
    if marker is None:
        return _drop_blank_lines(text)
    return F.when(content.contains(marker), join_lines(F.transform(newline_split(text), cut))).otherwise(_drop_blank_lines(text))


def medium(content: Column, file_type: Column) -> Column:
    """Drop blank and comment lines; cut trailing comments where the quotes before them are balanced."""
    return (F.when(file_type.isin(fv.HASH_COMMENT_TYPES), _without_comments(content, "#"))
            .when(file_type.isin(fv.SLASH_COMMENT_TYPES), _without_comments(content, "//"))
            .otherwise(_without_comments(content, None)))


def _regex_trailer(strength: str, file_type: Column) -> Column:
    return F.concat(F.lit(f"\n# ... ({strength} compression via regex - "), file_type, F.lit(")"))


def regex_light(content: Column, file_type: Column) -> Column:
    hashless = F.transform(newline_split(content), lambda line: F.when(
        lstrip(line).startswith("#!"), line).otherwise(F.substring_index(line, "#", 1)))
    bare = (F.when(file_type.isin(fv.SLASH_STRIP_TYPES) & content.contains("//"), F.regexp_replace(content, "//[^\n]*", ""))
            .when(file_type == "python", join_lines(hashless)).otherwise(content))
    return F.concat(_drop_blank_lines(bare), _regex_trailer("Light", file_type))


def regex_medium(content: Column, file_type: Column) -> Column:
    text = regex_light(content, file_type)
    unquoted = F.regexp_replace(F.regexp_replace(text, '(?s)""".*?"""', ""), "(?s)'''.*?'''", "")
    bare = (F.when(file_type.isin(fv.BLOCK_COMMENT_TYPES) & content.contains("/*"), F.regexp_replace(text, r"(?s)/\*.*?\*/", ""))
            .when(file_type == "python", unquoted).otherwise(text))
    return F.concat(bare, _regex_trailer("Medium", file_type))


def aggressive(content: Column, file_type: Column) -> Column:
    """Every type but Python, whose skeleton comes from the statement tables."""
    return F.coalesce(signatures(content, file_type), regex_medium(content, file_type))


def normalise_level(level: str) -> str:
    if level not in fv.LEVELS:
        raise ValueError(f"unknown level {level!r}: use one of {', '.join(fv.LEVELS)}")
    return fv.LEVELS[level]


def smart_route(file_type: Column, size: Column) -> Column:
    """The level that smart mode uses for files without a usable semantic result."""
    code = file_type.isin(fv.SMART_CODE_TYPES) & (size > fv.SMART_SEMANTIC_MIN_BYTES)

    def tiers(limits):
        return F.when(size > limits[0], "aggressive").when(size > limits[1], "medium").otherwise("light")

    return F.when(code, tiers(fv.SMART_CODE_TIERS)).otherwise(tiers(fv.SMART_OTHER_TIERS))


def typed(files: DataFrame) -> DataFrame:
    return files.select("*", paths.file_type(F.col("path")).alias("file_type"),
                        utf8_size(F.col("content")).alias("original_size"))


def dealt(files: DataFrame) -> DataFrame:
    """Files dealt evenly by their unique path.

    A scan has as many tasks as its tables have row groups or pieces of 128 MB, and reduction costs a hundred times what
    reading does, so that a few tasks would do all the work.  The explicit count keeps AQE from merging partitions by the size
    of the text.
    """
    return files.repartition(shuffle_partitions(files.sparkSession), *KEYS)


def reduce_routed(files: DataFrame, routes: set[str], label: str = fv.STRUCTURE_LABEL) -> DataFrame:
    """Reduce typed rows by their ``route`` column; ``routes`` names the values it can take.

    Python rows routed to the aggressive level need the statement tables and so are keyed and shuffled by path; all
    other rows are one narrow projection over the scan.
    """
    route, content, kind = F.col("route"), F.col("content"), F.col("file_type")
    rough = F.concat(F.lit("aggressive ("), kind, F.lit("-ast)"))
    branches = {
        "blank": lambda: (F.lit(""), F.lit(fv.METHOD_BLANK)), "none": lambda: (content, F.lit(fv.METHOD_NONE)),
        "light": lambda: (light(content), F.lit(fv.METHOD_LIGHT)),
        "medium": lambda: (medium(content, kind), F.lit(fv.METHOD_MEDIUM)),
        "aggressive": lambda: (aggressive(content, kind), rough)}
    text, method = F, F
    for name in [n for n in branches if n in routes]:
        reduced, described = branches[name]()
        text, method = text.when(route == name, reduced), method.when(route == name, described)
    if "aggressive" not in routes:
        return files.select("*", text.alias("reduced"), method.alias("method"))
    needs_skeleton = (kind == "python") & (route == "aggressive")
    plain = files.filter(~needs_skeleton).select("*", text.alias("reduced"), method.alias("method"))
    modules = files.filter(needs_skeleton)
    found = F.col("skeleton").isNotNull()
    parsed = modules.join(structure_skeleton(modules, label), KEYS, "left").select(
        *[F.col(c) for c in files.columns], F.coalesce("skeleton", medium(content, kind)).alias("reduced"),
        F.when(found, rough).otherwise(fv.METHOD_MEDIUM).alias("method"))
    return plain.unionByName(parsed)


def _only_spaced() -> Column:
    """True where a level did no more to the content than to drop or change white space and to add trailers: it found no mark of a
    comment.  Words are then those of the content.  Markdown's estimate counts marks that white space may end, so it never holds."""
    kind, route, content = F.col("file_type"), F.col("route"), F.col("content")
    unmarked = ~content.contains("#")
    by_route = (F.when(route == "light", True)
                .when(route == "medium", ~kind.isin(fv.HASH_COMMENT_TYPES) | unmarked)
                .when(kind == "python", F.col("method") == fv.METHOD_MEDIUM)
                .otherwise(F.col("reduced").endswith(_regex_trailer("Medium", kind)) & ~(kind.isin(fv.BLOCK_COMMENT_TYPES) & content.contains("/*"))))
    slashed = (((route == "medium") & kind.isin(fv.SLASH_COMMENT_TYPES)) | ((route == "aggressive") & kind.isin(fv.SLASH_STRIP_TYPES))) & content.contains("//")
    return (kind != "markdown") & route.isin("light", "medium", "aggressive") & ((kind != "python") | unmarked) & by_route & ~slashed


def measured(rows: DataFrame, words: str | None = None) -> DataFrame:
    """Add reduced size, tokens and original/reduced ratio (infinite when text vanished, 1 when there was none).

    ``words`` names the column with the keyword count of the content, where several levels of it are measured.
    """
    size = F.col("reduced_size")
    ratio = (F.when(size > 0, F.col("original_size") / size)
             .when((F.col("original_size") == 0) | (F.col("method") == fv.METHOD_BLANK), 1.0)
             .otherwise(F.lit(float("inf"))))
    sized = rows.withColumn("reduced_size", utf8_size(F.col("reduced")))
    if words is None:
        return add_tokens(sized, "reduced").withColumn("ratio", ratio)
    kind, trailed = F.col("file_type"), (F.col("route") == "aggressive") & (F.col("file_type") != "python")
    trailers = F.when(trailed, F.concat(_regex_trailer("Light", kind), _regex_trailer("Medium", kind))).otherwise("")
    spaced = sized.withColumn("_tidy", _only_spaced())
    known = F.when(F.col("_tidy"), F.col(words) + keyword_count(trailers, kind))
    return add_tokens(spaced, "reduced", words=known, tidy=F.col("_tidy")).withColumn("ratio", ratio).drop("_tidy")


ROUTES = {"none": {"none"}, "light": {"blank", "light"}, "medium": {"blank", "medium"},
          "aggressive": {"blank", "aggressive"}, "semantic": {"blank", "aggressive"},
          "smart": {"blank", "light", "medium", "aggressive"}}
PREFIXES = {"smart": "smart->", "semantic": f"{fv.METHOD_SEMANTIC}-failed, fallback to "}
COLUMNS = ["corpus_id", "path", "file_type", "level", "method", "reduced", "original_size", "reduced_size", "tokens",
           "ratio"]


def _target(level: str) -> Column:
    target = {"smart": lambda: smart_route(F.col("file_type"), F.col("original_size")),
              "semantic": lambda: F.lit("aggressive")}.get(level, lambda: F.lit(level))()
    return target if level == "none" else F.when(is_blank(F.col("content")), "blank").otherwise(target)


def reduce_levels(files: DataFrame, levels: list[str], label: str = fv.STRUCTURE_LABEL) -> DataFrame:
    """Reduced rows of several levels from one scan: files are dealt evenly and repeated per level before they are reduced.

    files -> corpus_id, path, file_type, level, method, reduced, original_size, reduced_size, tokens, ratio.
    ``smart`` and ``semantic`` here treat every file as having no model response; see operators.semantic for the
    form that takes a response table.
    """
    levels = [normalise_level(level) for level in levels]
    rows = typed(dealt(files.select(*KEYS, "content")))
    words = None if len(levels) == 1 else "_words"
    if words is None:
        rows = rows.select("*", F.lit(levels[0]).alias("level"), _target(levels[0]).alias("route"))
    else:
        pairs = [F.struct(F.lit(level).alias("level"), _target(level).alias("route")) for level in levels]
        count = F.when(F.col("file_type") != "markdown", keyword_count(F.col("content"), F.col("file_type")))
        rows = rows.select("*", count.alias(words)).select("*", F.inline(F.array(*pairs)))
    result = measured(reduce_routed(rows, set().union(*[ROUTES[level] for level in levels]), label), words)
    prefix = F.lit("")
    for level in [n for n in levels if n in PREFIXES]:
        prefix = F.when((F.col("level") == level) & (F.col("route") != "blank"), PREFIXES[level]).otherwise(prefix)
    return result.withColumn("method", F.concat(prefix, F.col("method"))).select(*COLUMNS)


def reduce_corpus(files: DataFrame, level: str, label: str = fv.STRUCTURE_LABEL) -> DataFrame:
    return reduce_levels(files, [level], label)


def reduce_without_model(files: DataFrame, level: str, label: str = fv.STRUCTURE_LABEL) -> DataFrame:
    """Levels semantic and smart where no model can be asked at all.

    Semantic takes the aggressive level.  Smart tries it for code files of some size and keeps what shrinks by more than
    the semantic ratio; the size tiers decide the rest.
    """
    level, prefix = normalise_level(level), F.lit(f"{fv.METHOD_SEMANTIC}-unavailable, fallback to ")
    blank = F.col("method") == fv.METHOD_BLANK
    if level == "semantic":
        return reduce_corpus(files, "aggressive", label).withColumn("level", F.lit(level)).withColumn(
            "method", F.when(blank, F.col("method")).otherwise(F.concat(prefix, F.col("method"))))
    if level != "smart":
        return reduce_corpus(files, level, label)
    code = typed(files.select("corpus_id", "path", "content")).filter(
        F.col("file_type").isin(fv.SMART_CODE_TYPES) & (F.col("original_size") > fv.SMART_SEMANTIC_MIN_BYTES))
    tried = stored(reduce_corpus(code, "aggressive", label), "smart-code").filter(
        ~blank & (F.col("ratio") > fv.SMART_SEMANTIC_MIN_RATIO))
    kept = tried.withColumn("level", F.lit(level)).withColumn("method", F.concat(F.lit(PREFIXES["smart"]), prefix, F.col("method")))
    rest = files.join(tried.select("corpus_id", "path"), ["corpus_id", "path"], "left_anti")
    return kept.unionByName(reduce_corpus(rest, level, label))


def prefix_preview(content: Column, limit: int = fv.PREFIX_CHARS, label: str = fv.OUTLINE_LABEL) -> Column:
    """The opening characters and a note."""
    return F.concat(F.left(content, F.lit(limit)), F.lit(f"\n# ... Signature preview (stub from {label})"))
