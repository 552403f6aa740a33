"""Apply edit scripts to a corpus.  The result is a new files table; the input is never changed in place.

Instructions of one script for one file are inherently sequential, so they form one array that a native fold runs
over the file's lines; files and scripts run in parallel.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions.paths import normalise
from corpusforge.functions.text import SPACE, any_of, bind, count_of, join_lines, lstrip, splitlines, strip
from corpusforge.session import stored

_EMPTY = "array<string>"
#: White space inside a line.
_GAP = rf"[{SPACE}&&[^\n]]"
#: A text of lines, each behind a line feed, up to the end of the last one that is no decorator, comment or blank.
_UP_TO_CODE = rf"(?s)\A.*\n{_GAP}*+[^{SPACE}@#][^\n]*+"


def _tail(lines: Column, start: Column) -> Column:
    """Lines from the 1-based position on."""
    return F.slice(lines, start.cast("int"), F.size(lines) + 1)


def _first(lines: Column, test) -> Column:
    return F.array_position(F.transform(lines, test), True)


def _text(lines: Column) -> Column:
    """Lines, each behind a line feed."""
    return bind(lines, lambda kept: F.when(F.size(kept) > 0, F.concat(F.lit("\n"), join_lines(kept))).otherwise(""))


def _breaks(text: Column) -> Column:
    return bind(text, lambda whole: count_of(whole, "\n"))


def _line_with(lines: Column, words: Column) -> Column:
    """Number of the first line that holds ``words`` between its outer white space, 0 if none does.

    One search in the joined lines: a test of each line costs a hundred times as much.
    """
    def found(text):
        return bind(F.instr(text, words), lambda at: F.when(at > 1, _breaks(F.substring(text, F.lit(1), at - 1))).otherwise(0))

    plain = (words != "") & (strip(words) == words) & ~words.contains("\n")
    return F.when(plain, bind(_text(lines), found)).otherwise(_first(lines, lambda line: strip(line).contains(words))).cast("int")


def _definition_line(lines: Column, limit: Column | None = None) -> Column:
    """Number of the first line that opens a definition, indented by ``limit`` at most if given; 0 if none does."""
    width = F.lit(f"\n{_GAP}*+") if limit is None else F.concat(F.lit(f"\n{_GAP}{{0,"), limit.cast("string"), F.lit("}+"))
    pieces = F.split(_text(lines), F.concat(width, F.lit(any_of(fv.DEFINITION_STARTS))), 2)
    return bind(pieces, lambda p: F.when(F.size(p) > 1, count_of(F.element_at(p, 1), "\n") + 1).otherwise(0))


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(lstrip(line))


def apply_preamble(lines: Column, until: Column, body: Column) -> Column:
    """Replace all before the line holding ``until`` (without it: before the first definition)."""

    def replaced(kept):
        hit = F.when(until != "", _line_with(kept, until)).otherwise(_definition_line(kept))
        return bind(hit, lambda at: F.concat(splitlines(body), F.when(at > 0, _tail(kept, at)).otherwise(
            F.array().cast(_EMPTY))))

    return bind(lines, replaced)


def apply_append(lines: Column, body: Column) -> Column:
    """Add a non-blank body at the end, after a blank line unless there is one."""

    def appended(kept):
        gap = F.when((F.size(kept) > 0) & (strip(F.try_element_at(kept, F.lit(-1))) != ""), F.array(F.lit(""))) \
            .otherwise(F.array().cast(_EMPTY))
        return F.when(strip(body) != "", F.concat(kept, gap, splitlines(body))).otherwise(kept)

    return bind(lines, appended)


def _with_decorators(lines: Column, at: Column) -> Column:
    """Move up over decorators; blank and comment lines in between are passed but do not move the start alone."""
    code = _breaks(F.regexp_extract(_text(F.slice(lines, 1, (at - 1).cast("int"))), _UP_TO_CODE, 0))
    return bind(code, lambda last: bind(
        _first(F.slice(lines, last + 1, (at - 1 - last).cast("int")), lambda line: strip(line).startswith("@")),
        lambda first: F.when(first > 0, last + first).otherwise(at)))


def apply_replace(lines: Column, find: Column, until: Column, body: Column) -> Column:
    """Replace (blank body: remove) the block that starts at the line holding ``find``; null when it is not found.

    Places are sought in the joined lines, so each instruction costs a few searches in the text.
    """
    nothing = F.array().cast(_EMPTY)

    def cut(kept, start):
        def with_rest(rest):
            def at_limit(limit):
                stop = F.when(until != "", _line_with(rest, until)).otherwise(_definition_line(rest, limit))
                added = F.when(strip(body) != "", splitlines(body)).otherwise(nothing)
                return bind(stop, lambda s: F.concat(F.slice(kept, 1, (start - 1).cast("int")), added,
                                                     F.when(s > 0, _tail(rest, s)).otherwise(nothing)))
            return bind(_indent(F.element_at(kept, start.cast("int"))), at_limit)
        return bind(_tail(kept, start + 1), with_rest)

    def replaced(kept):
        hit = _line_with(kept, find)
        return bind(hit, lambda at: F.when(at > 0, bind(_with_decorators(kept, at), lambda start: cut(kept, start))))

    return bind(lines, replaced)


def apply_one(lines: Column, section: Column, find: Column, until: Column, body: Column) -> Column:
    """Lines after one instruction on an existing file; null when it fails."""
    section, find, until = [strip(F.coalesce(c, F.lit(""))) for c in (section, find, until)]
    body = F.coalesce(body, F.lit(""))
    return (F.when(section == fv.PREAMBLE_SECTION, apply_preamble(lines, until, body))
            .when(find == "", apply_append(lines, body)).otherwise(apply_replace(lines, find, until, body)))


def file_text(lines: Column) -> Column:
    return bind(lines, lambda kept: F.when(F.size(kept) == 0, "").otherwise(F.concat(join_lines(kept), F.lit("\n"))))


def _step(state: Column, ins: Column) -> Column:
    creates = (F.coalesce(ins.find_method, F.lit("")) == "") & (strip(F.coalesce(ins.replace_with, F.lit(""))) != "")
    created = splitlines(F.rtrim(F.coalesce(ins.replace_with, F.lit("")), F.lit("\n")))
    outcome = F.when(state["exists"], apply_one(state.lines, ins.section, ins.find_method, ins.until_exclude,
                                                ins.replace_with)).when(creates, created)
    return bind(outcome, lambda after: F.struct(
        F.coalesce(after, state.lines).alias("lines"), (state["exists"] | after.isNotNull()).alias("exists"),
        F.array_append(state.done, after.isNotNull()).alias("done")))


def _folded(scripts: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with corpus_id, file and ``steps``, and what the steps leave: content, and ``done``, whether each step applied."""
    joined = scripts.join(files.select("corpus_id", F.col("path").alias("file"), "content"), ["corpus_id", "file"], "left")
    start = F.struct(F.coalesce(splitlines(F.col("content")), F.array().cast(_EMPTY)).alias("lines"),
                     F.col("content").isNotNull().alias("exists"), F.array().cast("array<boolean>").alias("done"))
    none = F.transform("steps", lambda step: F.lit(False))
    folded = joined.withColumn("state", F.when(F.col("file").isNotNull(), F.aggregate("steps", start, _step)))
    done = F.coalesce("state.done", none)
    text = F.when(F.exists(done, lambda d: d), file_text(F.col("state.lines"))).otherwise(F.col("content"))
    return folded.withColumn("done", done).withColumn("content", text).drop("state")


def _addressed(instructions: DataFrame) -> DataFrame:
    """Instructions with their file names normalised as paths; an empty name is none."""
    return instructions.withColumn("file", F.when(F.col("file") != "", normalise(F.col("file"))))


def apply_edits(instructions: DataFrame, files: DataFrame, single_file: bool = False) -> DataFrame:
    """script_id, corpus_id, file, content, n_instructions, applied for every (script, file) that instructions name.

    ``files`` has corpus_id and path; ``instructions`` also carries the corpus_id its file names belong to.  Content
    is null when nothing exists and nothing was created; instructions without a file fail as a group of their own.
    File names are normalised as paths.  With ``single_file``, the corpus is one file: all instructions address it, whatever
    file they name.
    """
    if single_file:
        instructions = instructions.drop("file").join(files.select("corpus_id", F.col("path").alias("file")), "corpus_id")
    else:
        instructions = _addressed(instructions)
    step = F.struct("seq", "section", "find_method", "until_exclude", "replace_with")
    scripts = instructions.groupBy("script_id", "corpus_id", "file").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return _folded(scripts, files).select(
        "script_id", "corpus_id", "file", "content", F.size("steps").alias("n_instructions"),
        F.size(F.filter("done", lambda d: d)).alias("applied"))


def apply_script_chain(instructions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply several scripts to one tree, one after the other: each sees what those before it left.

    ``instructions`` is that of ``apply_edits`` with ``script_seq``, the place of the script in the chain (null first; equal
    places go by script_id).  The first result has one row per corpus and file, whatever number of scripts name it:
    corpus_id, file, content, n_scripts, n_instructions, applied.  The second has one row per instruction: script_id,
    corpus_id, file, seq, applied, and conflict: it did not apply, but would have if its script had come alone, so that an
    earlier script took away what it looks for.  A step that fails leaves the file as it is.  Steps for one file are one fold,
    as its text depends on their order; files run in parallel.
    """
    step = F.struct("script_seq", "script_id", "seq", "section", "find_method", "until_exclude", "replace_with")
    named = _addressed(instructions)

    def folded(*groups):
        steps = named.groupBy("corpus_id", "file", *groups).agg(F.array_sort(F.collect_list(step), _by_place).alias("steps"))
        return _folded(steps, files)

    def outcomes(rows, name):
        each = rows.select("corpus_id", "file", F.explode(F.arrays_zip("steps", "done")).alias("x"))
        return each.select("corpus_id", "file", "x.steps.script_id", "x.steps.script_seq", "x.steps.seq", F.col("x.done").alias(name))

    chained = stored(folded(), "chain")
    keys = ["corpus_id", "file", "script_seq", "script_id", "seq"]
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    alone = outcomes(folded("script_seq", "script_id"), "alone").alias("b")
    report = outcomes(chained, "applied").alias("a").join(alone, same).select(
        "a.script_id", "a.corpus_id", "a.file", "a.seq", "a.applied", (F.col("alone") & ~F.col("applied")).alias("conflict"))
    whole = chained.select("corpus_id", "file", "content", F.size(F.array_distinct(F.transform(
        "steps", lambda x: F.struct(x.script_seq, x.script_id)))).alias("n_scripts"),
        F.size("steps").alias("n_instructions"), F.size(F.filter("done", lambda d: d)).alias("applied"))
    return whole, report


def _by_place(a: Column, b: Column) -> Column:
    """Order of steps: script's place, script, step; nulls first."""
    def rank(x, y):
        return F.when(x.eqNullSafe(y), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)

    first, second, third = (rank(a[k], b[k]) for k in ("script_seq", "script_id", "seq"))
    return F.when(first != 0, first).when(second != 0, second).otherwise(third)


def patched_corpus(files: DataFrame, applied: DataFrame) -> DataFrame:
    """The next version of the corpus: changed and created files replace stored ones.  ``applied`` has one row per file."""
    changed = applied.filter("applied > 0").select("corpus_id", F.col("file").alias("path"), "content")
    kept = files.select("corpus_id", "path", "content").join(changed.select("corpus_id", "path"),
                                                             ["corpus_id", "path"], "left_anti")
    return kept.unionByName(changed)


def apply_report(applied: DataFrame) -> DataFrame:
    """Per script: instructions, how many applied, and success (any did)."""
    return (applied.groupBy("script_id").agg(F.sum("n_instructions").alias("n_instructions"), F.sum("applied").alias("applied"))
            .withColumn("success", F.col("applied") > 0))
