"""Python code structure as relations: lines -> statements -> definitions, imports, classes, skeletons, outlines.

Whole files are shuffled once by (corpus_id, path), which is unique, so no key is hot.  A regex lexer in one
projection masks strings and comments; all that follows is windows and grouping that keep that partitioning.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions.text import NAME, WORD, bind, count_of, join_lines, lstrip, newline_split, rstrip, strip
from corpusforge.session import shuffle_partitions, stored

KEYS = ["corpus_id", "path"]

# Python tokens that matter for masking.  Possessive loops keep the matcher's stack flat on long literals.
LEXER = (r'(?s)"""(?:[^"\\]++|\\.|"(?!""))*+"""' + r"|'''(?:[^'\\]++|\\.|'(?!''))*+'''"
         + r'|"(?:[^"\\\n]++|\\.)*+"' + r"|'(?:[^'\\\n]++|\\.)*+'" + r"""|#[^\n]*+|[^"'#]++|["']""")
IN_STRING, STRAY_QUOTE = "\x01", "\x02"

#: Stands for every character inside more brackets than are looked at.
FILL = "\x04"
_BRACKETS = r"[()\[\]{}]|[^()\[\]{}]++"
_LAMBDA = rf"(?<!{WORD})lambda(?!{WORD})[^:]*+:"
#: The openings of headers, in a text whose brackets are filled.
DEF_OPENING = rf"^\s*(?:async\s+)?def\s+{NAME}\s*(?:\[{FILL}*+\]\s*)?\("
CLASS_OPENING = rf"^\s*class\s+{NAME}\s*(?:\[{FILL}*+\]\s*)?\("
RETURNS = r"^(\s*->\s*)([^:]*+):"
PIECE = rf"(?:{_LAMBDA}|[^,])++"
ANNOTATED = rf"^(\s*{NAME}\s*:\s*)([^=]*+)"
#: A compound statement up to the colon of its header.
HEAD = (rf"^\s*(?:(?:async\s+)?(?:def|class|if|elif|else|for|while|with|try|except|finally)(?!{WORD})|case(?=\s))"
        rf"(?:{_LAMBDA}|[^:])*+:")
FROM_IMPORT = rf"^from ?([. ]*(?:{NAME}[\p{{L}}\p{{N}}_.]* )?) ?import ?(.*)$"
IS_FROM = r"^\s*from[\s.](?s:.*)[\s.]import[\s(*]"
#: Statements of a line are numbered apart by this much.
SUB = 1 << 31
#: Lines whose bracket depths are summed by one fold.
CHUNK = 64

# Words that a name, number or text may follow, and words that may follow one.
LEADING = ("and as assert async await class def del elif else except finally for from global if import in is lambda "
            "nonlocal not or pass raise return try while with yield match case type").split()
FOLLOWING = "and or not in is if else for async as from import".split()
_COMPOUND = r"^\s*(?:def|class|if|elif|else|for|while|with|try|except|finally)(?:[^\p{L}\p{N}_]|\z)"
_NOT_TARGETS = ["else", "try", "finally", "except", "lambda"]


def line_table(files: DataFrame) -> DataFrame:
    """One row per line with its number and indentation width."""
    line = F.col("line")
    rows = files.select(*KEYS, F.posexplode(newline_split(F.col("content"))).alias("pos", "line"))
    return rows.select(*KEYS, (F.col("pos") + 1).alias("line_no"), "line",
                       (F.length(line) - F.length(lstrip(line))).alias("indent"))


def _mask(token: Column) -> Column:
    quoted = F.regexp_replace(F.regexp_replace(token, "[^\n]", '"'), "\n", "\n" + IN_STRING)
    return (F.when(token.startswith("#"), "").when(token.isin('"', "'"), STRAY_QUOTE)
            .when(token.startswith('"') | token.startswith("'"), quoted).otherwise(token))


def _running(values: Column) -> Column:
    """Sums of all values before each.  Pieces of the array are summed on their own: a fold copies its state at every step."""
    def sums(parts, value):
        return F.aggregate(parts, F.array(F.lit(0)), lambda done, x: F.array_append(done, F.element_at(done, -1) + value(x)))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")),
                         lambda i: sums(F.slice(values, i * CHUNK + 1, CHUNK), lambda x: x))
    return bind(pieces, lambda local: bind(sums(local, lambda one: F.element_at(one, -1)), lambda carried: F.flatten(F.transform(
        local, lambda one, i: F.transform(F.slice(one, F.lit(1), F.size(one) - 1), lambda x: x + F.get(carried, i))))))


def _line(raw: Column) -> Column:
    """What one masked line tells; the quote marks that the lexer left are taken out."""
    def told(masked):
        net = F.when(masked.rlike(r"[()\[\]{}]"), F.length(F.translate(masked, ")]}", "")) - F.length(F.translate(masked, "([{", "")))
        return F.struct(masked.alias("masked"), raw.startswith(IN_STRING).alias("in_string"), raw.contains(STRAY_QUOTE).alias("stray"),
                        F.coalesce(net, F.lit(0)).alias("net"), (lstrip(masked) == "").alias("blank"), masked.endswith("\\").alias("carried"))
    return bind(F.replace(raw, F.lit(IN_STRING), F.lit("")), told)


def _uncarried(line: Column) -> Column:
    """The line with its closing backslash as a blank."""
    return F.when(line.endswith("\\"), F.regexp_replace(line, r"\\\z", " ")).otherwise(line)


def _indentation(masked: Column) -> Column:
    return bind(F.replace(masked, F.lit("\t"), F.lit("        ")), lambda flat: F.length(flat) - F.length(F.ltrim(flat)))


def _logical(lines: Column, codes: Column) -> Column:
    """Logical lines: stmt (0 holds leading blank lines), start_line, end_line, indent, text, masked, last_code, net, stray."""
    def one(first, number, size):
        def struct(end, text, masked, last, net, stray):
            return F.struct(number.cast("bigint").alias("stmt"), (first + 1).alias("start_line"), end.alias("end_line"),
                            F.when(number > 0, _indentation(F.get(lines, first).masked)).alias("indent"), text.alias("text"),
                            masked.alias("masked"), last.alias("last_code"), net.alias("net"), stray.alias("stray"))

        def alone(x):
            return bind(_uncarried(F.get(codes, first)), lambda code: struct(
                F.when(~x.blank, first + 1), code, _uncarried(x.masked), F.when(~x.blank, code), x.net, x.stray))

        def joined(rows):
            behind = F.array_position(F.reverse(F.transform(rows, lambda x: x.blank)), False).cast("int")
            return bind(F.when(behind > 0, first + size - behind + 1), lambda end: struct(
                end, join_lines(F.transform(F.slice(codes, first + 1, size), _uncarried)),
                join_lines(F.transform(rows, lambda x: _uncarried(x.masked))), _uncarried(F.get(codes, end - 1)),
                F.aggregate(rows, F.lit(0), lambda n, x: n + x.net), F.exists(rows, lambda x: x.stray)))

        return F.when(size == 1, bind(F.get(lines, first), alone)).otherwise(bind(F.slice(lines, first + 1, size), joined))

    def cut(depths):
        starts = F.array_compact(F.transform(lines, lambda x, i: F.when(
            ~x.blank & ~x.in_string & (F.get(depths, i) <= 0) & ((i == 0) | ~F.get(lines, i - 1).carried), i)))
        return bind(starts, lambda found: bind(
            F.when(F.get(found, F.lit(0)) == 0, 1).otherwise(0), lambda base: bind(
                F.when(base == 1, found).otherwise(F.concat(F.array(F.lit(0)), found)), lambda firsts: F.transform(
                    firsts, lambda first, i: bind(F.coalesce(F.get(firsts, i + 1), F.size(lines)) - first,
                                                  lambda size: one(first, i + base, size))))))

    return bind(_running(F.transform(lines, lambda x: x.net)), cut)


def _statements_of(row: Column) -> Column:
    """The statements of a logical line, each with what tells whether it is whole."""
    masked = row.masked

    def struct(sub, start, end, deeper, text, shown, opens):
        return F.struct((row.stmt * SUB + sub).alias("stmt"), start.alias("start_line"), end.alias("end_line"),
                        (row.indent + deeper).alias("indent"), text.alias("text"), shown.alias("masked"), row.last_code.alias("last_code"),
                        sub.alias("sub"), opens.alias("opens"), row.net.alias("net"), row.stray.alias("stray"))

    # With its body on the line a header opens no block.
    whole = struct(F.lit(0), row.start_line, row.end_line, F.lit(0), row.text, masked, rstrip(masked).endswith(":"))

    def pieces(parts):
        def piece(part, i):
            upto = F.substring(masked, F.lit(1), part.at + part.size)
            before = F.substring(masked, F.lit(1), part.at + part.size - F.length(lstrip(F.substring(masked, part.at + 1, part.size))))
            return struct(i, row.start_line + count_of(before, "\n"), row.start_line + count_of(rstrip(upto), "\n"), part.deeper,
                          F.substring(row.text, part.at + 1, part.size), F.substring(masked, part.at + 1, part.size), F.lit(False))
        return F.when(F.size(parts) == 1, F.array(whole.withField("indent", row.indent + F.element_at(parts, 1).deeper))).otherwise(F.transform(parts, piece))

    # The cheap tests come first: most headers end with their colon.
    several = masked.contains(";") | (masked.contains(":") & ~masked.rlike(r":\s*\z") & masked.rlike(HEAD))
    return F.when(several, bind(flattened(masked), lambda flat: bind(_sub_statements(flat.around), pieces))).otherwise(F.array(whole))


def _read(content: Column, sound_only: bool = False) -> Column:
    """All statements of a text in order; with ``sound_only`` null for a text in which some line shows neighbours that no grammar accepts.

    Such neighbours stand in one line and in one statement of it, so the masked text tells before any statement is cut.  A line
    costs a few evaluations here; as rows of their own, lines went through two windows and an aggregation by statement.
    """
    tokens = F.regexp_extract_all(F.regexp_replace(content, "\r\n?", "\n"), F.lit(LEXER), F.lit(0))

    def split_tokens(parts):
        codes = newline_split(F.array_join(F.transform(parts, lambda t: F.when(t.startswith("#"), "").otherwise(t)), ""))

        def cut(masked):
            found = bind(codes, lambda code: bind(F.transform(newline_split(masked), _line), lambda lines: F.flatten(
                F.transform(_logical(lines, code), _statements_of))))
            return F.when(~_neighbours(F.replace(masked, F.lit(IN_STRING), F.lit(""))), found) if sound_only else found

        return bind(F.array_join(F.transform(parts, _mask), ""), cut)

    return bind(tokens, split_tokens)


def _by_file(files: DataFrame) -> DataFrame:
    """Whole files by their key.  An explicit count keeps AQE from merging partitions by the size of the text: lexing multiplies the work."""
    return files.select(*KEYS, "content").repartition(shuffle_partitions(files.sparkSession), *KEYS)


def _flawed(rows: Column, sound_only: bool = False) -> Column:
    """With ``sound_only`` the rows come from a text whose neighbours were looked at as a whole."""
    def broken(masked):
        return _broken(masked) if sound_only else _neighbours(masked) | _broken(masked)
    return F.exists(rows, lambda x: x.stray | (x.net != 0) | broken(x.masked))


def _statements(files: DataFrame, shown, sound_only: bool = False) -> DataFrame:
    """Rows of ``shown(statements, parses)`` of every file, or of those that may parse.  It stands in the generator, so nothing of it
    is computed twice for a filter."""
    found = bind(_read(F.col("content"), sound_only), lambda rows: bind(
        ~_flawed(rows, sound_only) & _closed(_nesting(rows, _top())), lambda parses: shown(rows, parses)))
    return _by_file(files).select(*KEYS, F.inline(found))


FIELDS = ["stmt", "start_line", "end_line", "indent", "text", "masked", "last_code"]


def statements(files: DataFrame) -> DataFrame:
    """Logical statements with their lines, indentation, text and kind; statement 0 holds leading blank lines."""
    return _statements(files, lambda rows, parses: F.transform(rows, lambda x: F.struct(
        *[x[f].alias(f) for f in FIELDS], _kind(x.masked).alias("kind"), parses.alias("parses"))))


def flattened(masked: Column) -> Column:
    """Struct of ``around`` and ``within``: the text with what is inside any bracket, or inside two, filled; lengths stay.

    A running bracket depth over the text's brackets and the runs between them, so brackets may nest as deep as they like.
    """
    def step(state, token):
        opens, closes = token.isin("(", "[", "{"), token.isin(")", "]", "}")
        depth = state.depth + F.when(opens, 1).when(closes, -1).otherwise(0)
        level = F.when(opens, state.depth).otherwise(depth)
        # One digit a token: a fold copies its state at every step, and copying an array costs a hundred times as much.
        return F.struct(depth.alias("depth"), F.concat(state.levels, F.when(level <= 0, "0").when(level == 1, "1").otherwise("2")).alias("levels"))

    def view(tokens, levels, most):
        shown = F.transform(tokens, lambda t, i: F.when(F.get(levels, i) <= most, t).otherwise(F.repeat(F.lit(FILL), F.length(t))))
        return F.array_join(shown, "")

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("levels"))
    return bind(F.regexp_extract_all(masked, F.lit(_BRACKETS), F.lit(0)), lambda tokens: bind(
        F.split(F.aggregate(tokens, start, step, lambda state: state.levels), ""),
        lambda levels: F.struct(view(tokens, levels, "0").alias("around"), view(tokens, levels, "1").alias("within"))))


def _sub_statements(outer: Column) -> Column:
    """Places, sizes and derived extra depth of the statements in one logical line: the header of a one-line block, then what
    stands between semicolons.  Empty ones are left out."""
    def cut(head):
        body = F.substring(outer, head + 1, F.length(outer))
        inline = (head > 0) & (lstrip(body) != "")
        parts = F.when(inline, F.concat(F.array(F.substring(outer, F.lit(1), head)), F.split(body, ";"))).otherwise(F.split(outer, ";"))

        def placed(ps):
            def one(p, i):
                gaps = F.when(inline, F.greatest(i - 1, F.lit(0))).otherwise(i)
                earlier = F.aggregate(F.slice(ps, F.lit(1), i), F.lit(0), lambda total, x: total + F.length(x))
                return F.struct((earlier + gaps).alias("at"), F.length(p).alias("size"),
                                F.when(inline & (i > 0), 1).otherwise(0).alias("deeper"))
            return F.filter(F.transform(ps, one), lambda x: lstrip(F.substring(outer, x["at"] + 1, x["size"])) != "")
        return bind(parts, placed)
    return bind(F.length(F.regexp_extract(outer, HEAD, 0)), cut)


def _top() -> Column:
    """The state in which a file begins."""
    return F.struct(F.array(F.lit(0)).alias("stack"), F.lit(False).alias("open"), F.lit(True).alias("right"))


def _nesting(rows: Column, start: Column) -> Column:
    """The state behind the logical lines: indentation stack, whether a block must open, whether all was right.

    Blocks must nest: deeper after a header and nowhere else.
    """
    def step(state, row):
        kept = F.filter(state.stack, lambda x: x <= row.indent)
        stack = F.when(state.open, F.array_append(state.stack, row.indent)).otherwise(kept)
        right = F.when(state.open, row.indent > F.element_at(state.stack, -1)).otherwise(F.element_at(kept, -1) == row.indent)
        return F.struct(stack.alias("stack"), row.opens.alias("open"), (state.right & right).alias("right"))

    return F.aggregate(F.filter(rows, lambda x: (x["sub"] == 0) & (x["stmt"] > 0)), start, step)


def _closed(state: Column) -> Column:
    return bind(state, lambda s: s.right & ~s.open)


def _outcomes(files: DataFrame) -> DataFrame:
    """Per file: its lines' places (``all``), whether any statement is ``flawed``, and whether its end may be one (``unended``):
    a quote, a bracket or a last line that what follows could close or continue."""
    def told(rows):
        ends = F.exists(rows, lambda x: x.stray) | (F.element_at(rows, -1).net != 0)
        lines = F.transform(rows, lambda x: F.struct(*[x[f].alias(f) for f in ("stmt", "sub", "indent", "opens")]))
        return F.when(F.size(rows) > 0, F.array(F.struct(lines.alias("all"), _flawed(rows).alias("flawed"), ends.alias("unended"))))

    return _by_file(files).select(*KEYS, F.inline(bind(_read(F.col("content")), told)))


def parses_with(files: DataFrame, endings: list[str]) -> DataFrame:
    """corpus_id, path, ending (its place in ``endings``), parses: does the file with that text on a new line behind it parse?

    A file is parsed once, whatever number of endings there are: where its last statement is complete, an ending only goes on from
    the indentation stack it leaves.  Files that end within a statement are parsed whole with each ending.
    """
    spark = files.sparkSession
    texts = F.array(*[F.lit(e) for e in endings])
    given = spark.range(1).select(F.lit("").alias("corpus_id"), F.posexplode(texts).alias("path", "content"))
    ends = _outcomes(given.select("corpus_id", F.col("path").cast("string").alias("path"), F.concat("content", F.lit("\n")).alias("content")))
    ends = ends.select(F.col("path").cast("int").alias("ending"), F.col("all").alias("lines"), F.col("flawed").alias("bad"))
    continued = files.filter(F.col("content").rlike(r"\\\r?\z")).select(*KEYS, F.lit(True).alias("continued"))
    read = stored(_outcomes(files).select(*KEYS, "flawed", "unended", _nesting(F.col("all"), _top()).alias("state")).join(continued, KEYS, "left").select(
        *KEYS, "flawed", "state", (F.col("unended") | F.coalesce("continued", F.lit(False))).alias("unended")), "read")
    ended = read.filter(~F.col("unended")).join(F.broadcast(ends)).select(
        *KEYS, "ending", (~F.col("flawed") & ~F.col("bad") & _closed(_nesting(F.col("lines"), F.col("state")))).alias("parses"))
    whole = files.join(read.filter("unended").select(*KEYS), KEYS).select(*KEYS, F.posexplode(texts).alias("ending", "end"), "content").select(
        "corpus_id", F.concat_ws("#", F.col("ending").cast("string"), "path").alias("path"),
        F.concat("content", F.lit("\n"), "end", F.lit("\n")).alias("content"))
    slow = statements(whole).groupBy(*KEYS).agg(F.bool_and("parses").alias("parses")).select(
        "corpus_id", F.expr("substr(path, locate('#', path) + 1)").alias("path"), F.substring_index("path", "#", 1).cast("int").alias("ending"), "parses")
    return ended.unionByName(slow)


def parsed_statements(files: DataFrame) -> DataFrame:
    """Statements of the files that parse: quotes and brackets close and no statement is broken."""
    return _statements(files, lambda rows, parses: F.when(parses, F.transform(rows, lambda x: F.struct(
        *[x[f].alias(f) for f in FIELDS], _kind(x.masked).alias("kind")))), sound_only=True)


def _kind(masked: Column) -> Column:
    return (F.when(~masked.rlike(r"^\s*(?:def|async|class|import|from|@)"), "other")
            .when(masked.rlike(rf"^\s*def\s+{NAME}"), "def")
            .when(masked.rlike(rf"^\s*async\s+def\s+{NAME}"), "async def")
            .when(masked.rlike(rf"^\s*class\s+{NAME}"), "class")
            .when(masked.rlike(r"^\s*import\s"), "import")
            .when(masked.rlike(IS_FROM), "from")
            .when(masked.rlike(r"^\s*@"), "decorator").otherwise("other"))


def _words(words: list[str]) -> str:
    return rf"(?:{'|'.join(words)})(?!{WORD})"


_NEXT = rf"[ \t]+(?!{_words(FOLLOWING)}|[rRbBuUfFtT]{{1,2}}\"){NAME}"
_FIRST = rf"(?<![\p{{L}}\p{{N}}_.])(?!{_words(LEADING)}){NAME}"
#: Signs that no Python grammar accepts, in masked text: a name, number, text or bracket with a name behind it; a name with a text
#: behind it; an operator that has no right side, or has another behind it that takes two; a call that is assigned to.
NEIGHBOURS = [_FIRST + _NEXT, rf"(?<![\p{{L}}\p{{N}}_.])\d[\p{{L}}\p{{N}}_.]*+{_NEXT}", rf"[\"\])}}]{_NEXT}", _FIRST + r'[ \t]+"']
OPERATORS = [r"[-+/%@&|^~=<>!]\s*:?\s*\z", r"[-+*/%@&|^~<>=][ \t]+(?:[/%@&|^<>]|=)", r'\.(?<=[\p{L}_)\]}"]\.)\s*\z']
#: A blank between two neighbours, the first no word that one may follow, the second no word that may follow: what all NEIGHBOURS
#: have.  Sought from the blank on, it costs a small part of them, and whole statements rarely show one.
GAP = (rf"[ \t](?<=[\p{{L}}\p{{N}}_.\"\])}}][ \t])(?<!(?<![\p{{L}}\p{{N}}_.])(?:{'|'.join(LEADING)})[ \t])[ \t]*+"
       rf"(?:\"|(?!{_words(FOLLOWING)}|[rRbBuUfFtT]{{1,2}}\")[\p{{L}}_])")
CALL_ASSIGNED = rf"{WORD}\({FILL}*+\)\s*=(?!=)"


def _neighbours(masked: Column) -> Column:
    return masked.rlike(GAP) & masked.rlike("|".join(NEIGHBOURS))


def _broken(masked: Column) -> Column:
    """Statements that no Python grammar accepts, by sure signs other than their neighbours."""
    headless = ~masked.contains(":") & masked.rlike(_COMPOUND)
    assigned = masked.contains("=") & masked.rlike(r"\)\s*=(?!=)") & bind(flattened(masked), lambda flat: flat.around.rlike(CALL_ASSIGNED))
    starred = masked.contains("*") & masked.rlike(r"\*\s*:?\s*\z") & ~masked.rlike(r"import\s*\*\s*\z")
    operators = masked.rlike(rf"(?=[-+*/%@&|^~=<>!.])(?:{'|'.join(OPERATORS)})")
    return operators | starred | headless | assigned


def _pieces(flat: Column, text: Column) -> Column:
    """Comma-separated pieces of a bracket's inside, as filled and as real text."""
    return bind(F.regexp_extract_all(flat, F.lit(PIECE), F.lit(0)), lambda parts: F.transform(parts, lambda p, i: F.struct(
        p.alias("flat"), F.substring(text, F.aggregate(F.slice(parts, F.lit(1), i), F.lit(1), lambda n, x: n + F.length(x) + 1),
                                     F.length(p)).alias("text"))))


def _inside(text: Column, masked: Column, opening: str, body) -> Column:
    """``body(pieces, behind, rest)`` of a header: the pieces in the bracket that ``opening`` ends with, the filled text behind
    it and the real text behind it."""
    def found(flat):
        def parts(at):
            size = F.length(F.regexp_extract(F.substring(flat.around, at + 1, F.length(masked)), rf"^{FILL}*+", 0))
            behind = at + F.when(at > 0, size + 2).otherwise(1)
            return body(_pieces(F.substring(flat.within, at + 1, size), F.substring(text, at + 1, size)),
                        F.substring(flat.around, behind, F.length(masked)), F.substring(text, behind, F.length(text)))
        return bind(F.length(F.regexp_extract(flat.around, opening, 0)), parts)
    return bind(flattened(masked), found)


def _positional(pieces: Column) -> Column:
    """Positional parameters: none before '/', none from the first '*' on."""
    def cut(ps):
        after = F.slice(ps, (F.array_position(F.transform(ps, lambda p: strip(p.flat)), "/") + 1).cast("int"), F.greatest(F.size(ps), F.lit(1)))
        return bind(after, lambda p: bind(
            F.array_position(F.transform(p, lambda x: lstrip(x.flat).startswith("*")), True),
            lambda star: F.when(star > 0, F.slice(p, 1, (star - 1).cast("int"))).otherwise(p)))
    return bind(F.filter(pieces, lambda p: strip(p.flat) != ""), cut)


def _printed(expression: Column) -> Column:
    """Spacing and quotes of an annotation as a canonical printer writes them."""
    text = F.regexp_replace(strip(expression), r"\s+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r" ?, ?", ", "), r" ?\| ?", " | ")
    return F.regexp_replace(text, r"""\"([^"'\\]*)\"""", "'$1'")


def def_signature(text: Column, masked: Column, annotated: bool) -> Column:
    """A definition's name and positional parameters, with annotations and return type if asked for.

    The header is cut by its bracket depth, in the text whose literals are masked; both texts have the same places.
    """
    def show(p):
        name = F.regexp_extract(p.flat, rf"^\s*({NAME})", 1)
        if not annotated:
            return name
        before, size = (F.length(F.regexp_extract(p.flat, ANNOTATED, g)) for g in (1, 2))
        return F.when(size > 0, F.concat(name, F.lit(": "), _printed(F.substring(p.text, before + 1, size)))).otherwise(name)

    def written(pieces, behind, rest):
        before, size = (F.length(F.regexp_extract(behind, RETURNS, g)) for g in (1, 2))
        return F.concat(F.lit("def "), F.regexp_extract(masked, rf"^\s*(?:async\s+)?def\s+({NAME})", 1), F.lit("("),
                        F.array_join(F.transform(_positional(pieces), show), ", "), F.lit(")"),
                        F.when(size > 0, F.concat(F.lit(" -> "), _printed(F.substring(rest, before + 1, size)))).otherwise(""))

    return _inside(text, masked, DEF_OPENING, written)


def class_signature(text: Column, masked: Column) -> Column:
    def written(pieces, behind, rest):
        bases = F.filter(pieces, lambda p: (strip(p.flat) != "") & ~p.flat.rlike(rf"^\s*{NAME}\s*=|^\s*\*\*"))
        listed = F.array_join(F.transform(bases, lambda p: _printed(p.text)), ", ")
        return F.concat(F.lit("class "), F.regexp_extract(masked, rf"^\s*class\s+({NAME})", 1),
                        F.when(listed != "", F.concat(F.lit("("), listed, F.lit(")"))).otherwise(""), F.lit(":"))

    return _inside(text, masked, CLASS_OPENING, written)


def _turns(statements: Column) -> Column:
    """The statements that open or may close a definition and the first decorators of runs, with what stands before them and the file's
    definition levels and end."""
    def is_def(kind):
        return kind.isin("def", "async def")

    def kept(rows, levels, last):
        def one(x, prev):
            turns = is_def(x.kind) | (x.indent < prev.indent) | is_def(prev.kind) | ((x.kind == "decorator") & ~prev.kind.eqNullSafe("decorator"))
            return F.when(turns, F.struct(
                x.stmt.alias("stmt"), x.start_line.alias("start_line"), x.indent.alias("indent"), x.kind.alias("kind"),
                F.when(is_def(x.kind), x.text).alias("header"), F.when(is_def(x.kind), x.masked).alias("header_masked"),
                prev.end_line.alias("prev_end"), prev.last_code.alias("prev_code"), prev.indent.alias("prev_indent"), prev.kind.alias("prev_kind"),
                levels.alias("levels"), last.end_line.alias("file_end"), last.last_code.alias("file_code")))
        return F.array_compact(F.transform(rows, lambda x, i: bind(F.get(rows, i - 1), lambda prev: one(x, prev))))

    known = F.transform(F.filter(statements, lambda x: x.stmt > 0), lambda x: F.struct(
        *[x[f].alias(f) for f in FIELDS], _kind(x.masked).alias("kind")))
    return bind(known, lambda rows: bind(
        F.array_distinct(F.transform(F.filter(rows, lambda x: is_def(x.kind)), lambda x: x.indent)), lambda levels: F.when(
            F.size(levels) > 0, bind(F.element_at(rows, -1), lambda last: kept(rows, levels, last)))))


def definitions(files: DataFrame, with_source: bool = True) -> DataFrame:
    """Every def and async def at any depth with span, signature and source.

    A definition ends before the first later statement that is indented no deeper.  Each statement is repeated for
    the definition indentations that it closes (those it dedents past) and each definition for its own, so within one
    indentation level the closing statement is simply the next row and no pairs are formed.
    """
    order = Window.partitionBy(*KEYS).orderBy("stmt")
    is_def = F.col("kind").isin("def", "async def")
    run_start = F.max(F.when((F.col("kind") == "decorator") & ~F.col("prev_kind").eqNullSafe("decorator"), F.col("start_line"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1))
    rows = _statements(files, lambda found, parses: F.when(parses, _turns(found)), sound_only=True).withColumn("source_start", F.when(
        F.col("prev_kind") == "decorator", run_start).otherwise(F.col("start_line")))
    after_def = F.col("prev_kind").isin("def", "async def")
    reachable = F.filter("levels", lambda level: (level >= F.col("indent")) & (
        (level < F.col("prev_indent")) | (after_def & (level == F.col("prev_indent"))) | (is_def & (level == F.col("indent")))))
    by_level = Window.partitionBy(*KEYS, "level").orderBy("stmt")
    rows = (rows.withColumn("level", F.explode(reachable))
            .withColumn("closed_end", F.lead("prev_end").over(by_level))
            .withColumn("closed_code", F.lead("prev_code").over(by_level))
            .filter(is_def & (F.col("level") == F.col("indent"))))
    found = rows.select(
        *KEYS, F.regexp_extract("header", rf"^\s*(?:async\s+)?def\s+({NAME})", 1).alias("name"),
        (F.col("kind") == "async def").alias("is_async"), "start_line",
        F.coalesce("closed_end", "file_end").alias("end_line"), "indent",
        def_signature(F.col("header"), F.col("header_masked"), True).alias("signature"), "source_start",
        F.when(F.col("closed_end").isNotNull(), F.col("closed_code")).otherwise(F.col("file_code")).alias("tail"))
    if not with_source:
        return found.drop("source_start", "tail")
    # One array per file (bounded by the file's own text) meets the file's lines once; then it is exploded again.
    fields = [c for c in found.columns if c not in KEYS]
    per_file = found.groupBy(*KEYS).agg(F.collect_list(F.struct(*fields)).alias("found"))
    text = F.regexp_replace(F.col("content"), "\r\n?", "\n")

    def with_text(lines):
        def one(d):
            body = F.concat(F.slice(lines, d.source_start, d.end_line - d.source_start), F.array(rstrip(d.tail)))
            return d.withField("source", strip(join_lines(body)))
        return F.transform("found", one)

    joined = files.select(*KEYS, "content").join(per_file, KEYS)
    return (joined.select(*KEYS, F.explode(bind(newline_split(text), with_text)).alias("d"))
            .select(*KEYS, *[F.col(f"d.{f}").alias(f) for f in fields + ["source"]]).drop("source_start", "tail"))


def _imported(kind: Column, text: Column) -> Column:
    """One canonical line per imported alias, in order."""
    flat = strip(F.regexp_replace(text, r"[\s\\]+", " "))
    plain = F.regexp_extract(flat, "^import (.*)$", 1)
    module = F.replace(F.regexp_extract(flat, FROM_IMPORT, 1), F.lit(" "), F.lit(""))
    listed = F.translate(F.regexp_extract(flat, FROM_IMPORT, 2), "()", "  ")

    def each(names, prefix):
        items = F.filter(F.transform(F.split(names, ","), lambda n: strip(n)), lambda n: n != "")
        return F.transform(items, lambda n: F.concat(prefix, n))

    return (F.when(kind == "import", each(plain, F.lit("import ")))
            .when(kind == "from", each(listed, F.concat(F.lit("from "), module, F.lit(" import ")))))


def _assigned(kind: Column, masked: Column) -> Column:
    """Plain names bound by an assignment or an annotation."""
    text = F.replace(masked, F.lit("=="), F.lit("\x03"))
    # The plain names before the first other target; split, not matched, so that a long chain takes no matcher stack.
    targets = F.transform(F.split(text, "="), lambda part: F.btrim(part, F.lit(" \t\n\\")))
    chain = bind(targets, lambda parts: bind(
        F.array_position(F.transform(parts, lambda part: ~part.rlike(rf"^{NAME}\z")), True),
        lambda other: F.slice(parts, F.lit(1), F.when(other > 0, F.least(other, F.size(parts)) - 1).otherwise(F.size(parts) - 1).cast("int"))))
    annotated = F.regexp_extract(text, rf"^\s*({NAME})[ \t]*:", 1)
    return F.when(kind == "other", F.when(F.size(chain) > 0, chain).when(
        (annotated != "") & ~annotated.isin(_NOT_TARGETS), F.array(annotated)))


def _augmented(kind: Column, masked: Column) -> Column:
    """The plain name changed by an augmented assignment."""
    grown = F.regexp_extract(masked, rf"^\s*({NAME})[ \t]*(?:\*\*|//|>>|<<|[-+*/%@&|^])=", 1)
    return F.when((kind == "other") & (grown != ""), F.array(grown))


def owned_statements(files: DataFrame) -> DataFrame:
    """Statements with signature (def, class), bound names and imports, and their place in a top-level block."""
    order = Window.partitionBy(*KEYS).orderBy("stmt")
    block = Window.partitionBy(*KEYS, "owner.stmt")
    kind, text, masked = F.col("kind"), F.col("text"), F.col("masked")
    first_inside = F.min_by("indent", F.when(F.col("stmt") > F.col("owner.stmt"), F.col("stmt"))).over(block)
    inside = ((F.col("owner.kind") == "class") & (F.col("stmt") > F.col("owner.stmt"))
              & (F.col("indent") == F.col("body_indent")))
    top = (F.col("indent") == 0) & (F.col("stmt") > 0)
    rows = parsed_statements(files).select(
        *KEYS, "stmt", "start_line", "indent", "kind", F.coalesce(top, F.lit(False)).alias("top"),
        F.when(kind == "def", def_signature(text, masked, False)).when(kind == "class", class_signature(text, masked)).alias("signature"),
        _assigned(kind, masked).alias("names"), _augmented(kind, masked).alias("grown"),
        _imported(kind, text).alias("imports"))
    return (rows.withColumn("owner", F.max(F.when(F.col("top"), F.struct("stmt", "kind", "signature"))).over(order))
            .withColumn("body_indent", first_inside)
            .withColumn("class_item", F.coalesce(inside, F.lit(False))))


def import_index(files: DataFrame) -> DataFrame:
    """One row per imported alias at any depth."""
    rows = parsed_statements(files).filter(F.col("kind").isin("import", "from"))
    return rows.select(*KEYS, F.col("start_line").alias("line_no"), "indent",
                       F.posexplode(_imported(F.col("kind"), F.col("text"))).alias("ordinal", "statement"))


def class_index(files: DataFrame) -> DataFrame:
    """Top-level classes with their direct sync methods and class variables; one row per class or member."""
    kind, item = F.col("kind"), F.col("class_item")
    member = F.when(F.col("top") & (kind == "class"), "class").when(item & (kind == "def"), "method").when(
        item & F.col("names").isNotNull(), "variable")
    values = F.when(F.col("member") == "variable", F.col("names")).otherwise(F.array("signature"))
    return (owned_statements(files).withColumn("member", member).filter("member is not null")
            .select(*KEYS, F.col("owner.signature").alias("class"), F.col("start_line").alias("line_no"), "member",
                    F.posexplode(values).alias("ordinal", "value")))


def toplevel_symbols(files: DataFrame) -> DataFrame:
    """Sync top-level functions by position and distinct top-level variables by first assignment."""
    is_def = F.col("kind") == "def"
    values = F.when(is_def, F.array("signature")).otherwise(F.coalesce("names", "grown"))
    rows = (owned_statements(files).filter(F.col("top"))
            .select(*KEYS, F.when(is_def, "function").otherwise("variable").alias("symbol"),
                    F.explode(values).alias("value"), F.when(is_def, F.col("stmt")).otherwise(0).alias("place"),
                    "start_line"))
    return (rows.filter("value is not null").groupBy(*KEYS, "symbol", "value", "place")
            .agg(F.min("start_line").alias("line_no")).drop("place"))


def structure_skeleton(files: DataFrame, label: str = fv.STRUCTURE_LABEL) -> DataFrame:
    """corpus_id, path, skeleton: imports, variables, functions and classes of each file that parses.

    Files with unbalanced quotes or brackets, or with a statement no grammar accepts, give no row.  Nested imports
    come by indentation, then position.
    """
    kind, line, top, member = F.col("kind"), F.col("stmt"), F.col("top"), F.col("class_item")
    signature, owner, none = F.col("signature"), F.col("owner.stmt"), F.lit(0)
    empty = F.array().cast("array<string>")

    def item(section, first, second, third, value, fourth=F.lit(0)):
        return F.struct(F.lit(section).alias("section"), first.cast("long").alias("a"), second.cast("long").alias("b"),
                        third.cast("long").alias("c"), F.coalesce(fourth, none).cast("long").alias("d"), value.alias("value"))

    method = F.concat(F.lit("    "), signature, F.lit(":\n        ..."))
    items = (F.when(F.col("imports").isNotNull(), F.transform("imports", lambda v, i: item(
                 0, F.col("indent"), line, i, v)))
             .when(top & (kind == "def"), F.array(item(2, line, none, none, F.concat(signature, F.lit(":\n    ...\n")))))
             .when(top & (kind == "class"), F.array(item(3, owner, none, none, signature),
                                                    item(3, owner, F.lit(9), none, F.lit(""))))
             .when(member & (kind == "def"), F.array(item(3, owner, F.lit(2), line, method)))
             .when(member, F.transform("names", lambda v, i: item(
                 3, owner, F.lit(1), line, F.concat(F.lit("    "), v, F.lit(" = ...")), i)))
             .when(top, F.transform(F.coalesce("names", "grown"), lambda v, i: item(
                 1, line, i, none, F.concat(v, F.lit(" = ..."))))))
    per_file = (owned_statements(files).select(*KEYS, F.explode_outer(items).alias("item"))
                .groupBy(*KEYS).agg(F.array_sort(F.collect_list("item")).alias("items")))

    def section(first, last):
        return F.transform(F.filter("items", lambda x: x.section.between(first, last)), lambda x: x.value)

    def spaced(values):
        return F.when(F.size(values) > 0, F.array_append(values, "")).otherwise(empty)

    parts = F.concat(spaced(section(0, 0)), spaced(F.array_distinct(section(1, 1))), section(2, 3))
    trailer = F.lit(f"\n# ... (Structure extracted via AST - {label})")
    return per_file.select(*KEYS, F.concat(join_lines(parts), trailer).alias("skeleton"))


def outline(files: DataFrame, label: str = fv.OUTLINE_LABEL) -> DataFrame:
    """corpus_id, path, outline: imports and the first header line of every class and function, in source order.

    Files without any give their first characters and a note.
    """
    order = Window.partitionBy(*KEYS).orderBy("stmt")
    header = F.substring_index(F.col("text"), "\n", 1)
    is_import = F.col("kind").isin("import", "from")
    rows = (statements(files).filter(F.col("kind").isin("import", "from", "def", "async def", "class"))
            .withColumn("is_import", is_import)
            .withColumn("after_import", F.coalesce(F.lag("is_import").over(order), F.lit(False)))
            .withColumn("entry", F.when(is_import, strip(F.col("text"))).otherwise(F.concat(strip(header), F.lit(" ..."))))
            .withColumn("entry", F.when(~is_import & F.col("after_import"), F.concat(F.lit("\n"), F.col("entry")))
                        .otherwise(F.col("entry"))))
    outlines = rows.groupBy(*KEYS).agg(
        F.concat(F.expr("listagg(entry, '\n') within group (order by stmt)"),
                 F.lit(f"\n# ... (Structure extracted via AST - {label})")).alias("outline"))
    note = F.lit(f"\n# ... API extraction (stub, {label} - AST analysis yielded no specific elements)")
    empty = F.concat(F.left(F.col("content"), F.lit(fv.OUTLINE_PREFIX_CHARS)), note)
    return (files.select(*KEYS, "content").join(outlines, KEYS, "left")
            .select(*KEYS, F.coalesce("outline", empty).alias("outline")))
