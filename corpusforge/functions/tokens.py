"""Language-aware token estimate as one column expression."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions.text import SPACE, WORD, bind, join_lines, lstrip, newline_split, strip


def clean(text: Column, file_type: Column, tidy: Column | None = None) -> Column:
    """What the estimator measures: whole-line '#' comments dropped (Python), blanks collapsed, ends stripped.

    Rows that ``tidy`` marks have no two blank lines in a row, so no run of them is sought.
    """
    def is_code(line):
        head = lstrip(line)
        return ~head.startswith("#") | head.startswith("#!")

    def spaced(kept):
        runs = kept.contains("\t") | kept.contains("  ")
        return F.when(runs, F.regexp_replace(kept, r"[ \t](?:(?<=\t)|(?=[ \t]))[ \t]*+", " ")).otherwise(kept)

    commented = (file_type == "python") & text.contains("#")
    shown = bind(F.when(commented, join_lines(F.filter(newline_split(text), is_code))).otherwise(text), spaced)
    squeezed = F.regexp_replace(shown, f"\n[{SPACE}]*\n[{SPACE}]*\n", "\n\n")
    return strip(squeezed if tidy is None else F.when(tidy, shown).otherwise(squeezed))


def word_pattern(words: str) -> str:
    """Whole words, any case, with Unicode word boundaries.  Their first letters are looked at first: most places end there."""
    firsts = "".join(sorted({word[0] for word in words.split()}))
    return f"(?i)(?=[{firsts}])(?<!{WORD})(?:{'|'.join(words.split())})(?!{WORD})"


def keyword_count(cleaned: Column, file_type: Column) -> Column:
    count = F
    for kind, (_, _, words) in fv.TOKEN_WORDS.items():
        count = count.when(file_type == kind, F.regexp_count(cleaned, F.lit(word_pattern(words))))
    markup = fv.MARKDOWN_MARKUP.replace("SPACE", f"[{SPACE}]")
    count = count.when(file_type == "markdown", F.regexp_count(cleaned, F.lit(markup)))
    return count.otherwise(F.regexp_count(cleaned, F.lit(WORD + "+")))


def _by_type(file_type: Column, index: int, markdown: float, default: float) -> Column:
    values = {"markdown": markdown, **{kind: config[index] for kind, config in fv.TOKEN_WORDS.items()}}
    table = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in values.items())), F.lit(","), F.lit(":"))
    return F.coalesce(F.try_element_at(table, file_type), F.lit(str(default))).cast("double")


def add_tokens(df: DataFrame, text: str, file_type: str = "file_type", out: str = "tokens", words: Column | None = None,
               tidy: Column | None = None) -> DataFrame:
    """0 for no text, 1 when only white space or comments remain, else characters/ratio + keywords*weight.

    The cleaned text is a column of its own, so that it is computed once per row although several terms use it.  ``words`` is the
    keyword count of rows for which it is known (null: counted here), ``tidy`` as in ``clean``.
    """
    kind, cleaned = F.col(file_type), F.col("_cleaned")
    ratio = _by_type(kind, 0, fv.MARKDOWN_RATIO, fv.DEFAULT_RATIO)
    weight = _by_type(kind, 1, fv.MARKDOWN_WEIGHT, fv.DEFAULT_WEIGHT)
    count = keyword_count(cleaned, kind) if words is None else F.coalesce(words, keyword_count(cleaned, kind))
    value = F.floor(F.length(cleaned) / ratio + count * weight).cast("bigint")
    tokens = F.when(F.col(text) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), value)).cast("bigint")
    return df.select("*", clean(F.col(text), kind, tidy).alias("_cleaned")).withColumn(out, tokens).drop("_cleaned")


def crude(text: Column) -> Column:
    """A third of the characters, rounded down: the estimate given to rows that failed."""
    return F.floor(F.length(text) / F.lit(3)).cast("bigint")
