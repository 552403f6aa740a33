"""Signature skeletons: the declaration lines of JavaScript, Java and C-family files."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions.text import contains_any, join_lines, newline_split, starts_with_any, strip


def _header(line: Column) -> Column:
    return F.concat(strip(F.substring_index(line, "{", 1)), F.lit(" { ... }"))


def _skeleton(content: Column, keep, render, language: Column) -> Column:
    """Kept lines plus trailer; null when no line is kept."""
    lines = F.transform(newline_split(content), lambda line: strip(line))
    kept = F.transform(F.filter(lines, keep), render)
    trailer = F.concat(F.lit("\n# ... (Aggressive compression via regex - "), language, F.lit(")"))
    # Kept lines always render to at least ' { ... }' or a keyword, so empty text means that none was kept.
    joined = join_lines(kept)
    return F.when(joined != "", F.concat(joined, trailer))


def js_signatures(content: Column) -> Column:
    return _skeleton(content, lambda line: starts_with_any(line, fv.JS_STARTS) | line.contains("function"), _header,
                     F.lit("javascript"))


def java_signatures(content: Column) -> Column:
    return _skeleton(content, lambda line: starts_with_any(line, fv.JAVA_STARTS), _header, F.lit("java"))


def _c_declaration(line: Column) -> Column:
    call = line.contains("(") & line.contains(")") & ~line.startswith("//")
    return starts_with_any(line, fv.C_STARTS) | (call & contains_any(line, fv.C_TYPE_WORDS))


def c_signatures(content: Column, language: Column) -> Column:
    return _skeleton(content, _c_declaration, lambda line: F.when(line.contains("{"), _header(line)).otherwise(line),
                     language)


def signatures(content: Column, file_type: Column) -> Column:
    """Null for languages without a skeleton and for files without a kept line."""
    return (F.when(file_type == "javascript", js_signatures(content))
            .when(file_type == "java", java_signatures(content))
            .when(file_type.isin(fv.C_FAMILY), c_signatures(content, file_type)))
