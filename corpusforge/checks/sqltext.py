"""DuckDB text of the column semantics, written apart from the Spark expressions so that each checks the other."""

from corpusforge import fixed_values as fv
from corpusforge.functions.text import LINE_BREAK, NAME, SPACE, SPACE_CHARS, WORD


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


NL = "chr(10)"
WS = lit(SPACE_CHARS)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {WS})"


def lstrip(x: str) -> str:
    return f"ltrim({x}, {WS})"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {by}, 'g')"


def pick(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


def pick_all(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)}, {group})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def each(values: str, body: str, var: str = "x") -> str:
    return f"list_transform({values}, lambda {var}: {body})"


def where(values: str, test: str, var: str = "x") -> str:
    return f"list_filter({values}, lambda {var}: {test})"


def joined(values: str, by: str = NL) -> str:
    return f"coalesce(array_to_string({values}, {by}), '')"


def lines(x: str) -> str:
    return f"string_split({x}, {NL})"


def unified(x: str) -> str:
    return sub(x, LINE_BREAK, NL)


def splitlines(x: str) -> str:
    return f"case when {x} = '' then cast([] as varchar[]) else {lines(sub(unified(x), chr(10) + chr(92) + 'z', lit('')))} end"


def among(x: str, words) -> str:
    return f"{x} in ({', '.join(lit(w) for w in words)})"


def starts(x: str, words) -> str:
    return "(" + " or ".join(f"starts_with({x}, {lit(w)})" for w in words) + ")"


def any_in(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def basename(x: str) -> str:
    return f"split_part({x}, '/', -1)"


def suffix(x: str) -> str:
    return f"lower({pick(basename(x), r'^(?s:.)+(\.[^.]+)$', 1)})"


def file_type(x: str) -> str:
    named = " ".join(f"when lower({basename(x)}) = {lit(n)} then {lit(t)}" for n, t in fv.FILE_TYPES_BY_NAME.items())
    cases = " ".join(f"when {suffix(x)} = {lit(e)} then {lit(t)}" for e, t in fv.FILE_TYPES.items())
    return f"case {named} {cases} else 'text' end"


def blank(x: str) -> str:
    return f"({strip(x)} = '')"


def light(x: str) -> str:
    text = joined(each(lines(unified(x)), rstrip("x")))
    return f"trim({sub(text, chr(10) + '{3,}', NL + ' || ' + NL)}, {NL})"


def _cut(marker: str) -> str:
    head = f"split_part(x, {lit(marker)}, 1)"

    def even(quote):
        return f"(length({head}) - length(replace({head}, {quote}, ''))) % 2 = 0"

    return (f"case when {lstrip('x')} = '' or starts_with({lstrip('x')}, {lit(marker)}) then null "
            f"when contains(x, {lit(marker)}) and {even('chr(34)')} and {even('chr(39)')} then {rstrip(head)} else x end")


def medium(x: str, kind: str) -> str:
    def cut(body):
        return joined(where(each(splitlines(x), body), "x is not null"))

    plain = joined(where(splitlines(x), f"{lstrip('x')} <> ''"))
    return (f"case when {among(kind, fv.HASH_COMMENT_TYPES)} then {cut(_cut('#'))} "
            f"when {among(kind, fv.SLASH_COMMENT_TYPES)} then {cut(_cut('//'))} else {plain} end")


def regex_medium(x: str, kind: str) -> str:
    bare = f"case when {among(kind, fv.SLASH_STRIP_TYPES)} then {sub(x, '//[^' + chr(10) + ']*', lit(''))} else {x} end"
    kept = joined(where(lines(bare), f"{lstrip('x')} <> ''"))
    lightly = f"({kept} || {NL} || '# ... (Light compression via regex - ' || {kind} || ')')"
    blocks = (f"case when {among(kind, fv.BLOCK_COMMENT_TYPES)} then {sub(lightly, '(?s)/[*].*?[*]/', lit(''))} "
              f"else {lightly} end")
    return f"({blocks} || {NL} || '# ... (Medium compression via regex - ' || {kind} || ')')"


_BRACE = f"{strip('split_part(x, chr(123), 1)')} || ' ' || chr(123) || ' ... ' || chr(125)"


def signatures(x: str, kind: str) -> str:
    """Null without a kept line."""
    stripped = each(lines(x), strip("x"))

    def skeleton(test, body):
        kept = each(where(stripped, test), body)
        return (f"nullif({joined(kept)}, '') || {NL} || '# ... (Aggressive compression via regex - ' || {kind} || ')'")

    js = skeleton(f"{starts('x', fv.JS_STARTS)} or contains(x, 'function')", _BRACE)
    java = skeleton(starts("x", fv.JAVA_STARTS), _BRACE)
    c = skeleton(f"{starts('x', fv.C_STARTS)} or (contains(x, '(') and contains(x, ')') and not starts_with(x, '//') "
                 f"and {any_in('x', fv.C_TYPE_WORDS)})", f"case when contains(x, chr(123)) then {_BRACE} else x end")
    return (f"case when {kind} = 'javascript' then {js} when {kind} = 'java' then {java} "
            f"when {among(kind, fv.C_FAMILY)} then {c} end")


def cleaned(x: str, kind: str) -> str:
    kept = joined(where(lines(x), f"not starts_with({lstrip('x')}, '#') or starts_with({lstrip('x')}, '#!')"))
    text = f"case when {kind} = 'python' then {kept} else {x} end"
    spaced = sub(text, "[ \t]+", lit(" "))
    return strip(sub(spaced, f"\n[{SPACE}]*\n[{SPACE}]*\n", f"{NL} || {NL}"))


def tokens(clean: str, raw: str, kind: str) -> str:
    """``clean`` must be a column that already holds the cleaned text."""
    words = f"len({where(pick_all(clean, WORD + '+', 0), 'WORDTEST')})"
    count = " ".join(
        f"when {kind} = {lit(k)} then {words.replace('WORDTEST', 'lower(x) in (' + ', '.join(lit(w) for w in sorted(set(c[2].split()))) + ')')}"
        for k, c in fv.TOKEN_WORDS.items())
    markup = fv.MARKDOWN_MARKUP.replace("SPACE", f"[{SPACE}]")
    count = (f"case {count} when {kind} = 'markdown' then len({pick_all(clean, markup, 0)}) "
             f"else len({pick_all(clean, WORD + '+', 0)}) end")

    def config(index, markdown, default):
        cases = " ".join(f"when {kind} = {lit(k)} then {c[index]}e0" for k, c in fv.TOKEN_WORDS.items())
        return f"case {cases} when {kind} = 'markdown' then {markdown}e0 else {default}e0 end"

    ratio = config(0, fv.MARKDOWN_RATIO, fv.DEFAULT_RATIO)
    weight = config(1, fv.MARKDOWN_WEIGHT, fv.DEFAULT_WEIGHT)
    return (f"case when {raw} = '' then 0 else greatest(1, cast(floor(length({clean}) / ({ratio}) + "
            f"({count}) * ({weight})) as bigint)) end")


__all__ = [n for n in dir() if not n.startswith("_")] + ["NAME"]
