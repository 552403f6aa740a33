"""Text expressions with Python string semantics, built from JVM-side functions only."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as the characters of a trim set and as a regex class body (same syntax in Java and RE2).
SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
               + "\u2028\u2029\u202f\u205f\u3000")
SPACE = (r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
LINE_BREAKS = ["\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
LINE_BREAK = r"\r\n|[\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]"
NAME = r"[\p{L}_][\p{L}\p{N}_]*"


def strip(text: Column, chars: str = SPACE_CHARS) -> Column:
    return F.btrim(text, F.lit(chars))


def rstrip(text: Column, chars: str = SPACE_CHARS) -> Column:
    return F.rtrim(text, F.lit(chars))


def lstrip(text: Column, chars: str = SPACE_CHARS) -> Column:
    return F.ltrim(text, F.lit(chars))


def is_blank(text: Column) -> Column:
    """True when the text holds nothing but white space.  A regex decodes all it is given, so the first characters are tried alone."""
    return ~(F.left(text, F.lit(64)).rlike(f"[^{SPACE}]") | text.rlike(f"[^{SPACE}]"))


def any_of(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(word) for word in words) + ")"


def starts_with_any(text: Column, starts: list[str]) -> Column:
    return text.rlike("^" + any_of(starts))


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike(any_of(words))


def unify_breaks(text: Column) -> Column:
    """Every line break as a line feed.

    A chain of byte searches is about ten times as fast as one regex here, and asking first whether there is any but line feeds
    costs a fifth of the chain.
    """
    def replaced(raw):
        unified, odd = raw, F.lit(False)
        for mark in LINE_BREAKS:
            unified = F.replace(unified, F.lit(mark), F.lit("\n"))
            odd = odd | raw.contains(mark[0])
        return F.when(odd, unified).otherwise(raw)

    return bind(text, replaced)


def splitlines(text: Column) -> Column:
    """Lines on every Unicode line break; one trailing break does not open another line."""
    unified = F.regexp_replace(unify_breaks(text), r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(unified, "\n"))


def newline_split(text: Column) -> Column:
    return F.split(text, "\n")


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a lambda over a one-element array)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def json_value(text: Column) -> Column:
    """A text that is one JSON value, as a variant; null for any other.

    The parser stops behind the first value, so the text is read as the first element of a list whose second is its own digest:
    nothing can stand between them.
    """
    digest = F.sha2(text, 256)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    whole = (F.try_variant_get(listed, "$[1]", "string") == digest) & F.try_variant_get(listed, "$[2]", "variant").isNull()
    return F.when(whole, F.try_variant_get(listed, "$[0]", "variant"))


#: The signs of a JSON string but for its ends; the standard's grammar, without the reader's extensions of it.
_PLAIN, _ESCAPE = r'[^"\\\x{0}-\x{1f}]', r'\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4}'
_GRAMMAR = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def json_outline(text: Column) -> Column:
    """A text of any size that is one JSON value, with short strings and numbers; null for any other text.

    JSON readers stop at long strings, names and numbers, and variants at 128 MiB.  So every string is cut to an ``s`` and its
    first 32 signs, which hold the names that are looked for, and runs of digits to 300: neither makes a broken text whole.
    A text is read as the first element of a list that ends with a string no text can hold, having no ``s``: nothing can
    stand between them.  In the outline, a value's first character tells its kind: ``{``, ``[``, ``s``, or that of a number,
    true, false or null.
    """
    def whole(listed):
        return F.when((F.size(listed) == 2) & (F.get(listed, F.lit(1)) == "end"), F.coalesce(F.get(listed, F.lit(0)), F.lit("null")))

    # A string without its end matches too, or each quote in it would be tried as a beginning.
    strings = F.regexp_replace(text, rf'"((?:{_PLAIN}|{_ESCAPE}){{0,32}}+)(?:{_PLAIN}++|{_ESCAPE})*+("?+)', '"s$1$2')
    short = F.regexp_replace(strings, r"(?<!\d)(\d{300})\d++", "$1")
    listed = F.from_json(F.concat(F.lit("["), short, F.lit(',"end"]')), "array<string>", _GRAMMAR)
    # Most prose shows by its first character that it is no JSON.
    return F.when(F.left(lstrip(text, " \t\n\r"), F.lit(1)).isin(*'{["-0123456789tfn'), bind(listed, whole))


def json_items(value: Column) -> Column:
    """Elements of a list in an outline; null for any other value."""
    items = F.from_json(F.when(value.startswith("["), value), "array<string>", _GRAMMAR)
    return F.transform(items, lambda v: F.coalesce(v, F.lit("null")))


def json_members(value: Column) -> Column:
    """Members of an object in an outline, for ``json_member``; null for any other value."""
    members = F.from_json(F.when(value.startswith("{"), value), "map<string,string>", _GRAMMAR)
    return F.transform_values(members, lambda _, v: F.coalesce(v, F.lit("null")))


def json_member(members: Column, name: str) -> Column:
    """The first member of that name (of 32 characters at most); null when there is none."""
    return F.try_element_at(members, F.lit(f"s{name}"))


def utf8_size(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def decode_utf8(content: Column) -> Column:
    """Bytes to text, dropping what is not UTF-8.  Genuine replacement characters wait under two noncharacters meanwhile."""
    parked = F.replace(content.cast("string"), F.lit("\ufffd"), F.lit("\ufdd0\ufdd1"))
    repaired = F.replace(F.make_valid_utf8(parked), F.lit("\ufffd"), F.lit(""))
    repaired = F.replace(repaired, F.lit("\ufdd0\ufdd1"), F.lit("\ufffd"))
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(repaired)
