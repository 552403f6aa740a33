"""Path expressions: suffix, base name, normalisation, wildcard translation, file types."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv

SUFFIX_PATTERN = r"^(?s:.)+(\.[^.]+)$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last suffix in lower case; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(basename(path), SUFFIX_PATTERN, 1))


def normalise_extensions(extensions: list[str] | None) -> list[str]:
    """'py,md' or '.PY' style lists to distinct lower-case suffixes with a dot."""
    items = [part.lower() for item in extensions or [] for part in re.split(r"[,\s]+", item) if part]
    return sorted({part if part.startswith(".") else "." + part for part in items})


def has_extension(path: Column, extensions: list[str] | None) -> Column:
    wanted = normalise_extensions(extensions)
    return suffix(path).isin(wanted) if wanted else F.lit(True)


def file_type(path: Column) -> Column:
    table = {**fv.FILE_TYPES, **{"/" + name: kind for name, kind in fv.FILE_TYPES_BY_NAME.items()}}
    types = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in table.items())), F.lit(","), F.lit(":"))
    whole = F.concat(F.lit("/"), F.lower(basename(path)))
    return F.coalesce(F.try_element_at(types, whole), F.try_element_at(types, suffix(path)), F.lit(fv.DEFAULT_FILE_TYPE))


def normalise(path: Column) -> Column:
    """Collapse '//', '.' and '..' with POSIX rules; '..' above a root vanishes, above a relative start stays."""
    absolute = path.startswith("/")

    def step(kept, part):
        last = F.try_element_at(kept, F.lit(-1))
        return (F.when((part == "") | (part == "."), kept)
                .when((part == "..") & F.coalesce(last != "..", F.lit(False)),
                      F.slice(kept, F.lit(1), F.size(kept) - 1))
                .when((part == "..") & absolute, kept)
                .otherwise(F.array_append(kept, part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    lead = F.when(path.rlike("^//(?:[^/]|$)"), "//").when(absolute, "/").otherwise("")
    joined = F.concat(lead, F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def wildcard_regex(pattern: str) -> str:
    """Shell wildcard to an anchored regex in which '*' also crosses '/'."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2 if pattern[i + 1:i + 2] not in ("!", "]") else i + 3) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1:close].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append(re.escape(char))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def matches_wildcard(path: Column, pattern: str) -> Column:
    if not pattern:
        return F.lit(True)
    regex = wildcard_regex(pattern)
    return path.rlike(regex) | basename(path).rlike(regex)
