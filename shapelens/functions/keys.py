"""Column expressions over key names: templates, prefixes and globs.

All of these are plain Spark SQL expressions (regex, split, higher-order array
functions), so they run inside the executors' generated code, never in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's rules for the same templates.
# Separators, tried in this order: ":", "_", "-", "."
KEY_SEPARATORS = (":", "_", "-", ".")
# A part (at index > 0) counts as an id when it is all digits, or at least six
# hex digits, or at least ten letters/digits (any case), or ends in a digit
# and is longer than two characters.
# ("%s" stands for any character but the separator).
ID_PART = r"(?:[0-9]+|[0-9a-fA-F]{6,}|[0-9a-zA-Z]{10,}|%s{2,}[0-9])"
# Rule 2: letters/underscores followed by digits, any case -> letters + "*".
NUMBER_SUFFIX_PATTERN = r"(?i)^([a-z_]+)([0-9]+)\z"
# Rule 3: a letter run followed by 16+ hex digits, any case; then every run of
# 8+ hex digits becomes "*".
LONG_HEX_TEST_PATTERN = r"(?i)[a-z]+[0-9a-f]{16,}"
LONG_HEX_RUN_PATTERN = r"(?i)[0-9a-f]{8,}"
# Rule 4: keys longer than 5 keep their first min(5, floor(len / 2)) chars.
SHORT_PREFIX_MIN_LENGTH = 5


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _separator_template(key: Column, sep: str) -> Column:
    """Rule 1 as one match: the least number of parts ahead of an id part, and ``*``."""
    mark = "[" + sep + "]"
    other = "[^" + sep + "]"
    ahead = f"{other}*{mark}(?:{other}*{mark})*?"
    start = F.regexp_extract(key, rf"^({ahead}){ID_PART % other}(?={mark}|\z)", 1)
    return F.when(start != "", F.concat(start, F.lit("*")))


def key_template(key) -> Column:
    """Template of one key (O-36): ``user:17:name`` -> ``user:*``.

    First matching rule wins: separator with an id part; trailing number;
    long hex runs; short prefix; else the key itself.
    """
    key = _col(key)
    by_separator = [_separator_template(key, sep) for sep in KEY_SEPARATORS]
    letters = F.regexp_extract(key, NUMBER_SUFFIX_PATTERN, 1)
    number_suffix = F.when(key.rlike(NUMBER_SUFFIX_PATTERN),
                           F.concat(letters, F.lit("*")))
    long_hex = F.when(key.rlike(LONG_HEX_TEST_PATTERN),
                      F.regexp_replace(key, LONG_HEX_RUN_PATTERN, "*"))
    n = F.length(key)
    keep = F.least(F.lit(SHORT_PREFIX_MIN_LENGTH), F.floor(n / 2).cast("int"))
    short_prefix = F.when(n > SHORT_PREFIX_MIN_LENGTH,
                          F.concat(F.left(key, keep), F.lit("*")))
    return F.coalesce(*by_separator, number_suffix, long_hex, short_prefix, key)


def key_prefixes(key) -> Column:
    """Every ``/``-prefix of a key (O-37): ``/a/b/c`` -> ``/a/``, ``/a/b/``, ``/a/b/c/``.

    Empty parts are ignored and a leading ``/`` is implied. Returns
    ``array<struct<depth:int, prefix:string>>``; depth = number of parts.
    """
    key = _col(key)
    parts = F.filter(F.split(key, "/", -1), lambda p: p != "")
    depths = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))) \
        .otherwise(F.array().cast("array<int>"))
    return F.transform(depths, lambda d: F.struct(
        d.alias("depth"),
        F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), d), "/"),
                 F.lit("/")).alias("prefix")))


def normal_path(key) -> Column:
    """The key's deepest prefix: ``a//b`` -> ``/a/b/``; ``//`` for a key without parts."""
    parts = F.filter(F.split(_col(key), "/", -1), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/"))


def glob_to_regex(glob: str) -> str:
    """Anchored Java regex for a key-store glob (``*``, ``?``, ``[...]``, ``\\``)."""
    out = ["^"]
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append("\\Q" + glob[i] + "\\E")
        elif c == "[":
            j = glob.find("]", i + 1)
            if j < 0:
                out.append("\\[")
            else:
                body = glob[i + 1:j]
                if body.startswith("^"):
                    body = "^" + body[1:].replace("\\", "\\\\").replace("[", "\\[")
                else:
                    body = body.replace("\\", "\\\\").replace("[", "\\[")
                out.append("[" + body + "]")
                i = j
        else:
            out.append("\\Q" + c + "\\E")
        i += 1
    out.append("\\z")
    return "(?s)" + "".join(out)
