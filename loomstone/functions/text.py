"""Scalar text functions as Column expressions (no UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, for trimming.
SPACE = r"[\s\p{Z}\x{85}\x{FEFF}]"


def strip_space(c: Column) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def java_trim(c: Column) -> Column:
    """Without characters up to U+0020 at both ends, as Java's ``trim``."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def leading_space(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\s*)", 1)


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_generics(c: Column, depth: int = 8) -> Column:
    """Type text without balanced ``<...>``: the innermost pairs go first, ``depth`` times."""
    for _ in range(depth):
        c = F.regexp_replace(c, "<[^<>]*>", "")
    return c


def quote_regex(text: str) -> str:
    r"""``text`` as a Java regex that matches it literally, also if it holds ``\E``."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def estimate_tokens(chars: Column) -> Column:
    """ceil(chars / 4)."""
    return F.floor((chars + 3) / 4).cast("bigint")


def duration_ms(c: Column) -> Column:
    """``200`` / ``200ms`` / ``2s`` in milliseconds; null unless it is a positive whole number."""
    n = F.regexp_extract(c, r"^\s*(\d{1,15})\s*(?:ms|s)?\s*$", 1)
    ms = n.cast("bigint") * F.when(c.rlike(r"\ds\s*$"), 1000).otherwise(1)
    return F.when((n != "") & (ms > 0), ms)


def glob_to_regex(glob: str) -> str:
    """A path glob as a Java regex for the whole path.

    ``*`` stays within a directory, ``**`` crosses them, ``?`` is one character of a name,
    ``[...]`` (``!`` negates) never matches a slash, ``{a,b}`` alternates, a backslash quotes.
    """
    out, i, braces = "", 0, 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "\\" and i < len(glob):
            out += re.escape(glob[i])
            i += 1
        elif ch == "*":
            if glob[i : i + 1] == "*":
                i += 1
                out += ".*"
            else:
                out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[":
            end = glob.find("]", i + 1)
            if end < 0:
                raise ValueError(f"glob {glob!r}: [ without ]")
            body = glob[i:end]
            negated = body.startswith("!")
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&")
            out += f"(?!/)[{'^' * negated}{body}]"
            i = end + 1
        elif ch == "{":
            if braces:
                raise ValueError(f"glob {glob!r}: braces cannot nest")
            out, braces = out + "(?:(?:", 1
        elif ch == "}" and braces:
            out, braces = out + "))", 0
        elif ch == "," and braces:
            out += ")|(?:"
        else:
            out += re.escape(ch)
    if braces:
        raise ValueError(f"glob {glob!r}: {{ without }}")
    return f"^(?s:{out})$"
