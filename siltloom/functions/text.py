"""Text functions: trims, truncations and sanitation. Columns where Catalyst can, Python for markup."""

from __future__ import annotations

import html as _html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that a plain trim removes: space, tab, line feed, carriage return, NUL, vertical tab.
TRIM = " \t\n\r\0\x0b"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(TRIM))


def collapse_ascii(c: Column) -> Column:
    """Runs of ASCII whitespace to one space; no-break spaces stay."""
    return F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " ")


def normalise(c: Column) -> Column:
    """Lower case, all Unicode whitespace collapsed, trimmed."""
    return trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def normalise_text(s: str) -> str:
    """As ``normalise`` for constants on the driver."""
    return re.sub(r"\s+", " ", s.lower()).strip(TRIM)


def truncate_field(c: Column, max_chars: int) -> Column:
    """Trimmed; beyond ``max_chars`` code points cut to ``max_chars - 3``, right-trimmed, with "..."; no cap if ``max_chars <= 0``."""
    t = trim(c)
    if max_chars <= 0:
        return t
    return F.when(F.char_length(t) <= max_chars, t).otherwise(F.concat(rtrim(F.substring(t, 1, max(max_chars - 3, 0))), F.lit("...")))


def truncate_clean(c: Column, max_chars: int = 120) -> Column:
    """Beyond ``max_chars`` code points the first ``max_chars`` and "..."; no trim."""
    return F.when(F.char_length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit("..."))).otherwise(c)


_BLANK = frozenset(" \t\n\v\f\r")


def strip_tags(text: str) -> str:
    """Markup out: quotes in tags are respected, comments removed, an unclosed tag takes the rest, a last "<" with it; "< " is text."""
    if "<" not in text:
        return text
    out, i, n = [], 0, len(text)
    while i < n:
        j = text.find("<", i)
        if j < 0:
            out.append(text[i:])
            break
        out.append(text[i:j])
        if text[j + 1 : j + 2] in _BLANK:
            out.append("<")
            i = j + 1
            continue
        if text.startswith("<!--", j):
            k = text.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        k, quote, depth = j + 1, "", 0
        while k < n:
            c = text[k]
            if quote:
                if c == quote:
                    quote = ""
            elif c in "\"'":
                quote = c
            elif c == "<":
                depth += 1
            elif c == ">":
                if depth == 0:
                    break
                depth -= 1
            k += 1
        i = k + 1
    return "".join(out)


_WORD = re.compile(r"\w")
_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_ENTITY = re.compile(r"&(?:#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6})|[A-Za-z][A-Za-z0-9]{1,31});")


def _entity(m: re.Match) -> str:
    s = m[0]
    if s[1] == "#":
        n = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
        if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF or (n < 32 and n not in (9, 10, 13)) or 127 <= n < 160:
            return s
        return chr(n)
    return _html.entities.html5.get(s[1:], s)


def decode_entities(text: str) -> str:
    """Named and numeric entities that end in a semicolon; others stay."""
    return _ENTITY.sub(_entity, text) if "&" in text else text


def drop_elements(text: str, names: tuple[str, ...] = ("script", "style")) -> str:
    """Elements of these names out with all they hold, up to their own end tag; one that is never ended stays."""
    low = text.lower() if text.isascii() else text.translate(_LOWER)  # one character each, so places agree
    if not any(f"<{n}" in low for n in names):
        return text
    out, i = [], 0
    at = 0
    while (at := low.find("<", at)) >= 0:
        name = next((n for n in names if low.startswith(n, at + 1) and not _WORD.match(low, at + 1 + len(n))), None)
        head = low.find(">", at) if name else -1
        end = low.find(f"</{name}>", head + 1) if head >= 0 else -1
        if end < 0:
            at += 1
            continue
        out.append(text[i:at])
        i = at = end + len(name) + 3
    return "".join([*out, text[i:]])


def _plain(s: str | None) -> str | None:
    try:
        return decode_entities(strip_tags(drop_elements(s))) if isinstance(s, str) else None
    except Exception:  # one row must not end the run
        return None


@F.pandas_udf(T.StringType())
def _markup_out(values: pd.Series) -> pd.Series:
    return values.map(_plain)


#: Filters on a UDF's result would be pushed below it with a second copy of the UDF; so it counts as not deterministic.
_markup_out = _markup_out.asNondeterministic()


def clean(c: Column) -> Column:
    """Scripts and styles, tags, entities, whitespace, trim, in this order; so encoded tags come out as text. Null for null and for what can't be read."""
    return trim(collapse_ascii(_markup_out(c)))
