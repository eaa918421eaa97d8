"""Loosely written dates as web pages carry them: absolute, relative, and English words mixed. Plain Python.

Rules: numbers past a month's end roll over into the next one; English month and day names only; parts may follow each other
in any order, each kind once; what is not understood makes the whole value unreadable. A date without a time is midnight, a
time without a date is today's, and nothing at all is now. Values without a zone are UTC.
"""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo, available_timezones

from siltloom.functions.instants import ABBREVIATIONS, EPOCH

_MONTHS = {m: i for i, names in enumerate(("jan january", "feb february", "mar march", "apr april", "may", "jun june", "jul july", "aug august", "sep sept september", "oct october", "nov november", "dec december"), 1) for m in names.split()}
_DAYS = {d: i for i, names in enumerate(("mon monday", "tue tues tuesday", "wed wednesday", "thu thur thurs thursday", "fri friday", "sat saturday", "sun sunday")) for d in names.split()}
_ORDINALS = {w: i for i, w in enumerate("zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split())} | {"last": -1, "previous": -1, "this": 0, "next": 1}
_UNITS = {u: x for u, x in (("sec", "s"), ("second", "s"), ("min", "m"), ("minute", "m"), ("hour", "h"), ("day", "d"), ("week", "w"), ("fortnight", "f"), ("month", "M"), ("year", "y"), ("weekday", "wd"))}
_MONTH = "(?P<mon>" + "|".join(sorted(_MONTHS, key=len, reverse=True)) + r")\.?"
_UNIT = "(?P<unit>" + "|".join(sorted(_UNITS, key=len, reverse=True)) + r")s?\b"
_DAY = "(?P<day>" + "|".join(sorted(_DAYS, key=len, reverse=True)) + r")\b"
_ORDINAL = "(?P<nth>" + "|".join(sorted((w for w in _ORDINALS if w != "zeroth"), key=len, reverse=True)) + ")"
_ZONE = r"(?:(?P<off>(?:gmt|utc)?[+-]\d{1,2}:?(?:\d{2})?)|(?P<abbr>z|[a-z]{3,5}\b))"
_PARTS = [
    ("epoch", r"@(?P<n>-?\d+)(?:\.(?P<f>\d{1,6}))?"),
    ("ymd", r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})(?![\d])(?:t(?=\d))?"),
    ("ymd", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?!\d)(?:t(?=\d))?"),
    ("ymd", r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4}|\d{2})(?!\d)"),
    ("ymd", r"(?P<d>\d{1,2})[.-](?P<m>\d{1,2})[.-](?P<y>\d{4})(?!\d)"),
    ("ymd", r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>6[1-9]|[7-9]\d)(?![\d:])"),  # with a smaller last number it is a time
    ("named", r"(?P<d>\d{1,2})(?:st|nd|rd|th)?[ \t.-]*" + _MONTH + r"(?:[ \t.,-]*(?P<y>\d{4})(?!\d|:))?"),
    ("named", _MONTH + r"[ \t.-]*(?P<d>\d{1,2})(?:st|nd|rd|th)?(?![\d:])(?:[ \t,.]+(?P<y>\d{4})(?!\d|:))?"),
    ("named", _MONTH + r"[ \t.,-]*(?P<y>\d{4})(?!\d)"),
    ("time", r"t?(?P<h>\d{1,2})[:.](?P<i>\d{2})(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[ap])\.?m\.?)?(?!\d)"),
    ("time", r"(?P<h>\d{1,2})\s*(?P<ap>[ap])\.?m\.?\b"),
    ("word", r"(?P<word>now|today|midnight|noon|tomorrow|yesterday)\b"),
    ("edge", r"(?P<edge>first|last) day of(?: (?P<nth>next|last|previous|this) (?P<unit>month|year))?"),
    ("step", r"(?P<sign>[+-]+)\s*(?P<n>\d+)\s*" + _UNIT + r"(?P<ago>\s+ago\b)?"),
    ("step", r"(?P<n>\d+)\s*" + _UNIT + r"(?P<ago>\s+ago\b)?"),
    ("step", _ORDINAL + r"\s+" + _UNIT + r"(?P<ago>\s+ago\b)?"),
    ("weekday", _ORDINAL + r"\s+" + _DAY),
    ("weekday", _DAY),
    ("place", r"[a-z]+(?:/[a-z_+-]+)+"),
    ("zone", _ZONE),
]
_GRAMMAR = [(kind, re.compile(pattern)) for kind, pattern in _PARTS]
_GAP = re.compile(r"[\s,]+|(?:\bat\b|\bon\b)")


@cache
def _places() -> dict[str, str]:
    return {name.lower(): name for name in available_timezones()}


def _add_months(at: datetime, n: int) -> datetime:
    month = at.year * 12 + at.month - 1 + n
    return _roll(month // 12, month % 12 + 1, at.day).replace(hour=at.hour, minute=at.minute, second=at.second, microsecond=at.microsecond)


def _roll(y: int, m: int, d: int) -> datetime:
    """Midnight of a date of which the day may lie past its month's end (up to 31), or be 0."""
    return datetime(y, m, 1) + timedelta(days=d - 1)


def _fields(match: re.Match) -> dict[str, str]:
    return {k: v for k, v in match.groupdict().items() if v is not None}


def parse_loose(value: str | None, now: datetime | None = None) -> int | None:
    """Microseconds since the epoch (UTC), or None for null and for what can't be read. ``now``: UTC, for relative values."""
    if value is None:
        return None
    text = value.strip().lower()
    at = (now or datetime.now(timezone.utc)).replace(tzinfo=None)
    date = clock = offset = weekday = edge = place = None
    steps: list[tuple[str, int]] = []
    i = 0
    while i < len(text):
        gap = _GAP.match(text, i)
        if gap:
            i = gap.end()
            continue
        kind, match = next(((k, m) for k, p in _GRAMMAR if (m := p.match(text, i))), ("", None))
        if match is None:
            return None
        i = match.end()
        g = _fields(match)
        if kind == "epoch":
            date, clock, offset = EPOCH.replace(tzinfo=None) + timedelta(seconds=int(g["n"])), (0, 0, 0, int((g.get("f", "") + "000000")[:6])), 0
            clock = (date.hour, date.minute, date.second, clock[3])
            date = date.replace(hour=0, minute=0, second=0)
        elif kind in ("ymd", "named"):
            if date is not None:
                return None
            y = int(g["y"]) if "y" in g else at.year
            y = y if len(g.get("y", "0000")) == 4 else 2000 + y if y < 70 else 1900 + y
            m, d = _MONTHS[g["mon"]] if kind == "named" else int(g["m"]), int(g.get("d", 1))
            if not 1 <= m <= 12 or d > 31 or y < 1:
                return None
            date = _roll(y, m, d)
            clock = clock or ((0, 0, 0, 0) if kind == "ymd" or "d" in g or "y" in g else None)
        elif kind == "time":
            h, minute, s = int(g["h"]), int(g.get("i", 0)), int(g.get("s", 0))
            if "ap" in g:
                if not 1 <= h <= 12:
                    return None
                h = h % 12 + (12 if g["ap"] == "p" else 0)
            if h > 24 or minute > 59 or s > 59 or (clock is not None and clock != (0, 0, 0, 0)):
                return None
            clock = (h, minute, s, int((g.get("f", "") + "000000")[:6]))
        elif kind == "word":
            word = g["word"]
            if word != "now":
                clock = (12, 0, 0, 0) if word == "noon" else clock or (0, 0, 0, 0)
            if word in ("tomorrow", "yesterday"):
                steps.append(("d", 1 if word == "tomorrow" else -1))
        elif kind == "edge":
            edge = g["edge"]
            if "unit" in g:
                steps.append((_UNITS[g["unit"]], _ORDINALS[g["nth"]]))
        elif kind == "step":
            n = int(g["n"]) if "n" in g else _ORDINALS[g["nth"]]
            n = -n if g.get("sign", "+").count("-") % 2 else n
            steps.append((_UNITS[g["unit"]], -n if "ago" in g else n))
        elif kind == "weekday":
            weekday = (_DAYS[g["day"]], _ORDINALS[g["nth"]] if "nth" in g else 0)
            clock = clock or (0, 0, 0, 0)
        elif kind == "place":
            place = _places().get(match[0])
            if offset is not None or place is None:
                return None
        elif kind == "zone":
            if offset is not None and offset != 0:
                return None
            if "off" in g:
                digits = re.sub(r"[^\d]", "", g["off"])
                minutes = int(digits[:2]) * 60 + int(digits[2:] or 0) if len(digits) != 3 else int(digits[0]) * 60 + int(digits[1:])
                offset = -minutes if "-" in g["off"] else minutes
            elif g["abbr"] == "z":
                offset = 0
            elif g["abbr"].upper() in ABBREVIATIONS:
                offset = ABBREVIATIONS[g["abbr"].upper()]
            else:
                return None
    try:
        base = date if date is not None else at.replace(hour=0, minute=0, second=0, microsecond=0)
        if clock is None and date is None:
            clock = (at.hour, at.minute, at.second, at.microsecond)
        h, minute, s, us = clock or (0, 0, 0, 0)
        out = base + timedelta(hours=h, minutes=minute, seconds=s, microseconds=us)
        for unit, n in steps:
            if unit in "yM":
                out = _add_months(out, n * (12 if unit == "y" else 1))
            elif unit == "wd":
                for _ in range(abs(n)):
                    out += timedelta(days=1 if n > 0 else -1)
                    while out.weekday() > 4:
                        out += timedelta(days=1 if n > 0 else -1)
            else:
                out += timedelta(seconds=n * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604_800, "f": 1_209_600}[unit])
        if edge:
            out = out.replace(day=1 if edge == "first" else monthrange(out.year, out.month)[1])
        if weekday is not None:
            day, nth = weekday
            ahead = (day - out.weekday()) % 7
            if nth > 0:
                ahead = (ahead or 7) + 7 * (nth - 1)
            elif nth < 0:
                ahead = ahead - 7
            out += timedelta(days=ahead)
        if place:
            offset = int(out.replace(tzinfo=ZoneInfo(place)).utcoffset().total_seconds()) // 60
        return (out - EPOCH.replace(tzinfo=None)) // timedelta(microseconds=1) - (offset or 0) * 60_000_000
    except (OverflowError, ValueError):
        return None
