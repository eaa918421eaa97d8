"""Readings of a written point in time: every valid interpretation of one value. Plain Python."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from typing import NamedTuple
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Reading(NamedTuple):
    """One interpretation.

    ``form`` numbers the format; ``certain`` is false where a clock change makes two of one local time; ``cost`` is what
    speaks against it by itself (see ``UNLIKELY``), whatever stands before and after.
    """

    form: int
    utc_us: int
    certain: bool
    cost: float = 0.0


#: Cost of a reading against what is known of the source or the world: another order of day and month than the source's,
#: another zone than the usual or the source's own of an abbreviation, a count since the epoch outside of ``LIKELY``.
UNLIKELY = 4.0
#: Microseconds between which counts since the epoch are expected (1990 to 2050).
LIKELY = (631_152_000_000_000, 2_524_608_000_000_000)


#: Month names and abbreviations (German, English, French). Fixed values.
_MONTHS = {
    1: "januar jänner jan january janvier janv", 2: "februar feber feb february février fevrier févr fév fevr",
    3: "märz maerz mär mrz march mar mars", 4: "april apr avril avr", 5: "mai may", 6: "juni jun june juin",
    7: "juli jul july juillet juil", 8: "august aug août aout", 9: "september sept sep septembre",
    10: "oktober okt october oct octobre", 11: "november nov novembre", 12: "dezember dez december dec décembre decembre déc",
}
MONTHS = {name: n for n, names in _MONTHS.items() for name in names.split()}
#: Weekday names and abbreviations, which carry no information here. Fixed values.
_WEEKDAYS = (
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so monday tuesday wednesday thursday friday saturday "
    "sunday mon tue tues wed thu thur thurs fri sat sun lundi mardi mercredi jeudi vendredi samedi dimanche lun mar mer jeu ven sam dim"
).split()
#: Minutes east of UTC of zone abbreviations. Fixed values.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "WESZ": 60, "WEZ": 0, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "OEZ": 120, "OESZ": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720,
    "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: Further zones that the same abbreviation stands for (Ireland, Israel; China; Bangladesh; Armenia; Arabia). Fixed values.
OTHER_ZONES = {"IST": (60, 120), "CST": (480,), "BST": (360,), "MST": (480,), "AST": (180,), "PST": (480,), "EST": (600,)}

_TZ = r"(?P<tz>[Zz]|(?:UTC|GMT)?[+\-−]\d{2}(?::?\d{2})?(?:\s*\[[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*\])?|[Zz]\[[A-Za-z_/]+\]|\[[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*\]|[A-Z]{2,5}|[A-Z][A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?)"
_FRACTION = r"(?:[.,](?P<f>\d{1,9}))?"
_CLOCK = (
    r"(?P<h>\d{1,2})(?:(?P<sep>[:.hH])\s?(?P<mi>\d{2})?(?:[:.](?P<s>\d{2})" + _FRACTION + r")?)?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?\s*(?:Uhr|uhr|h|heures?|o['’]clock)?\s*" + _TZ + "?"
)
_JOIN = r"(?:\s*[,;]?\s*(?:-|–|um|at|à|@|den)?\s*)"
_DAY = r"(?:(?:" + "|".join(sorted(_WEEKDAYS, key=len, reverse=True)) + r")\.?,?\s+(?:den\s+|le\s+)?)?"
_NAME = r"(?P<mon>[^\W\d_]{3,9})\.?"
_ISO = re.compile(r"(?P<y>\d{4})(?P<ds>[-/.])(?P<m>\d{1,2})(?P=ds)(?P<d>\d{1,2})(?:(?:[Tt]|\s+|,\s*|_)(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})" + _FRACTION + r")?\s*" + _TZ + r"?)?")
_BASIC = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:[Tt\s]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?" + _FRACTION + r"\s*" + _TZ + r"?)?")
_COUNT = re.compile(r"(?P<n>\d{9,10}|\d{12,13}|\d{15,16})(?:\.(?P<f>\d{1,6}))?")
_NUMERIC = re.compile(_DAY + r"(?P<a>\d{1,2})(?P<ds>[./-])(?P<b>\d{1,2})(?P=ds)(?P<y>\d{4}|\d{2})(?:(?:\s+|" + _JOIN + ")" + _CLOCK + ")?", re.I)
_DMY_NAME = re.compile(_DAY + r"(?P<d>\d{1,2})(?:\.|er|st|nd|rd|th)?[\s-]*" + _NAME + r"[\s,-]*(?P<y>\d{4}|\d{2})(?:" + _JOIN + _CLOCK + ")?", re.I)
_MDY_NAME = re.compile(_DAY + _NAME + r"\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?\s*,?\s+(?P<y>\d{4})(?:" + _JOIN + _CLOCK + ")?", re.I)

#: Numbers of the formats; the precision and kind of zone are added to them.
ISO, BASIC, COUNT, DMY, MDY, YMD_NAMES, DAY_NAME, MONTH_NAME = range(8)


@lru_cache(1000)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(200_000)
def _day_number(y: int, m: int, d: int) -> int | None:
    try:
        return date(y, m, d).toordinal() - 719163
    except ValueError:
        return None


@lru_cache(200_000)
def _hour_offsets(zone_name: str, hour: int) -> tuple[int, int] | None:
    """Offsets (s) of the two folds over a whole local hour, or None if they differ within it."""
    zone = _zone(zone_name)
    start = datetime(1970, 1, 1, tzinfo=zone) + timedelta(hours=hour)
    seen = set()
    for minute in (0, 15, 29, 30, 45, 59):
        at = start + timedelta(minutes=minute)
        seen.add((int(at.replace(fold=0).utcoffset().total_seconds()), int(at.replace(fold=1).utcoffset().total_seconds())))
    return seen.pop() if len(seen) == 1 else None


def _local(local_us: int, zone_name: str) -> list[tuple[int, bool]]:
    """UTC of a local time: none in a gap, two that aren't certain where the clock is put back."""
    zone = _zone(zone_name)
    if zone is None:
        return []
    offsets = _hour_offsets(zone_name, local_us // 3_600_000_000)
    if offsets is None:
        at = datetime(1970, 1, 1, tzinfo=zone) + timedelta(microseconds=local_us)
        offsets = (int(at.replace(fold=0).utcoffset().total_seconds()), int(at.replace(fold=1).utcoffset().total_seconds()))
    a, b = offsets
    if a == b:
        return [(local_us - a * 1_000_000, True)]
    if a < b:
        return []
    return [(local_us - a * 1_000_000, False), (local_us - b * 1_000_000, False)]


_OFFSET = re.compile(r"(?:UTC|GMT)?([+\-−])(\d{2}):?(\d{2})?")


def _resolve(local_us: int, tz: str | None, zone_name: str | None) -> tuple[int, list[tuple[int, bool, float]]]:
    """(kind of zone, instants with their costs)."""
    if not tz:
        return 0, [(us, sure, 0.0) for us, sure in _local(local_us, zone_name)] if zone_name else []
    if tz[0] in "Zz" and (len(tz) == 1 or tz[1] == "["):
        return 1, [(local_us, True, 0.0)]
    if m := _OFFSET.match(tz):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        if minutes > 18 * 60 or int(m[3] or 0) > 59:
            return 2, []
        return 2, [(local_us + (minutes if m[1] != "+" else -minutes) * 60_000_000, True, 0.0)]
    if tz[0] == "[" or "/" in tz:
        return 3, [(us, sure, 0.0) for us, sure in _local(local_us, tz.strip("[]"))]
    usual = ABBREVIATIONS.get(tz)
    if usual is None:
        return 4, []
    others = OTHER_ZONES.get(tz)
    if others is None:
        return 4, [(local_us - usual * 60_000_000, True, 0.0)]
    own = {(local_us - us) // 60_000_000 for us, _ in _local(local_us, zone_name)} if zone_name else set()
    known = next((m for m in (usual, *others) if m in own), usual)
    return 4, [(local_us - m * 60_000_000, True, 0.0 if m == known else UNLIKELY) for m in (usual, *others)]


def _clock_us(m: re.Match, groups: dict) -> tuple[int, int] | None:
    """(microseconds since midnight, precision) or None if there is no such time."""
    if groups.get("h") is None:
        return 0, 0
    hour, minute, second = int(groups["h"]), int(groups["mi"] or 0), int(groups["s"] or 0)
    half = groups.get("ap")
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half[0] in "pP" else 0)
    if hour > 23 or minute > 59 or second > 59:
        return None
    f = groups.get("f")
    return ((hour * 60 + minute) * 60 + second) * 1_000_000 + (int((f + "000000")[:6]) if f else 0), 3 if f else 2 if groups["s"] else 1


def readings(value: str | None, zone_name: str | None = None, order: str | None = None) -> list[Reading]:
    """All valid interpretations of ``value``; none for null, blank, relative and impossible values.

    ``zone_name``: zone of values without one. ``order``: ``dmy`` or ``mdy``, of purely numeric dates that don't start
    with the year. The other order is a reading too, but a costly one; a value that is no date in the known order is none.
    """
    if not value:
        return []
    value = " ".join(value.split())
    if not value or not any("0" <= c <= "9" for c in value):
        return []
    out: list[Reading] = []

    def add(kind: int, y: str, m: int, d: str, groups: dict, match: re.Match, cost: float = 0.0) -> None:
        day = _day_number(int(y) if len(y) == 4 else 2000 + int(y), m, int(d))
        clock = _clock_us(match, groups)
        if day is None or clock is None:
            return
        zone_kind, found = _resolve(day * 86_400_000_000 + clock[0], groups.get("tz"), zone_name)
        out.extend(Reading((kind * 4 + clock[1]) * 8 + zone_kind, us, certain, cost + more) for us, certain, more in found)

    first = value[0]
    if "0" <= first <= "9":
        if match := _ISO.fullmatch(value):
            g = match.groupdict()
            add(ISO, g["y"], int(g["m"]), g["d"], g, match)
            return out
        if match := _COUNT.fullmatch(value):
            n, f = match["n"], match["f"]
            usual = 1_000_000 if len(n) <= 10 else 1000 if len(n) <= 13 else 1
            for scale in (usual, *(x for x in (1_000_000, 1000, 1) if x != usual)):
                us = int(n) * scale + (int((f + "000000")[:6]) * scale // 1_000_000 if f else 0)
                if us < 253_402_300_800_000_000:  # the year 10000
                    out.append(Reading(COUNT * 32 + len(str(scale)), us, True, 0.0 if scale == usual else UNLIKELY if LIKELY[0] <= us < LIKELY[1] else 2 * UNLIKELY))
            if len(n) != 12:
                return out
        if match := _BASIC.fullmatch(value):
            g = match.groupdict()
            add(BASIC, g["y"], int(g["m"]), g["d"], g, match)
            return out
    if match := _NUMERIC.fullmatch(value):
        g = match.groupdict()
        for kind, own, month, day in ((DMY, "dmy", g["b"], g["a"]), (MDY, "mdy", g["a"], g["b"])):
            add(kind, g["y"], int(month), day, g, match, UNLIKELY if order not in (None, own) else 0.0)
        if order is not None and not any(x.form // 32 == (DMY if order == "dmy" else MDY) for x in out):
            return []
        if len({x.utc_us for x in out}) == 1:
            del out[1:]
        return sorted(out, key=lambda x: x.cost)
    for kind, pattern in ((DAY_NAME, _DMY_NAME), (MONTH_NAME, _MDY_NAME)):
        if match := pattern.fullmatch(value):
            g = match.groupdict()
            month = MONTHS.get(g["mon"].lower())
            if month is not None:
                add(kind, g["y"], month, g["d"], g, match)
                return out
    return out
