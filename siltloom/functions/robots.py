"""robots.txt: groups, longest match, wildcards. Parsed on the driver, matched natively."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    allow: bool
    pattern: str


def parse_robots(text: str, agent: str) -> list[Rule]:
    """Rules of the most specific group for ``agent``; those of ``*`` if none names it."""
    groups: list[tuple[list[str], list[Rule]]] = []
    open_agents = False
    for line in text.splitlines():
        key, sep, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            if not open_agents:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            open_agents = True
        elif key in ("allow", "disallow"):
            open_agents = False
            if groups and value:
                groups[-1][1].append(Rule(key == "allow", value))
        else:
            open_agents = False
    product = agent.split("/")[0].strip().lower()
    named = [(max(len(a) for a in agents if a != "*" and product.startswith(a)), rules) for agents, rules in groups if any(a != "*" and a and product.startswith(a) for a in agents)]
    if named:
        longest = max(n for n, _ in named)
        return [r for n, rules in named if n == longest for r in rules]
    return [r for agents, rules in groups if "*" in agents for r in rules]


def to_regex(pattern: str) -> str:
    anchored = pattern.endswith("$")
    body = "".join(".*" if c == "*" else re.escape(c) for c in pattern[: -1 if anchored else None])
    return "^" + body + ("$" if anchored else "")


def allowed(url: Column, rules: list[Rule]) -> Column:
    """Longest matching pattern decides, allow wins ties, no match allows."""
    target = F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    target = F.when(F.startswith(target, F.lit("?")), F.concat(F.lit("/"), target)).otherwise(target)

    def longest(allow: bool) -> Column:
        hits = [F.when(target.rlike(to_regex(r.pattern)), len(r.pattern)).otherwise(-1) for r in rules if r.allow == allow]
        return F.greatest(*hits, F.lit(-1)) if len(hits) > 1 else hits[0] if hits else F.lit(-1)

    return longest(True) >= longest(False)
