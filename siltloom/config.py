"""Site configuration: typed readers with warn-and-default behaviour, and the YAML source.

A configuration is bound to a run as an immutable value; there is no global state to reset.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

log = logging.getLogger("siltloom.crawler")


@dataclass(frozen=True)
class FieldSpec:
    """How a text field is extracted."""

    present: bool = False
    required: bool = False
    prefix: str = ""
    opengraph: tuple[str, ...] = ()
    css: tuple[str, ...] = ()
    max_chars: int = 120


@dataclass(frozen=True)
class DateSpec:
    """How the date is extracted."""

    present: bool = False
    only_date: bool = True
    opengraph: tuple[str, ...] = ()
    css: tuple[str, ...] = ()


@dataclass(frozen=True)
class ScoreRule:
    score: int = 0
    match_any: tuple[str, ...] = ()
    body_text_length_lt: int | None = None


@dataclass(frozen=True)
class Scoring:
    active: bool = False
    min_score: int = 4
    positive: tuple[ScoreRule, ...] = ()
    negative: tuple[ScoreRule, ...] = ()


@dataclass(frozen=True)
class SiteConfig:
    """All parameters of one site's run."""

    id: str = ""
    respect_robots_txt: bool = False
    robots_url: str | None = None
    start_urls: tuple[tuple[str, int], ...] = ()
    link_section: str = "#content"
    link_selector: str = "a[href]"
    allow_prefixes: tuple[str, ...] = ()
    deny_prefixes: tuple[str, ...] = ()
    deny_endings: tuple[str, ...] = ()
    forced_article_urls: tuple[str, ...] = ()
    strip_query_params_active: bool = False
    strip_query_params: tuple[str, ...] = ()
    max_teaser: int = 100
    max_retry: int = 3
    retry_status_codes: tuple[int, ...] = ()
    delay_ms: int = 0
    concurrency_per_host: int = 1
    user_agent: str = "Crawler/1.0"
    title: FieldSpec = field(default_factory=lambda: FieldSpec(present=True))
    intro: FieldSpec = field(default_factory=FieldSpec)
    datetime: DateSpec = field(default_factory=DateSpec)
    scoring: Scoring = field(default_factory=Scoring)

    def with_(self, **changes: Any) -> SiteConfig:
        return replace(self, **changes)


class Reader:
    """Typed access to an untyped parameter map. Missing keys warn, wrong types are errors; both give the default.

    A key set to null counts as missing. Messages are kept in ``notes`` as (level, key, text).
    """

    def __init__(self, parameters: dict[str, Any]):
        self.parameters = parameters
        self.notes: list[tuple[str, str, str]] = []

    def _get(self, key: str, quiet: bool = False) -> Any:
        value = self.parameters.get(key)
        if value is None and not quiet:
            self._note("warning", key, "missing")
        return value

    def _note(self, level: str, key: str, text: str) -> None:
        self.notes.append((level, key, text))
        log.log(logging.WARNING if level == "warning" else logging.ERROR, "%s: %s", key, text)

    def int(self, key: str, default: int) -> int:
        """An int, or a string of digits only."""
        value = self._get(key)
        if value is None:
            return default
        if isinstance(value, int) and not isinstance(value, bool):
            return value
        if isinstance(value, str) and re.fullmatch(r"[0-9]+", value):
            return int(value)
        self._note("error", key, "not an int")
        return default

    def bool(self, key: str, default: bool) -> bool:
        """A bool, or true/false/1/0 as a string in any case; the ints 0 and 1 are errors."""
        value = self._get(key)
        if value is None:
            return default
        if isinstance(value, bool):
            return value
        if isinstance(value, str) and (known := {"true": True, "1": True, "false": False, "0": False}.get(value.strip().lower())) is not None:
            return known
        self._note("error", key, "not a bool")
        return default

    def string(self, key: str, default: str) -> str:
        value = self._get(key)
        if value is None:
            return default
        if isinstance(value, str):
            return value
        self._note("error", key, "not a string")
        return default

    def nullable_string(self, key: str) -> str | None:
        """Trimmed; empty becomes None; silent when missing."""
        value = self._get(key, quiet=True)
        if value is None:
            return None
        if not isinstance(value, str):
            self._note("error", key, "not a string")
            return None
        return value.strip(" \t\n\r\0\x0b") or None

    def _list(self, key: str) -> list[Any]:
        value = self._get(key)
        if value is None:
            return []
        if not isinstance(value, list):
            self._note("error", key, "not a list")
            return []
        return value

    def int_list(self, key: str) -> tuple[int, ...]:
        """Ints and numeric strings, cut to ints, distinct, ascending."""
        out = set()
        for x in self._list(key):
            number = _number(x)
            if number is not None:
                out.add(int(number))
        return tuple(sorted(out))

    def string_list(self, key: str) -> tuple[str, ...]:
        return tuple(x for x in self._list(key) if isinstance(x, str) and x != "")

    def mixed_list(self, key: str) -> tuple[Any, ...]:
        """Everything but the empty string."""
        return tuple(x for x in self._list(key) if x != "")

    def score_rules(self, key: str) -> tuple[ScoreRule, ...]:
        """Rules of a list of maps; other entries are skipped, and nothing is said if the key is missing."""
        value = self.parameters.get(key)
        out = []
        for x in value if isinstance(value, list) else []:
            if not isinstance(x, dict):
                continue
            needles = x.get("match_any")
            condition = x.get("condition")
            limit = _number(condition.get("body_text_length_lt")) if isinstance(condition, dict) else None
            score = _number(x.get("score"))
            out.append(
                ScoreRule(
                    0 if score is None else int(score),
                    tuple(n for n in needles if isinstance(n, str) and n != "") if isinstance(needles, list) else (),
                    None if limit is None else int(limit),
                )
            )
        return tuple(out)

    def start_urls(self, key: str = "start_urls") -> tuple[tuple[str, int], ...]:
        """A bare string has depth 0; a map needs a string url; all else is dropped."""
        out = []
        for x in self._list(key):
            if isinstance(x, str):
                out.append((x, 0))
            elif isinstance(x, dict) and isinstance(x.get("url"), str):
                depth = _number(x.get("extraction_depth"))
                out.append((x["url"], 0 if depth is None else int(depth)))
        return tuple(out)


def _number(x: Any) -> float | int | None:
    if isinstance(x, bool):
        return None
    if isinstance(x, (int, float)):
        return x
    if isinstance(x, str) and re.fullmatch(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*", x):
        return float(x) if re.search(r"[.eE]", x) else int(x)
    return None


def site_config(parameters: dict[str, Any]) -> tuple[SiteConfig, list[tuple[str, str, str]]]:
    """(configuration, notes) of an untyped parameter map."""
    r = Reader(parameters)
    config = SiteConfig(
        id=r.string("id", ""),
        respect_robots_txt=r.bool("respect_robots_txt", False),
        robots_url=r.nullable_string("robots_url"),
        start_urls=r.start_urls(),
        link_section=r.string("link_section", "#content"),
        link_selector=r.string("link_selector", "a[href]"),
        allow_prefixes=tuple(x for x in r.mixed_list("allow_prefixes") if isinstance(x, str)),
        deny_prefixes=r.string_list("deny_prefixes"),
        deny_endings=tuple(x for x in r.mixed_list("deny_endings") if isinstance(x, str)),
        forced_article_urls=tuple(x for x in r.mixed_list("forced_article_urls") if isinstance(x, str)),
        strip_query_params_active=r.bool("strip_query_params_active", False),
        strip_query_params=r.string_list("strip_query_params"),
        max_teaser=r.int("max_teaser", 100),
        max_retry=r.int("max_retry", 3),
        retry_status_codes=tuple(int(x) for x in r.mixed_list("retry_status_codes") if _number(x) is not None),
        delay_ms=r.int("delay_ms", 0),
        concurrency_per_host=r.int("concurrency_per_host", 1),
        user_agent=r.string("user_agent", "Crawler/1.0"),
        title=FieldSpec(r.bool("title.present", True), False, r.string("title.prefix", ""), r.string_list("title.opengraph"), r.string_list("title.css"), r.int("title.max_chars", 120)),
        intro=FieldSpec(
            r.bool("introText.present", False), r.bool("introText.required_field", False), "", r.string_list("introText.opengraph"), r.string_list("introText.css"), r.int("introText.max_chars", 120)
        ),
        datetime=DateSpec(r.bool("datetime.present", False), r.bool("datetime.only-date", True), r.string_list("datetime.opengraph"), r.string_list("datetime.css")),
        scoring=Scoring(r.bool("content_scoring.active", False), r.int("content_scoring.min_score", 4), r.score_rules("content_scoring.positive"), r.score_rules("content_scoring.negative")),
    )
    return config, r.notes


def load_parameters(folder: str | Path, site_key: str) -> dict[str, Any]:
    """Parameters of ``<folder>/<site_key>.yaml``; a file without a map of parameters gives none, a missing one raises."""
    import yaml

    content = yaml.safe_load((Path(folder) / f"{site_key}.yaml").read_text(encoding="utf-8"))
    parameters = content.get("parameters") if isinstance(content, dict) else None
    if not isinstance(parameters, dict):
        return {}
    return {k.split(".", 1)[1] if isinstance(k, str) and k.startswith(PREFIX) else k: v for k, v in parameters.items()}


#: Vendor-neutral prefix that keys of a shared parameter file may carry.
PREFIX = "crawler."


def site_registry(parameters: dict[str, Any]) -> list[tuple[str, str]]:
    """(site key, schedule) of the registry ``sites``; entries that are no maps are left out."""
    sites = parameters.get("sites")
    return [(str(x.get("siteKey", "")), str(x.get("schedule", ""))) for x in sites if isinstance(x, dict)] if isinstance(sites, list) else []
