"""Pages to raw teasers: one DOM pass in Python gives raw strings; caps, filters and prefixes are native.

The pass is a ``mapInPandas``, for a struct-valued UDF would run twice under the filters on its fields.
"""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.config import DateSpec, FieldSpec, SiteConfig
from siltloom.functions.css import SelectorError, first
from siltloom.functions.html import Node, parse
from siltloom.functions.loose_dates import parse_loose
from siltloom.functions.text import TRIM, truncate_field
from siltloom.session import bound_arrow, spread

MAX_BYTES = 2_000_000
#: Where the body text is looked for, in order. Fixed values.
BODY_SELECTORS = ("main", "#content", "#boxes", "article", "body")


def guard(pages: DataFrame) -> DataFrame:
    """Pages worth parsing: neither null, '' nor "0", and of at most 2,000,000 bytes."""
    return pages.where(F.col("html").isNotNull() & ~F.col("html").isin("", "0") & (F.octet_length("html") <= MAX_BYTES))


def meta(root: Node, name: str) -> str | None:
    """Content of the first ``<meta property=name>``; '' without content; None where there is none or the name has a quote."""
    if '"' in name or "'" in name:
        return None
    for node in root.walk():
        if node.tag == "meta" and node.attrs.get("property") == name:
            return (node.attrs.get("content") or "").strip(TRIM)
    return None


def css_text(root: Node, selector: str) -> str | None:
    try:
        node = first(root, selector)
    except SelectorError:
        return None
    return None if node is None else node.content().strip(TRIM)


def css_attribute(root: Node, selector: str, name: str) -> str | None:
    try:
        node = first(root, selector)
    except SelectorError:
        return None
    value = None if node is None else node.attrs.get(name)
    return None if value is None else value.strip(TRIM)


def raw_field(root: Node, spec: FieldSpec) -> str | None:
    """First non-empty of the metas, then of the selectors' first elements."""
    if not spec.present:
        return None
    for name in spec.opengraph:
        if value := meta(root, name):
            return value
    for selector in spec.css:
        if value := css_text(root, selector):
            return value
    return None


def raw_date(root: Node, spec: DateSpec) -> str | None:
    """As ``raw_field``; of an element its ``datetime``, or its text where it has no such attribute. "0" counts as empty."""
    if not spec.present:
        return None
    for name in spec.opengraph:
        value = meta(root, name)
        if value and value != "0":
            return value
    for selector in spec.css:
        value = css_attribute(root, selector, "datetime")
        if value is None:
            value = css_text(root, selector)
        if value and value != "0":
            return value
    return None


def parse_date(raw: str | None, only_date: bool = True, now: datetime | None = None) -> int | None:
    """Microseconds UTC, or None for what can't be read; relative forms count from ``now`` (see ``parse_loose``)."""
    if raw is None:
        return None
    if only_date and len(raw) == 10 and raw[4:5] == raw[7:8] == "-" and raw.replace("-", "").isdigit():
        raw += " 00:00:00"
    return parse_loose(raw, now)


def body_text(root: Node) -> str:
    for selector in BODY_SELECTORS:
        node = first(root, selector)
        if node is not None:
            return node.content().strip(TRIM)
    return ""


RAW = "url string, title_raw string, intro_raw string, date_raw string, date_us bigint, body_text string, failed boolean"


def dom_pass(pages: DataFrame, config: SiteConfig, need_body: bool = True, now: datetime | None = None) -> DataFrame:
    """``url`` and the raw strings of each page; a page that can't be read is marked ``failed`` and has none.

    Relative dates count from ``now``, by default the time of this call, which is the same for all pages and retries.
    """
    now = now or datetime.now(timezone.utc)
    bound_arrow(pages.sparkSession)
    title, intro, date = config.title, config.intro, config.datetime

    def one(url, page):
        try:
            root = parse(page)
            raw = raw_date(root, date)
            return (url, raw_field(root, title), raw_field(root, intro), raw, parse_date(raw, date.only_date, now), body_text(root) if need_body else None, False)
        except Exception:  # one page must not end the run
            return (url, None, None, None, None, None, True)

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([one(u, h) for u, h in zip(pdf["url"], pdf["html"])], columns=[c.split()[0] for c in RAW.split(", ")])
            yield out.astype({"date_us": "Int64", "failed": bool})

    return spread(guard(pages).select("url", "html")).mapInPandas(run, RAW)


def teaser_columns(raw: DataFrame, config: SiteConfig) -> DataFrame:
    """``url, title, introText, datetime, body_text``: caps, title prefix, required fields. All native."""
    title = truncate_field(F.col("title_raw"), config.title.max_chars)
    intro = truncate_field(F.col("intro_raw"), config.intro.max_chars)
    out = raw.where(F.col("title_raw").isNotNull() & (F.col("title_raw") != "") & ~F.col("failed"))
    if config.intro.present:
        out = out.where(F.col("intro_raw").isNotNull())
    if config.datetime.present:
        out = out.where(F.col("date_us").isNotNull())
    return out.select(
        "url",
        (F.concat(F.lit(config.title.prefix), title) if config.title.prefix else title).alias("title"),
        intro.alias("introText"),
        F.timestamp_micros("date_us").alias("datetime"),
        "body_text",
    )
