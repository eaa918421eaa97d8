"""Lists of urls as tables ``ord, url``: rewriting, filters, ordered distinct, top-k, union.

Order matters for keep-first and for the cap, so it is a column, never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.config import SiteConfig
from siltloom.functions import robots
from siltloom.functions.urls import is_flat, path_ends_with_any, rewrite_any, rewrite_flat, starts_with_any


def rewrite(urls: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Sanitise every url and, if ``names`` is given, strip these parameters.

    Flat urls are rewritten by native expressions; only the rest goes through the Python codec.
    """
    flat = F.coalesce(is_flat(F.col("url")), F.lit(False))
    native = urls.where(flat).withColumn("url", rewrite_flat(F.col("url"), names or ()))
    other = urls.where(~flat).withColumn("url", rewrite_any(F.col("url"), names))
    return native.unionByName(other)


def keep_allowed(urls: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Urls with one of the prefixes; all, if there are none."""
    return urls.where(starts_with_any(F.col("url"), prefixes)) if prefixes else urls


def drop_denied(urls: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    return urls.where(~starts_with_any(F.col("url"), prefixes)) if prefixes else urls


def drop_endings(urls: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    return urls.where(~path_ends_with_any(F.col("url"), endings)) if endings else urls


def ordered_distinct(urls: DataFrame) -> DataFrame:
    """The first of equal urls, by ``ord``. Partial aggregation comes before the shuffle."""
    return urls.groupBy("url").agg(F.min("ord").alias("ord")).select("ord", "url")


def robots_filter(urls: DataFrame, text: str | None, agent: str) -> DataFrame:
    """Urls that robots.txt allows to ``agent``; all (distinct) if it can't be had."""
    urls = ordered_distinct(urls)
    return urls if text is None else urls.where(robots.allowed(F.col("url"), robots.parse_robots(text, agent)))


def first_k(urls: DataFrame, k: int) -> DataFrame:
    """The first ``k`` by ``ord``."""
    return urls.orderBy("ord").limit(max(k, 0))


def with_forced(urls: DataFrame, forced: tuple[str, ...]) -> DataFrame:
    """Forced urls after all others, past every filter and cap; the first of equal ones is kept."""
    if not forced:
        return ordered_distinct(urls)
    more = urls.sparkSession.createDataFrame([((1 << 61) + i, u) for i, u in enumerate(forced)], "ord bigint, url string")
    return ordered_distinct(urls.select(F.col("ord").cast("bigint"), "url").unionByName(more))


def normalise_urls(urls: DataFrame, config: SiteConfig) -> DataFrame:
    """Sanitise, strip, allow, deny, endings, ordered distinct: in this order."""
    urls = rewrite(urls.select("ord", "url"), config.strip_query_params if config.strip_query_params_active else None)
    urls = keep_allowed(urls, config.allow_prefixes)
    urls = drop_denied(urls, config.deny_prefixes)
    return ordered_distinct(drop_endings(urls, config.deny_endings))


def final_urls(links: DataFrame, config: SiteConfig, robots_text: str | None = None) -> DataFrame:
    """From discovered links to the list of urls to fetch: normalise, robots, cap, forced, distinct."""
    urls = normalise_urls(links, config)
    if config.respect_robots_txt and config.robots_url:
        urls = robots_filter(urls, robots_text, config.user_agent)
    return with_forced(first_k(urls, config.max_teaser), config.forced_article_urls)
