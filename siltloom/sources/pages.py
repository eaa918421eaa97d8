"""Pages as a table: the urls of a run joined with stored responses, in chunks if need be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.session import small_side


def latest(pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``url, html`` of each url's latest row: by ``fetched_at``, then ``page_id``; the smallest html, where there are no such columns.

    The row is chosen on narrow columns; html is read for the chosen rows alone. ``wanted`` (distinct ``url``) restricts the urls.
    """
    if not {"fetched_at", "page_id"} <= set(pages.columns):
        pages = pages if wanted is None else pages.join(wanted, "url", "left_semi")
        return pages.groupBy("url").agg(F.min("html").alias("html"))
    narrow = pages.where(F.col("url").isNotNull()).select("url", "fetched_at", "page_id")
    narrow = narrow if wanted is None else narrow.join(wanted, "url", "left_semi")
    chosen = narrow.groupBy("url").agg(F.max(F.struct("fetched_at", "page_id")).alias("last")).select("last.page_id")
    return pages.join(small_side(chosen, "latest"), "page_id", "left_semi").select("url", "html")


def fetch_pages(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """``url, html`` of the urls that have a page; urls without one are left out. Of several rows of a url the latest is taken."""
    return latest(pages, urls.select("url").distinct())


def successful(responses: DataFrame) -> DataFrame:
    """``url, html`` of responses with a status from 200 to 299 and a readable body."""
    return responses.where(F.col("status").between(200, 299) & F.col("error").isNull() & F.col("body").isNotNull()).select("url", F.col("body").alias("html"))


def chunked(urls: DataFrame, size: int) -> DataFrame:
    """``ord, url, chunk``: consecutive urls in chunks of at least one, by dense ``ord``."""
    return urls.withColumn("chunk", F.floor(F.col("ord") / max(1, size)).cast("bigint"))
