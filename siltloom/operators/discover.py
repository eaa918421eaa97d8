"""Bounded breadth-first link discovery over a table of pages.

Pages are parsed once, into a graph of links without html; levels are expanded on that graph alone. A level's links
are numbered by their path (positions from the start), which sorts as the queue would; seen urls are left out by an anti
join. A start whose links have reached the cap loads no more pages, so what lies behind the cap is neither read nor missed.
Every level is written to the shared folder once, so lineage does not grow and nothing is written again.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltloom.config import SiteConfig
from siltloom.functions.css import SelectorError, first, select
from siltloom.functions.html import parse
from siltloom.functions.urls import resolve, starts_with_any
from siltloom.session import bound_arrow, cut, spread
from siltloom.sources.pages import latest

LINK_SCHEME = "https://"


class MissingPage(RuntimeError):
    """A page that must be expanded is not there."""


def links_of(page: str | None, url: str, section: str, selector: str) -> list[str]:
    """Absolute links of a page in document order: elements of ``selector`` in every ``section`` (all, if it is '')."""
    if not page:
        return []
    root = parse(page)
    try:
        scopes = list(select(root, section)) if section else [root]
        nodes = [n for s in scopes for n in select(s, selector)]
    except SelectorError:
        return []
    out = []
    for n in nodes:
        href = n.attrs.get("href")
        link = resolve(url, href) if href is not None else None
        if link is not None and link.startswith(LINK_SCHEME):
            out.append(link)
    return out


def extract_links(pages: DataFrame, section: str, selector: str) -> DataFrame:
    """``url, links``: one Python pass over ``url, html``; nothing else is read."""
    bound_arrow(pages.sparkSession)

    def run(batches):
        for pdf in batches:
            links = [links_of(h if isinstance(h, str) else None, u, section, selector) for u, h in zip(pdf["url"], pdf["html"])]
            yield pd.DataFrame({"url": pdf["url"], "links": pd.Series(links, index=pdf.index, dtype="object")})

    return spread(pages.select("url", "html")).mapInPandas(run, "url string, links array<string>")


def explode_links(pages: DataFrame, section: str, selector: str) -> DataFrame:
    """``src_url, pos, dst_url`` of all links."""
    return extract_links(pages, section, selector).select(F.col("url").alias("src_url"), F.posexplode("links").alias("pos", "dst_url"))


def link_graph(pages: DataFrame, section: str, selector: str) -> DataFrame:
    """``url, links`` of each url's latest page, parsed once and written: what discovery needs of the pages."""
    return cut(extract_links(latest(pages), section, selector), "links")


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def crawl(graph: DataFrame, starts: DataFrame, config: SiteConfig, on_missing: str = "fail") -> DataFrame:
    """``start, path, url``: the links found from each start, in the order of ``size(path), path``.

    ``graph``: ``url, links``; ``starts``: ``start, url, max_depth``. See ``discover``.
    """
    limit = config.max_teaser
    allowed = F.col("links")
    if config.deny_prefixes:
        allowed = F.filter(allowed, lambda x: ~starts_with_any(x, config.deny_prefixes))
    if config.allow_prefixes:
        allowed = F.filter(allowed, lambda x: starts_with_any(x, config.allow_prefixes))
    graph = graph.select("url", allowed.alias("links"))
    frontier = cut(starts.select("start", "url", "max_depth", F.array().cast("array<int>").alias("path")), "bfs-starts")
    found: list[DataFrame] = []
    seen = [frontier.select("start", "url")]
    counts = frontier.select("start").distinct().withColumn("before", F.lit(0).cast("bigint"))
    depth = 0
    while limit > 0 and not frontier.isEmpty():
        level = cut(frontier.join(graph, "url", "left").withColumn("k", F.coalesce(F.size("links"), F.lit(0))), "bfs-level")
        totals = cut(level.groupBy("start").agg(F.sum("k").alias("now")).join(counts, "start").withColumn("full", F.col("before") + F.col("now") >= limit), "bfs-totals")
        plain = level.join(totals.where("not full").select("start"), "start", "left_semi")
        # of a start that reaches the cap, the queue so far has no more rows than the cap
        before = F.coalesce(F.sum("k").over(Window.partitionBy("start").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
        capped = level.join(totals.where("full").select("start", "before"), "start").withColumn("n", before).where(F.col("n") < limit)
        capped = capped.withColumn("links", F.slice("links", 1, F.least(F.col("k").cast("bigint"), F.lit(limit) - F.col("n")).cast("int")))
        loaded = plain.select("start", "url", "max_depth", "path", "links", F.lit(False).alias("full")).unionByName(capped.select("start", "url", "max_depth", "path", "links", F.lit(True).alias("full")))
        if on_missing == "fail":
            missing = loaded.where("links is null").limit(1).collect()
            if missing:
                raise MissingPage(missing[0]["url"])
        links = loaded.select("start", "max_depth", "path", "full", F.posexplode("links").alias("pos", "link"))
        new = cut(links.select("start", "max_depth", "full", F.col("link").alias("url"), F.concat("path", F.array(F.col("pos").cast("int"))).alias("path")), "bfs-found")
        found.append(new.select("start", "path", "url"))
        counts = totals.where("not full").select("start", (F.col("before") + F.col("now")).alias("before"))
        depth += 1
        first_seen = new.where((F.col("max_depth") >= depth) & ~F.col("full")).groupBy("start", "url").agg(F.min("path").alias("path"), F.max("max_depth").alias("max_depth"))
        frontier = cut(first_seen.join(reduce(DataFrame.unionByName, seen), ["start", "url"], "left_anti").select("start", "url", "max_depth", "path"), "bfs-frontier")
        seen.append(frontier.select("start", "url"))
    return reduce(DataFrame.unionByName, found) if found else _empty(graph.sparkSession, "start int, path array<int>, url string")


def discover(pages: DataFrame, config: SiteConfig, on_missing: str = "fail", starts: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """``ord, url``: links in the order a queue finds them, from every start url down to its depth; ``ord`` only tells the order.

    Links found on pages of the last level are given but not expanded; a url is expanded once a start, at its
    first place. At most ``max_teaser`` links a start count, equal ones included; a start that has them loads no more
    pages. A missing page that would be loaded fails the step, or gives no links with ``on_missing="skip"``; of several
    rows of one url the latest is taken. ``starts`` (``start, url, max_depth``; start is a number below 2^31) stands in for
    the configured start urls where there are many, ``graph`` (see ``link_graph``) for the pages.
    """
    spark = pages.sparkSession
    if starts is not None:
        starts = starts.select(F.col("start").cast("int"), "url", F.col("max_depth").cast("int"))
    elif config.start_urls:
        starts = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(config.start_urls)], "start int, url string, max_depth int")
    else:
        return _empty(spark, "ord bigint, url string")
    graph = link_graph(pages, config.link_section, config.link_selector) if graph is None else graph
    order = ["start", F.size("path"), "path"]
    # ranges in order, sorted: the running number of a row follows the order without any task seeing a whole start
    ranged = crawl(graph, starts, config, on_missing).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.select(F.monotonically_increasing_id().alias("ord"), "url"), "bfs-urls")
