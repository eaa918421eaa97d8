"""A site's run from urls to the index, and the batch over all sites."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from typing import Any
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession

from siltloom.config import SiteConfig, load_parameters, site_config, site_registry
from siltloom.operators.clean import clean_teasers
from siltloom.operators.discover import discover, link_graph
from siltloom.operators.extract import dom_pass, teaser_columns
from siltloom.operators.index import Index, Status, documents, new_run_id
from siltloom.operators.score import relevant
from siltloom.operators.urls import final_urls
from siltloom.schemas import TEASERS
from siltloom.session import cut, ship_package, temporary
from siltloom.sources.fetch import RobotsTexts, fetch_live
from siltloom.sources.pages import fetch_pages, successful

log = logging.getLogger("siltloom.crawler")


def extract_teasers(pages: DataFrame, config: SiteConfig) -> DataFrame:
    """``url, title, introText, datetime`` of pages: parse, required fields, caps, relevance."""
    raw = dom_pass(pages, config, need_body=config.scoring.active)
    return relevant(teaser_columns(raw, config), config.scoring, config.forced_article_urls).drop("body_text")


def teasers_of(pages: DataFrame, config: SiteConfig) -> DataFrame:
    return clean_teasers(extract_teasers(pages, config))


def step(name: str, run: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """Run one step to its end; an error is logged and gives an empty table, an empty result is warned of.

    Transformations are lazy, so the step is written before it counts as done.
    """
    try:
        out = cut(run(), f"step-{name}")
    except Exception:
        log.exception("step %s failed", name)
        return spark.createDataFrame([], schema)
    if out.isEmpty():
        log.warning("step %s gave nothing", name)
    return out


def run_site(
    spark: SparkSession, config: SiteConfig, pages: DataFrame, index: Index, robots_text: str | None = None, on_missing: str = "fail", allow_empty_snapshot: bool = True,
    date_field: str = "date", starts: DataFrame | None = None, graph: DataFrame | None = None, make_send: Callable | None = None,
) -> Status:
    """One run: collect urls, fetch, parse, clean, replace the source's snapshot. A failed step goes on with nothing.

    Pages come from the table, or, with ``make_send`` (see ``fetch_live``), the collected urls are fetched anew.
    """
    ship_package(spark)
    with temporary(spark):
        urls = step("collect", lambda: final_urls(discover(pages, config, on_missing, starts, graph), config, robots_text), spark, "ord bigint, url string")
        fetched = (lambda: fetch_pages(urls, pages)) if make_send is None else (lambda: successful(fetch_live(urls, config, make_send)))
        teasers = step("teasers", lambda: teasers_of(fetched(), config), spark, TEASERS)
        docs = documents(teasers, config.id, new_run_id(), config.intro.present, config.datetime.present, date_field)
        status = index.replace(docs, config.id, None, allow_empty_snapshot)
    log.log(logging.ERROR if status.errors else logging.INFO, "%s: %s", config.id, status)
    return status


def load_text(url: str, timeout: float = 10.0) -> str:
    """The text at ``url``, as for robots.txt."""
    with urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read().decode("utf-8", "replace")


def run_all(spark: SparkSession, registry: dict[str, Any], folder: str, pages: DataFrame, index: Index, load_robots: Callable[[str], str] = load_text) -> int:
    """Every site of the registry in turn; ends at the first that fails. 0: success, also where there are no sites.

    Pages are parsed for their links once for all sites that look for them in the same place; robots.txt is loaded
    once a url, and only where a site respects it.
    """
    sites = site_registry(registry)
    if not sites:
        log.info("no sites")
        return 0
    ship_package(spark)
    graphs: dict[tuple[str, str], DataFrame] = {}
    robots = RobotsTexts(load_robots)
    for key, _ in sites:
        if not key:
            log.error("a site without a key")
            return 1
        try:
            config, _ = site_config(load_parameters(folder, key))
            place = (config.link_section, config.link_selector)
            if config.start_urls and place not in graphs:
                graphs[place] = link_graph(pages, *place)
            text = robots.get(config.robots_url) if config.respect_robots_txt else None
            run_site(spark, config, pages, index, text, graph=graphs.get(place))
        except Exception:
            log.exception("site %s failed", key)
            return 1
    return 0


def main(argv: list[str] | None = None) -> int:
    """``python -m siltloom.plans.pipeline REGISTRY.yaml SITES_DIR PAGES_TABLE INDEX_DIR``"""
    import yaml

    parser = argparse.ArgumentParser(description="Run all sites over a table of pages.")
    for name in ("registry", "sites_dir", "pages", "index"):
        parser.add_argument(name)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    with open(args.registry, encoding="utf-8") as f:
        registry = yaml.safe_load(f) or {}
    return run_all(spark, registry.get("parameters", registry), args.sites_dir, spark.read.parquet(args.pages), Index(spark, args.index))


if __name__ == "__main__":
    raise SystemExit(main())
