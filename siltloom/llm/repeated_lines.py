"""Lines repeated across one site's documents (problem 4).

Method: duplicate documents are collapsed first (clusters of equal lines within a source, whatever the html around
them), then each line is counted over distinct clusters and publication dates, so that a republished article is not
mistaken for boilerplate. A line must stand in several clusters and on several dates; its share is taken over the
clusters where lines are removed from pages, and over the rows behind them where the cases are defined on rows.

Plan: one Python pass turns a page into its lines, written once to the shared folder. Counting
reads only 64-bit line hashes; texts are read again for the few lines that can be cases, where they are
counted exactly. Counting aggregates before the shuffle, so a source or line that holds a third of all rows
is spread; the html itself is never shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltloom.functions.html import page_lines
from siltloom.session import bound_arrow, cut, small_side, spread

MIN_ROWS = 5
MIN_SHARE = 0.3
#: Distinct documents and dates (where the source has so many) that a line must have even where rows are counted: one article is no boilerplate, however often it is republished.
MIN_DOCS, MIN_DAYS = 2, 2
#: Sources up to which their repeated lines (some hundred texts each at most) are broadcast.
MAX_SOURCES = 2_000


def lines_table(pages: DataFrame) -> DataFrame:
    """``page_id, sp_source, doc_hi, doc_lo, day, lines``: each page with its lines in order.

    Pages with null or empty html stay, with no lines, for they count in the total of their source.
    """
    bound_arrow(pages.sparkSession)

    def run(batches):
        for pdf in batches:
            lines = [page_lines(h) if isinstance(h, str) else [] for h in pdf["html"]]
            pdf["lines"] = pd.Series(lines, index=pdf.index, dtype="object")
            yield pdf.drop(columns="html")

    parsed = spread(pages).select("page_id", "sp_source", F.to_date("fetched_at").alias("day"), "html").mapInPandas(run, "page_id bigint, sp_source string, day date, lines array<string>")
    return parsed.withColumns({"doc_hi": F.xxhash64("lines"), "doc_lo": F.xxhash64(F.lit(1), "lines")})


def repeated_lines(pages: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, table: DataFrame | None = None, by_documents: bool = False) -> DataFrame:
    """``sp_source, line_text, n_rows, n_docs, n_days, n_total``: the lines repeated excessively in a source.

    A line is given when it occurs on at least ``min_rows`` and ``min_share`` of the source's rows, in at least
    ``MIN_DOCS`` distinct documents and on ``MIN_DAYS`` dates on which one of them first appeared; with ``by_documents`` the
    rows are those of distinct documents (pages without lines are none). Rows without a source form a source of their
    own (null). Repeated rows count as rows each. An empty table gives no rows.
    """
    table = cut(lines_table(pages), "p4-lines") if table is None else table
    clusters = (
        table.where(F.size("lines") > 0)
        .groupBy("sp_source", "doc_hi", "doc_lo")
        .agg(F.min("page_id").alias("page_id"), F.min("day").alias("day"), F.count("*").alias("rows"))
        .select("page_id", "sp_source", "day", "rows")
    )
    if by_documents:
        clusters = cut(clusters.withColumn("rows", F.lit(1).cast("bigint")), "p4-clusters")
    total = small_side((clusters if by_documents else table).groupBy("sp_source").agg(F.count("*").alias("n_total"), F.count_distinct("day").alias("days")), "p4-total")
    clusters = clusters.drop("sp_source")
    hashes = table.where(F.size("lines") > 0).select("page_id", "sp_source", F.transform(F.array_distinct("lines"), lambda x: F.xxhash64(x)).alias("hashes"))
    counted = (
        hashes.join(clusters, "page_id")
        .select("sp_source", "day", "rows", F.explode("hashes").alias("h"))
        .groupBy("sp_source", "h", "day")
        .agg(F.sum("rows").alias("rows"), F.count("*").alias("docs"))
        .groupBy("sp_source", "h")
        .agg(F.sum("rows").alias("rows"), F.sum("docs").alias("n_docs"), F.count("*").alias("n_days"))
    )
    # a page has few lines and a case is on min_share of the pages, so there are at most
    # (lines a page / min_share) of them a source, however many pages there are
    likely = small_side(
        counted.where((F.col("rows") >= min_rows) & (F.col("n_docs") >= MIN_DOCS))
        .join(total, _same(counted, total))
        .where((F.col("rows") >= F.lit(min_share) * F.col("n_total")) & (F.col("n_days") >= F.least(F.lit(MIN_DAYS), "days")))
        .select(counted["sp_source"], "h", "n_docs", "n_days", "n_total"),
        "p4-likely",
    )
    texts = table.select("sp_source", F.explode(F.array_distinct("lines")).alias("line_text")).withColumn("h", F.xxhash64("line_text"))
    found = (
        texts.join(likely, _same(texts, likely) & (texts["h"] == likely["h"]))
        .groupBy(texts["sp_source"], "line_text")
        .agg(F.count("*").alias("n_rows"), F.first("n_docs").alias("n_docs"), F.first("n_days").alias("n_days"), F.first("n_total").alias("n_total"))
    )
    return found if by_documents else found.where((F.col("n_rows") >= min_rows) & (F.col("n_rows") >= F.lit(min_share) * F.col("n_total")))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["sp_source"].eqNullSafe(b["sp_source"])


def strip_repeated(pages: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, sp_source, text, n_removed``: every page's lines without the repeated ones of its source.

    Shares are those of distinct documents, so an article republished on many rows keeps its lines. A line that
    stands several times in a page is kept, or removed and counted, each time.
    """
    table = cut(lines_table(pages), "p4-lines")
    bad = small_side(
        repeated_lines(pages, min_rows, min_share, table, True).groupBy(F.col("sp_source").alias("source")).agg(F.collect_set("line_text").alias("bad")), "p4-bad", MAX_SOURCES
    )
    joined = table.join(bad, F.col("sp_source").eqNullSafe(F.col("source")), "left")
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("bad", x), F.lit(False)))
    return joined.select("page_id", "sp_source", F.array_join(kept, "\n").alias("text"), (F.size("lines") - F.size(kept)).alias("n_removed"))
