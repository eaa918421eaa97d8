"""Sanitised teasers: markup out, text truncated, empty titles dropped, only known columns kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.functions.text import clean, truncate_clean


def clean_teasers(teasers: DataFrame) -> DataFrame:
    """``url, title, introText, datetime``. An intro that is null or '' becomes null, one that cleans to '' stays ''.

    A row of which a text can't be cleaned is left out; the others go on.
    """
    cleaned = teasers.select(
        "url",
        truncate_clean(clean(F.col("title"))).alias("title"),
        truncate_clean(clean(F.when(F.col("introText") != "", F.col("introText")))).alias("introText"),
        "datetime",
        (F.col("introText") != "").alias("_intro"),
    )
    failed = F.coalesce("_intro", F.lit(False)) & F.col("introText").isNull()
    return cleaned.where(F.col("title").isNotNull() & (F.col("title") != "") & ~failed).drop("_intro")
