"""New pages as a stream: the same extraction and cleaning as in a batch, run for what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siltloom.config import SiteConfig
from siltloom.plans.pipeline import teasers_of
from siltloom.session import ship_package


SCHEMA = "page_id bigint, url string, sp_source string, html string, fetched_at timestamp"


def page_stream(spark: SparkSession, folder: str, schema: str = SCHEMA, max_files: int = 64, pattern: str | None = None) -> DataFrame:
    """Parquet files of pages as they arrive in ``folder``, a bounded number of files in a batch; only those whose name has the ``pattern``, if there is one."""
    ship_package(spark)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def stream_teasers(pages: DataFrame, config: SiteConfig, target: str, checkpoint: str) -> StreamingQuery:
    """Append the teasers of all pages that have arrived, then stop; every page is processed once, also after a restart."""
    return teasers_of(pages, config).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
