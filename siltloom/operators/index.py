"""Index documents and the snapshot sink: a run replaces its source's documents.

The index is a folder of Parquet with one sub-folder a source, in which every snapshot is a version of its own. A run's
documents are written beside the old ones and a pointer is moved to them in one step, so a reader or a failed write never
sees half a snapshot or none; the snapshot before stays until the next run for those who are reading it.
"""

from __future__ import annotations

import logging
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltloom.pointer import Pointer
from siltloom.schemas import DOCUMENTS

log = logging.getLogger("siltloom.crawler")


class Status(NamedTuple):
    """Of a run: documents offered, taken and failed."""

    total: int
    processed: int
    errors: int


def new_run_id() -> str:
    """One for a whole run, never for a row."""
    return uuid.uuid4().hex


def documents(teasers: DataFrame, source: str, run_id: str, intro_present: bool, date_present: bool, date_field: str = "date") -> DataFrame:
    """Teasers as index documents.

    The date is read from ``date_field``: cleaned teasers have ``datetime`` and no ``date``, so ``sp_date`` stays
    null unless ``date_field="datetime"``. An intro of '' or "0" counts as none.
    """
    intro = F.when(F.col("introText").isNotNull() & ~F.col("introText").isin("", "0"), F.col("introText")) if intro_present else F.lit(None).cast("string")
    date = F.lit(None).cast("timestamp")
    if date_present and date_field in teasers.columns:
        kind = dict(teasers.dtypes)[date_field]
        date = F.col(date_field) if kind == "timestamp" else F.coalesce(*[F.try_to_timestamp(F.col(date_field), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy")])
    return teasers.select(
        F.col("url").alias("id"), "title", intro.alias("sp_intro"), date.alias("sp_date"), "url", F.lit(source).alias("sp_objecttype"),
        F.lit(run_id).alias("crawl_process_id"), F.array(F.lit(source)).alias("sp_source"),
    )


def upsert(old: DataFrame, new: DataFrame, complete: bool, order: list[str] | None = None) -> DataFrame:
    """The source's documents after a run: those of ``new``, and, if the run was not complete, the old ones it did not replace.

    Of documents with one id in ``new`` the one added last is kept: the last by ``order``, columns of ``new``. Documents of
    a run have distinct ids, so without an ``order`` the largest title, then intro, stands for the last.
    """
    by = [F.col(c).desc_nulls_last() for c in [*(order or []), "title", "sp_intro"]]
    rank = F.row_number().over(Window.partitionBy("id").orderBy(*by))
    new = new.withColumn("_n", rank).where("_n = 1").select(*old.columns)
    return new if complete else new.unionByName(old.join(new.select("id"), "id", "left_anti").select(*new.columns))


class Index:
    """A folder of documents by source."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, source: str) -> str:
        safe = "".join(c if c.isalnum() or c in "-_." else f"%{ord(c):04x}" for c in source)
        return f"{self.path}/source={safe}"

    def read(self, source: str) -> DataFrame:
        place = self._place(source)
        current = Pointer(self.spark, place).read()
        return self.spark.createDataFrame([], DOCUMENTS) if current is None else self.spark.read.schema(DOCUMENTS).parquet(f"{place}/{current['version']}")

    def replace(self, docs: DataFrame, source: str, failed: DataFrame | None = None, allow_empty_snapshot: bool = True, order: list[str] | None = None) -> Status:
        """Write a run's documents and delete the source's stale ones if none failed.

        ``failed``: ids that could not be taken; they are left out, and then nothing old is deleted. An empty run
        wipes the source, unless ``allow_empty_snapshot`` is false, when the old documents stay. ``order``: see ``upsert``.
        """
        total = docs.count()
        good = docs if failed is None else docs.join(failed.select("id"), "id", "left_anti")
        processed = total if failed is None else good.count()
        if total == 0 and not allow_empty_snapshot:
            log.warning("%s: an empty run; the snapshot stays", source)
            return Status(0, 0, 0)
        place, version = self._place(source), f"v-{uuid.uuid4().hex}"
        pointer = Pointer(self.spark, place)
        current = pointer.read()
        upsert(self.read(source), good, processed >= total, order).write.parquet(f"{place}/{version}")
        pointer.write({"version": version, "total": total, "processed": processed, "errors": total - processed})
        pointer.remove_others({version, current["version"]} if current else {version})
        if processed < total:
            log.error("%s: %d of %d documents failed", source, total - processed, total)
        return Status(total, processed, total - processed)

    def status(self, source: str) -> Status | None:
        """Of the last run that was taken; None where there was none."""
        current = Pointer(self.spark, self._place(source)).read()
        return None if current is None else Status(current["total"], current["processed"], current["errors"])

    # the remaining surface of an indexer: nothing to do for a batch index
    enabled = True

    def abort(self) -> None:
        """Nothing runs in the background."""

    def remove(self, ids: list[str]) -> None:
        """Documents are removed by the next snapshot."""
