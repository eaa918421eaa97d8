"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than this part of all rows, so there are fewer hot keys than parts.
HOT_PARTS = 1000


def split_hot(rows: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """The rows of no hot key: these are taken out where they are read, before any shuffle. ``hot`` is small (see ``join_counted``)."""
    return rows.join(F.broadcast(hot.select(*on)), on, "left_anti")


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row a key and the key's number of rows in ``count``.

    Keys with more than ``total / HOT_PARTS`` rows, of which there are fewer than ``HOT_PARTS``, are broadcast to
    their rows, which stay where they are; only the rows of other keys are shuffled, and none of these keys is
    large. No row is dropped or doubled.
    """
    limit = total // HOT_PARTS
    hot = keyed.where(F.col(count) > limit)
    cold = keyed.where(F.col(count) <= limit)
    return rows.join(F.broadcast(hot), on).unionByName(split_hot(rows, hot, on).join(cold, on))
