"""Duplicates hidden by formatting differences (problem 1).

Method: an incremental ledger. Records get a canonical key (128-bit hash of the text without whitespace,
punctuation and letter case, with url parameters and JSON keys in order). The ledger keeps, in buckets of
the key, the number of copies and the earliest representative of each record. Every new batch is aggregated
first, then full-outer-joined against the ledger's matching buckets: counts are added, the earliest
representative is retained, and untouched buckets are not read or written. A manifest tells where each bucket's current
version lies; it is swapped in one step when a batch is done, so a ledger lives on from job to job.

A record that makes up a third of all rows is one row after the aggregation of each task, so nothing is
skewed there; where copies are listed, hot records go by a broadcast of a bounded number of rows.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltloom.functions.skew import join_counted
from siltloom.pointer import Pointer
from siltloom.session import bound_arrow, cut, work_folder

#: Whitespace of every kind (zero-width ones included) and punctuation.
_STRIP = r"[\s\p{Z}\p{P}\x1c-\x1f\x85\x{200b}\x{2060}\x{feff}]+"
#: Buckets at least, records a bucket on average, and how many times that before a ledger gets more buckets.
BUCKETS, ROWS, GROWN = 8, 1_000_000, 4


def canonical(text: Column) -> Column:
    """Text without whitespace, punctuation and case (full Unicode case, ß equals SS); null stays null."""
    # lower, then upper folds all of Unicode; the step between keeps the optimizer from leaving out the first
    return F.regexp_replace(F.upper(F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))), _STRIP, "")


def canonical_url(url: Column) -> Column:
    """As ``canonical``, and the query's parameters in order."""
    head, fragment = F.substring_index(url, "#", 1), F.regexp_extract(url, "#(.*)$", 1)
    base, query = F.substring_index(head, "?", 1), F.regexp_extract(head, r"(?s)\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.transform(F.split(query, "&"), canonical), lambda p: p != ""))
    return F.concat(canonical(base), F.lit("?"), F.array_join(parts, "&"), F.lit("#"), canonical(fragment))


def _value(c: Column) -> Column:
    """Null is a value of its own, equal to null only."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit("0"))


def _key(origin: str, parts: Column) -> list[Column]:
    whole = F.concat(F.lit(origin), F.lit("\x1f"), parts)
    return [F.xxhash64(whole).alias("hi"), F.xxhash64(F.lit(1), whole).alias("lo")]


def teaser_records(teasers: DataFrame) -> DataFrame:
    """``origin, row_key, arrived, hi, lo`` of teasers (``url``, ``title``, ``introtext``)."""
    parts = F.concat_ws("\x1f", _value(canonical_url(F.col("url"))), _value(canonical(F.col("title"))), _value(canonical(F.col("introtext"))))
    return teasers.select(F.lit("teasers_raw").alias("origin"), F.col("teaser_id").alias("row_key"), F.col("harvested_at").alias("arrived"), *_key("teasers_raw", parts))


def _flat(payload: str | None) -> dict[str, str | None] | None:
    """Keys and values of a JSON object; None for null, broken or other payloads. Lists and objects become lines."""
    try:
        x = json.loads(payload) if isinstance(payload, str) else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(x, dict):
        return None
    out: dict[str, str | None] = {}
    todo = [(k, v) for k, v in x.items()]
    while todo:
        k, v = todo.pop()
        if isinstance(v, dict):
            out[k + "\x1d{}"] = ""
            todo.extend((f"{k}\x1d{a}", b) for a, b in v.items())
        elif isinstance(v, list):
            out[k + "\x1d[]"] = ""
            todo.extend((f"{k}\x1d{i}", b) for i, b in enumerate(v))
        else:
            out[k] = None if v is None else v if isinstance(v, str) else json.dumps(v)
    return out


def json_records(raw: DataFrame) -> DataFrame:
    """``origin, row_key, arrived, hi, lo`` of payloads; null, broken and non-object payloads are no records.

    Keys may come in any order; nested values are compared by their paths.
    """
    bound_arrow(raw.sparkSession, 5000)

    @F.pandas_udf("map<string,string>")
    def flat(payload: pd.Series) -> pd.Series:
        return payload.map(_flat)

    parsed = raw.select("raw_id", "received_at", flat("payload").alias("m")).where(F.col("m").isNotNull())
    is_url = lambda v: F.lower(F.ltrim(v)).rlike(r"^\s*https?://")
    entry = lambda e: F.concat(
        e["key"], F.lit("\x1e"), _value(F.when(is_url(e["value"]), canonical_url(e["value"])).otherwise(canonical(e["value"])))
    )
    parts = F.array_join(F.array_sort(F.transform(F.map_entries("m"), entry)), "\x1f")
    return parsed.select(F.lit("index_raw").alias("origin"), F.col("raw_id").alias("row_key"), F.col("received_at").alias("arrived"), *_key("index_raw", parts))


class Ledger:
    """Counts and earliest representatives of records, in buckets of their key, below one folder.

    Every ``apply`` writes the touched buckets anew in a folder of its own and then swaps the manifest (number of
    buckets and of records, folder of each bucket, name of the last batch), so a failed write leaves the ledger as it was;
    opened again, by any process, it goes on from there. One writer at a time. Folders that no bucket lies in
    any more are removed one batch later, when no reader of the manifest before can need them.
    """

    COLUMNS = "bucket int, origin string, hi bigint, lo bigint, n_copies bigint, first_key bigint"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or work_folder(spark, "ledger")
        self.pointer = Pointer(spark, self.path, "manifest.json")
        self.state = self.pointer.read() or {"buckets": buckets, "batches": 0, "rows": 0, "versions": {}, "last": None}

    @property
    def buckets(self) -> int:
        """Number of buckets; chosen by the first batch's size if it was not given, and doubled as the ledger grows."""
        return self.state["buckets"] or BUCKETS

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.col("hi"), F.lit(buckets)).cast("int").alias("bucket")

    def _at(self, buckets) -> DataFrame:
        paths: dict[str, list[int]] = {}
        for b in buckets:
            if str(b) in self.state["versions"]:
                paths.setdefault(self.state["versions"][str(b)], []).append(b)
        out = None
        for path, own in paths.items():
            part = self.spark.read.schema(self.COLUMNS).parquet(f"{self.path}/{path}").where(F.col("bucket").isin(own))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], self.COLUMNS) if out is None else out

    def _commit(self, table: DataFrame, touched: list[int], buckets: int, name: str | None) -> None:
        folder = f"batch-{self.state['batches'] + 1}-{uuid.uuid4().hex}"
        table.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        before = set(self.state["versions"].values())
        anew = buckets != self.state["buckets"]
        replaced = self.state["rows"] if anew else self._at(touched).count()
        versions = ({} if anew else self.state["versions"]) | dict.fromkeys(map(str, touched), folder)
        rows = self.state["rows"] - replaced + self.spark.read.schema(self.COLUMNS).parquet(f"{self.path}/{folder}").count()
        self.state = {"buckets": buckets, "batches": self.state["batches"] + 1, "rows": rows, "versions": versions, "last": name}
        self.pointer.write(self.state)
        self.pointer.remove_others(before | set(versions.values()))

    def apply(self, batch: DataFrame, name: str | None = None) -> None:
        """Take in ``origin, row_key, hi, lo`` of new rows. An empty batch changes nothing, and neither does one with the name of the last."""
        if name is not None and name == self.state["last"]:
            return
        news = cut(batch.groupBy("origin", "hi", "lo").agg(F.count("*").alias("more"), F.min("row_key").alias("new_key")), "ledger-batch")
        if self.state["buckets"] is None or self.state["rows"] > GROWN * ROWS * self.buckets:
            self._rebucket(max(news.count(), self.state["rows"]), name)
        news = news.select(self._bucket(self.buckets), "*")
        touched = sorted(r[0] for r in news.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return
        merged = (
            self._at(touched)
            .join(news, ["bucket", "origin", "hi", "lo"], "full_outer")
            .select(
                "bucket", "origin", "hi", "lo",
                (F.coalesce("n_copies", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_copies"),
                F.least("first_key", "new_key").alias("first_key"),
            )
        )
        self._commit(merged, touched, self.buckets, name)

    def _rebucket(self, rows: int, name: str | None) -> None:
        """More buckets, for so many records. Only an outgrown ledger is written anew as a whole."""
        buckets = max(BUCKETS, -(-rows // ROWS))
        if self.state["versions"]:
            table = self.table().drop("bucket").select(self._bucket(buckets), "origin", "hi", "lo", "n_copies", "first_key")
            self._commit(table, list(range(buckets)), buckets, self.state["last"])
        else:
            self.state["buckets"] = buckets

    def table(self) -> DataFrame:
        """``bucket, origin, hi, lo, n_copies, first_key`` of all records so far."""
        return self._at(range(self.buckets))


def fill_ledger(records: DataFrame, batches: int = 3, buckets: int | None = None) -> Ledger:
    """A ledger that took in ``records`` in ``batches`` steps by their time of arrival (nulls come first)."""
    ledger = Ledger(records.sparkSession, None, buckets)
    at = F.unix_micros("arrived").cast("double")
    shares = [i / batches for i in range(1, batches)]
    cuts = records.where(F.col("arrived").isNotNull()).select(at.alias("at")).approxQuantile("at", shares, 0.05) if shares else []
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:]):
        part = records
        if low is not None:
            part = part.where(at >= low)
        if high is not None:
            part = part.where((at < high) | F.col("arrived").isNull() if low is None else at < high)
        ledger.apply(part)
    return ledger


def all_records(teasers: DataFrame, raw: DataFrame) -> DataFrame:
    """The records of both tables, written once."""
    return cut(teaser_records(teasers).unionByName(json_records(raw)), "p1-records")


def copies(records: DataFrame, ledger: Ledger) -> DataFrame:
    """``origin, first_key, copy_key``: the smallest key of each record with several rows, with each other key."""
    known = ledger.table().where("n_copies > 1").drop("bucket")
    listed = join_counted(records, known, ["origin", "hi", "lo"], "n_copies", records.count())
    return listed.where("row_key <> first_key").select("origin", "first_key", F.col("row_key").alias("copy_key"))


def format_duplicates(teasers: DataFrame, raw: DataFrame) -> DataFrame:
    """All copies of records of ``teasers`` and ``raw`` (see ``copies``)."""
    records = all_records(teasers, raw)
    return copies(records, fill_ledger(records))


def distinct_records(teasers: DataFrame, raw: DataFrame) -> DataFrame:
    """``origin, first_key, n_copies``: one row a record."""
    return fill_ledger(all_records(teasers, raw)).table().select("origin", "first_key", "n_copies")
