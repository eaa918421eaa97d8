"""What changed between full snapshots (problem 7).

Method: content-defined chunks. The rows of all snapshots are sorted by key; a chunk ends before every key
whose hash hits a boundary, so a chunk's borders depend on keys alone and stay where they are when rows
come and go elsewhere. Chunks with equal digests in two consecutive snapshots are discarded; only the rows
of the other chunks are joined to classify them as added, removed or changed.

Plan: rows shrink to (source, run, id, 128-bit content hash) and are made distinct with a map-side
combine; one range exchange by (source, id) brings all snapshots' rows of a stretch of keys together, so
chunks of consecutive runs meet in one task and a source that holds a third of all rows is spread over
many. A task keeps two runs' rows of its own stretch, and digests of a run are taken and compared at once, in arrays.
Only rows of differing chunks go on to the join: where a share r of rows changes from run to run, chunks of c keys keep
1 - (1 - r)^c of them, so chunks are small.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.session import cut

#: A chunk ends at one key in CHUNK on average. With a tenth of the rows changing between runs, a third of them is kept.
CHUNK = 3
#: Columns whose stored text makes a record changed.
CONTENT = ("title", "sp_intro", "sp_date", "sp_objecttype")


def full_runs(runs: DataFrame) -> DataFrame:
    """``crawl_process_id, sp_source, run_no, n_runs``: runs without errors, numbered from 1 within their source by start.

    Ties in ``started_at`` go by the id. Runs with null ``errors`` aren't known to be whole and are left out.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("sp_source").orderBy("started_at", "crawl_process_id")
    return (
        runs.where("errors = 0")
        .select("crawl_process_id", "sp_source", "started_at")
        .dropDuplicates(["crawl_process_id"])
        .select("crawl_process_id", "sp_source", F.row_number().over(order).alias("run_no"), F.count("*").over(Window.partitionBy("sp_source")).cast("int").alias("n_runs"))
    )


def snapshot_rows(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``sp_source, run_no, n_runs, id, hi, lo``: one row an id and full run, with the hash of its content.

    Rows repeated within a run count once; if they differ, the one indexed last (then the largest
    ``entry_id``) holds. Rows without a run, of another source's run, or without an id are left out.
    """
    hashed = [x for c in CONTENT for x in (F.col(c).isNull(), F.col(c))]
    slim = docs.where(F.col("id").isNotNull()).select(
        "crawl_process_id", F.get("sp_source", F.lit(0)).alias("sp_source"), "id",
        F.struct("indexed_at", "entry_id", F.xxhash64(*hashed).alias("hi"), F.xxhash64(F.lit(1), *hashed).alias("lo")).alias("row"),
    )
    return (
        slim.join(full_runs(runs), ["crawl_process_id", "sp_source"])
        .groupBy("sp_source", "run_no", "id")
        .agg(F.max("row").alias("row"), F.max("n_runs").alias("n_runs"))
        .select("sp_source", "run_no", "n_runs", "id", "row.hi", "row.lo")
    )


def differing_rows(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``sp_source, run_no, id, hi, lo, old``: rows of chunks that differ between a run and the one before.

    ``run_no`` is the later run; ``old`` tells the earlier run's rows.
    """
    sorted_rows = (
        rows.withColumns({"cut": F.pmod(F.xxhash64("id"), F.lit(chunk)) == 0, "key_hash": F.xxhash64(F.lit(7), "id")})
        .repartitionByRange("sp_source", "id")
        .sortWithinPartitions("sp_source", "run_no", "id")
    )
    return sorted_rows.mapInPandas(_compare_chunks, "sp_source string, run_no int, id string, hi bigint, lo bigint, old boolean")


class _Run(NamedTuple):
    """One run's rows in a stretch of keys, sorted by key, and its chunks."""

    ids: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    sizes: np.ndarray  # of the chunks
    digests: np.ndarray  # a row a chunk: hash of its first key (0 for the stretch's beginning), number of rows, two sums of row hashes


def _run(parts: list[tuple]) -> _Run:
    ids, hi, lo, cut, h = [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts)]
    with np.errstate(over="ignore"):
        h = h.astype(np.uint64)
        mix1 = (h ^ hi.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mix2 = (h * np.uint64(0xC2B2AE3D27D4EB4F)) ^ lo.astype(np.uint64)
        first = cut.copy()
        first[0] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(ids)))
        name = np.where(cut[starts], h[starts] | np.uint64(1), np.uint64(0))
        digests = np.stack([name, sizes.astype(np.uint64), np.add.reduceat(mix1, starts), np.add.reduceat(mix2, starts)], axis=1)
    return _Run(ids, hi, lo, sizes, digests)


def _digest_rows(run: _Run) -> np.ndarray:
    return np.ascontiguousarray(run.digests).view([("", np.uint64)] * 4).ravel()


def _unmatched(before: _Run | None, after: _Run | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Rows (ids, hi, lo, old) of the chunks of which the other run has no equal."""
    out = []
    for run, other, old in ((before, after, True), (after, before, False)):
        if run is not None:
            differs = np.ones(len(run.sizes), bool) if other is None else ~np.isin(_digest_rows(run), _digest_rows(other))
            if differs.any():
                rows = np.repeat(differs, run.sizes)
                out.append((run.ids[rows], run.hi[rows], run.lo[rows], old))
    return out


class _Stretch:
    """One source in one task's stretch of keys, run after run."""

    def __init__(self, source, n_runs: int):
        self.source, self.n_runs = source, n_runs
        self.last_no, self.last = 0, None
        self.parts: list[tuple] = []
        self.out: list[tuple] = []

    def compare(self, before: _Run | None, after: _Run | None, run_no: int) -> None:
        self.out += [(*x, run_no) for x in _unmatched(before, after)]

    def end_run(self, run_no: int) -> None:
        current, self.parts = _run(self.parts), []
        if self.last is not None and run_no > self.last_no + 1:  # a run without rows in this stretch lies between
            self.compare(self.last, None, self.last_no + 1)
            self.last = None
        if run_no > 1:
            self.compare(self.last, current, run_no)
        self.last, self.last_no = current, run_no

    def end(self) -> None:
        if self.last is not None and self.last_no < self.n_runs:
            self.compare(self.last, None, self.last_no + 1)

    def frame(self) -> pd.DataFrame:
        sizes = [len(x[0]) for x in self.out]
        rows = pd.DataFrame({
            "sp_source": self.source,
            "run_no": np.repeat(np.array([x[4] for x in self.out], "int32"), sizes),
            "id": np.concatenate([x[0] for x in self.out]),
            "hi": np.concatenate([x[1] for x in self.out]),
            "lo": np.concatenate([x[2] for x in self.out]),
            "old": np.repeat(np.array([x[3] for x in self.out], bool), sizes),
        })
        self.out = []
        return rows


def _compare_chunks(batches):
    here: _Stretch | None = None
    run_no = 0
    for pdf in batches:
        if not len(pdf):
            continue
        source, number, runs = pdf["sp_source"].to_numpy(), pdf["run_no"].to_numpy(), pdf["n_runs"].to_numpy()
        columns = [pdf[c].to_numpy() for c in ("id", "hi", "lo", "cut", "key_hash")]
        first = np.ones(len(pdf), bool)
        first[1:] = (source[1:] != source[:-1]) | (number[1:] != number[:-1])
        starts = np.flatnonzero(first)
        for a, b in zip(starts, np.append(starts[1:], len(pdf))):
            if here is None or source[a] != here.source:
                if here is not None:
                    here.end_run(run_no)
                    here.end()
                    if here.out:
                        yield here.frame()
                here = _Stretch(source[a], int(runs[a]))
            elif number[a] != run_no:
                here.end_run(run_no)
            run_no = int(number[a])
            here.parts.append(tuple(c[a:b] for c in columns))
        if here.out:
            yield here.frame()
    if here is not None:
        here.end_run(run_no)
        here.end()
        if here.out:
            yield here.frame()


def snapshot_changes(docs: DataFrame, runs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``sp_source, crawl_process_id`` (of the later run), ``id, change_kind`` (added, removed, changed).

    Every pair of consecutive full runs of a source is compared; its first full run gives no rows. A full
    run of which no row was delivered removes all ids. Null and '' differ. Empty tables give no rows.
    """
    rows = cut(differing_rows(snapshot_rows(docs, runs), chunk), "p7-rows")
    key = ["sp_source", "run_no", "id"]
    old = rows.where("old").select(*key, F.col("hi").alias("old_hi"), F.col("lo").alias("old_lo"))
    new = rows.where("not old").select(*key, "hi", "lo")
    kinds = (
        old.join(new, key, "full_outer")
        .where("hi is null or old_hi is null or hi <> old_hi or lo <> old_lo")
        .select(*key, F.when(F.col("old_hi").isNull(), "added").when(F.col("hi").isNull(), "removed").otherwise("changed").alias("change_kind"))
    )
    return kinds.join(full_runs(runs).drop("n_runs"), ["sp_source", "run_no"]).select("sp_source", "crawl_process_id", "id", "change_kind")
