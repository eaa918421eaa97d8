import random
from statistics import median
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from siltloom.functions.instants import readings
from siltloom.functions.skew import join_counted
from siltloom.operators.snapshots import snapshot_changes
from siltloom.operators.timestamps import normalise

RUNS = "crawl_process_id string, sp_source string, started_at timestamp, finished_at timestamp, errors int"
DOCS = "entry_id bigint, id string, title string, sp_intro string, sp_date string, url string, sp_objecttype string, crawl_process_id string, sp_source array<string>, indexed_at timestamp, run_no string, hi string"
T = datetime(2024, 1, 1)


def at(n):
    return datetime(2024, 1, 1 + n)


def test_snapshots_against_brute_force(spark):
    rng = random.Random(3)
    runs, docs, state = [], [], {}
    for s in ("a", "b", "c"):
        for n in range(6):
            runs.append((f"{s}{n}", s, at(n), at(n), 1 if n == 3 else 0))
    full = {}
    entry = 0
    for s in ("a", "b"):  # c has runs and no documents
        have = {f"{s}-{i:04d}": rng.randrange(9) for i in range(300)}
        for n in range(6):
            if n == 4 and s == "b":
                have = {}
            for i in list(have):
                if rng.random() < 0.03:
                    del have[i]
                elif rng.random() < 0.03:
                    have[i] = rng.choice([None, 1, 2, 3])
            if n != 4:
                have |= {f"{s}-{rng.randrange(400):04d}": 5 for _ in range(5)}
            full[s, n] = dict(have)
            for i, v in have.items():
                for _ in range(40 if i == "a-0007" else rng.choice([1, 1, 2])):
                    entry += 1
                    docs.append((entry, i, None if v is None else f"t{v}", None, "", i, "o", f"{s}{n}", [s], T, "clash", "clash"))
    docs.append((entry + 1, None, "x", None, None, None, None, "a0", ["a"], T, None, None))
    docs.append((entry + 2, "lost", "x", None, None, None, None, None, None, None, None, None))
    expected = set()
    for s in ("a", "b"):
        order = [n for n in range(6) if n != 3]
        for p, n in zip(order, order[1:]):
            old, new = full[s, p], full[s, n]
            for i in old.keys() | new.keys():
                kind = "added" if i not in old else "removed" if i not in new else "changed" if old[i] != new[i] else None
                if kind:
                    expected.add((s, f"{s}{n}", i, kind))
    got = [tuple(r) for r in snapshot_changes(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(runs, RUNS), 8).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_snapshots_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert snapshot_changes(empty, spark.createDataFrame([], RUNS)).count() == 0
    assert snapshot_changes(empty, spark.createDataFrame([("x", "a", T, T, 0), ("y", "a", at(2), T, None)], RUNS)).count() == 0


VALUES = "origin string, record_key bigint, sp_source string, raw string, block string, forms string"
SITES = "sp_source string, site_key string, time_zone string, date_order string"


def test_path_over_blocks(spark):
    """The result must not depend on where blocks are cut, and equals Viterbi over the whole sequence."""
    from siltloom.operators.timestamps import best_path

    rng = random.Random(8)
    seq = []
    for k in range(400):
        a, b = rng.randint(1, 12), rng.randint(1, 12)
        seq.append((k * 3, rng.choice([f"{a:02d}/{b:02d}/2020", f"{a:02d}/{b:02d}/2020", f"2020-{a:02d}-{b:02d}T00:00:00Z", f"{b + 12}/{a}/2020" if b < 13 else "x", "n/a", None])))
    rows = [("t", k, "s", v, "clash", None) for k, v in seq] + [("t", 5, "other", "2020-01-01", None, None), ("t", 6, None, "2020-01-01T00:00Z", None, None)]
    sites = spark.createDataFrame([("s", "x", "UTC", None), ("s2", "x", "UTC", "dmy")], SITES)
    known = [(k, readings(v, "UTC", None)) for k, v in seq]
    known = [(k, r) for k, r in known if r]
    path = best_path([(np.array([x.form for x in r]), np.array([x.utc_us for x in r]), np.array([x.cost for x in r])) for _, r in known])
    best = {(k, r[i].utc_us) for (k, r), i in zip(known, path)}
    cost = lambda chosen: sum((a.form != b.form) + 0.5 * (b.utc_us < a.utc_us) for a, b in zip(chosen, chosen[1:]))
    for block in (16, 100, 1 << 16):
        got = {(r[1], r[3]) for r in normalise(spark.createDataFrame(rows, VALUES).repartition(4), sites, block).where("sp_source = 's'").collect()}
        assert len(got) == len(best)
        by = {k: {x.utc_us: x for x in r} for k, r in known}
        assert cost([by[k][us] for k, us in sorted(got)]) == cost([by[k][us] for k, us in sorted(best)])


def test_path_decides(spark):
    """Where the registry is silent the neighbours decide; where it speaks it is followed."""
    rows = [("t", 1, "s", "25/03/2024", None, None), ("t", 2, "s", "04/05/2024", None, None), ("t", 3, "s", "26/05/2024", None, None)]
    rows += [("t", 1, "u", "03/25/2024", None, None), ("t", 2, "u", "04/05/2024", None, None), ("t", 3, "u", "05/26/2024", None, None)]
    rows += [("t", 1, "v", "2024-10-27T02:10", None, None), ("t", 2, "v", "2024-10-27T02:40", None, None), ("t", 3, "v", "2024-10-27T02:20", None, None), ("t", 4, "v", "2024-10-27T03:00", None, None)]
    rows += [("t", 1, "w", "25/03/2024", None, None), ("t", 2, "w", "04/05/2024", None, None)]
    sites = spark.createDataFrame([("s", "", "UTC", None), ("u", "", "UTC", None), ("v", "", "Europe/Berlin", None), ("w", "", "UTC", "mdy")], SITES)
    for block in (2, 1 << 16):
        got = {(r[2], r[1]): (datetime(1970, 1, 1) + timedelta(microseconds=r[3])).strftime("%m-%d %H:%M") for r in normalise(spark.createDataFrame(rows, VALUES), sites, block).collect()}
        assert (got["s", 2], got["u", 2], got["w", 2]) == ("05-04 00:00", "04-05 00:00", "04-05 00:00")
        assert [got["v", k] for k in (1, 2, 3, 4)] == ["10-27 00:10", "10-27 00:40", "10-27 01:20", "10-27 02:00"]


def test_timestamps_defined_cases(spark):
    sites = spark.createDataFrame([("s", "x", "Europe/Berlin", "dmy")], SITES)
    rows = [("t", 1, "s", "2023-10-29 02:30", None, None), ("t", 2, "s", "2023-03-26 02:30", None, None), ("t", 3, "s", "x" * 10_000, None, None), ("t", 4, "gone", "2020-01-01", None, None), ("t", 4, "gone", "1589019627", None, None)]
    got = sorted((r[1], r[4]) for r in normalise(spark.createDataFrame(rows, VALUES), sites).collect())
    assert got == [(1, False), (4, True)]
    assert normalise(spark.createDataFrame([], VALUES), sites).count() == 0


def test_join_counted_keeps_all_rows(spark):
    rows = spark.createDataFrame([(1 if i % 3 == 0 else i, i) for i in range(3000)], "k bigint, v bigint")
    keyed = rows.groupBy("k").count()
    assert join_counted(rows, keyed, ["k"], "count", 3000).count() == 3000


def test_hot_keys_are_not_shuffled(spark):
    """A third of all rows has one key: no task gets much more than the others."""
    n = 300_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id").repartition(8)
    keyed = rows.groupBy("k").count()
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        joined = join_counted(rows, keyed, ["k"], "count", n)
        sizes = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sum(sizes) == n and max(sizes) <= 2 * median(sizes)
    assert "LeftAnti, BuildRight" in plan
