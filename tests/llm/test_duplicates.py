import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltloom.llm.format_duplicates import Ledger, all_records, copies, distinct_records, fill_ledger, format_duplicates, teaser_records

T0 = datetime(2024, 1, 1)
TEASERS = "teaser_id bigint, url string, title string, introtext string, harvested_at timestamp, hi string, n_copies string"
RAW = "raw_id bigint, received_at timestamp, payload string"


def teasers(spark, *rows):
    return spark.createDataFrame([(i, u, t, x, None if i % 7 == 0 else T0 + timedelta(hours=i), "clash", None) for i, (u, t, x) in enumerate(rows, 1)], TEASERS)


def raw(spark, *payloads):
    return spark.createDataFrame([(i, T0 + timedelta(hours=i), p) for i, p in enumerate(payloads, 1)], RAW)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_what_counts_as_the_same(spark):
    t = teasers(
        spark,
        ("https://h/x?a=1&b=2", "Straße – groß", None), ("HTTPS://H/x/?b=2&a=1&", "STRASSE\xa0gross!", None), ("https://h/x?a=1&b=2", "Straße – groß", ""),
        (None, None, None), (None, None, None), ("https://h/x?a=1&b=3", "Straße – groß", None), ("https://h/x?a=1&b=2", "„Straße“  groß", None),
        ("https://h/y", "ΣΑΣ", "ẞ"), ("https://h/y ", "σας", "ss"), ("https://h/y#b", "σας", "ss"),
    )
    r = raw(
        spark, '{"id":"https://h/?a=1&b=2","t":["x","y"],"n":null}', '{ "t" : ["X", "Y."], "n": null,\n "id": "https://h/?b=2&a=1" }', '{"id":"https://h/?a=1&b=2","t":["y","x"],"n":null}',
        None, '{"id":"https://h/?a=1', "[1]", "", "null", '{"id":"https://h/?a=1&b=2","t":["x","y"]}', '{"id":"https://h/?a=1',
    )
    assert found(format_duplicates(t, r)) == [("index_raw", 1, 2), ("teasers_raw", 1, 2), ("teasers_raw", 1, 7), ("teasers_raw", 4, 5), ("teasers_raw", 8, 9)]


def test_ledger_equals_one_count_and_hot_records(spark):
    rng = random.Random(1)
    rows = [("https://h/hot", "Hot", "x" * (i % 2)) if rng.random() < 0.4 else (f"https://h/{rng.randrange(60)}", rng.choice(["T", "t!", "U"]), None) for i in range(1500)]
    t, r = teasers(spark, *rows), raw(spark)
    records = all_records(t, r)
    expected = {}
    for i, (u, title, x) in enumerate(rows, 1):
        expected.setdefault((u, title.strip("!").upper(), x), []).append(i)
    for batches, buckets in ((1, 1), (4, 8), (7, 3)):
        table = fill_ledger(records, batches, buckets).table()
        assert sorted((x["first_key"], x["n_copies"]) for x in table.collect()) == sorted((min(v), len(v)) for v in expected.values())
    assert found(copies(records, fill_ledger(records))) == sorted(("teasers_raw", min(v), k) for v in expected.values() for k in v if k != min(v))
    assert distinct_records(t, r).count() == len(expected)


def test_ledger_leaves_other_buckets(spark):
    ledger = Ledger(spark, None, 64)
    ledger.apply(teaser_records(teasers(spark, *[(f"u{i}", "t", None) for i in range(200)])))
    before = dict(ledger.state["versions"])
    ledger.apply(teaser_records(teasers(spark, ("u3", "T", None))))
    assert sum(before[b] != v for b, v in ledger.state["versions"].items()) == 1
    assert sorted(x["n_copies"] for x in ledger.table().collect())[-2:] == [1, 2]
    ledger.apply(teaser_records(teasers(spark)))
    assert ledger.table().count() == 200


def test_ledger_lives_on(spark, tmp_path, monkeypatch):
    """Opened again it goes on; a batch told by name counts once; a failed write changes nothing; buckets grow; old versions go."""
    from siltloom.llm import format_duplicates as fd

    monkeypatch.setattr(fd, "ROWS", 20)
    path = f"file://{tmp_path}/ledger"
    rows = [(f"u{i % 150}", "t", None) for i in range(400)]
    for i in range(0, 400, 80):
        batch = teaser_records(teasers(spark, *rows[i : i + 80])).withColumn("row_key", F.col("row_key") + i)
        Ledger(spark, path).apply(batch, f"batch {i}")
        Ledger(spark, path).apply(batch, f"batch {i}")
    ledger = Ledger(spark, path)
    assert sorted((x["first_key"], x["n_copies"]) for x in ledger.table().collect()) == sorted((i + 1, len(range(i, 400, 150))) for i in range(150))
    assert ledger.state["batches"] == 5 and ledger.state["rows"] == 150 and ledger.buckets == 8
    with pytest.raises(Exception):
        ledger.apply(batch.select("origin", "row_key", "hi", F.raise_error(F.lit("no")).cast("bigint").alias("lo")))
    assert Ledger(spark, path).table().count() == 150
    Ledger(spark, path).apply(teaser_records(teasers(spark, *[(f"v{i}", "t", None) for i in range(700)])))
    Ledger(spark, path).apply(teaser_records(teasers(spark, ("u1", "t", None))).withColumn("row_key", F.lit(5000).cast("bigint")))
    ledger = Ledger(spark, path)
    assert ledger.buckets == 43 and ledger.table().count() == 850 and ledger.table().agg(F.sum("n_copies")).first()[0] == 1101
    folders = {x.name for x in (tmp_path / "ledger").iterdir() if x.is_dir()}
    assert set(ledger.state["versions"].values()) <= folders and len(folders) <= 3


def test_empty(spark):
    assert format_duplicates(teasers(spark), raw(spark)).count() == 0
    assert format_duplicates(teasers(spark, ("u", "x" * 500_000, None), ("u", "X" * 500_000, None)), raw(spark)).count() == 1
