"""Mixed timestamp formats and time zones to one UTC instant (problem 3).

Method: all valid interpretations of a value are generated as arrays, each with the cost of what speaks against it by
itself (another order of day and month than the source's, an unusual zone of an abbreviation or scale of a count). Among
them Viterbi chooses over each source's records in their order, with a penalty for a change of format and one for a
jump back in time. Where the registry is silent, as for local times that occur twice or a source without a date order,
the path alone decides; where it speaks, its cost outweighs any path.

Plan: an interpretation dearer than another by more than a path can gain is never chosen and is left out (exact).
Records are cut into blocks of keys, within which a window finds those beside an undecided one; all others need no
path and never reach Python again. Every block gives the matrix of its cheapest ways from first to last record
((min, +) product), Viterbi over the blocks' matrices fixes each block's ends, and blocks are then solved by
themselves. So no source is one task, even if it holds a third of all rows and nothing in it is decided.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltloom.functions.instants import readings
from siltloom.session import cut, small_side

SWITCH = 1.0
BACK = 0.5
#: Keys in a block; keys are unique, so a block has at most as many rows.
BLOCK = 1 << 16
_GROUP = ["origin", "sp_source", "block"]


def interpretations(values: DataFrame, sites: DataFrame) -> DataFrame:
    """``origin, record_key, sp_source, forms, instants, certain, costs``: the interpretations of each value that has any.

    ``values``: ``origin, record_key, sp_source, raw``. ``sites``: ``sp_source, time_zone, date_order``; values
    of an unknown source are read without either: local times then have no interpretation.
    """
    registry = small_side(sites.select("sp_source", "time_zone", "date_order").dropDuplicates(["sp_source"]), "p3-sites")

    def run(batches):
        for pdf in batches:
            found = [
                readings(v if isinstance(v, str) else None, z if isinstance(z, str) else None, o if o in ("dmy", "mdy") else None)
                for v, z, o in zip(pdf["raw"], pdf["time_zone"], pdf["date_order"])
            ]
            keep = [bool(x) for x in found]
            out = pdf.loc[keep, ["origin", "record_key", "sp_source"]]
            found = [x for x in found if x]
            for i, name in enumerate(("forms", "instants", "certain", "costs")):
                out[name] = pd.Series([[r[i] for r in x] for x in found], index=out.index, dtype="object")
            yield out

    return (
        values.where(F.col("raw").isNotNull())
        .join(registry, "sp_source", "left")
        .select("origin", "record_key", "sp_source", "raw", "time_zone", "date_order")
        .mapInPandas(run, "origin string, record_key bigint, sp_source string, forms array<int>, instants array<bigint>, certain array<boolean>, costs array<double>")
    )


def possible(known: DataFrame, reach: float = 2 * (SWITCH + BACK)) -> DataFrame:
    """Only interpretations that some path could choose.

    The links to the records before and after are all that a choice can gain, ``reach`` at most; one that costs more
    than that beyond the cheapest is on no best path.
    """
    ways = F.filter(F.arrays_zip("forms", "instants", "certain", "costs"), lambda x: x["costs"] <= F.array_min("costs") + F.lit(reach))
    slim = known.withColumn("ways", ways)
    return slim.select("origin", "record_key", "sp_source", *[F.col(f"ways.{c}").alias(c) for c in ("forms", "instants", "certain", "costs")])


def _link(a: tuple, b: tuple, switch: float, back: float) -> np.ndarray:
    """Costs of going from each interpretation of ``a`` to each of ``b``; both are (forms, instants, costs)."""
    return switch * (a[0][:, None] != b[0][None, :]) + back * (b[1][None, :] < a[1][:, None])


def best_path(steps: list[tuple], first: int | None = None, last: int | None = None, switch: float = SWITCH, back: float = BACK) -> list[int]:
    """Viterbi: which interpretation of each step to take; ``first`` and ``last`` fix those of the ends.

    A step is arrays (forms, instants, costs). Ties go to the earlier interpretation.
    """
    costs = steps[0][2].astype(float)
    if first is not None:
        costs = np.where(np.arange(len(costs)) == first, costs, np.inf)
    marks = []
    for a, b in zip(steps, steps[1:]):
        ways = costs[:, None] + _link(a, b, switch, back)
        marks.append(ways.argmin(axis=0))
        costs = ways.min(axis=0) + b[2]
    path = [int(costs.argmin()) if last is None else last]
    for row in reversed(marks):
        path.append(int(row[path[-1]]))
    return path[::-1]


def block_matrix(steps: list[tuple], switch: float = SWITCH, back: float = BACK) -> np.ndarray:
    """Cost of the cheapest way from each interpretation of the first step to each of the last, their own costs included."""
    ways = np.full((len(steps[0][2]),) * 2, np.inf)
    np.fill_diagonal(ways, steps[0][2])
    for a, b in zip(steps, steps[1:]):
        ways = (ways[:, :, None] + _link(a, b, switch, back)[None]).min(axis=1) + b[2][None, :]
    return ways


def _steps(pdf: pd.DataFrame) -> list[tuple]:
    return [(np.asarray(f), np.asarray(t), np.asarray(c, float)) for f, t, c in zip(pdf["forms"], pdf["instants"], pdf["costs"])]


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(_t=[t[0] for t in pdf["instants"]]).sort_values(["record_key", "_t"], kind="stable")


def _matrices(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _ordered(pdf)
    steps = _steps(pdf)
    head = {c: [pdf[c].iloc[0]] for c in _GROUP}
    ends = {f"{name}_{part}": [list(steps[i][k])] for name, i in (("first", 0), ("last", -1)) for k, part in enumerate(("forms", "instants"))}
    return pd.DataFrame(head | ends | {"ways": [list(block_matrix(steps).ravel())]})


def choose_ends(blocks: list[tuple], switch: float = SWITCH, back: float = BACK) -> list[tuple[int, int]]:
    """Viterbi over blocks in order: which interpretations of each block's first and last record to take.

    A block is (first forms, first instants, last forms, last instants, matrix).
    """
    costs, marks, before = None, [], None
    for f_forms, f_instants, l_forms, l_instants, ways in blocks:
        if costs is None:
            enter, came = np.zeros(len(f_forms)), np.zeros(len(f_forms), int)
        else:
            over = costs[:, None] + _link(before, (f_forms, f_instants), switch, back)
            enter, came = over.min(axis=0), over.argmin(axis=0)
        total = enter[:, None] + ways
        marks.append((total.argmin(axis=0), came))
        costs, before = total.min(axis=0), (l_forms, l_instants)
    out: list[tuple[int, int]] = []
    j = int(costs.argmin())
    for firsts, came in reversed(marks):
        i = int(firsts[j])
        out.append((i, j))
        j = int(came[i])
    return out[::-1]


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    blocks = []
    for a, b, c, d, w in zip(pdf["first_forms"], pdf["first_instants"], pdf["last_forms"], pdf["last_instants"], pdf["ways"]):
        blocks.append((np.asarray(a), np.asarray(b), np.asarray(c), np.asarray(d), np.asarray(w, float).reshape(len(a), len(c))))
    chosen = choose_ends(blocks)
    return pdf[_GROUP].assign(first=[i for i, _ in chosen], last=[j for _, j in chosen]).astype({"first": "int32", "last": "int32"})


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _ordered(pdf)
    path = best_path(_steps(pdf), int(pdf["first"].iloc[0]), int(pdf["last"].iloc[0]))
    out = pdf[["origin", "record_key", "sp_source"]].copy()
    out["utc_us"] = [int(t[k]) for t, k in zip(pdf["instants"], path)]
    out["certain"] = [bool(c[k]) for c, k in zip(pdf["certain"], path)]
    return out[[len(x) > 1 for x in pdf["forms"]]]


def normalise(values: DataFrame, sites: DataFrame, block: int = BLOCK) -> DataFrame:
    """``origin, record_key, sp_source, utc_us, certain``: the chosen instant of each value that has one.

    Null, blank, relative and impossible values give no row, and neither do local times in a gap of the
    clock. ``certain`` is false for local times that occur twice; the choice between them is the path's.
    Rows with one key are ordered by their instants; an empty table gives no rows.
    """
    known = cut(possible(interpretations(values, sites)).withColumn("block", F.floor(F.col("record_key") / F.lit(block))), "p3-readings")
    n = F.size("instants")
    decided = known.where(n == 1).select("origin", "record_key", "sp_source", F.col("instants")[0].alias("utc_us"), F.col("certain")[0].alias("certain"))
    beside = Window.partitionBy(*_GROUP).orderBy("record_key", F.col("instants")[0])
    wide = F.lit(1) < n
    # the ends of blocks, undecided records and those beside them; what lies between decided ones costs the same on every path
    near = cut(
        known.withColumns({"before": F.lag(wide).over(beside), "after": F.lead(wide).over(beside)})
        .where(wide | F.coalesce("before", F.lit(True)) | F.coalesce("after", F.lit(True)))
        .drop("before", "after"),
        "p3-near",
    )
    forms = "first_forms array<int>, first_instants array<bigint>, last_forms array<int>, last_instants array<bigint>"
    matrices = near.groupBy(*_GROUP).applyInPandas(_matrices, f"origin string, sp_source string, block bigint, {forms}, ways array<double>")
    ends = matrices.groupBy("origin", "sp_source").applyInPandas(_ends, "origin string, sp_source string, block bigint, first int, last int")
    ends = small_side(ends.select(*[F.col(c).alias("b_" + c) for c in _GROUP], "first", "last"), "p3-ends")
    same = F.col("origin").eqNullSafe(F.col("b_origin")) & F.col("sp_source").eqNullSafe(F.col("b_sp_source")) & (F.col("block") == F.col("b_block"))
    solved = (
        near.join(ends, same)
        .drop("b_origin", "b_sp_source", "b_block")
        .groupBy(*_GROUP)
        .applyInPandas(_solve, "origin string, record_key bigint, sp_source string, utc_us bigint, certain boolean")
    )
    return decided.unionByName(solved)


def timestamp_values(teasers: DataFrame, docs: DataFrame) -> DataFrame:
    """``origin, record_key, sp_source, raw`` of both tables."""
    a = teasers.select(F.lit("teasers_raw").alias("origin"), F.col("teaser_id").alias("record_key"), "sp_source", F.col("datetime_raw").alias("raw"))
    b = docs.select(F.lit("index_docs").alias("origin"), F.col("entry_id").alias("record_key"), F.get("sp_source", F.lit(0)).alias("sp_source"), F.col("sp_date").alias("raw"))
    return a.unionByName(b)
