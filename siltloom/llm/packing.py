"""Filling containers of fixed capacity with items (problem 9).

Method: vector bin packing by the dot-product heuristic. An item has a size in tokens, one segment and a number of
loss-bearing tokens; a container limits all three. Into the open container goes the item, of all that fit, whose
vector has the largest dot product with what is left of the container; when none fits, the next one is opened.
Items of one vector are one class, so a step looks at classes, not at items.

Plan: items are spread over shards of bounded size by their id and packed in parallel; what lies in the badly
filled containers of all shards is packed once more, in fewer shards, so that sharding costs next to no space.
Only an item longer than the capacity is split: into whole containers, and a rest that is packed as any item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.llm.tokenizer import FOLDER, NAME, encode
from siltloom.session import cut

#: Items a shard holds on average; a task keeps one shard of some numbers an item.
SHARD_ITEMS = 25_000
#: Containers filled below this share are packed once more.
LOOSE = 0.97
#: Kinds of containers are a short list that every item is laid out against.
MAX_KINDS = 1000

_PIECE = "container_kind string, capacity bigint, doc_id bigint, part_no int, start_token bigint, n_tokens bigint, n_loss bigint"
COLUMNS = "container_kind string, container_id bigint, doc_id bigint, part_no int, start_token bigint, n_tokens bigint, n_loss bigint, capacity bigint"


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, max_segments: int | None = None, max_loss: int | None = None) -> np.ndarray:
    """The container (0, 1, ...) of each item. No item may exceed a limit by itself."""
    n = len(tokens)
    if n and (tokens.max() > capacity or max_loss is not None and loss.max() > max_loss):
        raise ValueError("an item exceeds a limit by itself")
    limits = np.array([capacity, max_segments or max(1, capacity), max_loss or max(1, capacity)], float)
    order = np.lexsort((loss, tokens))[::-1]
    vectors = np.stack([tokens[order], np.ones(n), loss[order]], axis=1).astype(float)
    first = np.ones(n, bool)
    first[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    starts = np.flatnonzero(first)
    left_of = np.append(starts[1:], n) - starts  # items left in each class
    at = starts.copy()
    classes = vectors[starts]
    scaled = classes / limits
    out = np.empty(n, np.int64)
    box, todo = -1, n
    live = np.arange(len(classes))
    plain = max_segments is None and max_loss is None
    room = None
    while todo:
        if room is None:
            box += 1
            room = limits.copy()
        fits = (classes[live] <= room).all(axis=1)
        if not fits.any():
            room = None
            continue
        cand = live[fits]
        k = cand[int(np.argmax(scaled[cand] @ (room / limits)))]
        # equal items go in together, the largest first, as many as fit
        many = int(min(left_of[k], *(room[d] // classes[k][d] for d in range(3) if classes[k][d] > 0)))
        if not plain:
            many = 1  # with several limits the best direction changes with what is left
        out[order[at[k] : at[k] + many]] = box
        at[k] += many
        left_of[k] -= many
        room = room - many * classes[k]
        todo -= many
        if not left_of[k]:
            live = live[live != k]
    return out


def pieces(items: DataFrame, containers: DataFrame) -> DataFrame:
    """``container_kind, capacity, doc_id, part_no, start_token, n_tokens, n_loss``: items as they go into containers.

    ``items``: ``doc_id, n_tokens, n_loss``. Items up to the capacity are one piece; longer ones are split at
    multiples of it. Empty items are one empty piece. Containers without a positive capacity are left out.
    """
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity")).where("capacity > 0").dropDuplicates(["container_kind"])
    listed = kinds.limit(MAX_KINDS + 1).collect()
    if len(listed) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    choices = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(listed, key=str)]) if listed else F.array().cast("array<struct<container_kind:string,capacity:bigint>>")
    crossed = items.select("*", F.explode(choices).alias("kind")).select("doc_id", "n_tokens", "n_loss", "kind.container_kind", "kind.capacity")
    parts = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("bigint"))
    start = F.col("part_no") * F.col("capacity")
    size = F.least(F.col("capacity"), F.col("n_tokens") - start)
    return crossed.select("container_kind", "capacity", "doc_id", "n_tokens", "n_loss", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part_no")).select(
        "container_kind", "capacity", "doc_id", F.col("part_no").cast("int"), start.alias("start_token"), size.alias("piece"),
        F.greatest(F.lit(0).cast("bigint"), F.least(size, F.col("n_loss") - start)).alias("n_loss"),
    ).withColumnRenamed("piece", "n_tokens").select("container_kind", "capacity", "doc_id", "part_no", "start_token", "n_tokens", "n_loss")


def _packer(max_segments: int | None, max_loss_share: float | None, base: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part_no"], kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        max_loss = None if max_loss_share is None else max(1, int(capacity * max_loss_share))
        box = pack(pdf["n_tokens"].to_numpy(), pdf["n_loss"].to_numpy(), capacity, max_segments, max_loss)
        pdf["container_id"] = (base + int(pdf["shard"].iloc[0])) * (1 << 32) + box
        return pdf[["container_kind", "container_id", "doc_id", "part_no", "start_token", "n_tokens", "n_loss", "capacity"]]

    return run


def fill_containers(
    items: DataFrame, containers: DataFrame, max_segments: int | None = None, max_loss_share: float | None = None, shard_items: int = SHARD_ITEMS
) -> DataFrame:
    """``container_kind, container_id, doc_id, part_no, start_token, n_tokens, n_loss, capacity`` of every item, for each kind of container.

    Every item is in exactly one container of each kind (its parts, if it is longer than the capacity); none is
    overfull, has more than ``max_segments`` pieces or more loss-bearing tokens than ``max_loss_share`` of its
    capacity. Items with no tokens are pieces of no size. Repeated rows are items each. Without items there are no rows.
    """
    whole = cut(pieces(items, containers), "p9-pieces")
    full = whole.where("n_tokens = capacity") if max_loss_share is None else None
    rest = whole.where("n_tokens < capacity") if full is not None else whole
    n = rest.count()
    if n == 0 and full is None:
        return whole.sparkSession.createDataFrame([], COLUMNS)
    shards = max(1, -(-n // shard_items))
    spread = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(shards)).cast("int"))
    first = cut(spread.groupBy("container_kind", "shard").applyInPandas(_packer(max_segments, max_loss_share, 1), COLUMNS), "p9-first")
    fill = first.groupBy("container_kind", "container_id").agg((F.sum("n_tokens") / F.max("capacity")).alias("fill")).where(F.col("fill") < LOOSE)
    loose = cut(first.join(fill.select("container_kind", "container_id"), ["container_kind", "container_id"], "left_semi"), "p9-loose")
    tight = first.join(fill.select("container_kind", "container_id"), ["container_kind", "container_id"], "left_anti")
    again = max(1, -(-loose.count() // shard_items))
    repacked = (
        loose.drop("container_id")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(again)).cast("int"))
        .groupBy("container_kind", "shard")
        .applyInPandas(_packer(max_segments, max_loss_share, 1 + shards), COLUMNS)
    )
    out = tight.select(*repacked.columns).unionByName(repacked)
    if full is not None:
        # a piece as large as the container is a container by itself
        own = full.select("container_kind", (-1 - F.monotonically_increasing_id()).alias("container_id"), "doc_id", "part_no", "start_token", "n_tokens", "n_loss", "capacity")
        out = out.unionByName(own)
    return out


def document_items(documents: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``doc_id, n_tokens, n_loss`` of documents; in running text every token bears loss."""
    return encode(documents, folder, name, only_count=True).withColumn("n_loss", F.col("n_tokens"))


def prompted_items(documents: DataFrame, prompt: int = 64) -> DataFrame:
    """``doc_id, n_tokens, n_loss`` of documents of which the first ``prompt`` tokens bear no loss."""
    return document_items(documents).withColumn("n_loss", F.greatest(F.lit(0).cast("bigint"), F.col("n_tokens") - F.lit(prompt)))


def fill_report(assigned: DataFrame) -> DataFrame:
    """``container_kind, n_containers, n_tokens, least_containers, mean_fill``; no packing needs fewer than ``least_containers``."""
    boxes = assigned.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n_tokens"), F.max("capacity").alias("capacity"))
    return boxes.groupBy("container_kind").agg(
        F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.ceil(F.sum("n_tokens") / F.max("capacity")).alias("least_containers"), F.avg(F.col("n_tokens") / F.col("capacity")).alias("mean_fill")
    )
