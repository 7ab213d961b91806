"""Documents packed into containers of fixed capacity.

Sum of squares, online: a level array counts the open containers of each fill level; a
document goes to the level where the sum of the squared counts of the levels strictly
between empty and full grows least, a full container leaves the array. Ties go to the
fullest level.

A packing is sequential, so the documents are dealt into shards of bounded size by a hash
of their id, and each shard is packed by a task of its own. Containers that a shard fills
to the brim are final. What its other containers hold is dealt again into fewer shards of
the same bounded size, large items first, until one shard has taken all that is left or
less than half of it could be settled: so the space lost at the end of a shard is lost
once, not once for each shard. A document larger than the capacity gives full containers of its
own first, and only its rest is packed; no other is split.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Documents that one task packs.
SHARD = 20_000

_NEVER = np.iinfo(np.int64).max
_ITEMS = "capacity int, shard long, doc_id long, piece int, size long"
_PLACED = "capacity int, shard long, doc_id long, piece int, size long, slot int, fill long"


def sum_of_squares(sizes: Iterable[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item and the fill of each container. Items of size 0 go to
    the first container. Every size is at most ``capacity``."""
    open_at = np.zeros(capacity + 1, np.int64)  # per level, containers open at it
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    placed = []
    for size in sizes:
        if size == 0:
            if not fill:
                fill.append(0)
                waiting[0].append(0)
            placed.append(0)
            continue
        level = 0
        if size < capacity:
            # growth of the sum when a container of level h takes the item
            h = np.arange(1, capacity - size + 1)
            grown = 2 * (open_at[h + size] - open_at[h] + 1)
            grown[-1] = 1 - 2 * open_at[capacity - size]  # it leaves the array
            grown[open_at[h] == 0] = _NEVER
            best = len(h) - 1 - int(np.argmin(grown[::-1]))
            if grown[best] <= 2 * open_at[size] + 1:  # growth by a new container
                level = best + 1
        if level or waiting[0]:
            c = waiting[level].pop()
            if level:
                open_at[level] -= 1
        else:
            c = len(fill)
            fill.append(0)
        fill[c] += size
        if fill[c] < capacity:
            open_at[fill[c]] += 1
            waiting[fill[c]].append(c)
        placed.append(c)
    return np.array(placed, np.int32), np.array(fill, np.int64)


def pack(sizes: DataFrame, capacities: list[int], shard: int = SHARD) -> DataFrame:
    """``capacity, container, doc_id, piece, n_tokens``: for each capacity, the container of
    every document of ``sizes`` (``doc_id, n_tokens``).

    A document of at most the capacity is one piece, number 0. A larger one gives pieces 0,
    1, ... that fill a container each, and its rest as the last piece. Documents without
    tokens (0 or null) take no space and join some container. A null id is an id like any
    other; repeated rows are items of their own. Containers are named by strings, unique
    within a capacity. No capacities or no documents give no rows.
    """
    spark = sizes.sparkSession
    out = "capacity int, container string, doc_id long, piece int, n_tokens long"
    if any(c < 1 for c in capacities):
        raise ValueError("a capacity must be at least 1")
    if not capacities:
        return spark.createDataFrame([], out)
    each = sizes.select(
        F.explode(F.array(*(F.lit(int(c)) for c in sorted(set(capacities))))).alias("capacity"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("size"),
    )
    whole = each.where("size > capacity").select(
        "capacity",
        F.explode(F.expr("sequence(0, cast(size div capacity - 1 as int))")).alias("piece"),
        "doc_id",
    )
    done = [
        whole.select(
            "capacity",
            F.format_string("d%s-%d", "doc_id", "piece").alias("container"),
            "doc_id",
            "piece",
            F.col("capacity").cast("long").alias("n_tokens"),
        )
    ]
    items = each.where("size <= capacity or size % capacity > 0").select(
        "capacity",
        "doc_id",
        F.expr("cast(if(size > capacity, size div capacity, 0) as int)").alias("piece"),
        F.expr("if(size > capacity, size % capacity, size)").alias("size"),
    )

    def pack_shard(t: pa.Table) -> pa.Table:
        # later rounds hold what fitted badly: large items first leave less over
        order = [("doc_id", "ascending"), ("piece", "ascending")]
        if t.column("round")[0].as_py():
            order = [("size", "descending"), *order]
        t = t.sort_by(order).drop_columns(["round"])
        slot, fill = sum_of_squares(t.column("size").to_pylist(), t.column("capacity")[0].as_py())
        return t.append_column("slot", pa.array(slot)).append_column("fill", pa.array(fill[slot]))

    left = items.groupBy("capacity").count().agg(F.max("count")).first()[0] or 0
    round_no, before = 0, 0
    while left:
        shards = -(-left // shard)
        placed = durable(
            items.select(
                "capacity",
                F.expr(f"pmod(xxhash64(doc_id, piece, {round_no}), {shards}L)").alias("shard"),
                "doc_id",
                "piece",
                "size",
                F.lit(round_no).alias("round"),
            )
            .groupBy("capacity", "shard")
            .applyInArrow(pack_shard, _PLACED)
        )
        before, left = left, placed.where("fill < capacity").groupBy("capacity").count().agg(F.max("count")).first()[0] or 0
        # the last round: one shard has seen the rest, or packing it again gains little
        last = round_no > 0 and (shards == 1 or left > before // 2)
        done.append(
            (placed if last else placed.where("fill = capacity")).select(
                "capacity",
                F.format_string(f"r{round_no}-%d-%d", "shard", "slot").alias("container"),
                "doc_id",
                "piece",
                F.col("size").alias("n_tokens"),
            )
        )
        if last:
            break
        items = placed.where("fill < capacity").select("capacity", "doc_id", "piece", "size")
        round_no += 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result
