"""Sharding by longest-processing-time scheduling.

Groups of rows that must stay together are sorted by size, largest first, and each goes
to the shard with the least load, taken from a heap. Groups of one size are
interchangeable, so only the histogram of sizes is scheduled, as a stream in one task
that holds the loads of the shards and nothing else; long runs of one size are filled
in one step to the level that the heap would reach. Groups then find their shard by
their rank among groups of their size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import cut, ranked

SHARDS = 24
OVERHEAD = 8
#: Runs up to this length go through the heap one by one.
STEPS = 256


def fill(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard gets; adds them to loads.

    The heap takes starting loads in ascending order, ties to the smaller shard. Shard j
    starts groups at loads[j], loads[j] + size, ...; all starts below a level are taken
    before any at it, so most of a long run is counted at once.
    """
    took = [0] * len(loads)
    if count > STEPS:
        low, high = min(loads), min(loads) + size * (count + 1)
        below = lambda t: sum(max(0, -(-(t - x) // size)) for x in loads)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if below(mid) <= count else (low, mid - 1)
        for j, x in enumerate(loads):
            took[j] = max(0, -(-(low - x) // size))
        count -= sum(took)
    heap = [(x + took[j] * size, j) for j, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count):
        x, j = heap[0]
        heapq.heapreplace(heap, (x + size, j))
        took[j] += 1
    for j, n in enumerate(took):
        loads[j] += n * size
    return took


def schedule(histogram: DataFrame, shards: int) -> DataFrame:
    """(total, until) for each size: until[j] is the rank at which shard j's groups of it end.

    histogram: (total, n). It has a row for each distinct size and goes through one task
    as a sorted stream.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [0] * shards
        for batch in batches:
            until = []
            for total, n in zip(batch["total"].tolist(), batch["n"].tolist(), strict=True):
                ends, at = [], 0
                for took in fill(loads, total, n):
                    ends.append(at := at + took)
                until.append(ends)
            yield pd.DataFrame({"total": batch["total"], "until": until})

    return histogram.repartition(1).sortWithinPartitions(F.desc("total")).mapInPandas(run, "total long, until array<long>")


def shard(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS
) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for each row of docs.

    Size: UTF-8 bytes of the text plus OVERHEAD; a NULL text has no bytes and checksum 0,
    and NULL texts are one group, apart from empty ones. Rows of equal text go to one
    shard, even where they outweigh an even share; repeated rows each get a slot. Slots
    are gapless from 0 in each shard, in order of group and key. No text is shuffled:
    groups meet by SHA-256, counted before the shuffle, so a hot group costs one row a task.
    An empty table gives an empty result; other columns of the input aren't read.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    t = F.col(text)
    rows = cut(
        docs.select(
            F.col(key).alias("key"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(t), F.lit(0)).alias("text_crc32"),
            F.coalesce(F.sha2(t, 256), F.lit("")).alias("content"),
        )
    )
    groups = rows.groupBy("content").agg(F.sum("size").alias("total"))
    groups = ranked(groups, ["total"], ["content"])
    groups = cut(groups)
    plan = schedule(groups.groupBy("total").agg(F.count("*").alias("n")), shards)
    # The plan has a row for each different size and may grow: it is never a broadcast.
    placed = groups.join(cut(plan).hint("merge"), "total").select(
        "content", F.size(F.filter("until", lambda u: u <= F.col("rank"))).alias("shard")
    )
    put = rows.join(placed, "content")
    return ranked(put, ["shard"], ["content", "key"], "slot").select("key", "size", "text_crc32", "shard", "slot")
