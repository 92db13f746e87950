"""Connected components by alternating stars, on tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import cut, discard

MAX_ROUNDS = 100


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node of an edge: label is the smallest node reachable from it.

    Large star: a node's larger neighbours are tied to its smallest one. Small star: its
    smaller neighbours and itself are. Both keep components and end in stars after about
    log(n) rounds. Minima are summed up before the shuffle; each round is written to the
    shared folder, so that lineage stays short. Loops, repeated and reversed edges do no harm.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
            now.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        large = (
            both.join(least, "x").where("y > x")
            .select(F.col("y").alias("u"), F.least("m", "x").alias("v")).distinct()
        )
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        discard(before, large)
    else:
        raise RuntimeError("components don't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
