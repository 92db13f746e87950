"""Approximate nearest neighbours by inner product, with a forest of random-projection trees.

The forest is fitted on a bounded sample; every vector is then placed in one leaf of each
tree. A query walks all trees through one priority queue, nearest hyperplanes first, until
it has seen PROBES leaves. Queries and vectors meet by leaf, where complete inner products
rerank the candidates.

For inner products a coordinate is added that brings all vectors to one length, so that
the nearest by angle is the nearest by product; it is used for the trees only.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholium.llm.common import cut, small_batches, tidy

#: Vectors the forest is fitted on, at most.
SAMPLE = 65_536
#: Leaves of each tree and leaves that a query sees. Vectors without any structure, as those of
#: the test tables, need over half of all leaves for a recall of 0.9; clustered ones far fewer,
#: for which more and smaller leaves save work.
TREES, LEAVES, PROBES = 8, 64, 104
#: Vectors of a leaf that are compared at a time.
BLOCK = 4096
#: Queries that one task holds; if there are more, every leaf's are dealt to several tasks.
QUERIES = 65_536


class Forest:
    """Trees as arrays: node -> normal, threshold, children; a child below 0 is leaf -1 - child."""

    def __init__(self, points: np.ndarray, trees: int, leaf: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        normals, thresholds, children, self.roots, self.leaves = [], [], [], [], 0

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(3):  # the direction from one point to another
                    a, b = points[rng.choice(rows, 2, replace=False)]
                    normal = a - b
                    if (size := np.linalg.norm(normal)) == 0:
                        continue
                    normal = normal / size
                    at = points[rows] @ normal
                    cut_at = float(np.median(at))
                    left, right = rows[at <= cut_at], rows[at > cut_at]
                    if len(left) and len(right):
                        me = len(normals)
                        normals.append(normal)
                        thresholds.append(cut_at)
                        children.append(None)
                        children[me] = (grow(left), grow(right))
                        return me
            self.leaves += 1
            return -self.leaves

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(points))))
        dims = points.shape[1]
        self.normals = np.array(normals).reshape(-1, dims)
        self.thresholds = np.array(thresholds)
        self.children = np.array(children, np.int64).reshape(-1, 2)

    def margins(self, points: np.ndarray) -> np.ndarray:
        return points @ self.normals.T - self.thresholds

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        out = np.empty((len(points), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(points), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", points[inner], self.normals[node]) > self.thresholds[node]
                at[inner] = self.children[node, side.astype(int)]
            out[:, t] = -1 - at
        return out

    def probe(self, margins: list[float], probes: int, children: list) -> list[int]:
        """The first leaves that a queue over all trees yields; a branch counts as far as its worst hyperplane."""
        heap = [(-np.inf, root) for root in self.roots]
        heapq.heapify(heap)
        pop, push, out = heapq.heappop, heapq.heappush, []
        while heap:
            worst, node = pop(heap)
            if node < 0:
                out.append(-1 - node)
                if len(out) == probes:
                    break
                continue
            m = margins[node]
            left, right = children[node]
            push(heap, (max(worst, m), left))
            push(heap, (max(worst, -m), right))
        return out


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL, no component NULL or non-finite, not all zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, good) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _scored(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in extended precision: the same for a pair wherever it is met."""
    return (q.astype(np.longdouble) * p).sum(-1).astype(np.float64)


def _reranked(k: int):
    """Over rows (leaf, part, kind, id, j, vec) sorted by the first three, queries first: each query's k + 1 best of each block.

    A part has QUERIES queries or so, which are held; the points pass by in blocks.
    """

    def best(qi, qj, qv, pi, pj, pv) -> pa.RecordBatch:
        near = qv @ pv.T
        order = np.argsort(pi, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(pi[order]) != 0])
        by_key = near if len(start) == len(pi) else np.maximum.reduceat(near[:, order], start, axis=1)
        n = min(k + 1, len(start))
        # Rounding may swap candidates that are equal or nearly so: all within it are scored exactly.
        floor = np.partition(by_key, -n, axis=1)[:, -n] - 1e-9 * (1 + np.abs(near).max(axis=1))
        r, c = np.nonzero(near >= floor[:, None])
        score = np.concatenate([_scored(qv[r[i : i + 65536]], pv[c[i : i + 65536]]) for i in range(0, len(r), 65536)])
        if len(start) < len(pi):  # of a key's vectors that no other key has, the nearest
            order = np.lexsort((-score, pi[c], r))
            r, c, score = r[order], c[order], score[order]
            own = np.r_[True, (r[1:] != r[:-1]) | (pi[c][1:] != pi[c][:-1])] | (pj[c] > 0)
            r, c, score = r[own], c[own], score[own]
        order = np.lexsort((pi[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        new = np.r_[True, r[1:] != r[:-1]]
        # Vectors that several keys have don't count: they may all be of one key.
        before = np.cumsum(pj[c] < 0) - (pj[c] < 0)
        keep = before - before[new][np.cumsum(new) - 1] <= k
        r, c = r[keep], c[keep]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (qi[r], qj[r], pi[c], pj[c], score[keep])], ["q", "qj", "id", "j", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, ([], [])  # columns (id, j, vec) of queries and of points

        def points() -> Iterator[pa.RecordBatch]:
            if held[0] and held[1]:
                q, p = ([np.concatenate(x) for x in zip(*rows, strict=True)] for rows in held)
                for a in range(0, len(q[0]), BLOCK):
                    for b in range(0, len(p[0]), BLOCK):
                        yield best(*(x[a : a + BLOCK] for x in q), *(x[b : b + BLOCK] for x in p))
            held[1].clear()

        for batch in batches:
            leaves, parts, kinds, ids, j = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            vectors = _matrix(batch.column(5))
            if not len(leaves):
                continue
            edge = np.flatnonzero(np.r_[True, (leaves[1:] != leaves[:-1]) | (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])])
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(leaves)], strict=True):
                if (leaves[a], parts[a]) != place:
                    yield from points()
                    place = leaves[a], parts[a]
                    held[0].clear()
                held[kinds[a]].append((ids[a:b], j[a:b], vectors[a:b]))
                if sum(len(x[0]) for x in held[1]) >= BLOCK:  # a leaf's points pass in blocks, however many they are
                    yield from points()
        yield from points()

    return run


def search(
    vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    sample: int = SAMPLE, trees: int = TREES, leaves: int = LEAVES, probes: int = PROBES, seed: int = 0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row that ``queries`` holds for, itself excluded.

    Nearest is the largest inner product, ties to the smaller key; fewer rows if there are
    no more. Rows that are not usable() take no part; an empty table gives an empty result.
    Vectors that are shorter than others count as if filled up with zeros. Equal vectors
    are searched once and stand for each other, with their k + 1 smallest keys, so a very
    common vector costs one entry. A key with several vectors is one query and one
    candidate, as near as its nearest pair of vectors. NULL keys take no part.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec"), queries.alias("asks")).where(usable(F.col("vec")) & F.col("id").isNotNull())
    wide = good.agg(F.max(F.size("vec"))).first()[0]
    schema = f"query_id {dict(vectors.dtypes)[key]}, rank int, vec_id {dict(vectors.dtypes)[key]}, score double"
    if not wide:
        return spark.createDataFrame([], schema)
    zero = F.lit(0).cast(vectors.schema[vector].dataType.elementType)
    good = good.withColumn("vec", F.when(F.size("vec") < wide, F.concat("vec", F.array_repeat(zero, wide - F.size("vec")))).otherwise(F.col("vec")))
    base = cut(good.withColumn("h", F.xxhash64("vec")).distinct())
    # A distinct vector goes by its smallest key, and by j among those that have the same one, as
    # keys may be repeated; j is below 0 if no other key has the vector.
    firsts = base.groupBy("h", "vec").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    j = F.row_number().over(W.partitionBy("rep").orderBy("h", "vec"))
    reps = cut(firsts.withColumn("j", F.when(F.col("rep") == F.col("last"), -j).otherwise(j)).drop("last"))
    alike = W.partitionBy("h", "vec").orderBy("id")
    # A key may be both asked for and not, in repeated rows: it stands for itself once.
    rows = base.select("h", "vec", "id").distinct().withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).drop("n")
    members = cut(rows.join(reps, ["h", "vec"]).select("rep", "j", "id"))
    longest = reps.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0]
    fitted = _matrix(pa.Table.from_batches(reps.orderBy(F.xxhash64("rep"), "rep", "j").limit(sample).select("vec").toArrow().to_batches()).column(0).combine_chunks())
    forest = Forest(_lifted(fitted, longest), trees, -(-len(fitted) // leaves), seed)
    shipped = spark.sparkContext.broadcast(forest)  # bounded by the sample

    asked = cut(base.where("asks").select(F.col("id").alias("query_id"), "h", "vec").distinct().join(reps, ["h", "vec"]).select("query_id", "rep", "j"))
    asks = asked.select("rep", "j").distinct().join(reps, ["rep", "j"])
    parts = max(1, -(-asked.count() // QUERIES))
    kinds = asks.select("rep", "j", "vec", F.lit(0).alias("kind")).union(reps.select("rep", "j", "vec", F.lit(1).alias("kind")))
    element = vectors.schema[vector].dataType.simpleString()
    id_kind = dict(vectors.dtypes)[key]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shipped.value
        children = forest.children.tolist()
        for batch in batches:
            points, kinds = _matrix(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False)
            if not len(kinds):
                continue
            at, leaves, part = [], [], []
            own = np.flatnonzero(kinds == 1)
            if len(own):
                found = forest.place(_lifted(points[own], longest))
                for i in range(parts):  # every part of a leaf's queries meets all its points
                    at.append(np.repeat(own, found.shape[1]))
                    leaves.append(found.ravel())
                    part.append(np.full(found.size, i))
            own = np.flatnonzero(kinds == 0)
            for i in range(0, len(own), 64):
                some = own[i : i + 64]
                flat = np.concatenate([points[some], np.zeros((len(some), 1))], axis=1)
                for r, m in zip(some.tolist(), forest.margins(flat).tolist(), strict=True):
                    found = forest.probe(m, probes, children)
                    at.append(np.full(len(found), r))
                    leaves.append(np.array(found, np.int64))
                    part.append(np.full(len(found), zlib.crc32(points[r].tobytes()) % parts))
            rows = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(leaves)), pa.array(np.concatenate(part).astype(np.int32)), batch.column(3).take(rows), *(batch.column(i).take(rows) for i in range(3))],
                ["leaf", "part", "kind", "id", "j", "vec"],
            )

    dealt = kinds.mapInArrow(tidy(place), f"leaf long, part int, kind int, id {id_kind}, j int, vec {element}")
    met = dealt.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind").mapInArrow(tidy(_reranked(k)), f"q {id_kind}, qj int, id {id_kind}, j int, score double")
    order = W.partitionBy("q", "qj").orderBy(F.desc("score"), "id")
    # In each leaf and block as many vectors are left as it takes, so few rows of a key meet here.
    near = met.groupBy("q", "qj", "id").agg(F.max("score").alias("score"), F.collect_set(F.struct("j", "score")).alias("js"))
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("q", "qj", "id", F.inline("js"))
    # Distinct vectors become the rows that have them; k + 1 of these are enough, one may be the query itself.
    near = near.select("q", "qj", F.col("id").alias("rep"), "j", "score").join(members, ["rep", "j"])
    near = near.groupBy("q", "qj", "id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    same = (F.col("q") == F.col("rep")) & (F.col("qj") == F.col("j"))
    found = asked.join(near.select("q", "qj", "id", "score"), same).where("id != query_id")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))  # a key's nearest pair of vectors
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _lifted(points: np.ndarray, longest: float) -> np.ndarray:
    """points with a coordinate that brings each to the greatest length."""
    rest = np.sqrt(np.maximum(longest - (points**2).sum(axis=1), 0))
    return np.concatenate([points, rest[:, None]], axis=1)
