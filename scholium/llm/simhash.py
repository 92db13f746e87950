"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Two 64-bit fingerprints that differ in at most 3 bits have a 32-bit half in which they
differ in at most one. Each fingerprint stands in two tables, by half, and looks up its
own value and those one bit off: the small Hamming balls. A pair whose halves differ in
one bit is met from the side that has the bit set, so half of each ball suffices.
Complete distances are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import cut, small_batches, tidy
from scholium.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Members of one table cell that one task compares; a larger cell is split.
CELL = 4096
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint: a bit is 1 if it is set in over half the shingles' hashes.

    A-Z are lower-cased; words are parted by ASCII white space; fewer than three words
    are one shingle; a text without words (empty, NULL) has fingerprint 0. Repeats count.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(tokens) - SHINGLE + 1
    votes = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        a, b = starts[k : min(k + CHUNK, n)].tolist(), ends[k + SHINGLE - 1 : min(k + CHUNK, n) + SHINGLE - 1].tolist()
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], "<u8")
        votes += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) for every row; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, fp long")


def _spanning(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that tie each component of a cell together, at most one for each member."""
    rest = np.unique(fps).view(np.uint64)  # numpy counts the bits of a negative number's absolute value
    while len(rest):
        todo, rest = [rest[:1]], rest[1:]
        while todo and len(rest):
            for x in todo.pop():
                near = np.bitwise_count(rest ^ x) <= radius
                if near.any():
                    found, rest = rest[near], rest[~near]
                    yield np.full(len(found), x).view(np.int64), found.view(np.int64)
                    todo.append(found)


def _cells(radius: int):
    """Over rows (cell, part, fp, own) sorted by (cell, part): links within each that has an owner."""
    kept = ["cell", "part", "fp", "own"]

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        cell, part, fp, own = cols
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(cell):
            first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
            size = np.diff(np.r_[first, len(cell)])
            owners = np.add.reduceat(own.astype(np.int64), first)
            for i, n in zip(*(x[(owners > 0) & (size > 1)].tolist() for x in (first, size)), strict=True):
                for a, b in _spanning(fp[i : i + n], radius):
                    out_a.append(a)
                    out_b.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in kept]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            at = last[-1] + 1 if len(last) else 0  # the last cell may go on in the next batch
            held = [c[at:] for c in cols]
            yield links([c[:at] for c in cols])
        if held is not None:
            yield links(held)

    return run


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints that tie together all that are within radius bits.

    Not every pair is returned, but enough for the same components. Cells with more than
    ``cell`` members (many fingerprints that share a half) are divided by the bytes of the
    other half, and then dealt as pairs of blocks to many tasks; none is cut short.
    """
    if radius > 3:
        raise ValueError("two halves with balls of one bit find at most 3 bits")
    small_batches(fps.sparkSession)
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = F.array(F.struct(low.alias("v"), high.alias("other")), F.struct(high.alias("v"), low.alias("other")))
    keyed = fps.select("fp", F.posexplode(halves).alias("half", "h")).select("fp", "h.*", (2 * F.col("h.v") + F.col("half")).alias("cell"))
    ball = F.expr("transform(filter(sequence(0, 31), i -> getbit(v, i) = 1), i -> cell - shiftleft(2L, i))")
    entries = keyed.select(
        "fp", "other", F.explode(F.concat(F.array(F.struct("cell", F.lit(True).alias("own"))),
                                          F.transform(ball, lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own"))))).alias("e")
    ).select("fp", "other", "e.cell", "e.own")
    # Only cells with an owner and another member can hold a link: the others, nearly all, go no further.
    live = cut(_sizes(entries, "cell"))
    mine = entries.join(live, "cell")
    dealt = mine.where(F.col("n") <= cell).select("fp", "cell", "own", F.lit(0).cast("long").alias("part"))
    if not live.where(F.col("n") > cell).isEmpty():
        # Within a crowded cell members differ in at most 3 bits of the other half, so one of its 4 bytes is the same.
        at = F.posexplode(F.array(*[F.shiftright("other", 8 * i).bitwiseAND(F.lit(255)) for i in range(4)])).alias("i", "byte")
        split = mine.where(F.col("n") > cell).select("fp", "cell", "own", at).select("fp", "cell", "own", (256 * F.col("i") + F.col("byte")).alias("sub"))
        blocks = cut(_sizes(split, "cell", "sub")).withColumn("blocks", F.when(F.col("n") > cell, F.ceil(2 * F.col("n") / cell)).otherwise(1).cast("int"))
        # What still is crowded is dealt as pairs of blocks.
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        parts = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda j: F.shiftleft(F.col("sub") + 1, 48) + F.least(own, j) * F.col("blocks") + F.greatest(own, j),
        )
        dealt = dealt.union(split.join(blocks, ["cell", "sub"]).select("fp", "cell", "own", F.explode(parts).alias("part")))
    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(tidy(_cells(radius)), "a long, b long")


def _sizes(entries: DataFrame, *by: str) -> DataFrame:
    """(by..., n) of the groups that have an owner and another member."""
    return entries.groupBy(*by).agg(F.count("*").alias("n"), F.bool_or("own").alias("owned")).where("owned and n > 1").drop("owned")


def _labels(fps: DataFrame) -> DataFrame:
    """(fp, first, label) for each distinct fingerprint of (key, fp), with its smallest key."""
    distinct = cut(fps.groupBy("fp").agg(F.min("key").alias("first")))
    labels = components(cut(links(distinct.select("fp"))))
    return cut(distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))


def labelled(docs: DataFrame) -> DataFrame:
    """(key, hash, label) for every row of docs (key, text): the hash of its text and the label of its component."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], ["key", "hash", "fp"])

    kind = docs.schema["key"].dataType.simpleString()
    hashed = docs.select("key", F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull()).alias("hash"), "text")
    fps = cut(hashed.mapInArrow(tidy(run), f"key {kind}, hash long, fp long"))
    labels = _labels(fps.select("key", "fp")).select(F.col("fp").alias("_fp"), "label")
    return cut(fps.join(labels, F.col("fp") == F.col("_fp")).select("key", "hash", "label"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): component is the smallest key of the rows reachable over links.

    Rows of equal fingerprint are linked, texts without words among them. Repeated rows
    get the same component; a NULL key never is the smallest unless all of its component
    are NULL. Only distinct fingerprints are searched, so copies cost one entry.
    """
    fps = cut(fingerprints(docs, key, text))
    labels = _labels(fps)
    least = labels.groupBy("label").agg(F.min("first").alias("component"))
    known = labels.join(least, "label").select(F.col("fp").alias("_fp"), "component")
    return fps.join(known, F.col("fp") == F.col("_fp")).select("key", "fp", "component")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: one with the group's smallest key.

    Of several rows with that key in a group, one stays: that with the least hash of its
    text. So does one of a group of NULL keys alone. Rows that share a key, NULL too, but
    aren't near-duplicates are of different groups, and each group keeps its own.
    """
    grouped = labelled(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    first = F.struct(F.col("key").isNull().alias("none"), "key", "hash")
    kept = cut(grouped.groupBy("label").agg(F.min(first).alias("_first")).select("_first.key", "_first.hash"))
    found = kept.select(F.col("key").alias("_key"), F.col("hash").alias("_hash")).distinct()
    mine = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("mine"), mine.alias("hash"))
    out = rows.join(found, F.col("mine").eqNullSafe(F.col("_key")) & (F.col("hash") == F.col("_hash")), "left_semi")
    copies = grouped.join(found, F.col("key").eqNullSafe(F.col("_key")) & (F.col("hash") == F.col("_hash")), "left_semi")
    # Rows of one key and text differ in other columns at most.
    repeated = not copies.groupBy("key", "hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return (out.dropDuplicates(["mine", "hash"]) if repeated else out).select("row.*")
