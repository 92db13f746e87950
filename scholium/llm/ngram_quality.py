"""Quality by perplexity under an interpolated modified Kneser-Ney model of word n-grams.

Counts come from all trusted text; the tables grow with it. Grams of words of the
documents meet those of the model by shuffle, one order after the other: what the highest
order doesn't know goes on to the next, times what its context leaves. Below the single
words stands a model of their spelling, SPELLING bytes deep, so that unknown words (and
scripts without spaces) have a chance too; only that one is bounded by the alphabet, and
is a broadcast. Perplexities are held against a quantile of the trusted documents of the
same language. These would know all their grams, which no other document does; so each
word of a trusted document is scored by counts without itself (leaving one out).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import SPACE, discard, small_batches, tidy
from scholium.llm.common import cut as _cut

#: Words of a gram, and bytes of one of the spelling model.
ORDER, SPELLING = 3, 3
#: Grams of the highest order that one shuffle partition holds, about.
SHARD = 2_000_000
#: Stands for the words before the first.
START = 0
#: Which bytes separate words, as for bytes.split(), the first bytes of eight, and the longest word that is coded with others.
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
HEADS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG = 64
#: Documents beyond this quantile of the trusted ones' perplexity, in their language, are rejected.
QUANTILE = 0.99
#: Bytes of text whose grams a worker holds at a time.
BLOCK = 1 << 20
#: Grams are counted and scored in this many slices, in fewer if these had less text than so many bytes.
SLICES, SLICE = 8, 16 << 20
#: Words that a task remembers to have spelt, about.
SEEN = 200_000


#: While a table is written: its shuffle files go when it is done, and text is packed tighter than by default.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def cut(df: DataFrame) -> DataFrame:
    """As common.cut, but the shuffle files of df's plan go at once: nothing else here reads them."""
    conf = df.sparkSession.conf
    before = {name: conf.get(name, None) for name in WRITING}
    try:
        for name, value in WRITING.items():
            conf.set(name, value)
        return _cut(df)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The gram from each place of data, first byte highest; up to 7 bytes fit."""
    if order > 7:
        raise ValueError("a gram has at most 7 bytes")
    n = len(data) - order + 1
    out = np.zeros(max(n, 0), np.int64)
    for i in range(order):
        out = out << 8 | data[i : i + n] if n > 0 else out
    return out


def _parts(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, row) of texts, about BLOCK bytes at a time; no gram crosses texts, long texts come in parts."""
    got, rows, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - order + 1), BLOCK):
            g = grams(np.frombuffer(text[at : at + BLOCK + order - 1] if len(text) > BLOCK else text, np.uint8), order)
            got.append(g)
            rows.append(np.full(len(g), i))
            size += len(g)
            if size >= BLOCK:
                yield np.concatenate(got), np.concatenate(rows)
                got, rows, size = [], [], 0
    if size:
        yield np.concatenate(got), np.concatenate(rows)


def counted(trusted: DataFrame, text: str, order: int = SPELLING) -> DataFrame:
    """(gram, n) over all of a table's texts; each task sums up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: pd.Series | None = None

        def out(s: pd.Series) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(s.index.to_numpy(np.int64)), pa.array(s.to_numpy(np.int64))], ["gram", "n"])

        for batch in batches:
            for g, _ in _parts([(t or "").encode() for t in batch.column(0).to_pylist()], order):
                some = pd.Series(g).value_counts(sort=False)
                total = some if total is None else total.add(some, fill_value=0)
                if len(total) > 1_000_000:
                    yield out(total)
                    total = None
        if total is not None:
            yield out(total)

    small_batches(trusted.sparkSession)
    return trusted.select(text).mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """D(0..3) of modified Kneser-Ney from how many grams occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (counts_of_counts.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [0.0]
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d.append(min(max(i - (i + 1) * y * b / a, 0.1), i - 0.1) if a else i * 0.5)  # none may be 0: all bytes need a chance
    return np.array(d)


@dataclass
class Table:
    """Sorted grams with their discounted probabilities, and sorted contexts with what they leave to lower orders."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


def table(grams: np.ndarray, n: np.ndarray, d: np.ndarray) -> Table:
    """From grams in ascending order and their counts; all grams of a context must be there."""
    contexts, first, where = np.unique(grams >> 8, return_index=True, return_inverse=True)
    off = d[np.minimum(n, 3)]
    if not len(grams):
        return Table(grams, off, contexts, off)
    total = np.add.reduceat(n, first)
    return Table(grams, (n - off) / total[where], contexts, np.add.reduceat(off, first) / total)


def _at(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], other)


@dataclass
class Shard:
    """The highest order's table for grams from low up to high, and the tables of all lower orders, unigrams first."""

    order: int
    low: int
    high: int
    top: Table
    lower: list[Table]

    def log_probability(self, g: np.ndarray) -> np.ndarray:
        """Of the last byte of each gram after the others; all grams are of this shard."""
        p = np.full(len(g), 1 / 256)
        for m, t in enumerate([*self.lower, self.top], 1):
            part = g & ((1 << 8 * m) - 1)
            p = _at(t.grams, part, t.share, 0.0) + _at(t.contexts, part >> 8, t.rest, 1.0) * p
        return np.log(p)


def shards(counts: DataFrame, order: int = SPELLING, size: int = 1 << 8 * SPELLING) -> Iterator[Shard]:
    """The model, shard by shard. counts: (gram, n), which is read once for each shard."""
    def frequent(t: DataFrame) -> np.ndarray:
        return discounts({int(r["n"]): r["count"] for r in t.where("n <= 4").groupBy("n").count().collect()})

    lower, now = [], counts
    top = frequent(counts)
    for m in range(order - 1, 0, -1):  # a lower order counts the different bytes before a gram
        now = cut(now.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("gram")).agg(F.count("*").alias("n")))
        got = now.orderBy("gram").toPandas()  # at most 256 ** m rows
        lower.insert(0, table(got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64), frequent(now)))
    half = 8 * (order // 2)
    ranges, low, n = [], 0, 0
    for r in counts.groupBy(F.shiftright("gram", half).alias("head")).count().orderBy("head").collect():  # at most 256 ** (order / 2) rows
        if n and n + r["count"] > size:
            ranges.append((low, r["head"] << half))
            low, n = r["head"] << half, 0
        n += r["count"]
    for low, high in [*ranges, (low, 1 << 8 * order)]:
        got = counts.where((F.col("gram") >= low) & (F.col("gram") < high)).orderBy("gram").toPandas()
        yield Shard(order, low, high, table(got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64), top), lower)


def _places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data start and end."""
    inside = np.r_[False, ~IS_SPACE[data], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit code of each word of data, eight bytes after the other; none is START. Words of over LONG bytes get their XXH64."""
    data, n = np.r_[data, np.zeros(8, np.uint8)], ends - starts
    h = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    some = np.flatnonzero(n <= LONG)
    for at in range(0, LONG, 8):
        some = some[n[some] > at] if at else some
        for i in range(0, len(some), 1 << 17):
            now = some[i : i + (1 << 17)]
            x = data[(starts[now] + at)[:, None] + np.arange(8)].view("<u8")[:, 0] & HEADS[np.minimum(n[now] - at, 8)]
            x ^= h[now]
            for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
            h[now] = x ^ x >> np.uint64(33)
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return np.where(h == START, np.uint64(1), h).view(np.int64)


def _codes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    return _coded(data, *_places(data))


def _columns(order: int) -> list[str]:
    return [f"w{i}" for i in range(order)]


def word_grams(docs: DataFrame, order: int, slices: int = 1, piece: int = 0) -> DataFrame:
    """(row, own, w0, w1, ...): every word of docs (row, own, text) with those before it. Texts with fewer bytes than the order have none.

    Only those are returned whose last word but one falls into this piece of all slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, flags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = [t if t and len(t) >= order else b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            data = np.frombuffer(b" ".join(texts), np.uint8)
            starts, ends = _places(data)
            codes, at = _coded(data, starts, ends), np.arange(len(starts))
            n = np.diff(np.r_[0, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))])
            first = np.repeat(np.cumsum(n) - n, n)
            got = [np.where(at - i < first, START, np.roll(codes, i)) for i in range(order - 1, -1, -1)]
            keep = got[-2].view(np.uint64) % slices == piece if slices > 1 else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (np.repeat(rows, n), np.repeat(flags, n), *got)], ["row", "own", *_columns(order)])

    return docs.select("row", "own", "text").mapInArrow(tidy(run), "row long, own boolean, " + ", ".join(f"{c} long" for c in _columns(order)))


def _spelling(words: list[bytes], model: Shard) -> np.ndarray:
    """The log-probability of each word as a sequence of bytes up to a space, about BLOCK bytes at a time."""
    before, after = b" " * (model.order - 1), b" " * max(model.order - 1, 1)
    out, first, size = np.zeros(len(words)), 0, 0
    for last, word in enumerate(words, 1):
        size += len(word) + len(after)
        if size >= BLOCK or last == len(words):
            n = np.array([len(w) + len(after) for w in words[first:last]])
            at = np.repeat(np.arange(first, last), n)
            # Of what separates words, only the first space is predicted.
            inside = np.arange(size) - np.repeat(np.cumsum(n) - n, n) <= np.repeat(n, n) - len(after)
            done = 0
            for g, _ in _parts([before + after.join(words[first:last]) + after], model.order):
                part = slice(done, done + len(g))
                codes, different = pd.factorize(g, sort=True)
                out += np.bincount(at[part], model.log_probability(different)[codes] * inside[part], len(words))
                done += len(g)
            first, size = last, 0
    return out


def spelt(docs: DataFrame, model: Shard) -> DataFrame:
    """(w, base): each different word of docs and its probability as a sequence of bytes up to a space."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the alphabet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shipped.value, set()
        for batch in batches:
            words = list({w for t in batch.column(0).to_pylist() for w in (t or "").encode().split()} - seen)
            if len(seen) > SEEN:
                seen = set()
            seen.update(w for w in words if len(w) <= 64)
            yield pa.RecordBatch.from_arrays([pa.array(_codes(words), pa.int64()), pa.array(_spelling(words, model))], ["w", "base"])

    return docs.select("text").mapInArrow(tidy(run), "w long, base double").groupBy("w").agg(F.min("base").alias("base"))


def _off(n: Column, d: np.ndarray) -> Column:
    return F.when(n == 1, d[1]).when(n == 2, d[2]).when(n > 2, d[3]).otherwise(0.0)


def _parts_of(table: DataFrame, shard: int) -> int:
    """Shuffle partitions for a table with about shard rows in each."""
    return max(-(-table.count() // shard), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _dealt(table: DataFrame, parts: int, keys: list[str]) -> DataFrame:
    """A table with different keys, to be joined by shuffle whatever its size today. A task hashes its share of it, and nothing is sorted."""
    return table.repartition(parts, *keys).hint("shuffle_hash")


def _counts(grams: DataFrame, order: int) -> list[DataFrame]:
    """(w..., n) of each order from 2, or of the only one; a lower order counts the different words before a gram."""
    names = _columns(order)
    counts = [cut(grams.groupBy(*names).agg(F.count("*").alias("n")))]
    for k in range(order - 1, 1, -1):
        counts.insert(0, cut(counts[0].groupBy(*names[order - k :]).agg(F.count("*").alias("n"))))
    return counts


def _few(counts: DataFrame) -> dict[int, int]:
    """How many grams occur 1, 2, 3 and 4 times."""
    return {int(r["n"]): r["count"] for r in counts.where("n <= 4").groupBy("n").count().collect()}


def _singles(counts: DataFrame, order: int) -> DataFrame:
    """(w, n) of the single words, from the lowest of _counts."""
    last = _columns(order)[-1]
    return counts if order == 1 else counts.groupBy(last).agg(F.count("*").alias("n"))


def word_model(grams: DataFrame, words: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """From the grams of trusted text: for each order from 1 (w..., lp, lp1) and (context..., rest, rest1), as logarithms.

    lp1 and rest1 are without the occurrence that is scored, NULL if there is no other. The
    first order has every word of words (w, base), also those of no trusted text.
    """
    counts = _counts(grams, order)
    single = cut(_singles(counts[0], order))
    known, rests = _higher(counts, _first(single, words, order), [discounts(_few(c)) for c in counts], order)
    discard(single)
    return known, rests


def _first(now: DataFrame, words: DataFrame, order: int) -> DataFrame:
    """The first order's table, from (w, n) and all words (w, base)."""
    last, d = _columns(order)[-1], discounts(_few(now))
    n, total, left = F.col("n"), F.col("total"), F.col("left")
    t, o = now.agg(F.sum("n"), F.sum(_off(n, d))).first()
    both = words.join(now.withColumns({"total": F.lit(t), "left": F.lit(o)}), words["w"] == now[last], "left").select(
        words["w"].alias(last), "base", "n", "total", "left")
    share, share1 = (n - _off(n, d)) / total, (n - 1 - _off(n - 1, d)) / (total - 1)
    # Logarithms are added up as long as they can be: exp(base) may be 0.
    unknown = F.lit(float(np.log(o / t)) if t else 0.0) + F.col("base")
    unknown1 = F.when(total > 1, F.log((left - _off(n, d) + _off(n - 1, d)) / (total - 1)) + F.col("base")).otherwise(F.col("base"))
    lp = F.when(n.isNull(), unknown).otherwise(F.log(share + F.exp(unknown)))
    lp1 = F.when(n > 1, F.log(share1 + F.exp(unknown1))).otherwise(unknown1)
    return cut(both.select(last, lp.alias("lp"), lp1.alias("lp1")))


def _higher(counts: list[DataFrame], first: DataFrame, off: list[np.ndarray], order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """All orders' tables, from the counts of those above the first, which go, and their discounts."""
    names, known, rests = _columns(order), [first], [None]
    n, total, left = F.col("n"), F.col("total"), F.col("left")
    for k, now, d in zip(range(2, order + 1), counts, off):
        own = names[order - k :]
        fewer = left - _off(n, d) + _off(n - 1, d)
        contexts = cut(now.groupBy(*own[:-1]).agg(F.sum("n").alias("total"), F.sum(_off(n, d)).alias("left")))
        parts = _parts_of(now, SHARD)
        p = (n - _off(n, d) + left * F.exp("lp")) / total
        p1 = F.when(n > 1, F.log((n - 1 - _off(n - 1, d) + fewer * F.exp("lp")) / (total - 1)))
        joined = now.join(_dealt(contexts, parts, own[:-1]), own[:-1]).join(_dealt(known[-1].select(*own[1:], "lp"), parts, own[1:]), own[1:])
        known.append(cut(joined.select(*own, F.log(p).alias("lp"), p1.alias("lp1"))))
        rest1 = F.when(total > 1, F.log(F.greatest(left - d[1], F.lit(1e-9)) / (total - 1)))
        rests.append(cut(contexts.select(*own[:-1], F.log(left / total).alias("rest"), rest1.alias("rest1"))))
        discard(now, contexts)
    return known, rests


def sums(docs: DataFrame, words: DataFrame, order: int, shard: int, slices: int) -> DataFrame:
    """(row, s, n) as log_probabilities, for docs (row, own, text) under the model of those with own; words (w, base) has all their words, and goes.

    The work is done in slices by the last word but one, with which all grams of a context
    meet, also those of the lower orders, except for single words. These and the discounts
    come first, so grams are counted twice, but never more than a slice of them are on disk.
    """
    slices = slices if order > 1 else 1
    good, few, single = docs.where("own"), [Counter() for _ in range(max(order - 1, 1))], []
    for piece in range(slices):
        counts = _counts(word_grams(good, order, slices, piece), order)
        for some, c in zip(few, counts, strict=True):
            some.update(_few(c))
        single.append(cut(_singles(counts[0], order)))
        discard(*counts)
    now = cut(reduce(DataFrame.unionByName, single).groupBy(_columns(order)[-1]).agg(F.sum("n").alias("n")))
    first = _first(now, words, order)
    discard(now, words, *single)
    found = []
    for piece in range(slices):
        known, rests = _higher(_counts(word_grams(good, order, slices, piece), order) if order > 1 else [], first, [discounts(c) for c in few], order)
        found.append(log_probabilities(word_grams(docs, order, slices, piece), known, rests, order, shard))
        discard(*known[1:], *rests[1:])
    discard(first)
    out = cut(reduce(DataFrame.unionByName, found).groupBy("row").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    discard(*found)
    return out


def log_probabilities(grams: DataFrame, known: list[DataFrame], rests: list[DataFrame], order: int, shard: int = SHARD) -> DataFrame:
    """(row, s, n): the sum of the log-probabilities of a row's words, and how many there are; rows with own leave theirs out."""
    names = _columns(order)
    parts, now, found = _parts_of(known[-1], shard), grams.withColumn("s", F.lit(0.0)), []
    for k in range(order, 0, -1):
        own = names[order - k :]
        # Tables and documents grow alike, so both are shuffled; once for what is found and what is missed.
        met = now.join(_dealt(known[k - 1], parts, own), own, "left").withColumn("p", F.when(F.col("own"), F.col("lp1")).otherwise(F.col("lp")))
        missed = F.col("p").isNull()
        met = cut(met.select("row", "own", *[F.when(missed, F.col(c)).alias(c) for c in own], (F.col("s") + F.coalesce("p", F.lit(0.0))).alias("s"), missed.alias("missed")))
        found.append(cut(met.where("not missed").groupBy("row").agg(F.sum("s").alias("s"), F.count("*").alias("n"))))
        if k < order:
            discard(now)
        if k > 1:
            rest = F.coalesce(F.when(F.col("own"), F.col("rest1")).otherwise(F.col("rest")), F.lit(0.0))
            left = met.where("missed").join(_dealt(rests[k - 1], parts, own[:-1]), own[:-1], "left")
            now = cut(left.select("row", "own", *own[1:], (F.col("s") + rest).alias("s")))
        discard(met)
    out = cut(reduce(DataFrame.unionByName, found).groupBy("row").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    discard(*found)
    return out


def judge(
    docs: DataFrame, labels: DataFrame, trusted: str = "quality = 1", key: str = "doc_id", text: str = "text", lang: str = "lang",
    order: int = ORDER, shard: int = SHARD, quantile: float = QUANTILE, slices: int | None = None,
) -> DataFrame:
    """(key, lang, n_grams, perplexity, threshold, kept) for each row of docs; n_grams counts words.

    Trusted are documents with a label for which ``trusted`` holds. Texts with fewer bytes
    than the order or without words, NULL texts among them, have no perplexity and are kept.
    A language without trusted documents, or a NULL language, is held against the quantile
    over all; without any trusted text everything is kept. Repeated rows are judged alike.
    """
    every = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))
    ids = labels.where(trusted).where(F.col(key).isNotNull()).select(F.col(key).alias("_id")).distinct()
    small_batches(docs.sparkSession)
    # Labels grow with the corpus: they are joined by shuffle whatever their size today.
    marked = every.join(ids.hint("merge"), every["key"] == ids["_id"], "left").withColumn("own", F.col("_id").isNotNull())
    own = cut(marked.drop("_id"))
    good = own.where("own")
    gap = " " * (SPELLING - 1)
    spaced = good.select(F.concat(F.lit(gap), F.regexp_replace("text", SPACE, gap), F.lit(gap)).alias("text"))
    (spelling,) = shards(cut(counted(spaced, "text")))
    words = cut(spelt(own, spelling))
    if slices is None:
        size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        slices = min(SLICES, 1 + size // SLICE)
    summed = sums(own.select("row", "own", "text"), words, order, shard, slices)
    # Repeated rows share their sums, which n evens out.
    scored = summed.select(F.col("row").alias("_row"), "n", F.exp(-F.col("s") / F.col("n")).alias("perplexity"))
    copies = own.groupBy("row").agg(F.count("*").alias("c"))
    found = scored.join(copies, scored["_row"] == copies["row"]).select("_row", (F.col("n") / F.col("c")).cast("long").alias("n"), "perplexity")
    judged = cut(own.select("key", "lang", "row", "own").join(found, F.col("row") == F.col("_row"), "left").select("key", "lang", "own", F.coalesce("n", F.lit(0)).alias("n"), "perplexity"))
    discard(own, summed)
    good = judged.where("own and perplexity is not null")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = good.where("lang is not null").groupBy(F.col("lang").alias("_lang")).agg(limit.alias("_limit"))
    over_all = good.agg(limit).first()[0]
    fallback = F.lit(float("inf") if over_all is None else over_all)
    return judged.join(by_lang, judged["lang"] == by_lang["_lang"], "left").select(
        "key", "lang", F.col("n").alias("n_grams"), "perplexity", F.coalesce("_limit", fallback).alias("threshold"),
        (F.col("perplexity").isNull() | (F.col("perplexity") <= F.coalesce("_limit", fallback))).alias("kept"),
    )
