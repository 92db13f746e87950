"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other, here low quality and then toxicity, as the
labels give them. Each classifier is a logistic regression over the presence of words,
word beginnings and runs of punctuation; those of later categories also see the earlier
categories' probabilities. They are trained on out-of-fold predictions of these, so that
they meet what they will meet on new documents.

Training uses a bounded sample of labelled documents, chosen by hash of their keys; its
features are counted on the executors, and only the selected ones reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.common import cut, small_batches, tidy

#: Categories in order of the chain, each with the condition on the labels that makes it positive.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
#: Labelled documents to train on, at most, for each combination of categories.
SAMPLE = 800
#: Features for each category, at most, the root of the log-likelihood ratio that
#: one needs, and documents of the sample that it must be in.
FEATURES, CERTAIN, MIN_DOCS = 192, 5.0, 8
FOLDS, PENALTY, STEPS = 4, 0.1, 10
#: How much worse it is to reject a clean document than to miss another, in choosing a category's threshold.
FALSE_COST = 10
CACHE = 300_000
PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())


def features(token: str) -> list[str]:
    """What a word shows: itself in lower case, its beginnings of 4, 5 and 6 letters, its punctuation of two or more."""
    core = token.strip(PUNCTUATION)
    out = []
    if len(core) < len(token) and (marks := token.replace(core, "", 1) if core else token) and len(marks) > 1:
        out.append("/" + marks)
    if core:
        low = core.lower()
        out.append("=" + low)
        out += [f"{n}{low[:n]}" for n in (4, 5, 6) if len(low) >= n]
        if len(core) > 1 and core.isupper():
            out.append("/A")
    return out


@dataclass
class Chain:
    """The selected features' places and, for each category, weights (features, earlier categories, constant) and threshold."""

    names: list[str]
    index: dict[str, int]
    weights: list[np.ndarray]
    thresholds: list[float]

    def probabilities(self, present: np.ndarray) -> np.ndarray:
        out = np.empty((len(present), 0))
        for w in self.weights:
            out = np.column_stack([out, _sigmoid(np.column_stack([present, out, np.ones(len(present))]) @ w)])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a ridge penalty; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], PENALTY)
    penalty[-1] = 1e-6
    for _ in range(STEPS):  # Newton steps
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        far = np.abs(step).max()
        w = w - step * min(1.0, 5.0 / max(far, 1e-12))
        if far < 0.01:
            break
    return w


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where the share of positives found less FALSE_COST times that of negatives is largest, midway to the next lower value."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    gain = np.cumsum(y) / y.sum() - FALSE_COST * np.cumsum(1 - y) / (len(y) - y.sum())
    gain[:-1][p[:-1] == p[1:]] = -np.inf  # equal values go together
    best = int(gain.argmax())
    if gain[best] <= 0:  # nothing tells them apart: nothing is predicted
        return float("inf")
    return float((p[best] + p[min(best + 1, len(p) - 1)]) / 2)


def train(present: np.ndarray, labels: np.ndarray, names: list[str], index: dict[str, int]) -> Chain:
    """The chain from a sample: features present (rows x features) and labels (rows x categories)."""
    folds = np.arange(len(present)) % FOLDS
    earlier, weights, thresholds = np.empty((len(present), 0)), [], []
    for j in range(len(names)):
        x, y = np.column_stack([present, earlier, np.ones(len(present))]), labels[:, j].astype(float)
        if not 0 < y.sum() < len(y):  # nothing to tell apart: the category is never predicted
            weights.append(np.append(np.zeros(x.shape[1] - 1), -30.0))
            thresholds.append(1.0)
            out = np.zeros(len(y))
        else:
            weights.append(fit(x, y))
            out = np.empty(len(y))
            for f in range(FOLDS):
                rest = folds != f
                out[~rest] = _sigmoid(x[~rest] @ fit(x[rest], y[rest])) if 0 < y[rest].sum() < rest.sum() else y[rest].mean()
            thresholds.append(threshold(out, y))
        earlier = np.column_stack([earlier, out])
    return Chain(names, index, weights, thresholds)


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, categories, sample: int) -> DataFrame:
    """(id, text, one flag for each category) of the sample. Ids with several labels have each that one of them gives."""
    flags = [F.max(F.expr(f"cast({rule} as int)")).alias(f"c{i}") for i, (_, rule) in enumerate(categories)]
    each = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(*flags).na.drop()
    each = cut(each)
    names = [f"c{i}" for i in range(len(categories))]
    # A top-k for each combination, 2 ** categories of them: no task sees more than the sample of any.
    parts = [
        each.where(reduce(and_, [F.col(c) == v for c, v in zip(names, values, strict=True)])).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        for values in product((0, 1), repeat=len(names))
    ]
    some = F.broadcast(cut(reduce(DataFrame.union, parts)))  # at most sample rows for each combination
    own = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.join(some, own["_key"] == some["_id"]).select("_id", "text", *[f"c{i}" for i in range(len(categories))])


def _evidence(a: Column, b: Column, positives: int, negatives: int) -> Column:
    """Signed root of the log-likelihood ratio of a feature in a of the positives and b of the negatives."""
    total, rest = positives + negatives, positives + negatives - a - b

    def part(seen: Column, row: Column, column: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (row * column))).otherwise(0.0)

    ratio = part(a, a + b, positives) + part(b, a + b, negatives) + part(positives - a, rest, positives) + part(negatives - b, rest, negatives)
    return F.signum(a * negatives - b * positives) * F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", categories=CATEGORIES, sample: int = SAMPLE
) -> Chain:
    """Trains a chain on the labelled documents. Without any labels it predicts nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    flags = [f"c{i}" for i in range(len(categories))]
    chosen = cut(_labelled(docs, labels, key, text, categories, sample))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted({f for t in set(x.split()) for f in features(t)}) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string())), *batch.columns[1:]], ["found", *flags])

    found = chosen.select("text", *flags).mapInArrow(tidy(each), "found array<string>, " + ", ".join(f"{c} int" for c in flags))
    sums = [F.sum(c).alias(c) for c in flags]
    totals = chosen.agg(F.count("*").alias("n"), *sums).first()
    counts = cut(
        found.select(F.explode("found").alias("f"), *flags).groupBy("f").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= MIN_DOCS)
    )
    picked: set[str] = set()
    for c in flags:
        if totals["n"] and 0 < totals[c] < totals["n"]:
            z = _evidence(F.col(c), F.col("n") - F.col(c), totals[c], totals["n"] - totals[c])
            for sign, most in ((1, FEATURES), (-1, FEATURES // 4)):
                sure = counts.select("f", (sign * z).alias("z")).where(F.col("z") >= CERTAIN)
                picked |= {r["f"] for r in sure.orderBy(F.desc("z"), "f").limit(most).collect()}
    index = {f: i for i, f in enumerate(sorted(picked))}
    names = [n for n, _ in categories]
    rows = _present(chosen.select("text", "_id", *flags).orderBy(F.xxhash64("_id"), "_id"), index)
    x, y = np.zeros((len(rows), len(index))), np.zeros((len(rows), len(flags)))
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
        y[i] = [r[c] for c in flags]
    return train(x, y, names, index)


def _finder(index: dict[str, int]):
    """A function from a text to the places of its features; what a word shows is kept for frequent words."""
    cache: dict[str, tuple[int, ...]] = {}

    def places(token: str) -> tuple[int, ...]:
        got = cache.get(token)
        if got is None:
            got = tuple(index[f] for f in features(token) if f in index)
            if len(cache) < CACHE and len(token) < 40:
                cache[token] = got
        return got

    def find(text: str) -> list[int]:
        return list({i for got in filter(None, map(places, set(text.split()))) for i in got})

    return find


def _present(chosen: DataFrame, index: dict[str, int]) -> list:
    """The sample's rows with the places of their selected features; no more rows than the sample's bound."""
    flags = [c for c in chosen.columns if c not in ("text", "_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(index)
        for batch in batches:
            at = pa.array([find(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([at, *batch.columns[2:]], ["at", *flags])

    return chosen.mapInArrow(tidy(run), "at array<int>, " + ", ".join(f"{c} int" for c in flags)).collect()


def verdicts(text: Column, chain: Chain, spark: SparkSession) -> Column:
    """struct(p_<category> double, ..., <category> boolean, ...) of a text; NULL and empty texts show no features.

    Only texts go to the Python worker; all else of a row stays on the JVM.
    """
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(chain)  # bounded by FEATURES
    names = [f"p_{n}" for n in chain.names] + list(chain.names)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chain = shipped.value
        find = _finder(chain.index)
        for batch in batches:
            texts = batch.to_pylist()
            present = np.zeros((len(texts), len(chain.index)), np.float32)
            for i, t in enumerate(texts):
                if t:
                    present[i, find(t)] = 1
            p = chain.probabilities(present)
            cols = [pa.array(p[:, j]) for j in range(p.shape[1])] + [pa.array(p[:, j] >= t) for j, t in enumerate(chain.thresholds)]
            yield pa.StructArray.from_arrays(cols, names)

    kinds = [f"`p_{n}` double" for n in chain.names] + [f"`{n}` boolean" for n in chain.names]
    each = tidy(run)
    each.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, ", ".join(kinds))(text)


def scored(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """docs with a column p_<category> for each category and <category>, whether it is predicted.

    A NULL or empty text shows no features. All rows stay, repeated ones too, and an empty
    table gives an empty result; ties at a threshold are predicted. A column of the input
    with one of the new names is replaced; keep_clean() replaces none.
    """
    new = [f"p_{n}" for n in chain.names] + list(chain.names)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")).withColumn("v", verdicts(F.col("text"), chain, docs.sparkSession))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *[F.col("v").getField(c).alias(c) for c in new])


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", category: str = "toxic") -> DataFrame:
    """The rows of docs that aren't predicted to be of the category, with all their columns as they are.

    Whatever the columns are called, none is touched. Rows without text stay, as they show nothing.
    """
    chain = learn(docs, labels, key, text)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")).withColumn("v", verdicts(F.col("text"), chain, docs.sparkSession))
    return rows.where(~F.col("v").getField(category)).select("row.*")
