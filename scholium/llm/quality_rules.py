"""Quality rules with host verdicts, in DataFrame functions only.

A host whose documents mostly break the base rules is rejected as a whole. Small hosts
say little, so their failure rates are shrunk towards the corpus: the rates of all hosts
give a beta prior by moments, and a host's verdict is taken from its posterior mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import cut, words

#: Characters that count as symbols, as a Java and RE2 character class body.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A host goes if the posterior mean of its failure rate is above this.
MAX_HOST_RATE = 0.5
#: Weight of the prior, in documents, if the hosts' rates give no moments (one host, no spread).
FLAT_WEIGHT = 2.0
#: Bounds of the prior's weight: rates without spread would give an infinite one.
MAX_WEIGHT = 1000.0


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable isn't evaluated again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array, first included.

    Windows are compared by 64-bit hashes of their words. Most texts have no repeated
    window, which a hash set over primitive values shows; in the others windows are
    sorted with their places, equal neighbours keep their places, and the places, sorted
    again, are united: each window covers up to three words until the next.
    """
    # Bound here, as a filter above may put the column's expression in its place.
    return _bind(tokens, _repeated)


def _repeated(tokens: Column) -> Column:
    n = F.size(tokens)
    windows = F.transform(
        F.slice(tokens, F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )

    def twice(s: Column) -> Column:
        return F.transform(
            F.filter(
                s,
                lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)),
            ),
            lambda x: x["i"],
        )

    def united(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda a, x: F.struct(
                (a["n"] + F.least(F.lit(3), x - a["last"])).cast("long").alias("n"), x.alias("last")
            ),
            lambda a: a["n"],
        )

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            _bind(F.sort_array(_bind(placed, twice)), united)
        )

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_bind(windows, counted))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed); row is a struct of all columns.

    A NULL or empty text has no words and fails. Lines are split at line feeds only; a
    line counts as repeated if it has a word and equals an earlier one.
    """
    t = F.coalesce(F.col("t"), F.lit(""))
    full = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return (
        docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("t"))
        .withColumn("w", words(F.col("t")))
        .withColumn("n_words", F.size("w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"))
        .withColumn("n_dup_lines", _bind(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("w")))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        )
        .select("row", *MEASURES)
    )


def host_rates(measured: DataFrame, host: str = "host") -> DataFrame:
    """A row for each host: n_docs, n_failed, the prior's alpha and beta, rate, host_kept.

    The prior fits mean and variance of the hosts' rates, less the variance that sampling
    n_docs documents gives by itself. Counts are summed before the shuffle, so that a hot
    host costs no more than another; the moments are one row.
    """
    hosts = cut(
        measured.groupBy(F.col(host).alias("host")).agg(
            F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
        )
    )
    raw = F.col("n_failed") / F.col("n_docs")
    n, m, v, inv = hosts.agg(F.count("*"), F.avg(raw), F.var_samp(raw), F.avg(1 / F.col("n_docs"))).first()
    alpha, beta = beta_prior(n, m, v, inv)
    return hosts.withColumn(
        "rate", (F.col("n_failed") + alpha) / (F.col("n_docs") + alpha + beta)
    ).withColumn("host_kept", F.col("rate") <= MAX_HOST_RATE)


def beta_prior(n: int, m: float | None, v: float | None, inv: float | None) -> tuple[float, float]:
    """alpha and beta by moments of n rates of mean m and variance v; inv: mean of 1 / n_docs."""
    weight = FLAT_WEIGHT
    if n > 1 and 0 < m < 1:
        spread = v - m * (1 - m) * inv
        weight = min(max(m * (1 - m) / spread - 1, FLAT_WEIGHT), MAX_WEIGHT) if spread > 0 else MAX_WEIGHT
    m = 0.0 if m is None else m
    return m * weight, (1 - m) * weight


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The measures of every document, its host's rate and ``kept``.

    kept is false for documents that fail the base rules or whose host is rejected.
    Documents without a host (NULL) are one host. Repeated rows are judged as often as
    they come; an empty table gives an empty result. Columns of the input other than
    those in ``keep`` (default: doc_id) aren't carried; rows travel as structs, so none can clash.

    Measures are written once and read twice, for the hosts and for the verdicts; the
    join carries no text. Catalyst broadcasts the hosts if they are few and else joins
    by shuffle, where AQE splits a hot host.
    """
    keep = keep or ["doc_id"]
    measured = measure(docs, text).select(F.struct(*[F.col("row").getField(c).alias(c) for c in keep]).alias("row"), F.col("row").getField(host).alias("host"), *MEASURES)
    measured = cut(measured)
    hosts = host_rates(measured).select(F.col("host").alias("_h"), "rate", "host_kept")
    return measured.join(hosts, F.col("host").eqNullSafe(F.col("_h")), "left").select(
        *[F.col("row").getField(c).alias(c) for c in keep], *MEASURES, F.col("rate").alias("host_rate"),
        (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever they are called.

    Texts are measured where they are read, once for the hosts and once for the rows, so
    that none is shuffled or written. Only the rejected hosts are joined, by broadcast if
    Catalyst finds them few and else by shuffle.
    """
    rows = measure(docs, text).select("row", F.col("row").getField(host).alias("host"), "base_failed")
    hosts = host_rates(cut(rows.select("host", "base_failed")))
    rejected = cut(hosts.where(~F.col("host_kept")).select(F.col("host").alias("_h")))
    return rows.where(~F.col("base_failed")).join(rejected, F.col("host").eqNullSafe(F.col("_h")), "left_anti").select("row.*")
