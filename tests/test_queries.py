"""Every registered query of the library against its SQL."""

import random

import pandas as pd
import pytest
from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import functions as F

from scholium.functions import bib
from scholium.operators import references
from scholium.plans import queries
from tests.compare import SF, same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_merge_fuzzy_reads_whole_lines(spark, tmp_path):
    """Against a plain merge: neighbours by slug join if their whole first lines are similar."""
    rng = random.Random(1)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    head = " ".join(say(8) for _ in range(12))
    rows = [(i, head + " " + " ".join(say(9) for _ in range(30)) + "\nrest", f"s{i % 2}") for i in range(8)]
    rows += [(10 + i, rows[i][1].replace("\n", "x\n"), rows[i][2]) for i in range(3)] + [(20, rows[0][1], rows[0][2])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for source in ("s0", "s1"):
        lines = sorted((bib.slug(line), line) for _, text, s in rows if s == source for line in [text.split("\n")[0]])
        groups = []
        for _, line in lines:
            if groups and bib.similarity(groups[-1][-1], line) >= 92:
                groups[-1].append(line)
            else:
                groups.append([line])
        want += [(len(g), max(g, key=len)) for g in groups]
    got = [(r["n"], r["title"]) for r in queries.QUERIES["merge_fuzzy"](spark, str(tmp_path)).collect()]
    assert len(want) == 8
    assert sorted(got) == sorted(want)


def _without_comment(line):
    """Letter by letter: up to the first % without a backslash before it, or up to a line break before %."""
    at = line.find("\\\\%")
    if at >= 0:
        return line[:at] + "\\\\"
    out = ""
    for i, c in enumerate(line):
        if c == "%" and line[i - 1 : i] != "\\":
            break
        out = out[:-1] + c if c == "%" else out + c
    return out


def test_comments_of_all_documents(spark, tmp_path):
    texts = [None, "", "plain", "a % b", "50\\% of % x", "% all", "a \\\\% b", "a\\textbf{b}", "l1 % c\nl2", "x\\%%y", "a\\"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["line"] for r in queries.QUERIES["tex_comment_strip"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else _without_comment(t + "\\% x % y") for i, t in enumerate(texts)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_merge_scores_a_pair_once_and_over_all_cores(spark):
    """Entries of one key are one window, but their titles are compared in many tasks; those of other years not at all."""
    scored = spark.sparkContext.accumulator(0)
    tasks = spark.sparkContext.accumulator([], _Gathered())

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        scored.add(int((a.notna() & b.notna()).sum()))
        tasks.add([TaskContext.get().partitionId()])
        return pd.Series([False] * len(a))

    name = F.format_string("%03d", F.col("id"))
    entries = spark.range(300).select(
        F.lit("k").alias("key"), name.alias("citekey"), F.lit("misc").alias("genre"), F.create_map(F.lit("title"), name).alias("fields"), name.alias("title"),
        name.alias("title_slug"), F.when(F.col("id") < 200, "1999").otherwise(name).alias("year"), F.lit("a").alias("author_slug"), F.col("id").alias("ord"))
    assert references.merge_bibliography(entries, similar).count() == 300
    assert scored.value == 199
    assert len(set(tasks.value)) >= spark.sparkContext.defaultParallelism


class _Gathered(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return a + b
