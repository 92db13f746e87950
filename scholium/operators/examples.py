"""Operators over lines and examples: carrying forward, grouping, de-duplicating, qualifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CARRY = 25


def carry_forward(lines: DataFrame, keys: list[str], line: str, value: str, within: int = CARRY) -> DataFrame:
    """lines with ``carried``: the last value that isn't NULL, if fewer than ``within`` lines old.

    The frame ends there, so a file is one window partition but no row looks further back.
    """
    frame = W.partitionBy(*keys).orderBy(F.col(line).cast("long")).rangeBetween(1 - within, 0)
    return lines.withColumn("carried", F.last(value, ignorenulls=True).over(frame))


def previous_line(lines: DataFrame, keys: list[str], line: str, text: str, skipped: Column | None = None) -> DataFrame:
    """lines with ``prevline``: the text of the last line before that isn't skipped; '' at a file's start."""
    frame = W.partitionBy(*keys).orderBy(line).rowsBetween(W.unboundedPreceding, -1)
    kept = F.col(text) if skipped is None else F.when(~skipped, F.col(text))
    return lines.withColumn("prevline", F.coalesce(F.last(kept, ignorenulls=True).over(frame), F.lit("")))


def groups(lines: DataFrame, keys: list[str], line: str, starts: Column) -> DataFrame:
    """lines with ``grp``: how many lines so far start a group."""
    frame = W.partitionBy(*keys).orderBy(line).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("grp", F.sum(starts.cast("int")).over(frame))


def qualified_sources(examples: DataFrame) -> DataFrame:
    """examples (pub_id, local_id, sources) whose own publication is appended to the sources.

    With other sources it is cited as 'via' them, else by the local id alone.
    """
    own = F.when(
        F.size("sources") > 0, F.concat(F.lit("via"), F.coalesce(F.concat(F.lit(":"), F.nullif("local_id", F.lit(""))), F.lit("")))
    ).otherwise(F.coalesce("local_id", F.lit("")))
    return examples.withColumn("sources", F.concat("sources", F.array(F.struct(F.col("pub_id").alias("sid"), own.alias("pages")))))


def abbreviations(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, abbr, definition) from lines 'abbr & definition'; of several definitions the last counts."""
    rows = files.select(*keys, F.posexplode(F.split(text, "\n")).alias("ord", "line"))
    parts = F.split(F.regexp_replace("line", r"\\\\\s*\z", ""), "&")
    rows = rows.where(~F.trim("line").startswith("%")).withColumn("parts", parts).where(F.size("parts") == 2)
    rows = rows.select(*keys, "ord", F.trim(F.get("parts", F.lit(0))).alias("abbr"), F.trim(F.get("parts", F.lit(1))).alias("definition"))
    return rows.groupBy(*keys, "abbr").agg(F.max_by("definition", "ord").alias("definition"))


SEPARATORS = "-=~<>"


def recombined(morphemes: Column) -> Column:
    """Morphemes glued where one starts with a separator or follows one that ends in a separator; empty ones go."""
    starts = lambda x: x.rlike(f"^[{SEPARATORS}]")
    ends = lambda x: x.rlike(f"[{SEPARATORS}]\\z")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        glue = (F.size(done) > 0) & (starts(x) | F.coalesce(ends(last), F.lit(False)))
        return F.when(glue, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, x)))).otherwise(F.concat(done, F.array(x)))

    kept = F.filter(morphemes, lambda x: x != "")
    return F.when(F.size(kept) < 1, kept).otherwise(
        F.aggregate(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(F.element_at(kept, 1)), step)
    )


def igt_text(words: Column, gloss: Column) -> Column:
    """Two lines with words over their glosses, in columns of equal width."""
    width = lambda a, b: F.greatest(F.length(a), F.length(b))
    first = F.array_join(F.zip_with(words, gloss, lambda a, b: F.rpad(a, width(a, b), " ")), "  ")
    second = F.array_join(F.zip_with(words, gloss, lambda a, b: F.rpad(b, width(a, b), " ")), "  ")
    return F.concat(F.rtrim(first), F.lit("\n"), F.rtrim(second))
