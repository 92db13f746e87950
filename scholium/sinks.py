"""Bibliographies and examples as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import bib
from scholium.operators.examples import igt_text


def write_bibliography(merged: DataFrame, path: str, parts: int | None = None) -> int:
    """BibTeX files of merged (key, genre, fields), sorted by key; returns the number of entries.

    One file only if parts is 1; else as many as a range partition by key gives.
    """
    text = merged.select("key", F.concat(bib.as_bibtex(F.col("key"), F.col("genre"), F.col("fields")), F.lit("\n")).alias("value"))
    ordered = text.repartitionByRange(parts, "key").sortWithinPartitions("key") if parts else text.sort("key")
    ordered.select("value").write.mode("overwrite").text(path)
    return merged.count()


def write_by_publication(references: DataFrame, path: str) -> None:
    """A folder of BibTeX for each pub_id."""
    text = references.select("pub_id", F.concat(bib.as_bibtex(F.col("sid"), F.col("genre"), F.col("fields")), F.lit("\n")).alias("value"))
    text.write.mode("overwrite").partitionBy("pub_id").text(path)


def example_text() -> Column:
    """(local id) Language (source: pages; ...) and the aligned lines of an example."""
    cited = F.array_join(F.transform("sources", lambda s: F.concat_ws(": ", s["sid"], F.nullif(s["pages"], F.lit("")))), "; ")
    head = F.concat(F.lit("("), F.coalesce(F.nullif("local_id", F.lit("")), "id"), F.lit(") "), F.coalesce("language_name", F.lit("")), F.when(cited != "", F.concat(F.lit(" ("), cited, F.lit(")"))).otherwise(""))
    return F.concat(head, F.lit("\n"), igt_text(F.col("words"), F.col("gloss")), F.lit("\n‘"), F.coalesce("translation", F.lit("")), F.lit("’"))


def publication_text() -> Column:
    """creators year. title"""
    return F.format_string("%s %s. %s", "creators", "year", "title")
