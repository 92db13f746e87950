"""BibTeX files as references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import bib, tex
from scholium.sources.files import decode_udf, exploded, read_files


def _sources(text: str) -> list[tuple]:
    return [bib.to_source(k, g, f, tex.plain) for k, g, f in bib.parse_bibtex(text)]


def _raw(text: str) -> list[tuple]:
    return bib.parse_bibtex(text)


def parsed(files: DataFrame, keep: list[str], text: str = "text", delatex: bool = True) -> DataFrame:
    """(keep, ord, key, genre, fields, alt_keys) from texts of BibTeX files."""
    rows = exploded(files, _sources if delatex else _raw, "key string, genre string, fields map<string,string>", keep, text)
    return rows.withColumn("alt_keys", F.transform(bib.alternative_keys(F.col("fields")), lambda k: F.lower(F.replace(k, F.lit("–"), F.lit("--")))))


def read_bibtex(spark: SparkSession, root: str, delatex: bool = True) -> DataFrame:
    """Entries of all .bib files below root, files in order of their names."""
    files = read_files(spark, root, "*.bib").select("path", F.col("folder").alias("pub_id"), decode_udf("content").alias("text"))
    return parsed(files, ["pub_id", "path"], delatex=delatex)


def merge_input(entries: DataFrame) -> DataFrame:
    """What operators.references.merge_bibliography takes, from (citekey, genre, fields, ord)."""
    get = lambda k: F.coalesce(F.element_at("fields", F.lit(k)), F.lit(""))
    from scholium.functions import text as T

    return entries.select(
        bib.make_key_udf(get("author"), get("editor"), get("year")).alias("key"), "citekey", "genre", "fields", "ord",
        T.norm_title(get("title")).alias("title"), bib.slug_udf(get("title")).alias("title_slug"), T.year(get("year")).alias("year"),
        bib.last_names_slug_udf(get("author"), get("editor")).alias("author_slug"))
