"""Catalogues of publications as tables with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import text as T

COLUMNS = ("ID", "DOI", "metalanguage", "objectlanguage", "license", "creators", "title", "year", "edited", "superseded", "pages", "series", "seriesnumber", "isbn")


def read_catalog(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All rows, every column a string; columns that the file lacks are NULL."""
    rows = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]).withColumn("int_id", F.col("ID").cast("int"))


def published(catalog: DataFrame, missing: tuple[int, ...] = ()) -> DataFrame:
    """Rows with an open licence that have come out and whose sources are there."""
    rows = catalog.where(T.has_open_license(F.col("license")) & (F.coalesce("year", F.lit("")) != "Forthcoming"))
    return rows.where(~F.coalesce(F.col("int_id").isin(*missing), F.lit(False))) if missing else rows


def lookup(catalog: DataFrame, publication: str) -> DataFrame:
    """The row of an id, among all rows."""
    return catalog.where(F.col("ID") == publication)


def as_sources(catalog: DataFrame, publisher: str | None = None, address: str | None = None) -> DataFrame:
    """(sid, genre, fields): each publication as a bibliographic entry."""
    who = T.creators_as_names(F.col("creators"))
    fields = {
        "author": F.when(~F.coalesce(F.col("edited") == "True", F.lit(False)), who), "editor": F.when(F.col("edited") == "True", who), "title": F.col("title"),
        "year": F.col("year"), "doi": F.col("DOI"), "isbn": F.col("isbn"), "series": F.col("series"), "number": F.col("seriesnumber"), "pages": F.col("pages"),
        "publisher": F.lit(publisher), "address": F.lit(address),
    }
    pairs = [x for name, value in fields.items() for x in (F.lit(name), value.cast("string"))]
    return catalog.select(F.col("ID").alias("sid"), F.lit("book").alias("genre"), F.map_filter(F.create_map(*pairs), lambda _, v: F.coalesce(v, F.lit("")) != "").alias("fields"))


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.drop("int_id").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
