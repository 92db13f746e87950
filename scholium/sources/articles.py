"""Articles in XML: publications, references, citations, examples and abbreviations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import jats
from scholium.functions import text as T
from scholium.sources.files import decode_udf, exploded, number_in, read_files

_EXAMPLE = ("number string, letter string, language string, words array<string>, gloss array<string>, translation string, comment string, "
            "sources array<struct<sid:string,pages:string>>")


def _metadata(text: str) -> list[tuple]:
    return [(jats.metadata(jats.parse(text)),)]


def _references(text: str) -> list[tuple]:
    return jats.references(jats.parse(text))


def _abbreviations(text: str) -> list[tuple]:
    return list(jats.abbreviations(jats.parse(text)).items())


def _examples(text: str) -> list[tuple]:
    return [(g.number, g.letter, g.language, g.words, g.gloss, g.translation, g.comment, g.refs) for g in jats.glosses(jats.parse(text))]


def _citations(text: str) -> list[tuple]:
    return [(k,) for k in jats.cited(jats.parse(text))]


@dataclass
class Corpus:
    """The relations of a provider, all keyed by pub_id."""

    publications: DataFrame
    references: DataFrame
    citations: DataFrame
    examples: DataFrame
    abbreviations: DataFrame


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(pub_id, ord, text) of files named by numbers, in their order."""
    files = read_files(spark, root, "*.xml").withColumn("ord", number_in(F.col("path"), "xml")).where("ord is not null")
    return files.select(F.col("ord").cast("string").alias("pub_id"), "ord", decode_udf("content").alias("text"))


def corpus(texts: DataFrame) -> Corpus:
    """The relations of articles given as (pub_id, text)."""
    meta = exploded(texts, _metadata, "meta map<string,string>", ["pub_id"])
    names = ("doi", "title", "creators", "year", "volume", "issue", "license")
    examples = exploded(texts, _examples, _EXAMPLE, ["pub_id"])
    first = T.clean_translation(F.col("translation"))
    return Corpus(
        meta.select("pub_id", *[F.col("meta")[n].alias(n) for n in names]),
        exploded(texts, _references, "sid string, genre string, fields map<string,string>", ["pub_id"]),
        exploded(texts, _citations, "sid string", ["pub_id"]),
        examples.withColumn("local_id", F.concat("number", "letter")).withColumn("primary_text", F.array_join("words", " ")).withColumn("translation", first),
        exploded(texts, _abbreviations, "abbr string, definition string", ["pub_id"]),
    )


def read_articles(spark: SparkSession, root: str) -> Corpus:
    return corpus(read_texts(spark, root))
