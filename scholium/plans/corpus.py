"""Providers of publications, and the relations over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import bib
from scholium.functions import text as T
from scholium.operators import languages, references
from scholium.sources import articles, bibliographies, books, catalog, datasets, files
from scholium.sources.articles import Corpus

Provider = Callable[[SparkSession, str], Corpus]
PROVIDERS: dict[str, Provider] = {}


def provider(name: str) -> Callable[[Provider], Provider]:
    """Registers a loader of one kind of publications under a name."""

    def add(load: Provider) -> Provider:
        PROVIDERS[name] = load
        return load

    return add


provider("article")(articles.read_articles)
provider("dataset")(datasets.read_datasets)


@provider("book")
def read_books(spark: SparkSession, root: str) -> Corpus:
    """Books with their BibTeX files, one folder each; cited keys stand for the references' own.

    A catalogue catalog.tsv beside the folders, if there is one, says which books are
    published and what language they treat, which is that of examples that name none.
    """
    texts = books.read_texts(spark, root)
    listed = None
    if not files.read_files(spark, root, "catalog.tsv").limit(1).isEmpty():
        listed = catalog.published(catalog.read_catalog(spark, f"{root.rstrip('/')}/catalog.tsv"))
        texts = texts.join(listed.select(F.col("ID").alias("pub_id")), "pub_id", "left_semi")
    mains = books.main_files(texts)
    texts = books.inlined(texts.withColumn("text", books.rewritten_udf("text")), mains)
    parts = books.included(texts, mains)
    refs = books.chosen_bibliographies(texts, mains, bibliographies.read_bibtex(spark, root)).withColumnRenamed("key", "sid")
    if listed is not None:
        refs = refs.join(listed.select(F.col("ID").alias("pub_id")), "pub_id", "left_semi")
    cites = references.resolve_citations(books.citations(books.citing(texts, mains, parts)).select("pub_id", "key"), refs)
    short = parts.select("pub_id", "path", "name", "text").union(texts.where("name = 'abbreviations.tex'").select("pub_id", "path", "name", "text"))
    short = books.gloss_abbreviations(short)
    examples = references.resolve_example_sources(books.examples(parts), refs)
    examples = references.abbreviations_for(examples, short)
    if listed is None:
        return Corpus(mains.select("pub_id"), refs, cites.select("pub_id", "sid"), examples, short)
    languages_of = listed.select(F.col("ID").alias("pub_id"), F.nullif("objectlanguage", F.lit("")).alias("objectlanguage"))
    files_of = languages_of.select("pub_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("language")).limit(0)
    named = languages.default_language(examples.withColumnRenamed("language", "language_name"), files_of, languages_of)
    examples = named.select(*[F.col("language_name").alias("language") if c == "language" else F.col(c) for c in examples.columns])
    own = listed.join(mains.select(F.col("pub_id").alias("ID")), "ID", "left_semi").withColumn("pub_id", F.col("ID"))
    return Corpus(own.drop("ID"), refs, cites.select("pub_id", "sid"), examples, short)


def load(spark: SparkSession, exclude: Iterable[str] = (), **roots: str) -> dict[str, Corpus]:
    """The relations of each provider that a root is given for, by name in order; ids become provider + id."""
    out = {}
    for name in sorted(roots):
        if name in exclude:
            continue
        got = PROVIDERS[name](spark, roots[name])
        out[name] = Corpus(*[rows.withColumn("pub_id", F.concat(F.lit(name), "pub_id")) for rows in vars(got).values()])
    return out


def union(corpora: dict[str, Corpus], relation: str) -> DataFrame:
    """One relation of all providers, with columns that some lack as NULL."""
    parts = [getattr(c, relation).withColumn("provider", F.lit(name)) for name, c in corpora.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def resolved_examples(examples: DataFrame, languoids: DataFrame, names: DataFrame) -> DataFrame:
    """Examples with clean translations, the code of their language, and the comment as a last resort for it."""
    parts = T.translation_parts(F.col("translation"), F.col("comment"))
    rows = examples.withColumn("_p", parts).withColumns({"translation": F.col("_p.translation"), "comment": F.col("_p.comment"), "corpus_ref": F.col("_p.corpus_ref")}).drop("_p")
    return languages.comment_as_language(languages.resolve(rows, languoids, names, "language"), names)


def merged_bibliography(corpora: dict[str, Corpus]) -> DataFrame:
    """Cited references of all providers merged into one bibliography."""
    cited = []
    for name, c in corpora.items():
        refs = references.last_wins(c.references.select("pub_id", "sid", "genre", "fields", "ord"), ["pub_id", "sid"])
        cited.append(references.cited_references(refs, c.citations, ["pub_id", "sid"]).withColumn("provider", F.lit(name)))
    rows = reduce(DataFrame.unionByName, cited)
    ids = rows.select(F.concat_ws(":", "pub_id", "sid").alias("citekey"), "genre", F.map_concat(
        F.map_filter("fields", lambda k, _: k != "isreferencedby"), F.create_map(F.lit("isreferencedby"), F.col("pub_id"))).alias("fields"),
        F.struct("provider", F.regexp_extract("pub_id", "([0-9]+)$", 1).cast("long").alias("number"), "pub_id", "ord", "sid").alias("ord"))  # provider by provider, in order of files
    return references.merge_bibliography(bibliographies.merge_input(ids), bib.similar_titles())
