r"""Books as TeX projects: main files, included files, citations, examples and abbreviations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from scholium.functions import align, tex
from scholium.operators import examples as E
from scholium.operators import references as R
from scholium.sources.files import decode_udf, exploded, read_files

_EXAMPLE = ("id string, primary_text string, words array<string>, gloss array<string>, translation string, language string, comment string, "
            "sources array<struct<sid:string,pages:string>>")


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(pub_id, path, name, text) of the TeX files and Makefiles of books, one folder each below root."""
    files = read_files(spark, root, "{*.tex,Makefile}")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(re.sub("^file:/*", "/", root).rstrip("/")) + "/", "")
    return files.select(
        F.element_at(F.split(relative, "/"), 1).alias("pub_id"), F.array_join(F.slice(F.split(relative, "/"), 2, 1000), "/").alias("path"), "name", decode_udf("content").alias("text"))


def main_files(texts: DataFrame) -> DataFrame:
    """(pub_id, path) of each book's main file.

    In this order: the one a Makefile compiles, main.tex or book.tex at the top, the same
    in the only folder, a file with a document class at the top, and one anywhere.
    """
    depth = F.size(F.split("path", "/")) - 1
    made = texts.where("name = 'Makefile'").select(
        "pub_id", F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^\s*xelatex[^\n]*?([\w.-]+?)(?:\.tex)?\s*$", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"([\w-]+)\.pdf", 1), F.lit(""))).alias("made"))
    ranked = texts.where("name like '%.tex'").join(made.groupBy("pub_id").agg(F.max("made").alias("made")), "pub_id", "left").withColumn(
        "prio",
        F.when(F.coalesce(F.col("name") == F.concat("made", F.lit(".tex")), F.lit(False)) & (depth == 0), 0)
        .when(F.col("name").isin("main.tex", "book.tex") & (depth == 0), 1)
        .when(F.col("name").isin("main.tex", "book.tex") & (depth == 1), 2)
        .when(F.col("text").rlike(r"(?m)^\s*\\documentclass") & (depth == 0), 3)
        .when(F.col("text").rlike(r"(?m)^\s*\\documentclass"), 4),
    ).where("prio is not null")
    return ranked.groupBy("pub_id").agg(F.min_by("path", F.struct("prio", "path")).alias("path"))


@F.pandas_udf(StringType())
def rewritten_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else tex.rewritten(t))


def chosen_bibliographies(texts: DataFrame, mains: DataFrame, entries: DataFrame) -> DataFrame:
    """entries (pub_id, path, ord, ...) of the BibTeX file that a book has, or those its main file names if it has several.

    ord counts on through a book's files, taken in order of their names.
    """
    name = F.substring_index("path", "/", -1)
    sole = entries.groupBy("pub_id").agg((F.count_distinct("path") == 1).alias("_sole"))
    named = bibliography_names(texts.join(mains, ["pub_id", "path"], "left_semi")).select("pub_id", F.substring_index("bib", "/", -1).alias("_bib")).distinct()
    kept = entries.join(sole, "pub_id").join(named, (entries["pub_id"] == named["pub_id"]) & (name == F.col("_bib")), "left")
    kept = kept.where(F.col("_sole") | F.col("_bib").isNotNull()).select(*[entries[c] for c in entries.columns])
    sizes = kept.groupBy("pub_id", "path").agg((F.max("ord") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("pub_id").orderBy(F.substring_index("path", "/", -1), "path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return kept.join(sizes.select("pub_id", "path", before.alias("_before")), ["pub_id", "path"]).withColumn("ord", F.col("ord") + F.col("_before")).drop("_before").select(*entries.columns)


def included(texts: DataFrame, mains: DataFrame) -> DataFrame:
    """(pub_id, path, name, text, file_ord): files that a main file includes, in order, then those that theirs do not name.

    Names match whatever their case, with or without folder and suffix.
    """
    commands = F.regexp_extract_all(F.col("text"), F.lit(r"(?m)^[^%\n]*?\\(?:include|input|includechapter|includepaper)\{([^}]+)\}"), 1)
    wanted = texts.join(mains, ["pub_id", "path"]).select("pub_id", F.posexplode(commands).alias("file_ord", "wanted"))
    base = lambda c: F.lower(F.regexp_replace(F.substring_index(F.trim(c), "/", -1), r"(?i)\.tex$", ""))
    found = wanted.select("pub_id", "file_ord", base(F.col("wanted")).alias("base"))
    files = texts.where("name like '%.tex'").withColumn("base", base(F.col("path")))
    return files.join(found, ["pub_id", "base"]).groupBy("pub_id", "path").agg(F.first("name").alias("name"), F.first("text").alias("text"), F.min("file_ord").alias("file_ord"))


def citing(texts: DataFrame, mains: DataFrame, files: DataFrame) -> DataFrame:
    """(pub_id, path, text): included files, the main file and backmatter.tex beside it, each once."""
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    main = texts.join(mains, ["pub_id", "path"], "left_semi")
    places = mains.select("pub_id", F.concat(folder(F.col("path")), F.lit("backmatter.tex")).alias("path"))
    more = main.union(texts.join(places, ["pub_id", "path"], "left_semi"))
    return files.select("pub_id", "path", "text").union(more.select("pub_id", "path", "text")).dropDuplicates(["pub_id", "path"])


def _citations(text: str) -> list[tuple]:
    return [(k.replace("–", "--").lower(),) for k in tex.citation_keys("\n".join(map(tex.strip_comment, text.split("\n"))))]


def _examples(text: str) -> list[tuple]:
    out = []
    for raw in align.scan(text):
        x = align.make_example(raw)
        if x:
            out.append((x.id, x.primary_text, x.words, x.gloss, x.translation, x.language, x.comment, x.sources))
    return out


def citations(files: DataFrame) -> DataFrame:
    """(pub_id, path, ord, key): every citation of a file."""
    return exploded(files, _citations, "key string", ["pub_id", "path"])


def examples(files: DataFrame) -> DataFrame:
    """Examples of the files, each id once in a book: the first in order of files and lines."""
    rows = exploded(files, _examples, _EXAMPLE, ["pub_id", "path", "file_ord"])
    return R.first_wins(rows, ["pub_id", "id"], ["file_ord", "ord"])


def gloss_abbreviations(files: DataFrame) -> DataFrame:
    """(pub_id, path, abbr, definition): of a file's section of that name; path is NULL where it holds for the book."""
    section = F.regexp_extract("text", r"(?s)\\(?:sub)?section\*?\{Abbreviations[^}]*\}(.*?)(?=\\(?:sub)?section|\z)", 1)
    whole = F.col("name") == "abbreviations.tex"
    rows = files.select("pub_id", F.when(~whole, F.col("path")).alias("path"), F.when(whole, F.col("text")).otherwise(section).alias("text")).where("text != ''")
    return E.abbreviations(rows, ["pub_id", "path"])


def bibliography_names(mains: DataFrame) -> DataFrame:
    """(pub_id, ord, bib): the BibTeX files that a main file names."""
    named = F.regexp_extract_all(F.col("text"), F.lit(r"\\(?:bibliography|addbibresource)\{([^}]+)\}"), 1)
    rows = mains.select("pub_id", F.posexplode(F.split(F.array_join(named, ","), ",")).alias("ord", "bib")).where("trim(bib) != ''")
    return rows.withColumn("bib", F.concat(F.regexp_replace(F.trim("bib"), r"\.bib$", ""), F.lit(".bib")))


def inlined(texts: DataFrame, but: DataFrame | None = None) -> DataFrame:
    r"""texts with files that a line starts to \input put in its place, one level deep; missing ones leave nothing.

    Files of ``but`` (pub_id, path), as main files, keep their lines: what they include are files of their own.
    """
    if but is not None:
        kept = texts.join(but, ["pub_id", "path"], "left_semi").select("pub_id", "path", "name", "text")
        return kept.union(_inlined(texts.join(but, ["pub_id", "path"], "left_anti"), texts))
    return _inlined(texts, texts)


def _inlined(some: DataFrame, texts: DataFrame) -> DataFrame:
    lines = some.select("pub_id", "path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    name = F.regexp_extract("line", r"^\s*\\(?:input|include)\{([^}]+)\}", 1)
    wanted = lines.withColumn("base", F.lower(F.regexp_replace(F.substring_index(name, "/", -1), r"\.tex$", "")))
    files = texts.select("pub_id", F.lower(F.regexp_replace(F.substring_index("path", "/", -1), r"\.tex$", "")).alias("base"), F.col("text").alias("other"))
    files = files.groupBy("pub_id", "base").agg(F.max("other").alias("other"))
    shown = F.when(F.col("base") == "", F.col("line")).otherwise(F.coalesce("other", F.lit("")))
    out = wanted.join(files, ["pub_id", "base"], "left").select("pub_id", "path", "n", shown.alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return out.groupBy("pub_id", "path").agg(joined.alias("text")).withColumn("name", F.substring_index("path", "/", -1)).select("pub_id", "path", "name", "text")
