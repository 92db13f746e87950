"""Datasets of tables described by CSVW metadata: read by property, joined to sources and languages."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators import references as R
from scholium.sources import bibliographies
from scholium.sources.articles import Corpus
from scholium.sources.files import decode_udf, read_files

DROPPED_FIELDS = ("abstract", "file", "keywords", "langref", "cfn", "owner", "hhtype", "inlg", "lgcode", "macro_area", "src")


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The metadata object, read by Spark so that any store will do."""
    rows = spark.read.format("binaryFile").load(path).select(decode_udf("content").alias("text")).limit(1).collect()
    if not rows:
        raise FileNotFoundError(path)
    return json.loads(rows[0]["text"])


def read_table(spark: SparkSession, folder: str, metadata: dict, table: str) -> DataFrame | None:
    """A table by its file or its type's last part, columns named by their properties; lists are arrays. None if it isn't declared."""
    spec = next((t for t in metadata.get("tables", []) if t.get("url") == table or t.get("dc:conformsTo", "").endswith("#" + table)), None)
    if spec is None:
        return None
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder.rstrip('/')}/{spec['url']}")
    out = []
    for c in spec["tableSchema"]["columns"]:
        name = c["name"]
        if name not in rows.columns:
            continue
        column = F.col(f"`{name}`")
        if sep := c.get("separator"):
            column = F.filter(F.split(F.coalesce(column, F.lit("")), "\\Q" + sep + "\\E"), lambda x: x != "")
        elif c.get("datatype") in ("decimal", "float", "number") or isinstance(c.get("datatype"), dict) and c["datatype"].get("base") == "decimal":
            column = column.cast("double")
        out.append(column.alias(c.get("propertyUrl", name).rpartition("#")[2]))
    return rows.select(*out)


def sources_with_codes(sources: DataFrame, languages: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """sources (sid, genre, fields) with the field lgcode: codes of the languages that cite them, in order.

    languages: (id, languageCode, source array); with values (languageReference, source
    array) the citations are those of the values instead.
    """
    if values is None:
        links = languages.select("languageCode", F.explode("source").alias("cited"))
    else:
        codes = languages.select(F.col("id").alias("_l"), "languageCode").where("languageCode is not null")
        links = values.select("languageReference", F.explode("source").alias("cited")).join(codes, F.col("languageReference") == F.col("_l"))
    codes = R.language_codes(links.select(F.regexp_replace(F.trim("cited"), r"\[.*$", "").alias("_sid"), "languageCode"), "_sid", "languageCode")
    joined = sources.join(codes, sources["sid"] == codes["_sid"], "left")
    kept = F.map_filter("fields", lambda k, _: ~k.isin(*DROPPED_FIELDS))
    coded = F.when(F.col("lgcode").isNotNull(), F.map_concat(kept, F.create_map(F.lit("lgcode"), F.col("lgcode")))).otherwise(kept)
    return joined.select(*[coded.alias("fields") if c == "fields" else F.col(c) for c in sources.columns])


def examples(table: DataFrame, languages: DataFrame) -> DataFrame:
    """Examples with text and analysis, numbered as they stand in the table, with code and name of their language.

    table: (ord, id, languageReference, primaryText, analyzedWord, gloss, translatedText).
    A language that the dataset doesn't have is an error, when the rows are read.
    """
    kept = table.where((F.coalesce("primaryText", F.lit("")) != "") & (F.size("analyzedWord") > 0))
    named = languages.select(F.col("id").alias("_l"), F.col("languageCode").alias("language_id"), F.col("name").alias("language_name"))
    joined = kept.join(named, kept["languageReference"] == named["_l"], "left")
    unknown = F.raise_error(F.concat(F.lit("an example has an unknown language: "), F.coalesce("languageReference", F.lit("none"))))
    return joined.withColumn("language_name", F.when(F.col("_l").isNotNull(), F.col("language_name")).otherwise(unknown)).drop("_l")


FLAGS = ("id", "name", "conceptdoi", "source_to_language", "hhtype", "bib", "igt", "gloss_abbreviations")


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(ord, id, name, ...) of the datasets that catalog.csv lists, in its order."""
    rows = spark.read.option("header", True).csv(f"{root.rstrip('/')}/catalog.csv")
    rows = rows.select(F.monotonically_increasing_id().alias("ord"), *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in FLAGS])
    return rows.where("name is not null")


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """(name, doi, license, creators, title, year, version) from the JSON file of each dataset; creators are joined."""
    files = read_files(spark, root, "*.json").where(~F.col("name").rlike("-metadata.json$"))
    here = F.regexp_replace("path", "^file:/*", "/").alias("path")
    top = "/" + root.removeprefix("file:").strip("/") if "://" not in root else root.rstrip("/")
    schema = "doi string, license string, creators array<string>, title string, year string, version string"
    rows = files.select(here, F.regexp_replace("name", r"\.json$", "").alias("name"), decode_udf("content").alias("text")).where(F.col("path") == F.concat(F.lit(top + "/"), "name", F.lit(".json")))
    return rows.select("name", F.from_json("text", schema).alias("r")).select("name", "r.*").withColumn("creators", F.array_join("creators", " & "))


def publications(spark: SparkSession, root: str) -> DataFrame:
    """Each dataset of the catalogue with its metadata."""
    return read_catalog(spark, root).join(read_records(spark, root), "name").withColumn("pub_id", F.col("id"))


def _table(spark: SparkSession, folder: str, metadata: dict, table: str, schema: str) -> DataFrame:
    """A table with the columns of schema, NULL where it lacks them, and no rows where it is absent."""
    found = read_table(spark, folder, metadata, table)
    if found is None:
        return spark.createDataFrame([], schema)
    wanted = spark.createDataFrame([], schema).schema
    return found.select(*[(F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def read_dataset(spark: SparkSession, folder: str, row: dict) -> Corpus:
    """The relations of one dataset; row says of it what the catalogue does."""
    names = read_files(spark, folder, "*-metadata.json").select("path").orderBy("path").limit(1).collect()
    if not names:
        raise FileNotFoundError(f"no metadata in {folder}")
    path = names[0]["path"]
    folder, metadata = path.rpartition("/")[0], read_metadata(spark, path)
    pub = F.lit(row["id"]).alias("pub_id")
    languages = _table(spark, folder, metadata, "LanguageTable", "id string, languageCode string, name string, source array<string>")
    refs = bibliographies.read_bibtex(spark, folder).select(F.col("key").alias("sid"), "genre", "fields", "ord", "alt_keys")
    if not row["bib"]:
        refs = refs.limit(0)
    by = row["source_to_language"]
    values = _table(spark, folder, metadata, "ValueTable", "languageReference string, source array<string>") if by == "ValueTable" else None
    if by in ("LanguageTable", "ValueTable"):
        refs = sources_with_codes(refs, languages, values)
    if row["hhtype"]:
        refs = refs.withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, _: k != "hhtype"), F.create_map(F.lit("hhtype"), F.lit(row["hhtype"]))))
    schema = "id string, languageReference string, primaryText string, analyzedWord array<string>, gloss array<string>, translatedText string, comment string"
    table = _table(spark, folder, metadata, "ExampleTable", schema).withColumn("ord", F.monotonically_increasing_id())
    if not row["igt"]:
        table = table.limit(0)
    none = F.array().cast("array<struct<sid:string,pages:string>>")
    shown = examples(table, languages).select(
        pub, "ord", F.col("id").alias("local_id"), F.col("primaryText").alias("primary_text"), F.col("analyzedWord").alias("words"), "gloss",
        F.coalesce("translatedText", F.lit("")).alias("translation"), "language_id", F.col("language_name").alias("language"), "comment", none.alias("sources"))
    short = spark.createDataFrame([], "abbr string, definition string")
    if row["gloss_abbreviations"]:
        name, abbr, meaning = row["gloss_abbreviations"].split()
        found = spark.read.option("header", True).csv(f"{folder}/{name}")
        short = found.select(F.col(abbr).alias("abbr"), F.col(meaning).alias("definition"))
    refs = refs.select(pub, "*")
    return Corpus(spark.createDataFrame([(row["id"],)], "pub_id string"), refs, refs.select("pub_id", "sid"), shown, short.select(pub, "*"))


def read_datasets(spark: SparkSession, root: str) -> Corpus:
    """All datasets of a catalogue, each in the folder of its name; every source counts as cited.

    The catalogue is a short list that the driver walks; the tables are read by Spark.
    """
    listed = publications(spark, root)
    parts = [read_dataset(spark, f"{root.rstrip('/')}/{r['name']}", r.asDict()) for r in listed.orderBy("ord").collect()]
    if not parts:
        raise ValueError(f"{root} lists no datasets")
    joined = {n: reduce(lambda a, b: a.unionByName(b), [getattr(p, n) for p in parts]) for n in ("references", "citations", "examples", "abbreviations")}
    return Corpus(listed.drop("ord", "id"), **joined)


def new_versions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, version) of datasets that are absent locally or have another version."""
    return R.changed_files(remote, local, "id", "version")
