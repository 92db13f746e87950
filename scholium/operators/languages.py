"""Resolving language names and codes against a catalogue of languoids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def name_table(languoids: DataFrame, aliases: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """(name, code): custom names first, then primary names, of which the last counts, then aliases, of which the first does.

    languoids: (code, name, ord); aliases: (code, name, ord); custom: (name, code). An
    alias ends at its first [.
    """
    every = languoids.select("name", "code", F.lit(1).alias("kind"), (-F.col("ord")).alias("rank")).unionByName(
        aliases.select(F.trim(F.substring_index("name", "[", 1)).alias("name"), "code", F.lit(2).alias("kind"), F.col("ord").alias("rank"))
    )
    if custom is not None:
        every = every.unionByName(custom.select("name", "code", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("rank")))
    return every.where("name is not null and name != ''").groupBy("name").agg(F.min_by("code", F.struct("kind", "rank", "code")).alias("code"))


def resolve(rows: DataFrame, languoids: DataFrame, names: DataFrame, column: str, out: str = "language_id") -> DataFrame:
    """rows with the code that a column means: a code itself, else an ISO code, else a name; NULL if none."""
    codes = languoids.select(F.col("code").alias("_by_code")).where("_by_code is not null").distinct()
    iso = languoids.where("iso is not null").groupBy(F.col("iso").alias("_iso")).agg(F.max_by("code", "ord").alias("_by_iso"))
    named = names.select(F.col("name").alias("_name"), F.col("code").alias("_by_name"))
    value = rows[column]
    return (
        rows.join(codes, value == F.col("_by_code"), "left")
        .join(iso, value == F.col("_iso"), "left")
        .join(named, value == F.col("_name"), "left")
        .withColumn(out, F.coalesce("_by_code", "_by_iso", "_by_name"))
        .drop("_by_code", "_iso", "_by_iso", "_name", "_by_name")
    )


def comment_as_language(rows: DataFrame, names: DataFrame, comment: str = "comment", out: str = "language_id") -> DataFrame:
    """Where no language is known and the whole comment is a known name, it is the language and no comment."""
    named = names.select(F.col("name").alias("_name"), F.col("code").alias("_code"))
    used = F.col(out).isNull() & F.col("_code").isNotNull()
    return (
        rows.join(named, rows[comment] == F.col("_name"), "left")
        .withColumn(comment, F.when(~used, F.col(comment)))
        .withColumn(out, F.coalesce(out, "_code"))
        .drop("_name", "_code")
    )


def by_range(rows: DataFrame, ranges: DataFrame, number: str, on: str | None = None) -> DataFrame:
    """rows with the code of the first declared range (lo, hi, code, ord) that holds their number.

    ranges belong to the same ``on`` if given. Ranges are exploded to their numbers, so
    that a hash join finds them; they span a few thousand numbers at most.
    """
    keys = [on] if on else []
    points = ranges.select(*keys, "code", "ord", F.explode(F.sequence("lo", "hi")).alias("_n"))
    first = points.groupBy(*keys, "_n").agg(F.min_by("code", "ord").alias("code"))
    first = first.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = [rows[number] == first["_n"], *[rows[k] == first[f"_{k}"] for k in keys]]
    return rows.join(first, condition, "left").drop("_n", *[f"_{k}" for k in keys])


def language_specs(rows: DataFrame, spec: str = "spec", on: str = "id") -> DataFrame:
    """(on, code, lo, hi, ord) of specifications like 'abcd1234:1-20, efgh5678:-40'; a code alone holds for all numbers.

    Without bounds a range starts at 0 and ends at 1000; a code that isn't one is an error, when the rows are read.
    """
    parts = rows.where(F.trim(F.coalesce(spec, F.lit(""))) != "").select(F.col(on), F.posexplode(F.split(spec, ",")).alias("ord", "part"))
    code, span = F.trim(F.substring_index("part", ":", 1)), F.when(F.contains("part", F.lit(":")), F.substring_index("part", ":", -1)).otherwise("")
    low, high = F.trim(F.substring_index(span, "-", 1)), F.when(F.contains(span, F.lit("-")), F.trim(F.substring_index(span, "-", -1))).otherwise("")
    checked = F.when(code.rlike("^[a-z0-9]{4}[0-9]{4}$"), code).otherwise(F.raise_error(F.concat(F.lit("no language code: "), code)))
    bound = lambda x, other: F.coalesce(F.nullif(x, F.lit("")).cast("int"), F.lit(other))
    return parts.select(on, checked.alias("code"), bound(low, 0).alias("lo"), bound(high, 1000).alias("hi"), "ord")


def default_language(examples: DataFrame, overrides: DataFrame, publications: DataFrame) -> DataFrame:
    """examples (pub_id, path, language_name) completed by a file's, else by the publication's object language."""
    files = overrides.select(F.col("pub_id").alias("_p"), F.col("path").alias("_f"), F.col("language").alias("_file"))
    books = publications.select(F.col("pub_id").alias("_b"), F.col("objectlanguage").alias("_book"))
    return (
        examples.join(files, [examples["pub_id"] == F.col("_p"), examples["path"] == F.col("_f")], "left")
        .join(books, examples["pub_id"] == F.col("_b"), "left")
        .withColumn("language_name", F.coalesce("language_name", "_file", "_book"))
        .drop("_p", "_f", "_file", "_b", "_book")
    )
