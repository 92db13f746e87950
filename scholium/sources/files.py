"""Files as rows, and parsers over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scholium.session import dealt

ENTRY = "pub_id string, path string, ord long, key string, genre string, fields map<string,string>"


def read_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, name, folder, size, content) of all files below root whose names match glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(
        "path", F.substring_index("path", "/", -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("length").alias("size"), "content")


def decoded(content: bytes) -> str:
    """UTF-8, or Latin-1 where that fails."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


@F.pandas_udf(StringType())
def decode_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else decoded(bytes(b)))


def exploded(rows: DataFrame, parse: Callable[[str], list[tuple]], schema: str, keep: list[str], text: str = "text") -> DataFrame:
    """Rows of ``keep``, ord and what parse gives for each text; texts that can't be parsed give none."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep]
    names = [*keep, "ord", *[c.strip().split()[0] for c in _columns(schema)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    found = parse(row[-1] or "")
                except (ValueError, SyntaxError, KeyError, RecursionError):
                    found = []
                out += [(*row[:-1], i, *x) for i, x in enumerate(found)]
            yield pd.DataFrame(out, columns=names)

    ordered = [next(f for f in kept if f.startswith(f"`{k}`")) for k in keep]
    return dealt(rows.select(*keep, text)).mapInPandas(run, ", ".join([*ordered, "ord long", schema]))


def _columns(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def number_in(path: Column, suffix: str) -> Column:
    """The number that a file is named by, or NULL."""
    return F.nullif(F.regexp_extract(path, rf"([0-9]+)\.{suffix}$", 1), F.lit("")).cast("long")
