"""Command line: python -m scholium.cli COMMAND PROVIDER ROOT [PUBLICATION]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scholium import sinks
from scholium.functions import bib
from scholium.operators import references
from scholium.plans import corpus
from scholium.session import ship


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="scholium")
    commands = out.add_subparsers(dest="command", required=True)
    for name, text in (("bib", "references that a publication cites"), ("igt", "its glossed examples"), ("mergedbib", "one bibliography of all publications")):
        command = commands.add_parser(name, help=text)
        command.add_argument("provider", choices=sorted(corpus.PROVIDERS))
        command.add_argument("root")
        if name != "mergedbib":
            command.add_argument("publication")
        if name == "bib":
            command.add_argument("--bibtex", action="store_true")
        if name == "mergedbib":
            command.add_argument("--drop-until", type=int)
            command.add_argument("--out")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("scholium").getOrCreate()
    ship(spark)
    loaded = corpus.load(spark, **{given.provider: given.root})
    own = loaded[given.provider]
    if given.command == "mergedbib":
        if given.drop_until is not None:
            late = F.regexp_extract("pub_id", "([0-9]+)$", 1).cast("long") >= given.drop_until
            own.references, own.citations = own.references.where(late), own.citations.where(late)
        merged = corpus.merged_bibliography(loaded).cache()
        if references.duplicate_keys(merged).take(1):
            raise RuntimeError("merged keys repeat")
        if given.out:
            print(sinks.write_bibliography(merged, given.out))
        else:
            for row in merged.orderBy("key").select(bib.as_bibtex(F.col("key"), F.col("genre"), F.col("fields")).alias("t")).toLocalIterator():
                print(row["t"], end="\n\n")
        merged.unpersist()
        return 0
    name = given.provider + given.publication
    if given.command == "bib":
        cited = references.cited_references(own.references, own.citations, ["pub_id", "sid"]).where(F.col("pub_id") == name).orderBy("ord")
        shown = bib.as_bibtex(F.col("sid"), F.col("genre"), F.col("fields")) if given.bibtex else bib.as_citation(F.col("fields"))
        for row in cited.select(shown.alias("t")).toLocalIterator():
            print(row["t"])
        return 0
    rows = own.examples.where(F.col("pub_id") == name)
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("local_id", "id") if c not in rows.columns]).withColumnRenamed("language", "language_name")
    for row in rows.orderBy("ord").select(sinks.example_text().alias("t")).toLocalIterator():
        print(row["t"], end="\n\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
