"""Relations between publications, their references and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholium.session import dealt


def cited_references(references: DataFrame, citations: DataFrame, on: list[str]) -> DataFrame:
    """References that are cited at least once."""
    return references.join(citations.select(*on).distinct(), on, "left_semi")


def citation_counts(cites: DataFrame, publication: str = "pub_id", source: str = "sid") -> DataFrame:
    """(publication, source, n)"""
    return cites.groupBy(publication, source).agg(F.count("*").alias("n"))


def last_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """One row for each key: the values of the last, at the place of the first.

    max_by sums up before the shuffle, which a window wouldn't.
    """
    rest = [c for c in rows.columns if c not in (*keys, order)]
    latest = F.max_by(F.struct(*rest), order).alias("_row")
    return rows.groupBy(*keys).agg(latest, F.min(order).alias(order)).select(*keys, *[f"_row.{c}" for c in rest], order)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, with all its columns."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first).select("_row.*")


def alias_table(sources: DataFrame) -> DataFrame:
    """(pub_id, alias, sid) from (pub_id, sid, alt_keys, ord): of clashing aliases the last source's counts.

    A source's own id comes before its other keys.
    """
    every = sources.select(
        "pub_id", "sid", "ord",
        F.posexplode(F.concat(F.array("sid"), F.coalesce("alt_keys", F.array().cast("array<string>")))).alias("n", "alias"),
    )
    return every.groupBy("pub_id", "alias").agg(F.max_by("sid", F.struct("ord", "n")).alias("sid"))


def resolve_citations(cites: DataFrame, sources: DataFrame, key: str = "key") -> DataFrame:
    """cites (pub_id, key, ...) with the sid that key stands for; keys of no source are dropped."""
    table = alias_table(sources)
    return cites.join(table, [cites["pub_id"] == table["pub_id"], cites[key] == table["alias"]]).select(
        *[cites[c] for c in cites.columns], table["sid"]
    )


def language_codes(links: DataFrame, source: str, code: str) -> DataFrame:
    """(source, lgcode): the distinct codes of each source in order, as '[a]; [b]'."""
    codes = F.transform(F.sort_array(F.collect_set(code)), lambda c: F.concat(F.lit("["), c, F.lit("]")))
    return links.where(F.col(code).isNotNull()).groupBy(source).agg(F.array_join(codes, "; ").alias("lgcode"))


def inherit_crossrefs(entries: DataFrame, key: str = "key", fields: str = "fields") -> DataFrame:
    """Entries with the fields of the entry that their field crossref names, where they lack their own."""
    parents = entries.select(F.col(key).alias("_parent"), F.col(fields).alias("_fields"))
    joined = entries.join(parents, F.element_at(fields, F.lit("crossref")) == F.col("_parent"), "left")
    extra = F.map_filter(F.coalesce("_fields", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(fields, k))
    return joined.withColumn(fields, F.map_concat(fields, extra)).drop("_parent", "_fields")


def duplicate_keys(merged: DataFrame, key: str = "key") -> DataFrame:
    """Keys that occur more than once; a sound merge has none."""
    return merged.groupBy(key).count().where("count > 1")


def changed_files(remote: DataFrame, local: DataFrame, on: str = "path", mark: str = "size") -> DataFrame:
    """Remote rows that are absent locally or differ in ``mark``."""
    here = local.select(F.col(on).alias("_on"), F.col(mark).alias("_mark"))
    joined = remote.join(here, remote[on] == here["_on"], "left")
    return joined.where(F.col("_on").isNull() | ~F.col(mark).eqNullSafe(F.col("_mark"))).drop("_on", "_mark")


MERGE_THRESHOLD = 92


def merge_bibliography(entries: DataFrame, similar) -> DataFrame:
    """(key, genre, fields, citekeys) from (key, citekey, genre, fields, title, title_slug, year, author_slug, ord).

    key is the generated citation key that entries are gathered by. Entries that agree in
    title, year and author slugs are one block, which goes by the key of its first entry. Blocks of a key are taken in order of these
    three; one joins the batch before it if year and author are those of the last block
    with a title and a year or author, and ``similar`` (a function of two title columns)
    holds for the titles. Entries with neither stay alone. Batches get suffixes if a key
    has several. Order is explicit throughout, so partitioning never changes a result.
    """
    told = (F.col("title") != "") & ((F.col("year") != "") | (F.col("author_slug") != ""))
    rows = entries.withColumn("_told", told)
    block = F.when(~F.col("_told"), F.xxhash64("ord")).otherwise(F.lit(-1))
    blocks = rows.groupBy("title_slug", "year", "author_slug", block.alias("_alone")).agg(
        F.min_by("key", "ord").alias("key"), F.min_by("title", "ord").alias("title"), F.first("_told").alias("_told"), F.min("ord").alias("_ord")
    )
    order = W.partitionBy("key").orderBy("title_slug", "year", "author_slug", "_ord")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    before = F.last(F.when(F.col("_told"), F.struct("title", "year", "author_slug")), ignorenulls=True).over(earlier)
    paired = (
        F.col("_told") & (F.col("_before.year") == F.col("year")) & (F.col("_before.author_slug") == F.col("author_slug"))
        & (F.col("_before.title") != "") & (F.col("title") != "")
    )
    # Titles are scored once, evenly over all cores; windows, of which a key is one task, only find neighbours and number rows.
    columns = ["key", "title_slug", "year", "author_slug", "_alone", "_ord"]
    neighbours = blocks.withColumn("_before", before).select(*columns, F.when(paired, F.col("_before.title")).alias("_a"), F.when(paired, F.col("title")).alias("_b"))
    linked = dealt(neighbours).select(*columns, F.coalesce(similar(F.col("_a"), F.col("_b")), F.lit(False)).alias("_joins"))
    numbered = linked.withColumn("batch", F.sum((~F.col("_joins")).cast("int")).over(order)).withColumn("_place", F.row_number().over(order))
    numbered = numbered.withColumn("_batches", F.max("batch").over(W.partitionBy("key"))).drop("_ord", "_joins")
    on = ["title_slug", "year", "author_slug", "_alone"]
    placed = rows.drop("key").withColumn("_alone", block).join(numbered, on).withColumn(
        "merged_key", F.when(F.col("_batches") > 1, F.concat_ws(":", "key", F.col("batch").cast("string"))).otherwise(F.col("key"))
    ).withColumn("_order", F.struct("_place", "ord"))
    return fold_fields(placed)


#: Fields whose values are gathered instead of the longest one kept, and the creators, which the first entry gives.
GATHERED, FIRST_ONLY = {"isreferencedby": " ", "lgcode": "; "}, ("author", "editor")


def fold_fields(placed: DataFrame) -> DataFrame:
    """Merges entries of one merged_key in _order: longest value wins, of equally long ones the first."""
    heads = placed.groupBy("merged_key").agg(
        F.min_by("genre", "_order").alias("genre"),
        F.min_by("fields", "_order").alias("_first"),
        F.sort_array(F.collect_set("citekey")).alias("citekeys"),
    )
    values = placed.select("merged_key", "_order", F.explode("fields").alias("field", "value")).where(
        (F.trim("value") != "") & ~F.col("field").isin(*FIRST_ONLY)
    )
    ordered = F.sort_array(F.collect_list(F.struct("_order", "value")))
    gathered = values.where(F.col("field").isin(*GATHERED)).groupBy("merged_key", "field").agg(
        F.array_join(F.transform(ordered, lambda x: x["value"]), "\u0000").alias("value")
    )
    joined = gathered.withColumn(
        "value", F.when(F.col("field") == "lgcode", F.replace("value", F.lit("\u0000"), F.lit("; "))).otherwise(F.replace("value", F.lit("\u0000"), F.lit(" ")))
    )
    longest = values.where(~F.col("field").isin(*GATHERED)).groupBy("merged_key", "field").agg(
        # The least by (-length, order): longest first, then earliest.
        F.min_by("value", F.struct(-F.length("value"), "_order")).alias("value")
    )
    plain = F.when(F.col("field").isin("title", "booktitle"), F.regexp_replace("value", r"(?U)\{(\w)\}", "$1")).otherwise(F.col("value"))
    maps = longest.withColumn("value", plain).unionByName(joined).groupBy("merged_key").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("_fields")
    )
    creators = F.map_filter("_first", lambda k, v: k.isin(*FIRST_ONLY) & (F.trim(v) != ""))
    return heads.join(maps, "merged_key", "left").select(
        F.col("merged_key").alias("key"), "genre",
        F.map_concat(creators, F.coalesce("_fields", F.create_map().cast("map<string,string>"))).alias("fields"), "citekeys",
    )


#: Parts of paths whose files are no sources of text: archives, settings, figures, what programs have made.
NOT_FETCHED = tuple("__MACOSX .texpadtmp biblatex-sp-unified bibstyles.deprecated bibstyles/ draftinfo.tex Figures/ figures/ generated/ graphics/ -hyphenation /locale pdf/ seriesinfo styles/tcb".split())


def fetchable(tree: DataFrame, excluded: tuple[str, ...] = NOT_FETCHED) -> DataFrame:
    """Rows (path, type, ...) of a file tree that are TeX or BibTeX sources or Makefiles outside excluded places."""
    path = F.col("path")
    wanted = path.rlike(r"\.(bib|tex)$") | (F.substring_index(path, "/", -1) == "Makefile")
    rows = tree.where(~F.col("type").isin("tree", "commit") & wanted)
    for part in excluded:
        rows = rows.where(~path.contains(part))
    return rows


def example_sources(examples: DataFrame, sources: DataFrame) -> DataFrame:
    """(pub_id, example, ord, sid, pages, genre, fields): the entries that examples cite, but not their own publication.

    sources hold the publications themselves too. An unknown source gives NULL fields,
    for missing_sources() to report.
    """
    cited = examples.select("pub_id", F.col("id").alias("example"), F.posexplode("sources").alias("ord", "s")).select("pub_id", "example", "ord", "s.sid", "s.pages")
    known = sources.select(F.col("sid").alias("_sid"), "genre", "fields")
    return cited.where(F.col("sid") != F.col("pub_id")).join(known, F.col("sid") == F.col("_sid"), "left").drop("_sid")


def resolve_example_sources(examples: DataFrame, sources: DataFrame) -> DataFrame:
    """examples (pub_id, id, sources, ...) whose cited keys are replaced by those of their publication's sources.

    Keys that no source has go, the others keep their order; examples without any stay.
    """
    cited = examples.select("pub_id", "id", F.posexplode("sources").alias("n", "s")).withColumn("key", F.lower(F.replace("s.sid", F.lit("–"), F.lit("--"))))
    known = resolve_citations(cited, sources)
    lists = known.groupBy("pub_id", "id").agg(F.sort_array(F.collect_list(F.struct("n", "sid", F.col("s.pages").alias("pages")))).alias("_found"))
    lists = lists.select(F.col("pub_id").alias("_p"), F.col("id").alias("_i"), F.transform("_found", lambda x: F.struct(x["sid"], x["pages"])).alias("_found"))
    joined = examples.join(lists, (F.col("pub_id") == F.col("_p")) & (F.col("id") == F.col("_i")), "left")
    none = F.array().cast(examples.schema["sources"].dataType)
    return joined.withColumn("sources", F.coalesce(F.col("_found").cast(examples.schema["sources"].dataType), none)).drop("_p", "_i", "_found")


def example_counts(examples: DataFrame) -> DataFrame:
    """(pub_id, n_examples)"""
    return examples.groupBy("pub_id").agg(F.count("*").alias("n_examples"))


def missing_sources(cited: DataFrame) -> DataFrame:
    """Rows of example_sources() whose source is unknown; there should be none."""
    return cited.where(F.col("fields").isNull())


def abbreviations_for(examples: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """examples (pub_id, path, ...) with ``abbreviations``: those of their file if it has any, else of the book, else none."""
    maps = abbreviations.groupBy("pub_id", "path").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("abbr", "definition")))).alias("_map"))
    own = maps.where("path is not null").select(F.col("pub_id").alias("_p"), F.col("path").alias("_f"), F.col("_map").alias("_own"))
    book = maps.where("path is null").select(F.col("pub_id").alias("_b"), F.col("_map").alias("_book"))
    none = F.create_map().cast("map<string,string>")
    return (
        examples.join(own, [examples["pub_id"] == F.col("_p"), examples["path"] == F.col("_f")], "left")
        .join(book, examples["pub_id"] == F.col("_b"), "left")
        .withColumn("abbreviations", F.coalesce("_own", "_book", none))
        .drop("_p", "_f", "_own", "_b", "_book")
    )
