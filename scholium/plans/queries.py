"""Queries that run each operator on the test tables, whose columns stand in for bibliographic data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions import bib
from scholium.functions import text as T
from scholium.operators import examples, languages, references

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its name, with the SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_ENTRIES = """SELECT lower(p_brand) AS key, 'c' || p_partkey AS citekey, lower(p_name) AS slug0, p_name, p_type,
  CAST(1950 + p_size AS VARCHAR) AS year, p_partkey AS ord, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS title_slug,
  regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS author_slug FROM part"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.lower("p_brand").alias("key"), F.concat(F.lit("c"), F.col("p_partkey")).alias("citekey"), F.lit("book").alias("genre"),
        F.create_map(F.lit("title"), F.col("p_name"), F.lit("note"), F.col("p_type"), F.lit("isreferencedby"), F.col("p_partkey").cast("string")).alias("fields"),
        T.norm_title(F.col("p_name")).alias("title"), T.ascii_slug(F.col("p_name")).alias("title_slug"),
        (F.lit(1950) + F.col("p_size")).cast("string").alias("year"), T.ascii_slug(F.col("p_brand")).alias("author_slug"), F.col("p_partkey").alias("ord"),
    )


@query(f"""
WITH e AS ({_ENTRIES}),
b AS (SELECT key, title_slug, year, author_slug, row_number() OVER (PARTITION BY key ORDER BY title_slug, year, author_slug) AS batch,
        count(*) OVER (PARTITION BY key) AS batches FROM (SELECT DISTINCT key, title_slug, year, author_slug FROM e)),
p AS (SELECT e.*, CASE WHEN batches > 1 THEN key || ':' || batch ELSE key END AS merged FROM e JOIN b USING (key, title_slug, year, author_slug))
SELECT merged AS key, string_agg(citekey, ' ' ORDER BY citekey) AS citekeys, arg_min(p_name, {{'l': -length(p_name), 'o': ord}}) AS title,
  arg_min(p_type, {{'l': -length(p_type), 'o': ord}}) AS note, string_agg(CAST(ord AS VARCHAR), ' ' ORDER BY ord) AS isreferencedby
FROM p GROUP BY merged""")
def merge_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography merge where titles must be equal."""
    merged = references.merge_bibliography(_entries(spark, sf_dir), lambda a, b: a == b)
    return merged.select(
        "key", F.array_join("citekeys", " ").alias("citekeys"), F.col("fields")["title"].alias("title"), F.col("fields")["note"].alias("note"),
        F.col("fields")["isreferencedby"].alias("isreferencedby"),
    )


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def cited_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cites = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return references.cited_references(refs, cites, ["o_orderkey"])


@query("SELECT l_orderkey AS pub_id, l_partkey AS sid, count(*) AS n FROM lineitem GROUP BY ALL")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.citation_counts(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pub_id"), F.col("l_partkey").alias("sid")))


@query("""
WITH every AS (
  SELECT s_nationkey AS pub_id, s_name AS sid, s_suppkey AS ord, 0 AS n, s_name AS alias FROM supplier
  UNION ALL SELECT s_nationkey, s_name, s_suppkey, 1, 'alias' || (s_suppkey % 7) FROM supplier),
t AS (SELECT pub_id, alias, arg_max(sid, {'o': ord, 'n': n}) AS sid FROM every GROUP BY ALL),
c AS (SELECT c_nationkey AS pub_id, 'alias' || (c_custkey % 9) AS key, c_custkey FROM customer)
SELECT c.pub_id, c.key, c_custkey, sid FROM c JOIN t ON c.pub_id = t.pub_id AND c.key = t.alias""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("pub_id"), F.col("s_name").alias("sid"), F.array(F.concat(F.lit("alias"), F.col("s_suppkey") % 7)).alias("alt_keys"), F.col("s_suppkey").alias("ord"))
    cites = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("pub_id"), F.concat(F.lit("alias"), F.col("c_custkey") % 9).alias("key"), "c_custkey")
    return references.resolve_citations(cites, sources)


@query("""
SELECT pub_id, arg_max(s_name, ord) AS name, min(ord) AS ord FROM (SELECT s_nationkey AS pub_id, s_name, s_suppkey AS ord FROM supplier) GROUP BY pub_id""")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pub_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    return references.last_wins(rows, ["pub_id"])


_LANGS = "(VALUES ('engl1', 'en', 'ALGERIA', 0), ('germ1', 'de', 'BRAZIL', 1), ('fren1', 'fr', 'CANADA', 2), ('span1', NULL, 'es', 3), ('span2', NULL, 'es', 4))"
_ALIASES = "(VALUES ('fren1', 'es [old]', 0), ('engl1', 'src1', 1), ('germ1', 'src1 [x]', 2), ('span1', 'src3', 3))"
_NAMES = f"""every AS (SELECT name, code, 1 AS kind, -ord AS rank FROM languoids UNION ALL SELECT trim(split_part(name, '[', 1)), code, 2, ord FROM aliases),
names AS (SELECT name, arg_min(code, {{'k': kind, 'r': rank, 'c': code}}) AS code FROM every WHERE name <> '' GROUP BY name)"""
_WITH_LANGS = f"WITH languoids(code, iso, name, ord) AS {_LANGS}, aliases(code, name, ord) AS {_ALIASES}, {_NAMES}"


def _languoids(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    languoids = spark.sql(f"SELECT * FROM {_LANGS[1:-1]} AS t(code, iso, name, ord)").withColumn("ord", F.col("ord").cast("long"))
    aliases = spark.sql(f"SELECT * FROM {_ALIASES[1:-1]} AS t(code, name, ord)").withColumn("ord", F.col("ord").cast("long"))
    return languoids, aliases


@query(_WITH_LANGS + "\nSELECT name, code FROM names")
def name_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.name_table(*_languoids(spark))


@query(_WITH_LANGS + """
SELECT d.doc_id, d.lang, coalesce(l.code, i.code, n.code) AS language_id FROM documents d
LEFT JOIN (SELECT DISTINCT code FROM languoids) l ON d.lang = l.code
LEFT JOIN (SELECT iso, arg_max(code, ord) AS code FROM languoids WHERE iso IS NOT NULL GROUP BY iso) i ON d.lang = i.iso
LEFT JOIN names n ON d.lang = n.name""")
def lang_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    languoids, aliases = _languoids(spark)
    return languages.resolve(read(spark, sf_dir, "documents").select("doc_id", "lang"), languoids, languages.name_table(languoids, aliases), "lang")


@query(_WITH_LANGS + """
SELECT doc_id, CASE WHEN n.code IS NULL OR lang = 'en' THEN source END AS comment, CASE WHEN lang = 'en' THEN 'engl1' ELSE n.code END AS language_id
FROM documents LEFT JOIN names n ON source = n.name""")
def comment_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("comment"), F.when(F.col("lang") == "en", "engl1").alias("language_id"))
    return languages.comment_as_language(rows, languages.name_table(*_languoids(spark)))


_RANGES = "('aaaa1111', 1, 20, 0), ('bbbb2222', 15, 30, 1), ('cccc3333', 28, 45, 2)"


@query(f"""
SELECT p_partkey, p_size, (SELECT arg_min(code, ord) FROM (VALUES {_RANGES}) r(code, lo, hi, ord) WHERE p_size BETWEEN lo AND hi) AS code FROM part""")
def range_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.sql(f"SELECT * FROM VALUES {_RANGES} AS t(code, lo, hi, ord)")
    return languages.by_range(read(spark, sf_dir, "part").select("p_partkey", "p_size"), ranges, "p_size")


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 10 THEN 'file language' END, n_name) AS language_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def language_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("pub_id"), F.col("c_mktsegment").alias("path"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("language_name"))
    books = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pub_id"), F.col("n_name").alias("objectlanguage"))
    files = books.where("pub_id < 10").select("pub_id", F.lit("BUILDING").alias("path"), F.lit("file language").alias("language"))
    return languages.default_language(rows, files, books).select("c_custkey", "language_name")


def _sql_clean(x: str) -> str:
    for a, b in ((r"\s+", " "), ("^ | $", ""), ("^[`‘“]", ""), ("['’”]$", ""), (r"['’”]\.$", ".")):
        x = f"regexp_replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b}', 'g')"
    return f"replace(replace({x}, '()', ''), '...', '…')"


@query(f"SELECT doc_id, {_sql_clean(chr(39) + '‘ ' + chr(39) + ' || text || ' + chr(39) + ' () ...’.' + chr(39))} AS translation FROM documents")
def clean_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_translation(F.concat(F.lit("‘ "), F.col("text"), F.lit(" () ...’."))).alias("translation"))


@query("""
SELECT p_partkey, 'x ' || p_name AS translation, CASE p_partkey % 3 WHEN 0 THEN 'c; two words' WHEN 1 THEN 'c' ELSE 'c' END AS comment,
  CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS corpus_ref FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT p_partkey, 'x ' || p_name || ' […]', 'c', NULL FROM part WHERE p_partkey % 3 = 2""")
def translation_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.when(F.col("p_partkey") % 3 == 0, "two words").when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise("…")
    parts = T.translation_parts(F.concat(F.lit("‘x "), F.col("p_name"), F.lit(" ["), inside, F.lit("]")), F.lit("c"))
    return read(spark, sf_dir, "part").select("p_partkey", parts.alias("p")).select("p_partkey", "p.*")


@query("""
SELECT p_partkey, p_partkey % 4 < 2 AS is_open, p_partkey % 4 < 2 AND p_size <> 7 AS listed FROM part""")
def open_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    license = F.element_at(F.array(*map(F.lit, ("CC-BY 4.0", "CC-BY-SA", "CC-BY-NC 4.0", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    shown = F.when(F.col("p_size") == 7, "Forthcoming").otherwise(F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", T.has_open_license(license).alias("is_open"), (T.has_open_license(license) & (shown != "Forthcoming")).alias("listed"))


@query("""
SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS slug, CAST(1000 + p_partkey % 9000 AS VARCHAR) AS year,
  p_name || ' of X' AS title, substring(sha256(replace(p_name || '.', '.', '')), 1, 10) AS example_id, p_size AS number FROM part""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey", T.ascii_slug(name).alias("slug"), T.year(F.concat(F.lit("ca. "), 1000 + F.col("p_partkey") % 9000, F.lit("/99"))).alias("year"),
        T.strip_capitalization(F.concat(name, F.lit(" of {X}"))).alias("title"), T.example_id(F.concat(name, F.lit("."))).alias("example_id"),
        T.leading_number(F.concat(F.col("p_size"), F.lit("b"))).alias("number"),
    )


@query("SELECT p_partkey, p_name || ', ' || p_brand || ' and A, ' || p_type AS author FROM part")
def creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat("p_name", F.lit(", "), "p_brand", F.lit(" & A,"), "p_type")
    return read(spark, sf_dir, "part").select("p_partkey", T.creators_as_names(given).alias("author"))


@query("SELECT source, lang, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.first_wins(read(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], ["doc_id"])


@query("""
SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (
  PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 PRECEDING AND CURRENT ROW), -1) AS carried
FROM (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY conv_id, turn)""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    lines = lines.select("conv_id", "turn", F.when(F.col("role") == "user", F.length("text").cast("long")).alias("value"))
    return examples.carry_forward(lines, ["conv_id"], "turn", "value", within=2).select("conv_id", "turn", F.coalesce("carried", F.lit(-1)).alias("carried"))


@query("""
SELECT conv_id, turn, coalesce(lag(text) OVER w, '') AS prevline, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS grp
FROM (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY conv_id, turn)
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    out = examples.groups(examples.previous_line(lines, ["conv_id"], "turn", "text"), ["conv_id"], "turn", F.col("role") == "user")
    return out.select("conv_id", "turn", "prevline", "grp")


@query(r"""
SELECT doc_id, CASE WHEN contains(t, '\\%') THEN split_part(t, '\\%', 1) || '\\' ELSE replace(regexp_extract(t, '^(?:[^%\\]|\\.)*', 0, 's'), '\%', '%') END AS line
FROM (SELECT doc_id, text || '\% x % y' AS t FROM documents)""")
def tex_comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of all documents; NULL stays."""
    return read(spark, sf_dir, "documents").select("doc_id", T.strip_tex_comment(F.concat("text", F.lit("\\% x % y"))).alias("line"))


@query("""
SELECT p_brand AS path, lower(p_type) AS abbr, arg_max(p_name, p_partkey) AS definition FROM part GROUP BY ALL""")
def abbr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", F.concat(F.lower("p_type"), F.lit(" & "), "p_name", F.lit(" \\\\")).alias("l")))), lambda x: x["l"])
    files = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path")).agg(F.array_join(lines, "\n% a & b\n").alias("text"))
    return examples.abbreviations(files, ["path"])


@query("""SELECT p_partkey, replace(p_type, ' ', ' -') AS a, p_brand || '-' || p_type AS b FROM part""")
def recombine(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_type", " ")
    dashed = F.transform(words, lambda x, i: F.when(i > 0, F.concat(F.lit("-"), x)).otherwise(x))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.replace(F.array_join(examples.recombined(dashed), " "), F.lit("-"), F.lit(" -")).alias("a"),
        F.array_join(examples.recombined(F.concat(F.array(F.concat("p_brand", F.lit("-"))), words)), " ").alias("b"))


@query("""
SELECT o_orderkey, coalesce(string_agg(l_partkey || ':' || l_linenumber, '; ' ORDER BY l_linenumber, l_partkey) || '; ', '') || o_custkey || ':' ||
  CASE WHEN count(l_partkey) > 0 THEN 'via:' || substring(o_orderpriority, 1, 1) ELSE substring(o_orderpriority, 1, 1) END AS sources
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 GROUP BY o_orderkey, o_custkey, o_orderpriority""")
def source_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    rows = read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("pub_id"), F.substring("o_orderpriority", 1, 1).alias("local_id"),
        F.transform(F.coalesce("items", F.array().cast("array<struct<l_linenumber:bigint,l_partkey:bigint>>")),
                    lambda x: F.struct(x["l_partkey"].cast("string").alias("sid"), x["l_linenumber"].cast("string").alias("pages"))).alias("sources"))
    joined = F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["sid"], x["pages"])), "; ")
    return examples.qualified_sources(rows).select("o_orderkey", joined.alias("sources"))


@query("SELECT n_regionkey AS source, string_agg('[' || n_name || ']', '; ' ORDER BY n_name) AS lgcode FROM (SELECT DISTINCT n_regionkey, n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey) GROUP BY n_regionkey")
def lgcode_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return references.language_codes(links.select(F.col("n_regionkey").alias("source"), "n_name"), "source", "n_name")


@query("SELECT 'a' || c_custkey AS pub_id, c_name AS creators, NULL AS isbn FROM customer UNION ALL SELECT 'b' || s_suppkey, s_name, 'x' FROM supplier")
def union_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholium.plans import corpus
    from scholium.sources.articles import Corpus

    a = read(spark, sf_dir, "customer").select(F.concat(F.lit("a"), "c_custkey").alias("pub_id"), F.col("c_name").alias("creators"))
    b = read(spark, sf_dir, "supplier").select(F.concat(F.lit("b"), "s_suppkey").alias("pub_id"), F.col("s_name").alias("creators"), F.lit("x").alias("isbn"))
    return corpus.union({"a": Corpus(a, a, a, a, a), "b": Corpus(b, b, b, b, b)}, "publications").drop("provider")


@query("""SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(
        "page_id", F.size(T.links(F.col("html"))).cast("long").alias("n_links"), T.page_title(F.col("html")).alias("title"))


@query("SELECT p_partkey, 'b' || p_size || ' b' || (p_size + 1) AS rids FROM part")
def xref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholium.sources import articles

    xml = F.concat(F.lit('<a><xref ref-type="bibr" rid="b'), "p_size", F.lit('">x</xref><p>y <xref ref-type="fig" rid="f"/><xref rid="b'), F.col("p_size") + 1, F.lit('" ref-type="bibr"/></p></a>'))
    cites = articles.corpus(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pub_id"), xml.alias("text"))).citations
    rids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "sid"))), lambda x: x["sid"]), " ")
    return cites.groupBy(F.col("pub_id").alias("p_partkey")).agg(rids.alias("rids"))


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) OR o_custkey % 2 = 1""")
def new_or_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    local = remote.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 1, -1).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return references.changed_files(remote, local, "o_orderkey", "o_custkey")


@query("SELECT c_nationkey AS key, count(*) AS count FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.duplicate_keys(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")))


@query("SELECT n_name AS key, n_name AS title, r_name AS publisher FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL, r_name FROM region")
def crossrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region")
    children = read(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("key"), F.create_map(F.lit("title"), "n_name", F.lit("crossref"), "r_name").alias("fields"))
    parents = region.select(F.col("r_name").alias("key"), F.create_map(F.lit("publisher"), "r_name").alias("fields"))
    return references.inherit_crossrefs(children.union(parents)).select("key", F.col("fields")["title"].alias("title"), F.col("fields")["publisher"].alias("publisher"))


@query("""
SELECT p_partkey, rpad(p_brand, CAST(greatest(length(p_brand), length(p_type)) AS INTEGER), ' ') || '  ' || 'x' || chr(10) || rpad(p_type, CAST(greatest(length(p_brand), length(p_type)) AS INTEGER), ' ') || '  ' || 'y' AS igt FROM part""")
def igt_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", examples.igt_text(F.array("p_brand", F.lit("x")), F.array("p_type", F.lit("y"))).alias("igt"))


@query("""
SELECT p_partkey, path FROM (SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN 'book/' WHEN 1 THEN 'figures/' ELSE '' END || p_partkey ||
  CASE p_size % 3 WHEN 0 THEN '.tex' WHEN 1 THEN '.bib' ELSE '.pdf' END AS path FROM part)
WHERE p_size % 3 < 2 AND p_size % 4 <> 1 AND p_size % 5 <> 0""")
def fetch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("p_size") % 4 == 0, "book/").when(F.col("p_size") % 4 == 1, "figures/").otherwise("")
    suffix = F.when(F.col("p_size") % 3 == 0, ".tex").when(F.col("p_size") % 3 == 1, ".bib").otherwise(".pdf")
    tree = read(spark, sf_dir, "part").select(
        "p_partkey", F.concat(folder, F.col("p_partkey"), suffix).alias("path"), F.when(F.col("p_size") % 5 == 0, "tree").otherwise("blob").alias("type"))
    return references.fetchable(tree).select("p_partkey", "path")


@query("""
SELECT o_orderkey AS example, c.c_name AS title FROM orders o LEFT JOIN customer c ON c.c_custkey = o_custkey AND c_custkey % 2 = 0 WHERE o_custkey <> o_orderkey""")
def example_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pub_id"), F.array(F.struct(F.col("o_custkey").alias("sid"), F.lit("1").alias("pages"))).alias("sources"))
    sources = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("sid"), F.lit("book").alias("genre"), F.create_map(F.lit("title"), "c_name").alias("fields"))
    return references.example_sources(rows, sources).select("example", F.col("fields")["title"].alias("title"))


@query("""
WITH a AS (SELECT p_size % 5 AS pub_id, CASE WHEN p_size % 2 = 0 THEN p_type END AS path, lower(p_brand) AS abbr, max(p_name) AS definition FROM part GROUP BY ALL),
m AS (SELECT pub_id, path, string_agg(abbr || '=' || definition, ';' ORDER BY abbr) AS m FROM a GROUP BY ALL)
SELECT p_partkey, coalesce(f.m, b.m, '') AS short FROM (SELECT p_partkey, p_partkey % 6 AS pub_id, p_type AS path FROM part) e
LEFT JOIN m f ON f.pub_id = e.pub_id AND f.path = e.path LEFT JOIN m b ON b.pub_id = e.pub_id AND b.path IS NULL""")
def abbreviation_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    short = part.groupBy((F.col("p_size") % 5).cast("long").alias("pub_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("path"), F.lower("p_brand").alias("abbr")).agg(F.max("p_name").alias("definition"))
    rows = part.select("p_partkey", (F.col("p_partkey") % 6).alias("pub_id"), F.col("p_type").alias("path"))
    listed = F.array_join(F.transform(F.sort_array(F.map_entries("abbreviations")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return references.abbreviations_for(rows, short).select("p_partkey", listed.alias("short"))


@query("SELECT l_orderkey AS pub_id, count(*) AS n_examples FROM lineitem GROUP BY l_orderkey")
def example_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.example_counts(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pub_id")))


@query("""
WITH s AS (SELECT s_nationkey AS pub_id, 'k' || (s_suppkey % 4) AS alias, arg_max(s_name, s_suppkey) AS sid FROM supplier GROUP BY ALL)
SELECT c_custkey, coalesce((SELECT string_agg(sid || ':' || n, ' ' ORDER BY n) FROM (
  SELECT sid, 1 AS n FROM s WHERE s.pub_id = c_nationkey AND alias = 'k' || (c_custkey % 5) UNION ALL
  SELECT sid, 2 FROM s WHERE s.pub_id = c_nationkey AND alias = 'k' || (c_custkey % 3))), '') AS sources FROM customer""")
def example_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that examples cite, resolved in their publication."""
    sources = read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("pub_id"), F.col("s_name").alias("sid"), F.array(F.concat(F.lit("k"), F.col("s_suppkey") % 4)).alias("alt_keys"), F.col("s_suppkey").alias("ord"))
    cited = [F.struct(F.concat(F.lit("K"), F.col("c_custkey") % m).alias("sid"), F.lit(str(n)).alias("pages")) for n, m in ((1, 5), (2, 3))]
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("pub_id"), F.col("c_custkey").alias("id"), F.array(*cited).alias("sources"))
    out = references.resolve_example_sources(rows, sources)
    return out.select(F.col("id").alias("c_custkey"), F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["sid"], x["pages"])), " ").alias("sources"))


@query("SELECT p_partkey, p_size % 3 <> 0 AS current, p_brand || ' ' || p_size || '. ' || p_name AS shown FROM part")
def publication_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether publications are superseded, and how they are shown."""
    from scholium import sinks

    superseded = F.when(F.col("p_size") % 3 == 0, "True").when(F.col("p_size") % 3 == 1, "False")
    rows = read(spark, sf_dir, "part").select("p_partkey", superseded.alias("superseded"), F.col("p_brand").alias("creators"), F.col("p_size").cast("string").alias("year"), F.col("p_name").alias("title"))
    return rows.select("p_partkey", T.is_current(F.col("superseded")).alias("current"), sinks.publication_text().alias("shown"))


@query("""SELECT p_partkey, (SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ' ORDER BY i) FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS w, generate_subscripts(string_split(p_name || ' ' || p_type, ' '), 1) AS i)) AS name FROM part""")
def capitalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.capitalized(F.concat(F.lit("  "), "p_name", F.lit(" \n "), "p_type", F.lit(" "))).alias("name"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS sid, CASE WHEN p_size % 2 = 0 THEN p_type || ', ' || p_brand END AS editor, CASE WHEN p_size % 2 = 1 THEN p_type || ', ' || p_brand END AS author,
  p_name AS title, CAST(1950 + p_size AS VARCHAR) AS year, 'Press' AS publisher, CASE WHEN p_size % 3 = 0 THEN '9' END AS isbn FROM part""")
def catalog_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a catalogue as bibliographic entries."""
    from scholium.sources import catalog

    given = {"ID": F.col("p_partkey").cast("string"), "creators": F.concat("p_type", F.lit(", "), "p_brand"), "title": F.col("p_name"), "year": (1950 + F.col("p_size")).cast("string"),
             "edited": F.when(F.col("p_size") % 2 == 0, "True"), "isbn": F.when(F.col("p_size") % 3 == 0, "9")}
    rows = read(spark, sf_dir, "part").select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in catalog.COLUMNS])
    out = catalog.as_sources(rows, publisher="Press")
    return out.select("sid", *[F.element_at("fields", F.lit(c)).alias(c) for c in ("editor", "author", "title", "year", "publisher", "isbn")])


@query("""
SELECT p_partkey AS id, 'aaaa1234' AS code, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS lo, 1000 AS hi, 0 AS ord FROM part WHERE p_size % 5 <> 0
UNION ALL SELECT p_partkey, 'bbbb5678', 0, p_size, 1 FROM part WHERE p_size % 5 <> 0""")
def language_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages declared for ranges of numbers."""
    size = F.col("p_size").cast("string")
    spec = F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.concat(F.lit("aaaa1234"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(": "), size, F.lit("-"))).otherwise(""), F.lit(", bbbb5678:-"), size))
    return languages.language_specs(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), spec.alias("spec")))


@query("""
SELECT c_custkey AS id, c_name AS primary_text, 'code' || n_nationkey AS language_id, n_name AS language_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0 AND c_custkey % 7 <> 0""")
def dataset_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of a dataset with text and analysis, and their languages."""
    from scholium.sources import datasets

    named = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("code"), "n_nationkey").alias("languageCode"), F.col("n_name").alias("name"))
    words = F.when(F.col("c_custkey") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("c_name"))
    table = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("languageReference"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("primaryText"), words.alias("analyzedWord"))
    return datasets.examples(table, named).select("id", F.col("primaryText").alias("primary_text"), "language_id", "language_name")


@query("""
SELECT n_nationkey AS id, string_agg('[c' || code || ']', '; ' ORDER BY 'c' || code) AS lgcode FROM (SELECT DISTINCT n_nationkey, s_suppkey % 6 AS code FROM nation JOIN supplier ON s_nationkey = n_nationkey) GROUP BY n_nationkey
UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def source_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with the codes of the languages whose rows cite them, pages and all."""
    from scholium.sources import datasets

    cites = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("c"), F.col("s_suppkey") % 6).alias("languageCode"), F.array(F.concat("s_nationkey", F.lit("[3]"))).alias("source"))
    sources = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("sid"), F.lit("misc").alias("genre"), F.create_map(F.lit("title"), "n_name", F.lit("cfn"), F.lit("x")).alias("fields"))
    return datasets.sources_with_codes(sources, cites).select(F.col("sid").cast("long").alias("id"), F.element_at("fields", F.lit("lgcode")).alias("lgcode"))


@query("""
SELECT p_partkey, 'main.tex' AS path FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 'b' || p_size || '.tex' FROM part WHERE p_size % 4 = 1
UNION ALL SELECT p_partkey, 'sub/book.tex' FROM part WHERE p_size % 4 = 2 UNION ALL SELECT p_partkey, 'x.tex' FROM part WHERE p_size % 4 = 3""")
def main_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main file of books, by Makefile, name, folder or document class."""
    from scholium.sources import books

    kind, own = F.col("p_size") % 4, F.concat(F.lit("b"), "p_size")
    file = lambda path, text: F.struct(path.alias("path"), text.alias("text"))
    plain, classed = F.lit("text"), F.lit("x\n\\documentclass{book}\n")
    sets = F.when(kind == 0, F.array(file(F.lit("main.tex"), plain), file(F.lit("x.tex"), classed))).when(
        kind == 1, F.array(file(F.lit("Makefile"), F.concat(F.lit("all:\n\txelatex -a "), own, F.lit("\n"))), file(F.concat(own, F.lit(".tex")), plain), file(F.lit("main.tex"), plain))
    ).when(kind == 2, F.array(file(F.lit("sub/book.tex"), plain), file(F.lit("sub/y.tex"), classed))).otherwise(F.array(file(F.lit("x.tex"), classed), file(F.lit("sub/y.tex"), classed)))
    texts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pub_id"), F.explode(sets).alias("f")).select("pub_id", "f.path", F.substring_index("f.path", "/", -1).alias("name"), "f.text")
    return books.main_files(texts).select(F.col("pub_id").alias("p_partkey"), "path")


@query(r"""SELECT p_partkey, 'a.tex' AS path, p_name || chr(10) || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END || chr(10) || 'end' AS text FROM part
UNION ALL SELECT p_partkey, 'sub/b.tex', p_type FROM part WHERE p_size % 2 = 0""")
def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with what they input put in its place."""
    from scholium.sources import books

    part = read(spark, sf_dir, "part")
    one = part.select(F.col("p_partkey").alias("pub_id"), F.lit("a.tex").alias("path"), F.concat("p_name", F.lit("\n \\input{sub/B.tex}\nend")).alias("text"))
    two = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("pub_id"), F.lit("sub/b.tex").alias("path"), F.col("p_type").alias("text"))
    return books.inlined(one.union(two)).select(F.col("pub_id").alias("p_partkey"), "path", "text")


@query()
def merge_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography merge with similar titles: first lines of documents as titles, their sources as creators."""
    title = F.substring_index("text", "\n", 1)
    rows = read(spark, sf_dir, "documents").select(
        F.concat_ws(":", "source", F.lit("99")).alias("key"), F.concat(F.lit("d"), "doc_id").alias("citekey"), F.lit("misc").alias("genre"),
        F.create_map(F.lit("title"), title).alias("fields"), T.norm_title(title).alias("title"), bib.slug_udf(title).alias("title_slug"),
        F.lit("1999").alias("year"), F.col("source").alias("author_slug"), F.col("doc_id").alias("ord"))
    merged = references.merge_bibliography(rows, bib.similar_titles())
    return merged.select("key", F.size("citekeys").alias("n"), F.col("fields")["title"].alias("title"))


@query()
def keys_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, slugs and normalized keys of names, with letters that need folding."""
    name = F.concat(F.lit("Müller-Ø "), "c_name")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", bib.make_key_udf(name, F.lit(""), F.lit("1999")).alias("key"), bib.slug_udf(name).alias("slug"), bib.normalize_key_udf(F.concat(name, F.lit("–1"))).alias("normal"))


def _as_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit("@Book{K"), F.col("p_partkey"), F.lit(", title = {A {"), F.col("p_name"), F.lit("} \\'e}, date = "), F.lit("1999, ids = {x"), F.col("p_partkey"), F.lit("}, keywords = {k}}\n"))
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("pub_id")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("text"))


@query("SELECT p_brand AS pub_id, 'k' || p_partkey AS key, 'A ' || p_name || ' é' AS title, '1999' AS year, 'x' || p_partkey AS alias FROM part")
def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BibTeX files made from parts, parsed into entries."""
    from scholium.sources import bibliographies

    rows = bibliographies.parsed(_as_bibtex(spark, sf_dir), ["pub_id"])
    return rows.select("pub_id", "key", F.col("fields")["title"].alias("title"), F.col("fields")["year"].alias("year"), F.element_at("alt_keys", 1).alias("alias"))


@query(r"""
SELECT p_partkey, CAST(2 AS BIGINT) AS n, 'w' || p_partkey || '-ne ' || 'x' AS words, 'go-PL ' || 'y_' || p_size AS gloss, '`Said ' || p_partkey || '.''' AS translation, 'Lang' AS language FROM part""")
def tex_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TeX files made from parts, scanned for glossed examples."""
    from scholium.sources import books

    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("\\langinfo{Lang}{F}{\\citet[1]{D}}\n\\gll w"), key, F.lit("-ne x % c\n\\\\\n go-\\textsc{pl} {y "), F.col("p_size").cast("string"), F.lit("} \\\\\n\\glt `Said "), key, F.lit(".'\n"))
    files = read(spark, sf_dir, "part").select(key.alias("pub_id"), F.lit("f").alias("path"), F.lit(0).alias("file_ord"), text.alias("text"))
    return books.examples(files).select(
        F.col("pub_id").cast("long").alias("p_partkey"), F.size("words").cast("long").alias("n"), F.array_join("words", " ").alias("words"), F.array_join("gloss", " ").alias("gloss"), "translation", "language")


@query("""
SELECT p_partkey, 'r' || p_partkey AS sid, 'article' AS genre, p_name AS title, p_type AS journal, '1-9' AS pages FROM part""")
def article_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article XML made from parts, parsed into references."""
    from scholium.sources import articles

    text = F.concat(
        F.lit('<article><ref-list><ref id="r'), F.col("p_partkey"), F.lit('"><element-citation publication-type="journal"><article-title>'), F.col("p_name"),
        F.lit("</article-title><source>"), F.col("p_type"), F.lit("</source><fpage>1</fpage><lpage>9</lpage></element-citation></ref></ref-list></article>"))
    rows = articles.corpus(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pub_id"), text.alias("text"))).references
    get = lambda k: F.col("fields")[k].alias(k)
    return rows.select(F.col("pub_id").alias("p_partkey"), "sid", "genre", get("title"), get("journal"), get("pages"))
