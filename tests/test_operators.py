"""Relations on small tables, with one and with several partitions."""

import pytest
from pyspark.sql import functions as F

from scholium.functions import bib
from scholium.functions import text as T
from scholium.operators import examples, languages, references
from scholium.sources import bibliographies


def one(spark, column, **values):
    return spark.createDataFrame([values or {"x": 1}]).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("given, want", [("`abc'", "abc"), ("`abc'.", "abc."), ("", ""), ("  a \u00a0 b ", "a b"), ("“x ()...”", "x …")])
def test_clean_translation(spark, given, want):
    assert one(spark, T.clean_translation(F.lit(given))) == want


@pytest.mark.parametrize(
    "text, comment, want",
    [("some text [and a comment]", "comment", ("some text", "comment; and a comment", None)), ("t [ref]", None, ("t", None, "ref")), ("t […]", "c", ("t […]", "c", None)),
     ("a [b] [c]", None, ("a [b] [c]", None, None)), ("plain", None, ("plain", None, None))],
)
def test_translation_parts(spark, text, comment, want):
    got = one(spark, T.translation_parts(F.col("t"), F.col("c")), t=text, c=comment or "")
    assert tuple(got) == tuple(x if x is not None or i != 1 else "" for i, x in enumerate(want))


def test_scalars(spark):
    assert one(spark, T.creators_as_names(F.lit("Doe, Jane & Roe, Rick"))) == "Doe, Jane and Roe, Rick"
    assert one(spark, T.creators_as_names(F.lit("Doe, Jane, Roe"))) is None
    assert one(spark, T.has_open_license(F.lit("CC-BY-ND 4.0"))) is False
    assert one(spark, T.strip_tex_comment(F.lit(r"a\\%b"))) == "a\\\\"
    assert one(spark, T.unbalanced_removed(F.lit("a(b {c}"))) == "ab {c}"
    assert one(spark, T.leading_number(F.lit("12b"))) == 12
    assert one(spark, T.year(F.lit("n.d."))) == ""


def entries(spark, *rows, parts=1):
    """(citekey, title, year, editor, more fields) as input of a merge."""
    table = [(c, "book", {"title": t, "year": y, "editor": e} | more, i) for i, (c, t, y, e, more) in enumerate(rows)]
    frame = spark.createDataFrame(table, "citekey string, genre string, fields map<string,string>, ord long").repartition(parts)
    return bibliographies.merge_input(frame)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize(
    "second, n", [("The Title", 1), ("The Title More", 1), ("The Titlestring", 2)],
)
def test_merge(spark, parts, second, n):
    rows = entries(spark, ("a", "The Title", "1999", "Doe, J", {"isreferencedby": "a", "note": "short"}), ("c", second, "1999", "Doe, J", {"isreferencedby": "c", "note": "longer", "blank": " "}), parts=parts)
    got = references.merge_bibliography(rows, bib.similar_titles()).collect()
    assert len(got) == n
    if n == 1:
        assert got[0]["citekeys"] == ["a", "c"]
        assert got[0]["fields"]["isreferencedby"] == "a c" and got[0]["fields"]["note"] == "longer" and "blank" not in got[0]["fields"]
        assert got[0]["key"] == "doe:ed:99"
    else:
        assert sorted(r["key"] for r in got) == ["doe:ed:99:1", "doe:ed:99:2"]


def test_entries_without_year_or_creator_stay_apart(spark):
    rows = entries(spark, ("a", "Same", "", "", {}), ("b", "Same", "", "", {}), ("c", "", "", "", {}))
    assert sorted(tuple(r["citekeys"]) for r in references.merge_bibliography(rows, bib.similar_titles()).collect()) == [("a",), ("b",), ("c",)]


def test_only_neighbours_are_compared(spark):
    rows = entries(spark, ("a", "Grammar", "1999", "Doe, J", {}), ("b", "Grammar of", "1999", "Doe, J", {}), ("c", "Grammar of Old", "1999", "Doe, J", {}), ("d", "Zoo", "1999", "Doe, J", {}))
    got = {tuple(r["citekeys"]) for r in references.merge_bibliography(rows, bib.similar_titles()).collect()}
    assert got == {("a", "b", "c"), ("d",)}


def test_aliases(spark):
    sources = spark.createDataFrame([("p", "one", ["x"], 0), ("p", "two", ["x", "one"], 1), ("q", "x", None, 0)], "pub_id string, sid string, alt_keys array<string>, ord long")
    cites = spark.createDataFrame([("p", "x"), ("p", "one"), ("p", "none"), ("q", "x")], "pub_id string, key string")
    got = {(r["pub_id"], r["key"]): r["sid"] for r in references.resolve_citations(cites, sources).collect()}
    assert got == {("p", "x"): "two", ("p", "one"): "two", ("q", "x"): "x"}


def test_last_and_first(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, None), ("m", 5, "z")], "key string, ord int, v string")
    assert {tuple(r) for r in references.last_wins(rows, ["key"]).collect()} == {("k", "c", 1), ("m", "z", 5)}
    assert {tuple(r) for r in references.first_wins(rows, ["key"], ["ord"]).collect()} == {("k", 1, "a"), ("m", 5, "z")}


def test_languages(spark):
    languoids = spark.createDataFrame([("abcd1234", "abc", "lang", 0), ("efgh1234", None, "twice", 1), ("ijkl1234", "ijk", "twice", 2)], "code string, iso string, name string, ord long")
    aliases = spark.createDataFrame([("abcd1234", "alias [old]", 0), ("efgh1234", "alias", 1), ("abcd1234", "twice", 2)], "code string, name string, ord long")
    custom = spark.createDataFrame([("mine", "abcd1234")], "name string, code string")
    names = languages.name_table(languoids, aliases, custom)
    rows = spark.createDataFrame([(x,) for x in ("abcd1234", "abc", "lang", "alias", "mine", "twice", "none")], "lang string")
    got = {r["lang"]: r["language_id"] for r in languages.resolve(rows, languoids, names, "lang").collect()}
    assert got == {"abcd1234": "abcd1234", "abc": "abcd1234", "lang": "abcd1234", "alias": "abcd1234", "mine": "abcd1234", "twice": "ijkl1234", "none": None}
    rows = spark.createDataFrame([(None, "lang"), (None, "words"), ("x", "lang")], "language_id string, comment string")
    assert {tuple(r) for r in languages.comment_as_language(rows, names).collect()} == {("abcd1234", None), (None, "words"), ("x", "lang")}


def test_ranges(spark):
    ranges = spark.createDataFrame([("a", 1, 5, 0), ("b", 4, 9, 1)], "code string, lo int, hi int, ord int")
    rows = spark.createDataFrame([(i,) for i in (0, 4, 7)], "n int")
    assert {r["n"]: r["code"] for r in languages.by_range(rows, ranges, "n").collect()} == {0: None, 4: "a", 7: "b"}


def test_examples(spark):
    lines = spark.createDataFrame([("f", i, "x" if i == 0 else None) for i in range(30)], "f string, n int, v string")
    got = {r["n"]: r["carried"] for r in examples.carry_forward(lines, ["f"], "n", "v").collect()}
    assert got[24] == "x" and got[25] is None
    for given, want in ((["a", "", "-b"], ["a-b"]), (["a-", "b", "c"], ["a-b", "c"]), ([], []), (["", ""], [])):
        frame = spark.createDataFrame([(given,)], "m array<string>")
        assert frame.select(examples.recombined(F.col("m")).alias("y")).first()["y"] == want
    rows = spark.createDataFrame([("p", "1a", [("s", "3")]), ("p", None, [])], "pub_id string, local_id string, sources array<struct<sid:string,pages:string>>")
    got = [[tuple(s) for s in r["sources"]] for r in examples.qualified_sources(rows).collect()]
    assert got == [[("s", "3"), ("p", "via:1a")], [("p", "")]]


def test_bibtex_text(spark):
    fields = F.create_map(F.lit("title"), F.lit("T"), F.lit("year"), F.lit("1999"), F.lit("author"), F.lit("A"))
    assert one(spark, bib.as_bibtex(F.lit("k"), F.lit("book"), fields)) == "@book{k,\n  author = {A},\n  title  = {T},\n  year   = {1999}\n}"
    assert one(spark, bib.as_citation(fields)) == "A. 1999. T."
