"""Whole projects on disk, read, related and written."""

import json

import pytest
from pyspark.sql import functions as F

from scholium import sinks
from scholium.functions import bib
from scholium.operators import references
from scholium.sources import articles, bibliographies, books, catalog, datasets
from scholium.streaming import incremental
from tests.test_functions import TEX, XML


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")


def test_catalog(spark, tmp_path):
    write(tmp_path, c_dot_tsv="ID\tlicense\tyear\tcreators\ttitle\tsuperseded\n1\tCC-BY 4.0\t2000\tDoe, Jane\tA\tFalse\n2\tCC-BY-NC\t2001\tDoe, Jane\tB\tTrue\n3\tCC-BY\tForthcoming\t\tC\t\n4\tCC-BY\t2002\t\tD\t\n")
    rows = catalog.read_catalog(spark, str(tmp_path / "c.tsv"))
    assert rows.count() == 4
    assert [r["ID"] for r in catalog.published(rows, missing=(4,)).collect()] == ["1"]
    assert catalog.lookup(rows, "3").first()["title"] == "C"
    source = {r["sid"]: r["fields"] for r in catalog.as_sources(rows).collect()}["1"]
    assert source == {"author": "Doe, Jane", "title": "A", "year": "2000"}
    catalog.write_catalog(rows, str(tmp_path / "out"))
    assert catalog.read_catalog(spark, str(tmp_path / "out")).count() == 4


def test_books(spark, tmp_path):
    root = tmp_path / "books"
    write(root, **{
        "1__main_dot_tex": "\\documentclass{x}\n\\include{chapters/One}\n\\include{chapters/two}\n\\bibliography{the}\n", "1__chapters__one_dot_tex": TEX,
        "1__chapters__two_dot_tex": TEX + "\\section{Abbreviations}\npl & plural \\\\\n", "1__chapters__abbreviations_dot_tex": "sg & singular\\\\\n% x & y\n",
        "2__Makefile": "all:\n\txelatex special\n", "2__special_dot_tex": "x", "2__main_dot_tex": "y", "3__sub__book_dot_tex": "z", "1__the_dot_bib": "@book{Doe1999, title={T}, ids={Foo}}",
    })
    texts = books.read_texts(spark, str(root))
    mains = books.main_files(texts)
    assert {(r["pub_id"], r["path"]) for r in mains.collect()} == {("1", "main.tex"), ("2", "special.tex"), ("3", "sub/book.tex")}
    files = books.included(texts, mains)
    assert [r["path"] for r in files.orderBy("file_ord").collect()] == ["chapters/one.tex", "chapters/two.tex"]
    found = books.examples(files).collect()
    assert len(found) == 2 and all(r["path"] == "chapters/one.tex" for r in found)
    cites = books.citations(files)
    sources = bibliographies.read_bibtex(spark, str(root)).select("pub_id", F.col("key").alias("sid"), "alt_keys", "ord", "genre", "fields")
    resolved = references.resolve_citations(cites.select("pub_id", "key"), sources)
    assert {r["sid"] for r in resolved.collect()} == {"doe1999"}
    assert resolved.count() == 4
    assert references.cited_references(sources, resolved, ["pub_id", "sid"]).count() == 1
    short = {(r["path"], r["abbr"]): r["definition"] for r in books.gloss_abbreviations(files.select("pub_id", "path", "name", "text").union(
        texts.where("name = 'abbreviations.tex'").select("pub_id", "path", "name", "text"))).collect()}
    assert short == {("chapters/two.tex", "pl"): "plural", (None, "sg"): "singular"}
    assert [r["bib"] for r in books.bibliography_names(texts.join(mains, ["pub_id", "path"])).collect()] == ["the.bib"]
    assert "\\langinfo" in {r["path"]: r["text"] for r in books.inlined(texts.where("pub_id = '1'")).collect()}["main.tex"]


def test_articles(spark, tmp_path):
    write(tmp_path, **{"12_dot_xml": XML, "3_dot_xml": XML, "4_dot_xml": "<broken", "x_dot_xml": XML})
    texts = articles.read_texts(spark, str(tmp_path))
    assert [r["pub_id"] for r in texts.orderBy("ord").collect()] == ["3", "4", "12"]
    got = articles.corpus(texts)
    assert {r["pub_id"] for r in got.publications.collect()} == {"3", "12"}
    assert got.references.count() == 6 and got.citations.count() == 4 and got.abbreviations.count() == 4
    example = got.examples.first()
    assert (example["local_id"], example["primary_text"], example["translation"]) == ("1a", "wa² ti", "They go.")
    cited = references.cited_references(got.references, got.citations, ["pub_id", "sid"])
    assert {r["sid"] for r in cited.collect()} == {"B1"}


def test_datasets(spark, tmp_path):
    spec = {"tables": [{"url": "languages.csv", "dc:conformsTo": "http://x/terms.rdf#LanguageTable", "tableSchema": {"columns": [
        {"name": "ID", "propertyUrl": "http://x#id"}, {"name": "Glotto", "propertyUrl": "http://x#languageCode"}, {"name": "Name", "propertyUrl": "http://x#name"},
        {"name": "Source", "propertyUrl": "http://x#source", "separator": ";"}, {"name": "Latitude", "propertyUrl": "http://x#latitude", "datatype": "decimal"}, {"name": "Absent"}]}}]}
    write(tmp_path, **{"m_dot_json": json.dumps(spec), "languages_dot_csv": "ID,Glotto,Name,Source,Latitude\nl1,aaaa1111,One,b1;b2[3],1.5\nl2,bbbb2222,Two,b1,\nl3,,Three,b2,2\n"})
    meta = datasets.read_metadata(spark, str(tmp_path / "m.json"))
    langs = datasets.read_table(spark, str(tmp_path), meta, "LanguageTable")
    assert langs.dtypes == [("id", "string"), ("languageCode", "string"), ("name", "string"), ("source", "array<string>"), ("latitude", "double")]
    assert datasets.read_table(spark, str(tmp_path), meta, "ValueTable") is None
    sources = spark.createDataFrame([("b1", "book", {"title": "T", "cfn": "x"}), ("b2", "book", {"title": "U"}), ("b3", "book", {"title": "V"})], "sid string, genre string, fields map<string,string>")
    got = {r["sid"]: r["fields"] for r in datasets.sources_with_codes(sources, langs).collect()}
    assert got == {"b1": {"title": "T", "lgcode": "[aaaa1111]; [bbbb2222]"}, "b2": {"title": "U", "lgcode": "[aaaa1111]"}, "b3": {"title": "V"}}
    values = spark.createDataFrame([("l2", ["b2"]), ("l3", ["b3"])], "languageReference string, source array<string>")
    got = {r["sid"]: r["fields"].get("lgcode") for r in datasets.sources_with_codes(sources, langs, values).collect()}
    assert got == {"b1": None, "b2": "[bbbb2222]", "b3": None}
    table = spark.createDataFrame([(0, "e1", "l1", "x", ["x"]), (1, "e2", "l1", "", ["x"]), (2, "e3", "l2", "y", [])], "ord int, id string, languageReference string, primaryText string, analyzedWord array<string>")
    assert [(r["id"], r["language_name"]) for r in datasets.examples(table, langs).collect()] == [("e1", "One")]


def test_sinks(spark, tmp_path):
    merged = spark.createDataFrame([("b", "book", {"title": "T"}), ("a", "misc", {"note": "N"})], "key string, genre string, fields map<string,string>")
    assert sinks.write_bibliography(merged, str(tmp_path / "bib"), parts=1) == 2
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "bib"), wholetext=True).collect())
    assert [k for k, _, _ in bib.parse_bibtex(text)] == ["a", "b"]
    sinks.write_by_publication(merged.select(F.lit("p").alias("pub_id"), F.col("key").alias("sid"), "genre", "fields"), str(tmp_path / "each"))
    assert (tmp_path / "each" / "pub_id=p").exists()
    row = spark.createDataFrame([("1a", "x", "Lang", [("s", "3")], ["ab", "c"], ["x", "yz"], "T")],
                                "local_id string, id string, language_name string, sources array<struct<sid:string,pages:string>>, words array<string>, gloss array<string>, translation string")
    assert row.select(sinks.example_text().alias("y")).first()["y"] == "(1a) Lang (s: 3)\nab  c\nx   yz\n‘T’"


def test_stream(spark, tmp_path):
    write(tmp_path, in__1_dot_xml=XML)
    seen = []
    for _ in range(2):
        incremental.start(incremental.new_files(spark, str(tmp_path / "in"), "*.xml"), lambda rows, _: seen.extend(r["path"] for r in rows.select("path").collect()), str(tmp_path / "check")).awaitTermination()
        write(tmp_path, in__2_dot_xml=XML)
    assert [p.rsplit("/")[-1] for p in seen] == ["1.xml", "2.xml"]


def test_books_cite_in_main_file_and_backmatter(spark, tmp_path):
    from scholium.plans import corpus

    (tmp_path / "1").mkdir()
    entries = "".join(f"@book{{{k}, title = {{T {k}}}, year = 1999}}\n" for k in ("inmain", "inchapter", "inback", "nowhere"))
    for name, text in {
        "main.tex": "\\documentclass{book}\n\\include{chapter}\nSee \\citet{inmain}.\n", "chapter.tex": "See \\citet{inchapter}.\n",
        "backmatter.tex": "See \\citet{inback}.\n", "other.tex": "See \\citet{nowhere}.\n", "all.bib": entries,
    }.items():
        (tmp_path / "1" / name).write_text(text)
    got = corpus.read_books(spark, str(tmp_path)).citations.collect()
    assert sorted(r["sid"] for r in got) == ["inback", "inchapter", "inmain"]


@pytest.fixture(scope="module")
def dataset_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("datasets")
    table = lambda name, *columns: {"url": f"{name}.csv", "dc:conformsTo": f"http://x/terms.rdf#{name}", "tableSchema": {"columns": [
        {"name": c, "propertyUrl": f"http://x#{p}", **({"separator": s} if s else {})} for c, p, s in columns]}}
    spec = {"tables": [
        table("LanguageTable", ("ID", "id", ""), ("Glotto", "languageCode", ""), ("Name", "name", ""), ("Source", "source", ";")),
        table("ExampleTable", ("ID", "id", ""), ("Lang", "languageReference", ""), ("Text", "primaryText", ""), ("Words", "analyzedWord", "\t"), ("Gloss", "gloss", "\t"), ("Said", "translatedText", "")),
    ]}
    write(root, **{
        "catalog_dot_csv": "id,name,conceptdoi,source_to_language,hhtype,bib,igt,gloss_abbreviations\n1,one,10.1/x,LanguageTable,grammar,x,x,abbr.csv A B\n2,two,10.1/y,,,,,\n",
        "one_dot_json": json.dumps({"doi": "10.1/1", "license": "CC-BY 4.0", "creators": ["Roe, A", "Doe, J"], "title": "One", "year": "2020", "version": "v1"}),
        "two_dot_json": json.dumps({"doi": "10.1/2", "license": "CC-BY 4.0", "creators": ["Roe, A"], "title": "Two", "year": "2021", "version": "v2"}),
        "one__m-metadata_dot_json": json.dumps(spec), "two__m-metadata_dot_json": json.dumps({"tables": []}),
        "one__LanguageTable_dot_csv": "ID,Glotto,Name,Source\nl1,aaaa1111,Lang,s1[2];s2\n",
        "one__ExampleTable_dot_csv": "ID,Lang,Text,Words,Gloss,Said\ne1,l1,wa ti,wa\tti,go\thouse,They go.\ne2,l1,,x,y,No text\n",
        "one__abbr_dot_csv": "A,B\nPL,plural\n", "one__sources_dot_bib": "@book{s1, author={Moe, A}, title={A Title}, year=1999, cfn={x}}\n@book{s2, author={Poe, B}, title={Else}, year=2000}\n",
        "two__sources_dot_bib": "@book{never, title={T}}\n"})
    return str(root)


def test_datasets_as_a_provider(spark, dataset_root, capsys):
    from scholium import cli
    from scholium.plans import corpus

    got = datasets.read_datasets(spark, dataset_root)
    assert {(r["pub_id"], r["title"], r["creators"]) for r in got.publications.collect()} == {("1", "One", "Roe, A & Doe, J"), ("2", "Two", "Roe, A")}
    refs = {(r["pub_id"], r["sid"]): r["fields"] for r in got.references.collect()}
    assert set(refs) == {("1", "s1"), ("1", "s2")}
    assert refs["1", "s1"]["lgcode"] == "[aaaa1111]" and refs["1", "s1"]["hhtype"] == "grammar" and "cfn" not in refs["1", "s1"]
    (example,) = got.examples.collect()
    assert (example["local_id"], example["words"], example["language"], example["language_id"]) == ("e1", ["wa", "ti"], "Lang", "aaaa1111")
    assert [tuple(r) for r in got.abbreviations.collect()] == [("1", "PL", "plural")]
    cli.main(["bib", "dataset", dataset_root, "1"], spark)
    assert "A Title" in capsys.readouterr().out
    cli.main(["igt", "dataset", dataset_root, "1"], spark)
    assert "(e1) Lang" in capsys.readouterr().out
    loaded = corpus.load(spark, dataset=dataset_root)
    assert {tuple(r["citekeys"]) for r in corpus.merged_bibliography(loaded).collect()} == {("dataset1:s1",), ("dataset1:s2",)}


def test_an_unknown_language_is_an_error(spark):
    table = spark.createDataFrame([(0, "e1", "l9", "x", ["x"])], "ord int, id string, languageReference string, primaryText string, analyzedWord array<string>")
    langs = spark.createDataFrame([("l1", "aaaa1111", "One")], "id string, languageCode string, name string")
    with pytest.raises(Exception, match="unknown language: l9"):
        datasets.examples(table, langs).collect()


def test_books_of_a_catalogue(spark, tmp_path):
    from scholium.plans import corpus

    example = "\\gll wa ti\\\\\n go house\\\\\n\\glt `They go \\citep[3]{Alias}.'\n"
    catalog_rows = "ID\tDOI\tedited\tmetalanguage\tobjectlanguage\tlicense\tsuperseded\tpages\tseries\tseriesnumber\tcreators\ttitle\tyear\n"
    catalog_rows += "1\td\t\teng\tSomali\tCC-BY 4.0\t\t\t\t\tRoe, A\tOne\t2020\n2\td\t\teng\t\tCC-BY 4.0\t\t\t\t\tRoe, A\tTwo\tForthcoming\n"
    write(tmp_path, **{
        "catalog_dot_tsv": catalog_rows, "1__main_dot_tex": "\\documentclass{book}\n\\bibliography{b}\n\\include{one}\n", "1__one_dot_tex": example + "\\input{more}\n", "1__more_dot_tex": "\\cite{roe2001}",
        "1__a_dot_bib": "@book{never, title={N}, year=1900}\n", "1__b_dot_bib": "@book{doe1999, ids={alias}, author={Doe, J}, title={T}, year=1999}\n@book{roe2001, author={Roe, J}, title={U}, year=2001}\n",
        "1__abbreviations_dot_tex": "PL & plural\\\\\n", "2__main_dot_tex": "\\documentclass{book}\n" + example, "2__b_dot_bib": "@book{x, title={X}}\n"})
    got = corpus.read_books(spark, str(tmp_path))
    assert [r["pub_id"] for r in got.publications.collect()] == ["1"]
    assert {r["sid"] for r in got.references.collect()} == {"doe1999", "roe2001"}
    assert {r["sid"] for r in got.citations.collect()} == {"doe1999", "roe2001"}
    (row,) = got.examples.collect()
    assert row["language"] == "Somali" and [tuple(s) for s in row["sources"]] == [("doe1999", "3")] and row["abbreviations"] == {"PL": "plural"}


def test_texts_of_one_piece_are_parsed_in_many_tasks(spark):
    stored = spark.range(200).select(F.col("id").cast("string").alias("pub_id"), F.lit("f").alias("path"), F.lit(0).alias("file_ord"), F.lit(TEX).alias("text")).coalesce(1)
    cited = books.citations(stored)
    sizes = [r["count"] for r in cited.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200 * books.citations(stored.limit(1)).count() > 0
    assert len(sizes) >= spark.sparkContext.defaultParallelism
    assert max(sizes) < sum(sizes) / 4
