"""Commands over a small tree of books and articles."""

import pytest

from scholium import cli
from scholium.plans import corpus
from tests.test_functions import TEX, XML
from tests.test_sources import write


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("all")
    bibs = "@book{Doe1999, author={Doe, J}, title={A Title}, year=1999}\n@book{roe2001, title={Never}}\n@book{x, ids={foo}, author={Ruiz, L}, title={Else}, year=2003}"
    write(root, **{"book__7__main_dot_tex": "\\include{one}", "book__7__one_dot_tex": TEX, "book__7__the_dot_bib": bibs,
                   "book__9__main_dot_tex": "\\include{one}", "book__9__one_dot_tex": TEX, "book__9__the_dot_bib": bibs, "article__12_dot_xml": XML})
    return root


def test_bib(spark, root, capsys):
    cli.main(["bib", "book", str(root / "book"), "7", "--bibtex"], spark)
    out = capsys.readouterr().out
    assert out.count("@book{") == 3 and "A Title" in out
    cli.main(["bib", "article", str(root / "article"), "12"], spark)
    assert capsys.readouterr().out.strip() == "Doe, J. 2001. T. Jrnl 2."


def test_igt(spark, root, capsys):
    cli.main(["igt", "book", str(root / "book"), "7"], spark)
    assert "wa-ne   ti_ro\ngo-PL   big_house" in capsys.readouterr().out.replace("wa-ne  ti_ro", "wa-ne   ti_ro").replace("go-PL  big_house", "go-PL   big_house")
    cli.main(["igt", "article", str(root / "article"), "12"], spark)
    assert "(1a) Modern Portuguese (B1: 7)" in capsys.readouterr().out


def test_mergedbib(spark, root, capsys):
    cli.main(["mergedbib", "book", str(root / "book")], spark)
    out = capsys.readouterr().out
    assert out.count("@book{") == 4  # one has neither year nor creator and is never merged
    assert "isreferencedby = {book7 book9}" in out or "isreferencedby = {book9 book7}" in out
    cli.main(["mergedbib", "book", str(root / "book"), "--drop-until", "8", "--out", str(root / "out")], spark)
    assert capsys.readouterr().out.strip() == "3"


def test_all_providers(spark, root):
    loaded = corpus.load(spark, book=str(root / "book"), article=str(root / "article"))
    assert list(loaded) == ["article", "book"]
    assert corpus.union(loaded, "publications").count() == 3
    merged = {tuple(r["citekeys"]) for r in corpus.merged_bibliography(loaded).collect()}
    assert ("book7:doe1999", "book9:doe1999") in merged and len(merged) == 5
    names = spark.createDataFrame([("Lang", "abcd1234")], "name string, code string")
    languoids = spark.createDataFrame([("abcd1234", None, "Lang", 0)], "code string, iso string, name string, ord long")
    got = corpus.resolved_examples(loaded["book"].examples, languoids, names).collect()
    assert {(r["translation"], r["language_id"]) for r in got} == {("They go home.", "abcd1234"), ("Eat!", None)}
