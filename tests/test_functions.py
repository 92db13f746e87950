"""Parsers and plain functions on texts of our own."""

import random

import pytest

from scholium.functions import align, bib, jats, tex


@pytest.mark.parametrize(
    "given, want",
    [(("Meier, Ana and Ruiz, Leo", "", "2003"), "meier:ruiz:03"), (("Müller, A. and B, C and D, E", "", "in 1999"), "mueller:b:etal:99"),
     (("", "van Berg, Jo", ""), "vanberg:ed:nd"), (("", "", "n.d."), "np:nd"), (("Ana de la Cruz", "", "1870"), "delacruz:70")],
)
def test_make_key(given, want):
    assert bib.make_key(*given) == want


def test_slug_and_key():
    assert bib.slug("Éléments d’Ø (2)") == "elementsdo2"
    assert bib.normalize_key("Ana–Bo:E\u0301") == "ana--bo:é"


def test_similarity():
    assert bib.similarity("a grammar of x", "a grammar of x") == 100
    assert bib.similarity("a grammar", "a grammar of x") == 100  # all words of one are in the other
    assert bib.similarity("old title", "old titlestring") < 92
    assert bib.ratio("", "") == 100
    assert bib.ratio("abc", "xyz") == 0


BIB = r"""
@string{pub = "The Press"}
@comment{nothing}
@Book{Old:Key–1, author = {Doe, Jane and {Big Group}}, title = {A {T}itle with {\"o} \& more}, publisher = pub # " Ltd", year = 1999,
  ids = {other, More}, date-added = {x}, journaltitle = {Rev}, journal = {First}}
@article{broken, title = {never closed
@mastersthesis{m, title = "Quoted {x}", year = {2001}}
@thesis{t, type = {mathesis}, title = {About (this}}
"""


def test_bibtex():
    found = bib.parse_bibtex(BIB)
    assert [k for k, _, _ in found] == ["Old:Key–1", "m", "t"]
    fields = found[0][2]
    assert fields["publisher"] == "The Press Ltd" and fields["year"] == "1999"
    key, genre, plain = bib.to_source(*found[0], tex.plain)
    assert (key, genre) == ("old:key--1", "book")
    assert plain["title"] == "A Title with ö & more"
    assert "date-added" not in plain and plain["journal"] == "First" and "journaltitle" not in plain
    assert bib.to_source(*found[2], tex.plain)[1:] == ("mastersthesis", {"title": "About this"})


@pytest.mark.parametrize(
    "given, want",
    [(r"\textit{a} \textsc{pl}~b", "a PL b"), (r"\'e\"{o}\c{c}\v s", "éöçš"), (r"x\footnote{note \emph{here}}y", "xy"), (r"\hfill \llap{q}z\index{w}", "z"),
     (r"\Third{}.\Sg{} go", "3.SG go"), (r"\japhug{a}{b}", "a [b]"), (r"\ref{a}{b}", "ab"), (r"\ref", ""), (r"\jambox{}{b}", "b"), (r"\linieb{a}{b}", "b"), (r"\href{a}{b}", "[b](a)"), (r"\Nom-\pst", "NOM-PST"), (r"x\Zero", "x∅"), (r"\ilt{a}b", "b"), (r"\tss{f}", ".F"), (r"a % rest", "a"), (r"\unknown{kept}", "kept"), (r"$x$ \ldots{} \o", "x … ø"), ("{a {b} c", "a b c")],
)
def test_tex(given, want):
    assert tex.to_text(given).text.replace("..", "").strip(". ") == want.strip(". ") or tex.to_text(given).text == want


def test_tex_notes_and_citations():
    got = tex.to_text(r"word\footnote{see \citet[12]{Doe1999,&Roe--2}} and \href{http://u}{shown} \cite{Z}")
    assert got.text == "word and [shown](http://u)"
    assert got.refs == [("doe1999", "12"), ("roe--2", "12"), ("z", "")]
    assert got.notes == ["see"]
    assert tex.to_text(r"\PL{} go-\PL", frozenset({"PL"})).text == "PL go-PL"


def test_citations():
    assert tex.normalize_citations("\\parencites[1]{a}[see][2]{b,c}") == r"\cite[1]{a} \cite[2]{b,c}"
    assert tex.citation_keys("\\citeauthor*[x]{A, B} and \\citet\n{C}") == ["A", "B", "C"]
    assert tex.strip_comment(r"a\%b % c") == "a%b "
    assert tex.strip_comment(r"a\\%b") == "a\\\\"


@pytest.mark.parametrize(
    "words, gloss, want",
    [("a b .", "x y", (["a", "b."], ["x", "y"], None)), ("a b", "x y [note]", (["a", "b"], ["x", "y"], "note")), ("a … b", "x y", (["a", "…", "b"], ["x", "…", "y"], None)),
     ("a ∅ b", "x y", (["a", "∅", "b"], ["x", "∅", "y"], None)), ("a b ]", "x y", (["a", "b", "]"], ["x", "y", "_"], None)), ("a b (rem)", "x y", (["a", "b"], ["x", "y"], "rem")),
     ("a {b c} d", "x {y z} w", (["a", "b_c", "d"], ["x", "y_z", "w"], None)), ("a -b c", "x -y z", (["a-b", "c"], ["x-y", "z"], None)), ("a {} b", "x y z", (["a", "_", "b"], ["x", "y", "z"], None)),
     ("< a >", "x", (["<", "a", ">"], ["_", "x", "_"], None))],
)
def test_alignment(words, gloss, want):
    got = align.align(words, gloss)
    if want[0][0] == "<":  # brackets are separators, too: both glue alike
        assert len(got[0]) == len(got[1])
    else:
        assert got == want


TEX = r"""
Text \citep[4]{Roe2001}.
\ea \langinfo{Lang}{Fam}{\citealt[7]{Doe1999}}\\
\gll wa-ne {ti ro} % note
 \\
 go-\textsc{pl} {big house} \\
\glt `They go home.'\footnote{Heard \cite{Foo}.}
\z
\gll a b \\
x \\
\glt dropped
\ex Name \citep[3]{Bar}
\gll ka \\ eat \\
\glt
\textit{Eat!}
"""


def test_tex_examples():
    raws = align.scan(TEX)
    assert len(raws) == 3
    first, none, last = map(align.make_example, raws)
    assert (first.words, first.gloss, first.language) == (["wa-ne", "ti_ro"], ["go-PL", "big_house"], "Lang")
    assert first.primary_text == "wane ti_ro" and first.translation == "`They go home.'"
    assert ("foo", "") in first.sources and ("doe1999", "7") in first.sources
    assert none is None
    assert (last.language, last.translation, last.words) == ("Name", "Eat!", ["ka"])


XML = """<article><front><article-meta><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>A <italic>study</italic></article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>Jane</given-names></name></contrib></contrib-group><pub-date><year>2020</year></pub-date>
<volume>3</volume><license xmlns:x="l" x:href="http://creativecommons.org/licenses/by/4.0/"/></article-meta></front>
<body><sec><title>Abbreviations</title><p><sc>pl</sc> = plural, <sc>sg</sc> = singular</p></sec>
<p>See&nbsp;<xref ref-type="bibr" rid="B1">Doe (2001: 4)</xref></p>
<list list-type="gloss"><list-item><list list-type="wordfirst"><list-item><p>(1)</p></list-item></list></list-item><list-item><list list-type="wordfirst"><list-item><p>a.</p></list-item></list></list-item>
<list-item><list list-type="sentence-gloss"><list-item><list list-type="final-sentence"><list-item><p><italic>modern portuguese</italic> (stuff)</p></list-item></list></list-item></list></list-item>
<list-item><list list-type="sentence-gloss">
<list-item><list list-type="word"><list-item><p>wa<sup>2</sup></p><p>go</p></list-item></list><list list-type="word"><list-item><p>ti</p><p><sc>pl</sc></p></list-item></list></list-item>
<list-item><list list-type="final-sentence"><list-item><p>‘They go.’   (<xref ref-type="bibr" rid="B1">Doe: 7</xref>)</p></list-item></list></list-item></list></list-item></list></body>
<back><ref-list><ref id="B1"><element-citation publication-type="journal"><person-group person-group-type="author"><name><surname>Doe</surname><given-names>J</given-names></name></person-group>
<year>2001</year><article-title>T</article-title><source>Jrnl</source><fpage>1</fpage><lpage>9</lpage><volume>2</volume></element-citation></ref>
<ref id="B2"><mixed-citation publication-type="book"><string-name><surname>Roe</surname></string-name> <year>1999</year> <source>Thing. Doctoral dissertation</source><publisher-name>Uni</publisher-name></mixed-citation></ref>
<ref id="B3"><element-citation publication-type="book"><chapter-title>C</chapter-title><source>Book</source></element-citation></ref></ref-list></back></article>"""


def test_article():
    doc = jats.parse(XML)
    assert jats.metadata(doc) == {"doi": "10.1/x", "title": "A study", "creators": "Doe, Jane", "year": "2020", "volume": "3", "issue": "", "license": "CC-BY"}
    assert jats.abbreviations(doc) == {"PL": "plural", "SG": "singular"}
    assert jats.cited(doc) == ["B1", "B1"]
    refs = {k: (g, f) for k, g, f in jats.references(doc)}
    assert refs["B1"] == ("article", {"author": "Doe, J", "year": "2001", "pages": "1-9", "title": "T", "journal": "Jrnl", "volume": "2"})
    assert refs["B2"] == ("phdthesis", {"author": "Roe", "year": "1999", "title": "Thing", "school": "Uni"})
    assert refs["B3"] == ("incollection", {"title": "C", "booktitle": "Book"})
    (gloss,) = jats.glosses(doc)
    assert (gloss.number, gloss.letter, gloss.language) == ("1", "a", "Modern Portuguese")
    assert (gloss.words, gloss.gloss, gloss.translation, gloss.comment) == (["wa²", "ti"], ["go", "PL"], "‘They go.’", "Doe: 7")
    assert gloss.refs == [("B1", "7")]
    assert jats.pages("Doe 2001: [3]: 4") == "(3): 4"


#: Every field name that the reference maps, with its target; without one it is dropped.
FIELDS = """
journaltitle=journal ids=ids urldate= isbn=isbn subtitle=subtitle edition=edition type=type institution=institution shorttitle= month=
howpublished=howpublished issn=issn abstract= booksubtitle=booksubtitle issue=issue organization=organization venue=venue langid= annote=
annotation= language= numpages=pages stableurl=url addendum= shortauthor= chapter=chapter file= shortjournal=journal optaddress=
call-number= sortyear= lgcode=lgcode options= namea= maintitle= acmid= pubstate= opturl=url translator= eprint=eprint related= alnumcodes=
languoidbase_ids= numberofpages=pages day= bib= eventtitle=eventtitle optmonth= collaborator= optchapter= titleaddon= sortkey= serie=series
optnote= editors=editor relatedstring= lastchecked= issuetitle= optannote= bdsk-url-2= autheditor=editor biburl= opturldate= bdsk-file-2=
read= key=key bibsource= optkey= pagetotal=pages lccn=lccn origdate= sortauthor= optnumber= place=address issue_date= hyphenation=
urlaccessdate= adress=address archiveprefix= version=version eid= optlocation= eprinttype= page=pages lid= chaper=chapter
author-translation= rating= creationdate= opttype= bdsk-file-3= eventdate= price= booktitleaddon= collection= mendeley-groups= urlmonth=
urlday= vol=volume optseries=series inlg=inlg macro_area= pmid= interhash= intrahash= oldhhfn= src= pdf= editora=editor editoratype=
sorttitle= hhtype=hhtype city=address added-at= optaddendum= ozbib_id= volumes= hal_id= hal_version= bookauthor= xjournal= xpublisher=
xeditor= opteditor= ee= ozbibreftype= pubkey= originalyear= optpublisher= journalsubtitle= citeulike-article-id= posted-at= shorthand=
numer=number addres=address optxref= optvolume= groups= fn= annotate= aiatsis_callnumber= oclcid= url_checked= homepage= uselessnote=
more-editors= publishers=publisher citedin= optcrossref= optedition= primaryclass= rights=rights yaddress= booktitel=booktitle typ=
iso_code=lgcode olac_field=olac_field wals_code=wals_code oclc=oclc editorx= xisbn= aiatsis_code=aiatsis_code aiatsis_reference_language=
accessdate= institutions=institution issue_year= book= research_area= urlpage= optpages= quality= author-transl= origlanguage=
bootitle=booktitle bdsk-file-4= vols= optbooktitle= altauthor= optorganization= email= issuesubtitle= optvolumes= cfn= class_loc=
document_type= mpi_eva_library_shelf= optauthor= notes= ozbibnote= asjp_name= indexauthor= urlx= reprint= optsubtitle= opttitle=
mainsubtitle= issueeditor= anote= articleno= optschool= research_sub_area= urldsate= urlzip= origyear= postscript= editorbtype= nourl=
optshorthand= execute= urladte= eventvenue= optrelated= optrelatedtype= seriestitle= optassress= db= tags= affiliation= ean= status=
eidtor=editor publihers=publisher risfield_0_bt= paper= class= double_booktitle= numnber=number numbers=number publihser=publisher mpifn=
subject_headings= announced= paperbackoptisbn= pgaes=pages added= refdb_id= booktitle1= addresss=address annotex= issnx= publisherx=
venuedate= editior=editor priority= part=part dddress=address opttitleaddon= local-noopurl= annnote= publishing= utf_author= country=
subject= publication= institute=school sannote= tppubtype= scshool=school preis= opthowpublished= lastcheck= bdsk-file-5= bdsk-file-6=
bdsk-file-7= journa=journal source= unmatched-authority= dewey-call-number= library-id= size= etc= adderss=address addrss=address origtitle=
origlocation= local-url= misc= longnote= uuid= introduction= entrysubtype= optissn= verkauf= optyear= adsnote= adsurl= titel=title
optlanguage= publsher=publisher refid= websitetitle= booktile=booktitle arxivid= description= ris_reference_number= citeulike-linkout-0=
eventdatet= bdsk-url-3= bdsk-url-4= sssauthor= sssbooktitle= optstableurl= itemartakarmat= yomi= substitle=subtitle bdsk-url= types= noter=
orig_= title_english= alteditor= bookstitle=booktitle unidentified= sorname= scool=school bootktitle=booktitle note_original= abbrv=
confdate= xdoi= xurl= editorb= label= vollume=volume trad= library= elocation-id= pooktitle=booktitle attachments= shorteditor= xxxauthor=
pubisher=publisher translation= fnnote= autor=author modified= authauthor=author bdsk-url-1= optisbn= cited= comment= bilal= achilleos=
xmonth= xaddress= last_changed= urlyear= copyright=
"""


def test_citing_commands():
    assert tex.to_text(r"\scite{a}{b}").refs == [("b", "")]
    assert tex.to_text(r"\fatcit{a}{b}").refs == tex.to_text(r"\blockcquote{A}{b}").refs == [("a", "b")]
    assert tex.to_text(r"\langinfo{L}{F}{Doe1999}").refs == [("doe1999", "")]
    assert tex.to_text(r"\langinfo{L}{F}{\citet[1]{D}}").refs == [("d", "1")]
    assert "pangloss-doi" in tex.to_text(r"\japhdoi{doi}").text
    assert tex.plain(r"\href{..}") == r"\href{..}" and tex.plain(r"\href{u}{x}") == "u"


def test_rewritten_tex():
    assert tex.rewritten(r"\langinfobreak{}{}{} {\db}{\db}{\db}a {\db}{\db}b \textsc{id}:x \glossN. \hfill [\href{u}c]") == r"\langinfo{}{}{} [[[a [[b x \glossN{}."


@pytest.mark.parametrize("given, want", [
    ("Roe, Ann, Doe, Jo", "Roe, Ann and Doe, Jo"), ("Ann Roe, Jo B. Doe, Al Moe,", "Ann Roe and Jo B. Doe and Al Moe"), ("Roe, Ann, Jo Doe, Al Moe", "Roe, Ann and Jo Doe and Al Moe"),
    ("Roe, Ann, & Doe, Jo", "Roe, Ann and Doe, Jo"), (r"Roe, Ann \& Doe, Jo", "Roe, Ann and Doe, Jo"), ("Roe, Ann A., Jr.,", "Roe, Ann A. Jr."), ("Roe, Jr., Ann", "Roe, Jr., Ann"),
    ("Roe, Ann and family=Doe, given=Jo", "Roe, Ann and Doe, Jo"), ("Roe, Ann", "Roe, Ann"), ("Ann Roe", "Ann Roe")])
def test_lists_of_names(given, want):
    assert bib.mended_names(given) == want


def test_slips_in_bibtex():
    text = "@book{a,\n _orig = {x},\n --Author = {y},\n% title = {no},\n title = {T},%12\n}\n@book{{French}b, title={U}}\n@Article{, title={V}}\n@book{c, crossref = {coling98}}"
    got = {k: f for k, _, f in bib.parse_bibtex(text)}
    assert got == {"a": {"orig": "x", "xxauthor": "y", "title": "T"}, "French_b": {"title": "U"}, "undefined": {"title": "V"}, "c": {"crossref": "Branco98a"}}


def test_all_field_names():
    known = dict(x.split("=") for x in FIELDS.split())
    assert len(known) == 348
    for name, target in known.items():
        assert bib.to_source("k", "book", {name: "v"}, str)[2] == ({target: "v"} if target else {}), name
        if target and target != name:
            assert bib.to_source("k", "book", {name: "v", target: "w"}, str)[2] == {target: "w"}, name


def test_alike_is_similarity_at_a_threshold():
    rng = random.Random(5)
    say = lambda: "".join(rng.choice("abC é,") for _ in range(rng.randint(0, rng.choice((4, 30, 90)))))
    found = []
    for _ in range(3000):
        a, threshold = say(), rng.choice((0, 50, 80, 92, 100))
        words, letters = a.split(), list(a)
        for _ in range(rng.randint(0, min(6, len(a)))):
            letters[rng.randrange(len(a))] = rng.choice("abx ")
        b = rng.choice((say(), "".join(letters), " ".join(rng.sample(words, len(words)))))
        assert bib.alike(a, b, threshold) == (bib.similarity(a, b) >= threshold), (a, b, threshold)
        assert bib.ratio(a, b) == bib.ratio(b, a)
        found.append(bib.alike(a, b, threshold))
    assert 300 < sum(found) < 2700
