"""Bibliographic keys, slugs, similarity and BibTeX text.

Unicode folding isn't a Spark function, so these are plain functions with vectorized
wrappers; everything that can be an expression is in text.py.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters that have no decomposition.
_FOLD = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L",
                       "ı": "i", "þ": "th", "Þ": "Th", "ð": "d", "’": "'", "–": "-", "—": "-", "ŋ": "n", "ə": "e", "ɛ": "e", "ɔ": "o"})
_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"})
_NFC_DASH = "–"
_NOT_SLUG = bytes(set(range(128)) - set(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def ascii_fold(s: str) -> str:
    """s in ASCII: marks go, ligatures are spelled out, what can't be folded is dropped."""
    s = unicodedata.normalize("NFKD", s.translate(_FOLD))
    return s.encode("ascii", "ignore").decode()


def slug(s: str) -> str:
    return (s if s.isascii() else ascii_fold(s)).encode().lower().translate(None, _NOT_SLUG).decode()


def normalize_key(k: str) -> str:
    """Citation keys compare in lower case, composed, with en dashes as two hyphens."""
    return unicodedata.normalize("NFC", k.replace(_NFC_DASH, "--").lower())


def names(creators: str) -> list[tuple[str, str, str]]:
    """(given, particle, last) of each name of a BibTeX list."""
    out = []
    for name in re.split(r"\s+and\s+", creators.strip()):
        if not name:
            continue
        if "," in name:
            last, given = (x.strip() for x in name.split(",", 1))
        else:
            parts = name.split()
            k = len(parts) - 1
            while k > 1 and parts[k - 1][:1].islower():
                k -= 1
            last, given = " ".join(parts[k:]), " ".join(parts[:k])
        parts = last.split()
        n = 0
        while n < len(parts) - 1 and parts[n][:1].islower():
            n += 1
        out.append((given, " ".join(parts[:n]), " ".join(parts[n:])))
    return out


def make_key(author: str, editor: str, year: str) -> str:
    """name:name-yy with at most two names; :etal for more, :ed for editors, np and nd for none."""
    who = names(author or "") or names(editor or "")
    key = ":".join((p + last) for _, p, last in who[:2]) if who else "np"
    if len(who) > 2:
        key += ":etal"
    if who and not names(author or ""):
        key += ":ed"
    found = re.search("[0-9]{4}", year or "")
    key += ":" + (found[0][2:] if found else "nd")
    for a, b in (('"=', "-"), ("?", "na")):
        key = key.replace(a, b)
    key = ascii_fold(re.sub(r"[`{}\[\]&]", "", key).translate(_UMLAUTS))
    return re.sub(r"[,/.'()= ]", "", key).lower()


#: Letters after which _common looks whether it can still reach what it needs.
_LOOK = 32


def _common(a: str, b: str, need: int = 0) -> int:
    """Length of the longest common subsequence, with a bit for each letter of the longer text.

    Less than ``need`` if it is less than that, but then not the length itself.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(b) < need:
        return len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for at in range(0, len(b), _LOOK):
        for c in b[at : at + _LOOK]:
            u = s & masks.get(c, 0)
            s = (s + u | s - u) & full
        most = len(a) - s.bit_count() + max(0, len(b) - at - _LOOK)
        if most < need:
            return most
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> int:
    """Similarity 0 to 100 by insertions and deletions."""
    total = len(a) + len(b)
    return round(200 * _common(a, b) / total) if total else 100


def token_set_ratio(a: str, b: str) -> int:
    """Similarity of the words that texts share and of what is left; 100 if one's words are all in the other."""
    x, y = (set(re.findall(r"\w+", s.lower())) for s in (a, b))
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    return max(ratio(left, right), ratio(both, left) if both else 0, ratio(both, right) if both else 0)


def similarity(a: str, b: str) -> int:
    return max(ratio(a, b), token_set_ratio(a, b))


def _reach(common: int, total: int, threshold: int) -> bool:
    return (round(200 * common / total) if total else 100) >= threshold


def _ratio_reaches(a: str, b: str, threshold: int, shared: int = 0) -> bool:
    """ratio() >= threshold, for texts that both begin with ``shared`` more letters."""
    total = len(a) + len(b) + 2 * shared
    if not _reach(min(len(a), len(b)) + shared, total, threshold):
        return False
    need = max(0, int((threshold - 0.5) * total / 200) - 2)
    while not _reach(need, total, threshold):
        need += 1
    return _common(a, b, need - shared) >= need - shared


def alike(a: str, b: str, threshold: int) -> bool:
    """similarity() >= threshold, without counting further than that takes."""
    x, y = (set(re.findall(r"\w+", s.lower())) for s in (a, b))
    if x and y:
        shared = x & y
        if shared and (x <= y or y <= x):
            return threshold <= 100 or _ratio_reaches(a, b, threshold)
        both = len(" ".join(shared))
        left, right = (" ".join(sorted(s - shared)) for s in (x, y))
        gap = bool(shared)  # what is shared is where both begin, so common as a whole
        if shared and any(_reach(both, 2 * both + 1 + len(s), threshold) for s in (left, right)):
            return True
        if _ratio_reaches(left, right, threshold, both + gap):
            return True
    return _ratio_reaches(a, b, threshold)


def similar_titles(threshold: int = 92) -> Callable[[Column, Column], Column]:
    """A condition on two title columns; pairs are counted no further than tells them apart."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and alike(x, y, threshold) for x, y in zip(a, b, strict=True)], dtype=bool)

    return lambda a, b: (a == b) | similar(a, b)


@F.pandas_udf(StringType())
def slug_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: slug(x or ""))


@F.pandas_udf(StringType())
def normalize_key_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else normalize_key(x))


@F.pandas_udf(StringType())
def make_key_udf(author: pd.Series, editor: pd.Series, year: pd.Series) -> pd.Series:
    return pd.Series([make_key(*x) for x in zip(author, editor, year, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def last_names_slug_udf(author: pd.Series, editor: pd.Series) -> pd.Series:
    return pd.Series([slug("".join(last for _, _, last in (names(a or "") or names(e or ""))[:1])) for a, e in zip(author, editor, strict=True)], dtype=object)


# BibTeX text -------------------------------------------------------------------------

#: Fields that say nothing about a work, and other names for fields that do; the first alias in an entry wins.
DROPPED = frozenset("""
    date-added
    abbrv abstract accessdate achilleos acmid added added-at addendum adsnote adsurl affiliation aiatsis_callnumber aiatsis_reference_language
    alnumcodes altauthor alteditor annnote annotate annotation annote annotex announced anote archiveprefix articleno arxivid asjp_name
    attachments author-transl author-translation bdsk-file-2 bdsk-file-3 bdsk-file-4 bdsk-file-5 bdsk-file-6 bdsk-file-7 bdsk-url bdsk-url-1
    bdsk-url-2 bdsk-url-3 bdsk-url-4 bib bibsource biburl bilal book bookauthor booktitle1 booktitleaddon call-number cfn cited citedin
    citeulike-article-id citeulike-linkout-0 class class_loc collaborator collection comment confdate copyright country creationdate day db
    description dewey-call-number document_type double_booktitle ean editoratype editorb editorbtype editorx ee eid elocation-id email
    entrysubtype eprinttype etc eventdate eventdatet eventvenue execute file fn fnnote groups hal_id hal_version homepage hyphenation
    indexauthor interhash intrahash introduction issnx issue_date issue_year issueeditor issuesubtitle issuetitle itemartakarmat journalsubtitle
    label langid language languoidbase_ids last_changed lastcheck lastchecked library library-id lid local-noopurl local-url longnote macro_area
    mainsubtitle maintitle mendeley-groups misc modified month more-editors mpi_eva_library_shelf mpifn namea note_original noter notes nourl
    oclcid oldhhfn optaddendum optaddress optannote optassress optauthor optbooktitle optchapter optcrossref optedition opteditor
    opthowpublished options optisbn optissn optkey optlanguage optlocation optmonth optnote optnumber optorganization optpages optpublisher
    optrelated optrelatedtype optschool optshorthand optstableurl optsubtitle opttitle opttitleaddon opttype opturldate optvolume optvolumes
    optxref optyear orig_ origdate originalyear origlanguage origlocation origtitle origyear ozbib_id ozbibnote ozbibreftype paper
    paperbackoptisbn pdf pmid posted-at postscript preis price primaryclass priority pubkey publication publisherx publishing pubstate quality
    rating read refdb_id refid related relatedstring reprint research_area research_sub_area ris_reference_number risfield_0_bt sannote
    seriestitle shortauthor shorteditor shorthand shorttitle size sorname sortauthor sortkey sorttitle sortyear source src sssauthor
    sssbooktitle status subject subject_headings tags title_english titleaddon tppubtype trad translation translator typ types unidentified
    unmatched-authority url_checked urlaccessdate urladte urldate urlday urldsate urlmonth urlpage urlx urlyear urlzip uselessnote utf_author
    uuid venuedate verkauf vols volumes websitetitle xaddress xdoi xeditor xisbn xjournal xmonth xpublisher xurl xxxauthor yaddress yomi
""".split())
RENAMED = {alias: name for name, aliases in {
    "address": "place adress city addres addresss dddress adderss addrss",
    "author": "autor authauthor",
    "booktitle": "booktitel bootitle booktile bookstitle bootktitle pooktitle",
    "chapter": "chaper",
    "editor": "editors autheditor editora eidtor editior",
    "institution": "institutions",
    "journal": "journaltitle shortjournal journa",
    "lgcode": "iso_code",
    "number": "numer numnber numbers",
    "pages": "numpages numberofpages pagetotal page pgaes",
    "publisher": "publishers publihers publihser publsher pubisher",
    "school": "institute scshool scool",
    "series": "serie optseries",
    "subtitle": "substitle",
    "title": "titel",
    "url": "stableurl opturl",
    "volume": "vol vollume",
}.items() for alias in aliases.split()}
GENRES = {"thesis": "phdthesis", "report": "techreport", "online": "misc", "electronic": "misc", "www": "misc", "mvbook": "book",
          "mvcollection": "collection", "inreference": "incollection", "periodical": "misc", "patent": "misc"}


#: Slips in BibTeX files and what they stand for: names of fields, comments, keys.
_SLIPS = [(re.compile(a, re.M), b) for a, b in (
    (r"^\s*_orig\s*=", "orig ="),
    (r"^\s*@(?:Note|Abstract|Comments?)\s*=", "xnote ="),
    (r"^\s*__[mM](?:arkedentry|ARKEDENTRY)\s*=", "markedentry ="),
    (r"^\s*__publisher\s*=", "publisher ="),
    (r"^\s*--(Address|Author)\s*=", r"xx\1 ="),
    (r"^\s*%.*$", ""),
    (r",%(?:Undefined\?|[nN]ame is not available|[0-9a-z]*)$", ","),
    (r"\}%,", "},"),
    (r"@([a-z]+)\{\{(English|French|vedic)\}", r"@\1{\2_"),
    (r"(crossref\s*=\s*\{)dryhaspWALS\}", r"\1wals}"),
    (r"(crossref\s*=\s*\{)coling98\}", r"\1Branco98a}"),
    (r"@book:1997\s*\{foley,", "@book{foley:1997,"),
    (r"@Article\{,", "@Article{undefined,"),
    (r"(@\w+\{)(Rep)ú(blicadelParaguay2001,)", r"\1\2u\3"),
    (r"@book\{Kury\\l\{\}owicz1973", "@book{kurylowicz1973"),
)]


def mended(text: str) -> str:
    text = text.replace("\u00a0", " ").replace("{\\{AA}}", "{\\AA}").replace("{L\\{", "{L{\\").replace("{{\\{", "{{{")
    for slip, meant in _SLIPS:
        text = slip.sub(meant, text)
    return text


def mended_names(value: str) -> str:
    """A list of names with 'and' between them, where commas, ampersands or named parts stand in its place."""
    value = re.sub(r"family=([^,]+),\s*given=([^,]+?)(?=\s+and\s|\s*$)", r"\1, \2", value)
    value = re.sub(r",?\s*\\?&\s*", " and ", value).rstrip(" ,")
    if " and " in value or value.count(",") < 2:
        return value
    parts = [p.strip() for p in value.split(",") if p.strip()]
    if len(parts) == 3 and re.fullmatch(r"[JS]r\.?|I+V?", parts[1] if re.fullmatch(r"[JS]r\.?|I+V?", parts[1]) else parts[2]):
        return value if parts[2] not in ("Jr.", "Sr.", "Jr", "Sr") else f"{parts[0]}, {parts[1]} {parts[2]}"
    if all(" " in p for p in parts):
        return " and ".join(parts)
    if all(" " in p for p in parts[2:]):
        return " and ".join([f"{parts[0]}, {parts[1]}", *parts[2:]])
    if len(parts) % 2 == 0:  # last, first, last, first
        return " and ".join(f"{a}, {b}" for a, b in zip(parts[::2], parts[1::2], strict=True))
    return value


def parse_bibtex(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(key, genre, fields) of each entry; @string macros are expanded, broken entries are skipped.

    Repeated keys stay. Field names are lower-cased; of a repeated field the last counts.
    """
    macros = {m: m for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()}
    out = []
    text = mended(text)
    for found in re.finditer(r"(?m)^[ \t]*@(\w+)\s*([{(])", text):
        kind, at = found[1].lower(), found.end()
        if kind in ("comment", "preamble"):
            continue
        try:
            if kind == "string":
                name, at = _name(text, at)
                macros[name.lower()], _ = _value(text, at, macros)
                continue
            out.append(_entry(text, at, kind, macros))
        except (IndexError, ValueError):
            continue
    return out


def _name(text: str, at: int) -> tuple[str, int]:
    found = re.compile(r"\s*([^\s=,{}()\"]+)\s*=\s*").match(text, at)
    if not found:
        raise ValueError("no field")
    return found[1], found.end()


def _entry(text: str, at: int, kind: str, macros: dict[str, str]) -> tuple[str, str, dict[str, str]]:
    found = re.compile(r"\s*([^,\s}]+)\s*(,|(?=[})]))").match(text, at)
    if not found:
        raise ValueError("no key")
    key, at, fields = found[1].replace("\\", ""), found.end(), {}
    while True:
        end = re.compile(r"[\s,]*").match(text, at).end()
        if text[end] in "})":
            return key, kind, fields
        name, at = _name(text, end)
        fields[name.lower()], at = _value(text, at, macros)


def _value(text: str, at: int, macros: dict[str, str]) -> tuple[str, int]:
    """A value: braced, quoted, a number, a macro, or several joined by #; a bare text runs to the comma."""
    parts = []
    while True:
        at = re.compile(r"\s*").match(text, at).end()
        if text[at] in '{"':
            close, depth, start = ("}" if text[at] == "{" else '"'), 0, at + 1
            at = start
            while depth or text[at] != close:
                depth += (text[at] == "{") - (text[at] == "}")
                at += 2 if text[at] == "\\" and text[at + 1] in '{}"' and close == "}" and text[at + 1] == '"' else 1
            parts.append(text[start:at])
            at += 1
        else:
            found = re.compile(r"[^,#}\n]+").match(text, at)
            if not found:
                raise ValueError("no value")
            word = found[0].strip()
            parts.append(macros.get(word.lower(), word))
            at = found.end()
        more = re.compile(r"\s*#").match(text, at)
        if not more:
            return re.sub(r"\s+", " ", "".join(parts)).strip(), at
        at = more.end()


def to_source(key: str, genre: str, fields: dict[str, str], plain: Callable[[str], str]) -> tuple[str, str, dict[str, str]]:
    """An entry with a normalized key, a plain genre and plain field values under their usual names."""
    genre = GENRES.get(genre.lower(), genre.lower())
    if genre == "phdthesis" and re.search(r"mathesis|M\.\s?A\.", fields.get("type", "")):
        genre, fields = "mastersthesis", {k: v for k, v in fields.items() if k != "type"}
    out: dict[str, str] = {}
    for name, value in fields.items():
        value = plain(value)
        for a, b in ("()", "{}"):
            if value.count(a) != value.count(b):
                value = value.replace(a, "").replace(b, "")
        if name in ("author", "editor"):
            value = mended_names(value.replace("[", "").replace("]", ""))
        out["year" if name.lower() == "date" else name.lower()] = value
    for name in list(out):
        if name in DROPPED:
            del out[name]
        elif name in RENAMED:
            value = out.pop(name)
            out.setdefault(RENAMED[name], value)
    return normalize_key(key), genre, out


def alternative_keys(fields: Column) -> Column:
    """Keys of the field ids, without repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.element_at(fields, F.lit("ids")), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def as_bibtex(key: Column, genre: Column, fields: Column) -> Column:
    """BibTeX text of an entry, field names padded to one width."""
    width = F.array_max(F.transform(F.map_keys(fields), lambda k: F.length(k)))
    lines = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(F.lit("  "), F.rpad(e["key"], width, " "), F.lit(" = {"), e["value"], F.lit("}")))
    return F.concat(F.lit("@"), genre, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def as_citation(fields: Column) -> Column:
    """Author. Year. Title. Source. as running text."""
    get = lambda *k: F.coalesce(*[F.element_at(fields, F.lit(x)) for x in k])
    place = F.concat_ws(": ", get("address"), get("publisher", "school"))
    where = F.concat_ws(" ", get("journal"), get("volume"))
    parts = [get("author", "editor"), get("year"), get("title"), F.concat(F.lit("In "), get("booktitle")), F.nullif(where, F.lit("")), F.nullif(place, F.lit(""))]
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))
