"""Article XML: mixed text, references, abbreviations, glossed examples and metadata."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

_PLAIN = "0123456789+-=()"
_SUP, _SUB = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"
RAISED = dict(zip(_PLAIN, _SUP, strict=True)) | {"n": "ⁿ", "i": "ⁱ", "h": "ʰ", "w": "ʷ", "j": "ʲ"}
LOWERED = dict(zip(_PLAIN, _SUB, strict=True)) | {"a": "ₐ", "e": "ₑ", "o": "ₒ", "i": "ᵢ", "j": "ⱼ", "n": "ₙ"}
SKIPPED = {"table-wrap", "disp-formula", "list", "fn"}


def parse(text: str) -> ET.Element:
    """The root of a document; the one HTML entity that articles use is a character."""
    return ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text.replace("&nbsp;", "&#160;")))


def _moved(s: str, table: dict[str, str]) -> str:
    return "".join(table[c] for c in s) if all(c in table for c in s) else ""


def text(e: ET.Element | None) -> str:
    """Text of mixed content: small capitals as capitals, raised and lowered signs as such, no tables."""
    if e is None:
        return ""
    out = [e.text or ""]
    for child in e:
        inner = text(child) if child.tag in ("italic", "bold", "sc", "p", "underline", "styled-content", "xref", "ext-link", "named-content") else child.text or ""
        if child.tag == "sc":
            inner = inner.upper()
        elif child.tag == "sup":
            inner = _moved(inner, RAISED)
        elif child.tag == "sub":
            inner = _moved(inner, LOWERED)
        elif child.tag in SKIPPED:
            inner = ""
        out += [inner, child.tail or ""]
    return "".join(out)


def squeezed(e: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", text(e)).strip()


def cited(doc: ET.Element) -> list[str]:
    """Keys of the references that a document cites, as often as it does."""
    return [x.get("rid") for x in doc.iter("xref") if x.get("ref-type") == "bibr" and x.get("rid")]


def pages(label: str) -> str:
    """What follows the first colon of a citation's label."""
    _, colon, rest = label.partition(":")
    return rest.replace("[", "(").replace("]", ")").strip() if colon else ""


def language_name(e: ET.Element) -> str | None:
    """A language's name from a heading: what comes before a bracket or lowered mark, unless it is quoted."""
    shown = squeezed(e)
    if not shown or shown[0] in "‘“'\"`":
        return None
    for child in e:
        if child.tag == "sub":
            head = re.sub(r"\s+", " ", (e.text or "")).strip() or " ".join(squeezed(x) for x in child if x.tag in ("sc", "italic")) or squeezed(child)
            shown = head or re.sub(r"\s+", " ", "".join(child.itertext())).strip()
            break
    shown = shown.split("(")[0].strip()
    return " ".join(w[:1].upper() + w[1:].lower() for w in shown.split()) or None


def abbreviations(doc: ET.Element) -> dict[str, str]:
    """Abbreviations of the section of that title: small capitals start one, the text after them defines it."""
    out: dict[str, str] = {}
    for sec in doc.iter("sec"):
        if squeezed(sec.find("title")).lower() != "abbreviations":
            continue
        for p in sec.iter("p"):
            for e in p:
                if e.tag == "sc" and (abbr := squeezed(e).upper()):
                    definition = re.sub(r"^[\s=:]+|[\s,;.]+$", "", e.tail or "")
                    if definition:
                        out[abbr] = definition
    return out


GENRES = {"journal": "article", "confproc": "inproceedings", "conf-proc": "inproceedings", "cofproc": "inproceedings", "webpage": "online", "/label": "misc"}
_COPIED = (("volume", "volume"), ("issue", "number"), ("series", "series"), ("comment", "note"), ("conf-name", "eventtitle"), ("conf-loc", "address"), ("conf-sponsor", "publisher"),
           ("publisher-loc", "address"), ("publisher-name", "publisher"))


def names(parent: ET.Element) -> str:
    out = []
    for n in parent.iter():
        if n.tag in ("name", "string-name"):
            last, given = squeezed(n.find("surname")), squeezed(n.find("given-names"))
            if last:
                out.append(f"{last}, {given}" if given else last)
    return " and ".join(out)


def reference(ref: ET.Element) -> tuple[str, str, dict[str, str]] | None:
    """(id, genre, fields) of a reference; later elements overwrite what earlier ones gave."""
    cite = next((ref.find(t) for t in ("element-citation", "mixed-citation") if ref.find(t) is not None), None)
    if cite is None or not ref.get("id"):
        return None
    kind = cite.get("publication-type") or "misc"
    genre, fields = GENRES.get(kind, kind), {}
    for group in cite.iter("person-group"):
        if who := names(group):
            fields["editor" if group.get("person-group-type") == "editor" else "author"] = who
    direct = [n for n in cite if n.tag == "string-name"]
    if direct:
        holder = ET.Element("x")
        holder.extend(direct)
        fields["author"] = names(holder) or fields.get("author", "")
    get = lambda tag: squeezed(cite.find(tag))
    for tag, name in (("year", "year"), ("edition", "edition"), ("uri", "url")):
        if get(tag):
            fields[name] = get(tag)
    if get("fpage"):
        fields["pages"] = "-".join(filter(None, [get("fpage"), get("lpage")]))
    for pub in cite.iter("pub-id"):
        if pub.get("pub-id-type") == "doi":
            fields["doi"] = squeezed(pub)
    if get("article-title"):
        fields["title"] = get("article-title")
    if get("chapter-title"):
        genre, fields["title"] = "incollection", get("chapter-title")
    if source := get("source"):
        fields["booktitle" if genre == "incollection" else "journal" if genre == "article" else "title"] = source
    for name in ("title", "journal", "booktitle"):
        if re.search(r"\.\s*doctoral dissertation$", fields.get(name, ""), re.I):
            genre, fields[name] = "phdthesis", re.sub(r"(?i)\.\s*doctoral dissertation$", "", fields[name])
    whole = " ".join("".join(cite.itertext()).split()).lower()
    if cite.tag == "mixed-citation":
        if "doctoral dissertation" in whole:
            genre = "phdthesis"
        elif "ma dissertation" in whole or "ma thesis" in whole:
            genre = "mastersthesis"
    for tag, name in _COPIED:
        if get(tag):
            fields[name] = get(tag)
    if "thesis" in genre and "publisher" in fields:
        fields["school"] = fields.pop("publisher")
    return ref.get("id"), genre, {k: v for k, v in fields.items() if v}


def references(doc: ET.Element) -> list[tuple[str, str, dict[str, str]]]:
    return [r for refs in doc.iter("ref-list") for ref in refs.findall("ref") if (r := reference(ref))]


@dataclass
class Gloss:
    number: str
    letter: str
    language: str | None
    words: list[str]
    gloss: list[str]
    translation: str
    comment: str | None
    refs: list[tuple[str, str]] = field(default_factory=list)


def _typed(e: ET.Element, kind: str) -> list[ET.Element]:
    return [x for x in e.iter("list") if x.get("list-type") == kind]


def _refs(e: ET.Element) -> list[tuple[str, str]]:
    return [(x.get("rid"), pages(squeezed(x))) for x in e.iter("xref") if x.get("ref-type") == "bibr" and x.get("rid")]


def glosses(doc: ET.Element) -> list[Gloss]:
    """Glossed examples in document order; of equal words the first example stays.

    Number, letter, language and citations carry on until a new number.
    """
    out: list[Gloss] = []
    seen: set[str] = set()
    for top in _typed(doc, "gloss"):
        if any(x is not top for x in _typed(top, "gloss")):
            continue
        number = letter = ""
        language: str | None = None
        refs: list[tuple[str, str]] = []
        for cell in _typed(top, "wordfirst"):
            shown = squeezed(cell.find("list-item"))
            if m := re.fullmatch(r"\(([0-9]+|[iv]+)\)", shown):
                if number:
                    letter, language, refs = "", None, []
                number = m[1]
            elif m := re.fullmatch(r"([a-z])\.", shown):
                letter = m[1]
                break
        for sentence in _typed(top, "sentence-gloss"):
            finals = _typed(sentence, "final-sentence")
            words = _typed(sentence, "word")
            if finals and len(finals[0].findall("list-item")) == 1 and not words:
                item = finals[0].find("list-item")
                name = language_name(item.find("p") if item.find("p") is not None else item)
                if name and len(name) > 1 and name[0].isupper():
                    language = name
                refs = refs + _refs(finals[0])
                continue
            if not words or next(sentence.iter("inline-graphic"), None) is not None:
                continue
            tiers = [[squeezed(p) for item in w.findall("list-item") for p in item.findall("p")] for w in words]
            if any(len(t) != 2 for t in tiers):
                continue
            said, comment = "", None
            for final in finals:
                said = squeezed(final.find("list-item/p"))
                raw = text(final.find("list-item/p")) if final.find("list-item/p") is not None else ""
                if m := re.search(r"\s{2,}\(([^()]*)\)\s*$", raw):
                    comment, said = m[1], re.sub(r"\s+", " ", raw[: m.start()]).strip()
                refs = refs + _refs(final)
            plain = " ".join(a for a, _ in tiers)
            if plain in seen:
                continue
            seen.add(plain)
            out.append(Gloss(number, letter, language, [a for a, _ in tiers], [b for _, b in tiers], said, comment, refs))
    return out


def metadata(doc: ET.Element) -> dict[str, str]:
    """Title, DOI, creators, year, volume, issue and licence of an article; title and DOI must be there."""
    meta = doc.find(".//article-meta")
    if meta is None:
        raise ValueError("no metadata")
    doi = next((squeezed(x) for x in meta.iter("article-id") if x.get("pub-id-type") == "doi"), "")
    title = squeezed(meta.find(".//article-title"))
    if not doi or not title:
        raise ValueError("no DOI or title")
    authors = ET.Element("x")
    authors.extend(c for c in meta.iter("contrib") if c.get("contrib-type", "author") == "author")
    link = next((v for e in meta.iter("license") for k, v in e.attrib.items() if k.endswith("href")), "")
    return {"doi": doi, "title": title, "creators": names(authors), "year": squeezed(meta.find(".//pub-date/year")), "volume": squeezed(meta.find("volume")),
            "issue": squeezed(meta.find("issue")), "license": "CC-BY" if re.search(r"creativecommons\.org/licenses/by/", link) else ""}
