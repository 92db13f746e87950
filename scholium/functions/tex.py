r"""TeX to plain text: a tolerant reader of commands and groups.

Commands fall in classes: symbols, accents, those that show one of their arguments,
those that show nothing, footnotes, links and citations. An unknown command shows its
arguments. Tables can be extended by the caller.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from scholium.functions.macros import ABBREVIATIONS, MACROS

#: LaTeX accent commands as combining characters.
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "H": "\u030b", "c": "\u0327", "k": "\u0328", "=": "\u0304",
           "b": "\u0331", ".": "\u0307", "d": "\u0323", "r": "\u030a", "u": "\u0306", "v": "\u030c"}
SYMBOLS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "aa": "å", "AA": "Å", "ng": "ŋ",
           "dh": "ð", "th": "þ", "textquoteleft": "‘", "textquoteright": "’", "textquotedblleft": "“", "textquotedblright": "”", "ldots": "…", "dots": "…",
           "textendash": "–", "textemdash": "—", "emptyset": "∅", "textschwa": "ə", "textglotstop": "ʔ", "rightarrow": "→", "leftarrow": "←", "textbackslash": "\\",
           "S": "§", "P": "¶", "pm": "±", "times": "×", "alpha": "α", "beta": "β", "gamma": "γ", "slash": "/", "db": "[[", "quad": " ", "qquad": " ", "newline": "\n", "particle": "PARTICLE"} | MACROS | ABBREVIATIONS
UPPER = {"textsc", "textupsc", "textscl", "sc", "gsc", "tsc", "Sc", "gloss", "feat", "glossfeat", "ig", "mc"}
FIRST = {"mbox", "textup", "textit", "textbf", "emph", "uline", "ulp", "ulg", "ref", "ili", "text", "textrm", "textsf", "texttt", "underline"}
SECOND = {"linieb", "textcolor", "colorbox", "parbox"}
NOTHING = {"il": 1, "is": 1, "ist": 1, "it": 0, "ia": 1, "ix": 1, "label": 1, "index": 1, "llap": 1, "vspace": 1, "hspace": 1, "phantom": 1, "dline": 3, "ux": 1, "ilt": 1, "REF": 1,
           "hfill": 0, "noindent": 0, "small": 0, "footnotesize": 0, "scshape": 0, "itshape": 0, "bfseries": 0, "upshape": 0, "normalfont": 0, "centering": 0, "relax": 0}
NOTES = {"footnote", "footnotetext"}
#: Citations whose first argument is the key and whose second the page.
QUOTED = {"fatcit", "fatcitNP", "blockcquote"}
CITES = re.compile(r"[a-zA-Z]*[cC]ite[a-zA-Z]*\Z")


@dataclass
class Text:
    """Plain text with the footnotes and (key, pages) citations that were in it."""

    text: str
    notes: list[str] = field(default_factory=list)
    refs: list[tuple[str, str]] = field(default_factory=list)


class _Reader:
    def __init__(self, tex: str, abbreviations: frozenset[str], keep_notes: bool):
        self.tex, self.at, self.abbreviations, self.keep_notes = tex, 0, abbreviations, keep_notes
        self.notes: list[str] = []
        self.refs: list[tuple[str, str]] = []

    def group(self, close: str = "") -> str:
        """Text up to the closing sign of this group, or to the end."""
        out: list[str] = []
        tex, n = self.tex, len(self.tex)
        while self.at < n:
            c = tex[self.at]
            self.at += 1
            if c == close:
                break
            if c == "\\":
                out.append(self.command())
            elif c == "{":
                inner = self.group("}")
                out.append(inner)
            elif c == "}":
                continue
            elif c == "%":
                end = tex.find("\n", self.at)
                self.at = n if end < 0 else end
            elif c == "~":
                out.append(" ")
            elif c == "$":
                continue
            else:
                out.append(c)
        return "".join(out)

    def space(self) -> None:
        while self.at < len(self.tex) and self.tex[self.at] in " \t":
            self.at += 1

    def argument(self) -> str:
        self.space()
        if self.at >= len(self.tex):
            return ""
        c = self.tex[self.at]
        self.at += 1
        if c == "{":
            return self.group("}")
        return self.command() if c == "\\" else c

    def options(self) -> list[str]:
        out = []
        while self.at < len(self.tex) and self.tex[self.at] == "[":
            self.at += 1
            out.append(self.group("]"))
        return out

    def cite(self, keys: str, pages: str) -> None:
        self.refs += [(k.strip().lstrip("&").strip().replace("–", "--").lower(), pages) for k in keys.split(",") if k.strip() and k.strip() != "["]

    def command(self) -> str:
        found = re.compile(r"[a-zA-Z]+\*?|.", re.S).match(self.tex, self.at)
        if not found:
            return ""
        name = found[0]
        self.at = found.end()
        word = name[0].isalpha()
        if not word and name in ACCENTS or word and name in ACCENTS and len(name) == 1 and self.at < len(self.tex) and self.tex[self.at] in " {\\":
            base = self.argument().replace("ı", "i").replace("ȷ", "j")
            return unicodedata.normalize("NFC", base[:1] + ACCENTS[name] + base[1:]) if base else ""
        if not word:
            return {"\\": "\n", ",": " ", ";": " ", ":": " ", "!": "", "-": "", "/": "", "@": ""}.get(name, name)
        name = name.rstrip("*")
        bare = self.tex[self.at : self.at + 1] != "{" and self.tex[self.at : self.at + 1] != "["
        if bare:
            self.space()
        if name in self.abbreviations:
            if self.tex.startswith("{}", self.at):
                self.at += 2
            return name.upper()
        if name in SYMBOLS:
            if self.tex.startswith("{}", self.at):
                self.at += 2
            return SYMBOLS[name]
        if name == "tss":
            return "." + self.argument().upper()
        if name in UPPER:
            return self.argument().upper()
        if name in NOTHING:
            for _ in range(NOTHING[name]):
                self.argument()
            return ""
        if name in NOTES:
            self.options()
            note = self.argument()
            if self.keep_notes and note.strip():
                self.notes.append(note.strip())
            return ""
        if name == "href":
            if not self.keep_notes and not re.match(r"\s*\{[^{}]*\}\s*\{", self.tex[self.at :]):
                raise ValueError("a link without text")
            url, shown = self.argument(), self.argument()
            return f"[{shown}]({url})" if self.keep_notes else url
        if name == "japhug":
            return f"{self.argument()} [{self.argument()}]"
        if name == "japhdoi":
            return f"https://doi.org/10.24397/pangloss-{self.argument()}"
        if name == "scite":
            self.argument()
            self.cite(self.argument(), "")
            return ""
        if name in QUOTED:
            keys, pages = self.argument(), self.argument()
            self.cite(keys, pages)
            return ""
        if name == "jambox":
            self.options()
            return self.argument()
        if name == "langinfo":
            shown, family = self.argument(), self.argument()
            self.cite(self.argument(), "")
            return " ".join(x for x in (shown.strip(), family.strip()) if x)
        if CITES.match(name):
            pages, keys = self.options(), self.argument()
            self.cite(keys, pages[-1].replace('"', "") if pages else "")
            return ""
        if name in SECOND:
            self.options()
            self.argument()
            return self.argument()
        if name in FIRST:
            self.options()
            return self.argument()
        if name in ("begin", "end"):
            self.argument()
            return ""
        self.options()
        out = []
        while self.at < len(self.tex) and self.tex[self.at] == "{":
            out.append(self.argument())
        return "".join(out)


def to_text(tex: str, abbreviations: frozenset[str] = frozenset()) -> Text:
    """Plain text, with footnotes and citations taken out of it."""
    reader = _Reader(tex.replace("{\\sc ", "{\\scshape "), abbreviations, True)
    text = reader.group()
    return Text(re.sub(r"[ \t]+", " ", text).strip(), reader.notes, reader.refs)


def plain(tex: str) -> str:
    """Plain text of a bibliographic field; a text that can't be read stays as it is."""
    try:
        return re.sub(r"\s+", " ", _Reader(tex, frozenset(), False).group()).strip()
    except (RecursionError, ValueError):
        return tex


def strip_comment(line: str) -> str:
    """A line up to its first unescaped %."""
    if "\\\\%" in line:
        return line.split("\\\\%", 1)[0] + "\\\\"
    return re.sub(r"(?<!\\)%.*", "", line, flags=re.S).replace("\\%", "%")


def rewritten(tex: str) -> str:
    r"""A source with what would hinder reading examples put plainly: synonyms, runs of \db, links at the right margin."""
    tex = re.sub(r"\s*\\hfill\s*\[\\href\{[^}]+\}[^\]]*\]\s*\Z", "", tex)
    for written, meant in (("\\langinfobreak", "\\langinfo"), ("{\\db}" * 3, "[" * 3), ("{\\db}" * 2, "[" * 2), ("\\textsc{id}:", ""), ("\\glossN.", "\\glossN{}.")):
        tex = tex.replace(written, meant)
    return tex


_MANY = re.compile(r"\\(?:paren|text)?cites((?:(?:\[[^\]]*\]){0,2}\{[^}]*\})+)")


def normalize_citations(tex: str) -> str:
    r"""Citations as \cite[pages]{key}: broken lines joined, lists of citations taken apart, variants renamed."""
    tex = re.sub(r"(\\[a-zA-Z]*[cC]ite[a-zA-Z]*\*?(?:\[[^\]]*\])*)\s*\n\s*\{", r"\1{", tex)

    def apart(m: re.Match) -> str:
        return " ".join("\\cite" + (f"[{o[-1]}]" if (o := re.findall(r"\[([^\]]*)\]", one)) else "") + "{" + re.search(r"\{([^}]*)\}", one)[1] + "}"
                        for one in re.findall(r"(?:\[[^\]]*\])*\{[^}]*\}", m[1]))

    return re.sub(r"\\[a-zA-Z]*[cC]ite[a-zA-Z]*\*?(?=[\[{])", r"\\cite", _MANY.sub(apart, tex))


def citation_keys(tex: str) -> list[str]:
    return [k.strip() for m in re.finditer(r"\\cite(?:\[[^\]]*\])*\{([^}]*)\}", normalize_citations(tex)) for k in m[1].split(",") if k.strip()]
