"""BibTeX entries to rows: a scanner that matches braces and goes on after an entry that is broken."""

from __future__ import annotations

import re
import unicodedata

from refloom.functions.cleanup import clean_text
from refloom.functions.citations import DOI_ITSELF

# Where a venue is looked for, in this order, and names that stand for further authors.
VENUE_FIELDS = ("journal", "booktitle", "school", "institution", "publisher", "howpublished")
OTHERS = frozenset({"others", "et al.", "et al"})
MONTHS = {m[:3]: m for m in "January February March April May June July August September October November December".split()}

_entry = re.compile(r"^[ \t]*@\s*([A-Za-z]+)\s*([{(])", re.M)
_key = re.compile(r"\s*([^,\s{}()=\"]+)\s*(,|(?=[})]))")
_field = re.compile(r"\s*([A-Za-z][\w:.+-]*)\s*=\s*")
_bare = re.compile(r"[^\s,{}()\"#]+")
_raw_key = re.compile(r"@\s*\w+\s*[{(]\s*([^,\s]+)")
_marks = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "d": "\u0323", "b": "\u0331", "k": "\u0328", "r": "\u030a"}
_accent = re.compile(r"\\([`'^~\"=.]|[uvHcdbkr](?![A-Za-z]))\s*(?:\{\s*(\\?[A-Za-z])\s*\}|(\\?[A-Za-z]))")
_letters = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "ı", "j": "ȷ", "&": "&", "%": "%", "$": "$", "#": "#", "_": "_"}
_letter = re.compile(r"\\(ss|ae|AE|oe|OE|aa|AA|[oOlLij](?![A-Za-z])|[&%$#_])(?:\{\}|\s+(?=\w)|)")


class Broken(Exception):
    """The entry can't be read."""


def latex_text(value: str) -> str:
    """Accents and special letters as characters; other commands stay."""

    def accented(m: re.Match) -> str:
        letter = (m[2] or m[3]).lstrip("\\")
        return unicodedata.normalize("NFC", letter + _marks[m[1]])

    return _letter.sub(lambda m: _letters[m[1]], _accent.sub(accented, value)).replace("~", " ").replace("--", "–") if "\\" in value else value


def one_line(value: str) -> str:
    return " ".join(clean_text(value).replace("{", "").replace("}", "").split())


def _braced(text: str, at: int, close: str) -> int:
    """The place after the bracket that closes the one before `at`; brackets of the other kind may stand inside."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == close and not depth:
            return i + 1
        if c == "{":
            depth += 1
        elif c == "}":
            if not depth:
                raise Broken
            depth -= 1
        i += 1
    raise Broken


def _value(text: str, at: int, strings: dict[str, str]) -> tuple[str, int]:
    """One field's value, whose parts # joins, and the place after it."""
    out = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            raise Broken
        if text[at] == "{":
            end = _braced(text, at + 1, "}")
            out.append(text[at + 1 : end - 1])
        elif text[at] == '"':
            end = _braced(text, at + 1, '"')
            out.append(text[at + 1 : end - 1])
        elif m := _bare.match(text, at):
            end = m.end()
            out.append(strings.get(m[0].lower(), MONTHS.get(m[0].lower(), m[0])))
        else:
            raise Broken
        rest = re.compile(r"\s*#").match(text, end)
        if not rest:
            return "".join(out), end
        at = rest.end()


def _fields(body: str, strings: dict[str, str]) -> tuple[dict[str, str], bool]:
    """The fields of an entry, the first of each name, and whether one is there twice."""
    out: dict[str, str] = {}
    twice, at = False, 0
    while body[at:].strip(" \t\r\n,"):
        while body[at] in " \t\r\n,":
            at += 1
        m = _field.match(body, at)
        if not m:
            raise Broken
        value, at = _value(body, m.end(), strings)
        twice |= m[1].lower() in out
        out.setdefault(m[1].lower(), value)
        if body[at:].strip() and not body[at:].lstrip().startswith(","):
            raise Broken
    return out, twice


def split_names(value: str) -> list[str]:
    """The names that `and` outside braces sets apart."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"[{}]|\s+and\s+", value):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif depth <= 0:
            out.append(value[start : m.start()])
            start = m.end()
    return [n for n in map(str.strip, [*out, value[start:]]) if n]


def _words(name: str) -> list[str]:
    """Words of a name; a braced group is part of one word."""
    return re.findall(r"(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|[^\s{}~])+", name)


def name_parts(name: str) -> tuple[str, str]:
    """(surname with its particles, given names) of a name in any of BibTeX's forms."""
    small = lambda w: w[:1].islower()
    sections = [s.strip() for s in re.split(r",(?![^{]*\})", name)]
    if len(sections) > 1:
        return one_line(sections[0]), one_line(sections[-1])
    words = _words(name)
    if not words:
        return "", ""
    first = next((i for i, w in enumerate(words[:-1]) if small(w)), len(words) - 1)
    return one_line(" ".join(words[first:])), one_line(" ".join(words[:first]))


def entry_fields(kind: str, fields: dict[str, str]) -> dict:
    """A row of `refloom.schema.FIELDS`; whatever is there is sure."""
    text = {k: one_line(latex_text(v)) for k, v in fields.items() if k not in ("author", "editor")}
    people = [name_parts(latex_text(n)) for n in split_names(fields.get("author") or fields.get("editor") or "")]
    authors = [{"surname": s, "given": g} for s, g in people if s and s.lower() not in OTHERS]
    years = [m[1] for k in ("year", "date") if k in text and (m := re.search(r"\b(\d{4})\b", text[k]))]
    out = {
        "title": text.get("title") or None, "authors": authors, "et_al": any(s.lower() in OTHERS for s, _ in people), "year": int(years[0]) if years else None,
        "venue": next((text[k] for k in VENUE_FIELDS if text.get(k)), None), "doi": named[1].lower() if (named := re.search(DOI_ITSELF, text.get("doi", ""), re.IGNORECASE)) else None, "entry_type": kind,
    }
    return out | {"confidence": {k: 1.0 if out[k] else 0.0 for k in ("title", "authors", "year", "venue", "doi")}}


# Warnings.
BROKEN_ENTRY = "Line {line}: entry could not be parsed (BibTeX syntax error); marked UNPARSEABLE."
REPEATED_KEY = "Line {line}: duplicate citation key '{key}'; both entries are checked."
REPEATED_FIELD = "Line {line}: entry '{key}' repeats a field; only one of the values is used."
EMPTY = {"title": None, "authors": [], "et_al": False, "year": None, "venue": None, "doi": None, "entry_type": None, "confidence": dict.fromkeys(("title", "authors", "year", "venue", "doi"), 0.0)}


def parse_bibtex(text: str) -> tuple[list[dict], list[str]]:
    """(references, warnings). A broken entry is a reference without fields; of a repeated key both entries stay."""
    strings: dict[str, str] = {}
    rows: list[dict] = []
    warnings: list[str] = []
    seen: set[str] = set()
    heads = list(_entry.finditer(text))
    after = 0
    for i, head in enumerate(heads):
        if head.start() < after:
            continue  # inside a value of the entry before
        kind, line = head[1].lower(), text.count("\n", 0, head.start() + len(head[0]) - len(head[0].lstrip())) + 1
        limit = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        try:
            end = _braced(text, head.end(), "}" if head[2] == "{" else ")")
            if end > limit and re.search(r"\n\s*@", text[head.end() : end]):
                raise Broken  # a bracket is missing, and another entry's closed this one
            body, after = text[head.end() : end - 1], end
            if kind == "string":
                strings |= _fields(body, strings)[0]
            if kind in ("string", "comment", "preamble"):
                continue
            key = _key.match(body)
            if not key:
                raise Broken
            fields, twice = _fields(body[key.end() :], strings)
        except Broken:
            if kind in ("string", "comment", "preamble"):
                continue
            raw, after = text[head.start() : limit], head.end()
            warnings.append(BROKEN_ENTRY.format(line=line))
            named = _raw_key.search(raw)
            rows.append({"raw": one_line(raw), "key": named[1] if named else None, "line": line, "fields": EMPTY})
            continue
        if key[1] in seen:
            warnings.append(REPEATED_KEY.format(line=line, key=key[1]))
        elif twice:
            warnings.append(REPEATED_FIELD.format(line=line, key=key[1]))
        seen.add(key[1])
        rows.append({"raw": one_line(text[head.start() : end]), "key": key[1], "line": line, "fields": entry_fields(kind, fields)})
    return [{"idx": i, **r} for i, r in enumerate(rows, 1)], warnings
