"""Free-text citations to fields. What patterns can say is a Spark expression: identifiers, noise, quoted titles, venues and entry types. Names, the choice of a year, and
where a title without quotation marks begins and ends come from one Arrow UDF, `refloom.functions.parsing.read`.

Java's classes are those of Unicode under (?U), as the fixed patterns expect.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.config import PARSE, Parse
from refloom.functions import parsing
from refloom.functions.text import letters
from refloom.schema import AUTHOR

# Patterns that decide what is noise, an identifier, a venue or an entry type.
DOI = r"\b10\.\d{4,9}/[^\s\"<>{}]+"
#: The same up to the last character that isn't closing punctuation.
DOI_ITSELF = r"\b(10\.\d{4,9}/(?=[^\s\"<>{}])[^\s\"<>{}]*(?<![.,;:)\]}'”]))"
DOI_PREFIX = r"(?:https?://(?:dx\.)?doi\.org/|\bdoi\s*:\s*)"
URL = r"(?:https?://|\bwww\.)\S+"
ACCESS_NOTE = r"\[(?:online)\]|\b(?:available\s*(?:at|from)?|accessed|retrieved)\b[^.]*:?"
ARXIV = r"\barxiv(?:\s+preprint)?\s*:?\s*(?:arxiv:)?\s*\d{4}\.\d{4,5}(?:v\d+)?"
QUOTED = r"[“\"«]\s*([^”\"»]+?)\s*[,.]?\s*[”\"»]"
VENUE_LEAD = r"^(?:in\s*:|in\b)\s*"
VENUE_END = r"(?:[,.;:]?\s*)(?:\(|\b(?:vol|volume|no|issue|pp|pages|chapter|ch)\b\.?|\d)"
BOOK_HINTS = r"\b(?:press|publishers?|publishing|edition|ed\.|isbn|verlag|books?|springer\s+nature)\b"
PUBLISHER_ONLY = (
    r"(?:john\s+)?wiley(?:\s*(?:&|and)\s*sons)?|springer(?:-verlag)?|routledge|sage|elsevier|pearson(?:\s+education)?|mcgraw[\s-]hill|prentice[\s-]hall"
    r"|macmillan|penguin|crc|academic|addison[\s-]wesley|taylor\s*(?:&|and)\s*francis|mit|s\.?\s*chand|orient\s+blackswan|(?:\w+\s+){1,3}university"
)
JOURNAL_WORDS = r"\b(?:journal|review|transactions|proceedings|letters|quarterly|annals|bulletin|magazine)\b"
THESIS_HINTS = r"\b(?:thesis|dissertation|ph\.?\s?d\.?|m\.?\s?tech|master'?s)\b"
REPORT_HINTS = r"\b(?:technical\s+report|tech\.\s*rep\.?|working\s+paper|white\s+paper)\b"
LIST_MARKER = r"^\s*(?:\[\d{1,4}\]|\(\d{1,4}\)|\d{1,4}\.(?=\s))\s*"
MIN_VENUE_CHARS = 3
#: How sure a field is that a pattern found.
QUOTED_SURE, VENUE_SURE, DOI_SURE = 0.95, 0.6, 1.0

READ = f"title_start int, title_end int, title_sure double, year int, year_sure double, authors array<{AUTHOR}>, et_al boolean, authors_sure double"


def any_case(pattern: str) -> str:
    return "(?iU)" + pattern


def stripped(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def evaluated_once(function: Callable, kind: str) -> Callable[..., Column]:
    """An Arrow UDF that the optimiser neither copies nor moves filters through, so that it and the expressions on top of it run once a row. It can't stand inside an aggregate."""
    return F.pandas_udf(function, kind).asNondeterministic()


def found_or_null(text: Column) -> Column:
    return F.when(text != "", text)


def doi(text: Column) -> Column:
    return found_or_null(F.lower(F.regexp_extract(text, any_case(DOI_ITSELF), 1)))


def without_noise(raw: Column) -> Column:
    """The citation on one line, without its number in the list, identifiers, addresses and notes on access."""
    noise = [any_case(p) for p in (DOI_PREFIX, DOI, URL, ACCESS_NOTE)] + [r"(?U)\s+"]
    return stripped(reduce(lambda t, p: F.regexp_replace(t, p, " "), noise, F.regexp_replace(raw, "(?U)" + LIST_MARKER, "")), " ,;")


def quoted_title(text: Column, least_letters: int) -> Column:
    """struct(start, title_start, title_end, stop) of the first quotation with letters enough, places from 0; null if there is none."""
    pattern = "(?U)" + QUOTED
    between = F.transform(F.split(text, pattern), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    titles = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    which = F.array_position(F.transform(titles, lambda t: letters(t) >= least_letters), True).cast("int")
    total = lambda sizes, n: F.aggregate(F.slice(sizes, 1, n), F.lit(0), lambda a, b: a + b)
    start = total(between, which) + total(whole, which - 1)
    place = F.struct(start.alias("start"), (start + F.get(whole, which - 1)).cast("int").alias("stop"), F.get(titles, which - 1).alias("title"))
    return F.when(which > 0, place)


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(stripped(F.trim(title), "“”\"'«»")), "[.,;: ]+$", ""))


def venue(rest: Column) -> Column:
    """The venue at the beginning of what follows a title."""
    rest = F.regexp_replace(rest, '^[ .,;:”"]+', "")
    head = F.get(F.split(F.regexp_replace(rest, any_case(VENUE_LEAD), ""), any_case(VENUE_END), 2), F.lit(0))
    named = stripped(head, " .,;:()")
    return F.when(rest.rlike(any_case(ARXIV)), F.lit("arXiv")).when(F.length(named) >= MIN_VENUE_CHARS, named)


def entry_type(raw: Column, place: Column) -> Column:
    says = lambda pattern: raw.rlike(any_case(pattern))
    publisher = F.coalesce(place.rlike(any_case(rf"^\s*(?:{PUBLISHER_ONLY})\s*$")) & ~place.rlike(any_case(JOURNAL_WORDS)), F.lit(False))
    return F.when(says(THESIS_HINTS), "phdthesis").when(publisher, "book").when(says(REPORT_HINTS), "techreport").when(says(BOOK_HINTS), "book")


def _read(cfg: Parse) -> Callable[..., Column]:
    """A UDF of struct(text, start, stop): the text, and where its quoted title stands with its marks, null if it has none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [parsing.read(t, None if pd.isna(a) else (int(a), int(b)), cfg) for t, a, b in zip(rows["text"], rows["start"], rows["stop"], strict=True)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ") if " " in c]).astype({"title_start": "Int32", "title_end": "Int32", "year": "Int32"})

    return evaluated_once(run, READ)


def parse_fields(raw: Column, cfg: Parse = PARSE) -> Column:
    """The fields of one citation and how sure each is, as `refloom.schema.FIELDS`. Null is an empty citation."""

    # No inner function names a variable of an outer one here: Spark doesn't take such an argument of a UDF out of the plan.
    both = bound(without_noise(F.coalesce(raw, F.lit(""))), lambda t: F.struct(t.alias("text"), quoted_title(t, cfg.min_title_chars).alias("q")))
    prose = bound(both, lambda b: F.struct(b["text"].alias("text"), b["q"]["start"].alias("start"), b["q"]["stop"].alias("stop"), b["q"]["title"].alias("title")))

    def titled(x: Column) -> Column:
        r, p, line = x["read"], x["prose"], x["prose"]["text"]
        title = F.when(p["start"].isNotNull(), clean_title(p["title"])).when(r["title_start"].isNotNull(), clean_title(F.substr(line, r["title_start"] + 1, r["title_end"] - r["title_start"])))
        end = F.coalesce(p["stop"], r["title_end"])
        return F.struct(x.alias("x"), title.alias("title"), F.substr(line, end + 1, F.length(line)).alias("rest"))

    def placed(y: Column) -> Column:
        return F.struct(y["x"].alias("x"), y["title"].alias("title"), F.when(y["title"].isNotNull(), venue(y["rest"])).alias("venue"), doi(y["x"]["raw"]).alias("doi"))

    def made(z: Column) -> Column:
        r, p, raw = z["x"]["read"], z["x"]["prose"], z["x"]["raw"]
        sure = lambda value, most: F.when(value.isNotNull(), F.lit(most)).otherwise(F.lit(0.0))
        confidence = F.struct(
            F.when(p["start"].isNotNull(), F.lit(QUOTED_SURE)).otherwise(F.coalesce(r["title_sure"], F.lit(0.0))).alias("title"), r["authors_sure"].alias("authors"),
            r["year_sure"].alias("year"), sure(z["venue"], VENUE_SURE).alias("venue"), sure(z["doi"], DOI_SURE).alias("doi"),
        )
        return F.struct(
            z["title"].alias("title"), r["authors"].alias("authors"), r["et_al"].alias("et_al"), r["year"].alias("year"), z["venue"].alias("venue"), z["doi"].alias("doi"),
            F.when(p["text"] != "", entry_type(raw, z["venue"])).alias("entry_type"), confidence.alias("confidence"),
        )

    read = F.struct(F.coalesce(raw, F.lit("")).alias("raw"), prose.alias("prose"), _read(cfg)(prose).alias("read"))
    return bound(bound(bound(read, titled), placed), made)
