"""Titles, author lists and venues of a citation and a found work, compared.

Words are made canonical and edit similarities worked out in Arrow UDFs, each distinct title or pair once in a batch; how the word lists are lined up, what settles a comparison
without any edit similarity, shares, abbreviations and statuses are array expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.config import MATCH, Match
from refloom.functions import strings, text
from refloom.functions.citations import bound, evaluated_once

PAIR = "struct<title_score:double,title_status:string,author_share:double,first_author:boolean,venue_score:double,venue_words:int>"
KERNEL = "ratio double, agree boolean, partial double, met int, first boolean, venue double"
_ELLIPSIS = "(?:" + "|".join(m.replace(".", r"\.") for m in strings.ELLIPSES) + ")$"


def _once(function: Callable) -> Callable:
    return lru_cache(maxsize=1 << 16)(function)


def _lists(function: Callable, kind: str) -> Callable[[Column], Column]:
    """A UDF from an array of texts to what the function makes of each; each distinct text once."""

    def apply(texts: Column) -> Column:
        def run(rows: pd.Series) -> pd.Series:
            made = _once(function)
            return pd.Series([None if row is None else [None if t is None else made(t) for t in row] for row in rows], dtype=object)

        return evaluated_once(run, f"array<{kind}>")(texts)

    return apply


canonical_lists = _lists(strings.canonical_words, "array<string>")
surname_keys = _lists(strings.surname_key, "string")
folded_all = _lists(strings.fold, "string")


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


# Titles


def _bare(title: Column) -> tuple[Column, Column]:
    """(the title without a mark that says it was cut short, whether there was one)."""
    whole = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^\s+|\s+$", "")
    cut = whole.rlike(_ELLIPSIS)
    return F.when(cut, F.regexp_replace(F.regexp_replace(whole, _ELLIPSIS, ""), "[ ,;:-]+$", "")).otherwise(whole), cut


def _title_words(cited: Column, found: Column) -> Column:
    """What `_lined_up` takes: the words of both titles and of their main parts, by one crossing."""
    (a, a_cut), (b, b_cut) = _bare(cited), _bare(found)
    made = canonical_lists(F.array(a, text.main_title(a), b, text.main_title(b)))
    return F.struct(made.alias("words"), a_cut.alias("a_cut"), b_cut.alias("b_cut"))


def _cut_alike(whole: Column, cut: Column) -> Column:
    """As many words of a whole title as a cut one has; its last word may be cut as well."""
    part = F.slice(whole, F.lit(1), F.size(cut))
    last = F.element_at(cut, -1)
    through = (F.size(part) > 0) & (F.size(cut) > 0) & F.startswith(F.element_at(part, -1), last)
    return F.when(through, F.concat(F.slice(part, F.lit(1), F.greatest(F.size(part) - 1, F.lit(0))), F.array(last))).otherwise(part)


def _lined_up(w: Column) -> Column:
    """struct(x, y, dropped): the words to compare, and whether one title is the other without its subtitle."""
    a, a_main, b, b_main = (F.get(w["words"], F.lit(i)) for i in range(4))
    x = F.when(w["b_cut"] & (F.size(b) < F.size(a)), _cut_alike(a, b)).otherwise(a)
    says_enough = lambda main: (F.size(main) >= 2) | (F.length(F.array_join(main, "")) >= 4)
    dropped = F.when(a == b, False).when(a_main == b, (a_main != a) & says_enough(a_main)).when(b_main == a, (b_main != b) & says_enough(b_main)).otherwise(False)
    return bound(F.struct(x.alias("x"), a.alias("a"), b.alias("b"), w["a_cut"].alias("a_cut"), dropped.alias("dropped")), lambda s: F.struct(
        s["x"].alias("x"), F.when(s["a_cut"] & (F.size(s["x"]) < F.size(s["b"])), _cut_alike(s["b"], s["x"])).otherwise(s["b"]).alias("y"), s["dropped"].alias("dropped"),
    ))


def _open_titles(t: Column) -> tuple[Column, Column]:
    """The joined words of both sides, null where they need no edit similarity."""
    is_open = (F.size(t["x"]) > 0) & (F.size(t["y"]) > 0) & (t["x"] != t["y"])
    return F.when(is_open, joined(t["x"])), F.when(is_open, joined(t["y"]))


def _title_result(t: Column, k: Column, cfg: Match) -> Column:
    """struct(score, status, overlap, agree)."""
    x, y = t["x"], t["y"]
    nothing, same = (F.size(x) == 0) | (F.size(y) == 0), x == y
    ratio = F.when(nothing, 0.0).when(same, 1.0).otherwise(k["ratio"])
    agree = F.when(nothing, False).when(same, F.exists(x, lambda w: ~w.isin(*strings.STOPWORDS))).otherwise(k["agree"])

    def finish(r: Column) -> Column:
        score, agrees = r["score"], r["agree"]
        short = F.least(F.size(r["t"]["x"]), F.size(r["t"]["y"])) < cfg.overlap_min_words
        overlap = F.when(r["nothing"], 0.0).when(short | r["same"], score).otherwise(F.greatest(score, F.coalesce(r["partial"], F.lit(0.0))))
        matches = r["t"]["dropped"] | ((score >= cfg.title_match) & agrees)
        status = F.when(matches, "match").when(~r["nothing"] & (overlap >= cfg.title_reject), "partial").otherwise("mismatch")
        return F.struct(score.alias("score"), status.alias("status"), overlap.alias("overlap"), agrees.alias("agree"))

    score = F.when(t["dropped"] & (ratio > 0), F.greatest(ratio, F.lit(cfg.subtitle_score))).otherwise(ratio)
    return bound(F.struct(t.alias("t"), score.alias("score"), agree.alias("agree"), nothing.alias("nothing"), same.alias("same"), k["partial"].alias("partial")), finish)


# People


def _open_people(here: Column, there: Column, cut: Column) -> Column:
    """struct(here, there, settled): surname keys to compare; of a list cut short, only so many cited ones as it shows count. settled: all stand in the found list."""
    named = lambda keys: F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.coalesce(k, F.lit("")) != "")
    here, there = named(here), named(there)
    here = F.when(F.coalesce(cut, F.lit(False)), F.slice(here, F.lit(1), F.size(there))).otherwise(here)
    return F.struct(here.alias("here"), there.alias("there"), (F.size(F.array_except(here, there)) == 0).alias("settled"))


def _share(p: Column, met: Column) -> Column:
    """Null if there is nothing to compare."""
    n = F.size(p["here"])
    return F.when((n > 0) & (F.size(p["there"]) > 0), F.when(p["settled"], 1.0).otherwise(met / n))


# Venues


def venue_words(folded: Column) -> Column:
    return F.filter(F.split(F.coalesce(folded, F.lit("")), " "), lambda w: ~w.isin("", *strings.STOPWORDS, *strings.GENERIC_VENUE_WORDS))


def abbreviation_overlap(short: Column, long: Column) -> Column:
    """The share of the short name's words that stand for words of the long one, in order; the first ones have to agree."""

    def step(s: Column, word: Column) -> Column:
        rest = F.slice(long, s["after"] + 1, F.size(long))
        at = F.array_position(F.transform(rest, lambda o: text.same_abbreviated(word, o)), True).cast("int")
        return bound(at, lambda at: F.when(at > 0, F.struct((s["after"] + at).alias("after"), (s["met"] + 1).alias("met"))).otherwise(s))

    met = F.aggregate(short, F.struct(F.lit(0).alias("after"), F.lit(0).alias("met")), step, lambda s: s["met"])
    begins = text.same_abbreviated(F.get(short, F.lit(0)), F.get(long, F.lit(0)))
    return F.when(F.coalesce(begins, F.lit(False)), met / F.size(short)).otherwise(0.0)


def _venue_score(v: Column, k: Column) -> Column:
    """v: struct(a, b) of words. No words on one side are like nothing."""
    shorter = F.size(v["a"]) <= F.size(v["b"])
    short, long = F.when(shorter, v["a"]).otherwise(v["b"]), F.when(shorter, v["b"]).otherwise(v["a"])
    sorted_alike = F.array_sort(v["a"]) == F.array_sort(v["b"])
    whole = F.when(sorted_alike, 1.0).otherwise(F.coalesce(k["venue"], F.lit(0.0)))
    likeness = bound(F.struct(short.alias("short"), long.alias("long")), lambda s: abbreviation_overlap(s["short"], s["long"]))
    return F.when((F.size(v["a"]) == 0) | (F.size(v["b"]) == 0), 0.0).otherwise(F.greatest(whole, F.bround(likeness, 4)))


def _open_venues(v: Column) -> tuple[Column, Column]:
    a, b = F.array_sort(v["a"]), F.array_sort(v["b"])
    is_open = (F.size(a) > 0) & (F.size(b) > 0) & (a != b)
    return F.when(is_open, joined(a)), F.when(is_open, joined(b))


# The kernel


def _kernel(cfg: Match, always_partial: bool) -> Callable[..., Column]:
    """Edit similarities of what is left open, each distinct pair once a batch; null where nothing is asked."""

    def run(x: pd.Series, y: pd.Series, here: pd.Series, there: pd.Series, first: pd.Series, other_first: pd.Series, venue: pd.Series, other_venue: pd.Series) -> pd.DataFrame:
        @_once
        def titles(a: str, b: str) -> tuple:
            like = max(strings.ratio(a, b), strings.token_sort_ratio(a, b)) / 100
            agree = like >= cfg.title_match and strings.words_agree(a.split(" "), b.split(" "), cfg.word_match)
            if not always_partial and (agree or like >= cfg.title_reject):
                return round(like, 4), agree, None
            agree = agree or strings.words_agree(a.split(" "), b.split(" "), cfg.word_match)
            return round(like, 4), agree, round(strings.partial_ratio(a, b) / 100, 4)

        @_once
        def close(a: str, b: str) -> bool:
            return a == b or min(len(a), len(b)) >= 4 and strings.ratio(a, b) / 100 >= cfg.surname_match

        @_once
        def venues(a: str, b: str) -> float:
            return round(strings.ratio(a, b) / 100, 4)

        out = []
        for a, b, h, t, f, g, v, w in zip(x, y, here, there, first, other_first, venue, other_venue, strict=True):
            met = None if h is None else sum(any(close(k, o) for o in t) for k in h)
            out.append((*((None, None, None) if a is None else titles(a, b)), met, None if f is None else close(f, g), None if v is None else venues(v, w)))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in KERNEL.split(", ")])
        return made.astype({"ratio": "Float64", "partial": "Float64", "met": "Int32", "venue": "Float64"})

    return evaluated_once(run, KERNEL)


def _ask(cfg: Match, always_partial: bool = False, **asked: Column) -> Column:
    none, nobody = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    of = {"x": none, "y": none, "here": nobody, "there": nobody, "first": none, "other_first": none, "venue": none, "other_venue": none} | asked
    return _kernel(cfg, always_partial)(*of.values())


def _titles(cited: Column, found: Column, cfg: Match) -> Column:
    t = bound(_title_words(cited, found), _lined_up)
    x, y = _open_titles(t)
    both = F.struct(t.alias("t"), _ask(cfg, True, x=x, y=y).alias("k"))
    made = bound(both, lambda s: _title_result(s["t"], s["k"], cfg))
    return F.when(cited.isNotNull() & found.isNotNull(), made)


def title_status(cited: Column, found: Column, cfg: Match = MATCH) -> Column:
    return _titles(cited, found, cfg)["status"]


def title_similarity(cited: Column, found: Column, cfg: Match = MATCH) -> Column:
    return _titles(cited, found, cfg)["score"]


def title_overlap(cited: Column, found: Column, cfg: Match = MATCH) -> Column:
    return _titles(cited, found, cfg)["overlap"]


def same_words(cited: Column, found: Column, cfg: Match = MATCH) -> Column:
    return _titles(cited, found, cfg)["agree"]


def author_share(cited: Column, found: Column, cut: Column, cfg: Match = MATCH) -> Column:
    p = _open_people(surname_keys(cited), surname_keys(found), cut)
    asks = lambda c: F.when(~p["settled"], c)
    return bound(F.struct(p.alias("p"), _ask(cfg, here=asks(p["here"]), there=asks(p["there"])).alias("k")), lambda s: _share(s["p"], s["k"]["met"]))


def venue_similarity(cited: Column, found: Column, cfg: Match = MATCH) -> Column:
    folded = folded_all(F.array(cited, found))
    v = F.struct(venue_words(F.get(folded, F.lit(0))).alias("a"), venue_words(F.get(folded, F.lit(1))).alias("b"))
    a, b = _open_venues(v)
    made = bound(F.struct(v.alias("v"), _ask(cfg, venue=a, other_venue=b).alias("k")), lambda s: _venue_score(s["v"], s["k"]))
    return F.when(cited.isNotNull() & found.isNotNull(), made)


def with_pair_scores(rows, name: str, cited_title: Column, found_title: Column, surnames: Column, names: Column, cut: Column, venue: Column, found_venue: Column, cfg: Match = MATCH):
    """The rows with a column `name` as PAIR says. Python is crossed twice: for the words of all, and for what these leave open."""
    own, kernel = f"{name}_words", f"{name}_kernel"
    known = lambda v: F.coalesce(v, F.lit("")) != ""
    folded, keys, found_keys = folded_all(F.array(venue, found_venue)), surname_keys(surnames), surname_keys(names)
    first, other_first = (F.coalesce(F.get(k, F.lit(0)), F.lit("")) for k in (keys, found_keys))
    read = F.struct(
        _title_words(cited_title, found_title).alias("title"), F.struct(keys.alias("here"), found_keys.alias("there"), cut.alias("cut")).alias("people"), first.alias("first"), other_first.alias("other_first"),
        folded.alias("folded"), (known(venue) & known(found_venue)).alias("venues"),
    )
    rows = rows.withColumn(own, read)

    def lined(r: Column) -> Column:
        v = F.struct(venue_words(F.get(r["folded"], F.lit(0))).alias("a"), venue_words(F.get(r["folded"], F.lit(1))).alias("b"))
        return F.struct(
            bound(r["title"], _lined_up).alias("t"), _open_people(r["people"]["here"], r["people"]["there"], r["people"]["cut"]).alias("p"),
            F.when(r["venues"], v).alias("v"), r["first"].alias("first"), r["other_first"].alias("other_first"),
        )

    rows = rows.withColumn(own, bound(F.col(own), lined))
    w = F.col(own)
    (x, y), (a, b) = _open_titles(w["t"]), _open_venues(w["v"])
    both_first = (w["first"] != "") & (w["other_first"] != "") & (w["first"] != w["other_first"])
    people = lambda c: F.when(~w["p"]["settled"], c)
    rows = rows.withColumn(kernel, _ask(
        cfg, x=x, y=y, here=people(w["p"]["here"]), there=people(w["p"]["there"]), first=F.when(both_first, w["first"]), other_first=F.when(both_first, w["other_first"]), venue=a, other_venue=b,
    ))

    def result(s: Column) -> Column:
        w, k = s["w"], s["k"]
        title = _title_result(w["t"], k, cfg)
        first_author = F.when((w["first"] == "") | (w["other_first"] == ""), False).when(w["first"] == w["other_first"], True).otherwise(k["first"])
        words = F.least(F.size(w["v"]["a"]), F.size(w["v"]["b"]))
        return bound(title, lambda t: F.struct(
            t["score"].alias("title_score"), t["status"].alias("title_status"), _share(w["p"], k["met"]).alias("author_share"), first_author.alias("first_author"),
            F.when(w["v"].isNotNull(), _venue_score(w["v"], k)).alias("venue_score"), F.when(w["v"].isNotNull(), words).alias("venue_words"),
        ))

    return rows.withColumn(name, bound(F.struct(w.alias("w"), F.col(kernel).alias("k")), result).cast(PAIR)).drop(own, kernel)
