from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from refloom.config import PARSE, Parse
from refloom.functions import citations
from refloom.functions import parsing as P
from refloom.functions.bibtex import parse_bibtex
from refloom.functions.summaries import parse_summary

CASES = [
    ("Doe, J., Roe, R., & Poe, P. (2017). Reading the tea leaves of data. Journal of Leaves, 3(2), 1-9. https://doi.org/10.1000/ABC.", "Reading the tea leaves of data", ["Doe", "Roe", "Poe"], 2017, "Journal of Leaves", "10.1000/abc"),
    ("J. Doe and R. Roe, “Reading the tea leaves of data,” in Proc. Leaves Conf., vol. 3, pp. 1-9, 2017.", "Reading the tea leaves of data", ["Doe", "Roe"], 2017, "Proc. Leaves Conf", None),
    ("Doe J, Roe RA. Reading the tea leaves of data. Leaves. 2017;3(2):1-9.", "Reading the tea leaves of data", ["Doe", "Roe"], 2017, "Leaves", None),
    ("Doe, J.Q. and Roe, R. (2017), \"Reading the tea leaves of data\", Leaves Quarterly, Vol. 3 No. 2, pp. 1-9.", "Reading the tea leaves of data", ["Doe", "Roe"], 2017, "Leaves Quarterly", None),
    ("[3] Jane Doe, Richard Roe. 2017. Reading the tea leaves of data. In Proceedings of Leaves. 1-9.", "Reading the tea leaves of data", ["Doe", "Roe"], 2017, "Proceedings of Leaves", None),
    ("Doe, J.Q. (1973), Reading the tea leaves of data, Wiley.", "Reading the tea leaves of data", ["Doe"], 1973, "Wiley", None),
    ("Jean de la Fontaine, et al. Reading the tea leaves of data. arXiv preprint arXiv:1706.03762, 2017.", "Reading the tea leaves of data", ["de la Fontaine"], 2017, "arXiv", None),
]


def parsed(spark, raws, cfg=PARSE):
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").select("i", citations.parse_fields(F.col("raw"), cfg).alias("f")).collect()
    return [r.f.asDict(recursive=True) for r in sorted(rows, key=lambda r: r.i)]


def test_styles(spark):
    for (_, title, surnames, year, venue, doi), f in zip(CASES, parsed(spark, [c[0] for c in CASES]), strict=True):
        assert (f["title"], [a["surname"] for a in f["authors"]], f["year"], f["venue"], f["doi"]) == (title, surnames, year, venue, doi)


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        ("A. P. J. Abdul Kalam", ("Abdul Kalam", "A. P. J.")), ("Sharma AK", ("Sharma", "AK")), ("Jean-Pierre Müller-Lüdenscheidt", ("Müller-Lüdenscheidt", "Jean-Pierre")), ("Ludwig van Beethoven", ("van Beethoven", "Ludwig")),
        ("John Q. Public", ("Public", "John Q.")), ("O'Brien", ("O'Brien", "")), ("A.", None), ("of the", None), ("Deep Learning. Springer", None), ("A B", None), ("one two three four five six", None), ("Sammy Davis Jr.", ("Davis", "Sammy")),
    ],
)
def test_names(name, wanted):
    found = P.parse_name(name)
    assert (tuple(found) if found else None) == wanted


def test_year_bounds():
    year = lambda text: P.Prose(text, Parse(as_of_year=2026)).year
    assert year("printed 2030 and 1750") is None
    assert year("pages 1990-1999, 2005").value == 2005
    assert year("it was (1999a) or 2003")[::3] == (1999, 0.95)


def test_never_breaks(spark):
    rnd = random.Random(2)
    raws = [None, ""] + ["".join(rnd.choice("AaBé .,;:()[]“”\"'0129/&-\n and et al doi:10.1000/") for _ in range(rnd.randint(0, 120))) for _ in range(500)]
    for f in parsed(spark, raws):
        assert all(0 <= v <= 1 for v in f["confidence"].values())
        assert f["title"] is None or sum(map(str.isalpha, f["title"])) >= 10


SUMMARIES = [
    ("J Doe, R Roe… - Journal of …, 2017 - x.org", [], {"authors": ["J Doe", "R Roe"], "authors_truncated": True, "venue": "Journal of", "venue_truncated": True, "year": 2017, "source": "x.org"}),
    ("J DoeLeaves quarterly, 1989•JSTOR", ["J Doe"], {"venue": "Leaves quarterly", "source": "JSTOR"}), ("J DoeLeaves quarterly, 1989•JSTOR", [], {"venue": "Leaves quarterly"}), ("J DoeLeaves quarterly, 1989•JSTOR", None, {"venue": "Leaves quarterly"}),
    ("Nature, 2015", [], {"venue": "Nature", "authors": []}), ("J Doe", [], {"authors": ["J Doe"]}),
    ("", [], {"authors": [], "authors_truncated": False, "venue": None, "venue_truncated": False, "year": None, "source": None}), (None, None, {"authors": [], "venue": None}),
]


def test_summaries(spark):
    rows = spark.createDataFrame([(i, s, n) for i, (s, n, _) in enumerate(SUMMARIES)], "i int, s string, n array<string>")
    for r in rows.select("i", parse_summary(F.col("s"), F.col("n")).alias("p")).collect():
        assert {k: r.p[k] for k in SUMMARIES[r.i][2]} == SUMMARIES[r.i][2]


def test_bibtex():
    rows, warnings = parse_bibtex(
        """% a comment
@string{jl = "Journal of Leaves"}
@article{one, title = {Reading {Tea} Leaves}, author = "M{\\"u}ller, J\\"org and Jean de la Fontaine and others", journal = jl, year = 2017, doi = {https://doi.org/10.1000/X}}
@book{bad, title = {never closed, year = 2019

@misc(two, title = "Other " # "title", howpublished = {Web}, date = {2020-03-01})
@misc{one, title = {Again}, title = {Twice}}
"""
    )
    assert [r["key"] for r in rows] == ["one", "bad", "two", "one"] and [r["line"] for r in rows] == [3, 4, 6, 7]
    one, bad, two, again = (r["fields"] for r in rows)
    assert (one["title"], one["venue"], one["year"], one["doi"], one["et_al"]) == ("Reading Tea Leaves", "Journal of Leaves", 2017, "10.1000/x", True)
    assert one["authors"] == [{"surname": "Müller", "given": "Jörg"}, {"surname": "de la Fontaine", "given": "Jean"}]
    assert bad["title"] is None and bad["entry_type"] is None
    assert (two["title"], two["venue"], two["year"]) == ("Other title", "Web", 2020)
    assert again["title"] == "Again"
    assert len(warnings) == 2 and "syntax error" in warnings[0] and "duplicate citation key 'one'" in warnings[1]
    assert parse_bibtex("no entries") == ([], [])
