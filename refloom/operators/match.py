"""Field comparisons, the best candidate of each reference, and the verdict.

Edit similarities come from `refloom.functions.compare`; statuses, scores, ranks and rules are Catalyst expressions over its numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.config import MATCH, VERDICT, VERDICTS, WEB, Match, Verdict
from refloom.functions import compare

JUDGED = ("authors", "year", "venue")
AGREEING = ("match", "partial")


def year_status(cited: Column, found: Column, editions: Column | None = None, cfg: Match = MATCH) -> Column:
    gap = F.abs(cited - found)
    near = gap <= cfg.year_tolerance
    near = near if editions is None else near | F.coalesce(editions, F.lit(False))
    return F.when(gap.isNull(), "unknown").when(gap == 0, "match").when(near, "partial").otherwise("mismatch")


def year_score(status: Column, cfg: Match = MATCH) -> Column:
    return F.when(status == "match", 1.0).when(status == "partial", cfg.partial_year_score).when(status == "mismatch", 0.0)


def share_status(share: Column, cfg: Match = MATCH) -> Column:
    return F.when(share.isNull(), "unknown").when(share >= 1.0, "match").when(share >= cfg.author_overlap, "partial").otherwise("mismatch")


def venue_status(score: Column, words: Column, publisher: Column, cfg: Match = MATCH) -> Column:
    """A venue is only said to differ if both names have words enough to tell, and it is no book's publisher."""
    return F.when(score.isNull(), "unknown").when(score >= cfg.venue_match, "match").when((words >= 2) & ~F.coalesce(publisher, F.lit(False)), "mismatch").otherwise("unknown")


def doi_status(doi: Column, link: Column) -> Column:
    """A DOI in the link proves the work; its absence proves nothing."""
    return F.when(F.coalesce(F.contains(F.lower(link), F.lower(doi)) & (doi != ""), F.lit(False)), "match").otherwise("unknown")


def confidence(title: Column, authors: Column, year: Column, venue: Column, doi: Column, engine: Column, cfg: Match = MATCH) -> Column:
    """The weighted mean of the scores that are not null, lifted by a DOI and capped for the web."""
    parts = [(cfg.weight_title, title), (cfg.weight_authors, authors), (cfg.weight_year, year), (cfg.weight_venue, venue)]
    weight = reduce(Column.__add__, [F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for w, s in parts])
    summed = reduce(Column.__add__, [F.coalesce(F.lit(w) * s, F.lit(0.0)) for w, s in parts])
    mean = F.coalesce(F.try_divide(summed, weight), F.lit(0.0))
    lifted = F.when(doi == "match", F.greatest(mean, F.lit(cfg.doi_confidence))).otherwise(mean)
    capped = F.when(engine == WEB, F.least(lifted, F.lit(cfg.web_cap))).otherwise(lifted)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), capped)), 4)


def compared(pairs: DataFrame, cfg: Match = MATCH) -> DataFrame:
    """pairs: `fields` and `candidate`, other columns stay. Adds `m`, the comparison of the two."""
    f, c = F.col("fields"), F.col("candidate")
    surnames = F.transform(f["authors"], lambda a: a["surname"])
    rows = compare.with_pair_scores(pairs, "p", f["title"], c["title"], surnames, c["authors"], c["authors_truncated"], f["venue"], c["venue"], cfg)
    book = F.coalesce(f["entry_type"].isin(*cfg.edition_types), F.lit(False))
    year = year_status(f["year"], c["year"], book, cfg)
    authors, venue = share_status(F.col("p.author_share"), cfg), venue_status(F.col("p.venue_score"), F.col("p.venue_words"), book, cfg)
    doi = doi_status(f["doi"], c["link"])
    known = lambda status, score: F.when(status != "unknown", score)
    sure = confidence(F.col("p.title_score"), known(authors, F.round("p.author_share", 4)), year_score(year, cfg), known(venue, F.col("p.venue_score")), doi, c["engine"], cfg)
    m = F.struct(
        F.col("p.title_status").alias("title"), F.col("p.title_score").alias("title_score"), authors.alias("authors"), F.round("p.author_share", 4).alias("authors_score"),
        year.alias("year"), year_score(year, cfg).alias("year_score"), venue.alias("venue"), F.col("p.venue_score").alias("venue_score"), doi.alias("doi"),
        sure.alias("confidence"), F.col("p.first_author").alias("first_author"), book.alias("book"),
    )
    return rows.withColumn("m", m).drop("p")


def disagreeing(m: Column) -> Column:
    return reduce(Column.__add__, [(m[n] == "mismatch").cast("int") for n in JUDGED])


def agreeing(m: Column) -> Column:
    return reduce(Column.__add__, [m[n].isin(*AGREEING).cast("int") for n in JUDGED])


def middle_band(m: Column) -> Column:
    """A reworded title whose first author and year agree."""
    return (m["title"] == "partial") & m["first_author"] & m["year"].isin(*AGREEING)


def rank_key(m: Column, cited_by: Column, ordinal: Column, position: Column) -> Column:
    """Greater is better; of equals the first found. A matching title beats any other."""
    hit = m["title"] == "match"
    return F.struct(
        hit.alias("a"), F.when(hit, -disagreeing(m)).otherwise(middle_band(m).cast("int")).cast("double").alias("b"), F.when(hit, agreeing(m).cast("double")).otherwise(m["title_score"]).alias("c"),
        m["confidence"].alias("d"), F.when(hit, F.coalesce(cited_by, F.lit(0))).otherwise(F.lit(0)).cast("long").alias("e"), (-ordinal).alias("f"), (-position).alias("g"),
    )


def best_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each reference: the best candidate and its comparison, the most versions of any matching title, and the count of candidates.

    An aggregate, not a window: a reference with many candidates is combined before the shuffle.
    """
    key = rank_key(F.col("m"), F.col("candidate.cited_by"), F.col("ordinal"), F.col("position"))
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct("candidate", "m", "ordinal", "position"), key).alias("best"), F.max(F.when(F.col("m.title") == "match", F.col("candidate.versions"))).alias("versions"), F.count("*").alias("n_candidates")
    )


def confident_ordinal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stop: the first query with a matching title that no field speaks against; later ones need not be asked."""
    sure = (F.col("m.title") == "match") & (disagreeing(F.col("m")) == 0)
    return rows.where(sure).groupBy(*keys).agg(F.min("ordinal").alias("stop"))


def joined_words(words: Column) -> Column:
    """a, b and c"""
    n = F.size(words)
    return F.when(n <= 1, F.array_join(words, "")).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(words, -1)))


def shortened(names: Column, most: int = 3) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(names, F.lit("")), ","), lambda t: F.trim(t)), lambda p: p != "")
    shown = F.array_join(F.slice(parts, 1, most), ", ")
    return F.when(F.size(parts) > most, F.concat(shown, F.lit(" et al."))).otherwise(shown)


def differences(m: Column, fields: Column, candidate: Column) -> Column:
    cited_names = F.array_join(F.transform(fields["authors"], lambda a: a["surname"]), ", ")
    found = {"authors": shortened(F.array_join(candidate["authors"], ", ")), "year": candidate["year"].cast("string"), "venue": candidate["venue"]}
    cited = {"authors": shortened(cited_names), "year": fields["year"].cast("string"), "venue": fields["venue"]}
    verb = {"authors": "authors are ", "year": "year is ", "venue": "venue is "}
    said = [F.when(m[n] == "mismatch", F.concat(F.lit(verb[n]), F.coalesce(found[n], F.lit("")), F.lit(", not "), F.coalesce(cited[n], F.lit("")))) for n in JUDGED]
    return F.array_compact(F.array(*said))


def verified_reason(m: Column, candidate: Column) -> Column:
    names = F.array_compact(F.array(F.lit("title"), *(F.when(m[n].isin(*AGREEING), F.lit(n)) for n in JUDGED)))
    said = joined_words(names)
    subject = F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, F.lit(2), F.length(said)), F.when(F.size(names) == 1, " matches").otherwise(" match"))
    open_ = F.array_compact(F.array(*(F.when(m[n] == "unknown", F.lit(n)) for n in ("authors", "venue"))))
    web = F.concat(
        subject, F.lit(" a Google web result. Found only via Google web search (not in Google Scholar)"),
        F.when(F.size(open_) > 0, F.concat(F.lit("; "), joined_words(open_), F.lit(" could not be confirmed"))).otherwise(""), F.lit("."),
    )
    kind = F.when(m["book"], "another edition or reprint").otherwise("the preprint or published version")
    scholar = F.concat(
        subject, F.lit(" a Google Scholar record"),
        F.when(candidate["cited_by"] > 0, F.concat(F.lit(" (cited by "), F.format_number(candidate["cited_by"], 0), F.lit(")"))).otherwise(""),
        F.when(m["year"] == "partial", F.concat(F.lit("; Scholar lists "), candidate["year"].cast("string"), F.lit(", likely "), kind)).otherwise(""), F.lit("."),
    )
    return F.when(candidate["engine"] == WEB, web).otherwise(scholar)


# What a result says where nothing was compared.
NO_TITLE = "No title could be extracted from this reference, so it was not searched."
BROKEN_ENTRY = "The BibTeX entry could not be parsed, so it was not searched."
OUT_OF_BUDGET = "Not fully checked: the search budget for this run ran out first."
MISSES = {
    "offline": "Not checked: no cached search result for this reference (offline mode).",
    "demo": "Not checked: this reference is not part of the bundled demo data.",
    "live": "Not checked: no search result was available.",
}


def decided(rows: DataFrame, cfg: Match = MATCH, verdicts: Verdict = VERDICT) -> DataFrame:
    """rows: fields, source_format, best (struct of candidate and m, or null), versions, complete, incomplete_reason.
    Adds verdict, confidence, reason, mismatched. The rules in order; the first that holds decides."""
    f, m, c = F.col("fields"), F.col("best.m"), F.col("best.candidate")
    hit, band, score = m["title"] == "match", middle_band(m), F.coalesce(m["title_score"], F.lit(0.0))
    broken = (F.col("source_format") == "bibtex") & f["entry_type"].isNull()
    no_title = F.coalesce(f["title"], F.lit("")) == ""
    said = differences(m, f, c)
    fields = F.array_compact(F.array(*(F.when(m[n] == "mismatch", F.lit(n)) for n in JUDGED)))
    # A version of a work may have another year and venue, but not other authors.
    other = F.when((F.col("versions") > 1) & (m["authors"] != "mismatch"), F.concat(F.lit(" (Google Scholar lists this work with "), F.col("versions").cast("string"), F.lit(" versions; this may be a different version.)"))).otherwise("")
    wrong = F.concat(F.lit("Title matches, but "), F.array_join(said, "; "), F.lit("."), other)
    close = F.concat(F.lit("Title differs from the closest real paper: '"), c["title"], F.lit("' ("), F.coalesce(c["year"].cast("string"), F.lit("None")), F.lit(")."))
    nearest = F.concat(F.lit("No Google Scholar record matches this title; the closest result was “"), c["title"], F.lit("” ("), F.bround(score * 100, 0).cast("int").cast("string"), F.lit("% similar)."))
    none = F.array().cast("array<string>")
    rules = [
        (no_title, "UNPARSEABLE", F.lit(1.0), F.when(broken, BROKEN_ENTRY).otherwise(NO_TITLE), none),
        (hit & (F.size(fields) == 0), "VERIFIED", m["confidence"], verified_reason(m, c), none),
        (hit, "METADATA_MISMATCH", F.round(F.when(c["engine"] == WEB, F.least(score, F.lit(cfg.web_cap))).otherwise(score), 4), wrong, fields),
        (band, "METADATA_MISMATCH", m["confidence"], close, F.array(F.lit("title"))),
        (~F.col("complete"), "SKIPPED_BUDGET", F.lit(0.0), F.col("incomplete_reason"), none),
        (F.col("best").isNull(), "NOT_FOUND", F.lit(verdicts.not_found_confidence), F.lit("No Google Scholar record was found for this title."), none),
        (F.lit(True), "NOT_FOUND", F.round(F.greatest(F.lit(verdicts.not_found_floor), F.lit(verdicts.not_found_confidence) - score / 2), 4), nearest, none),
    ]
    made = [F.struct(F.lit(v).alias("verdict"), sure.alias("confidence"), why.alias("reason"), of.alias("mismatched")) for _, v, sure, why, of in rules]
    ladder = reduce(lambda acc, x: acc.when(F.coalesce(x[0], F.lit(False)), x[1]), zip([r[0] for r in rules[1:]], made[1:], strict=True), F.when(rules[0][0], made[0]))
    return rows.withColumn("d", ladder).select(*rows.columns, "d.verdict", "d.confidence", "d.reason", "d.mismatched")


def integrity_score(verified: Column, mismatched: Column, not_found: Column, cfg: Verdict = VERDICT) -> Column:
    """A percentage with one decimal; null if nothing could be checked."""
    return F.round(F.try_divide(100.0 * (verified + F.lit(cfg.mismatch_weight) * mismatched), (verified + mismatched + not_found).cast("double")), 1)


def summarised(results: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """by, a count for each verdict (zero where there is none), total, checked, integrity_score. Counts are combined before the shuffle; the list of verdicts is fixed, so nothing is collected to pivot."""
    counts = results.groupBy(*by).agg(*(F.count_if(F.col(verdict) == v).alias(v.lower()) for v in VERDICTS), F.count("*").alias("total"))
    v, m, n = F.col("verified"), F.col("metadata_mismatch"), F.col("not_found")
    return counts.withColumn("checked", v + m + n).withColumn("integrity_score", integrity_score(v, m, n))


def ranked_window(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in rank order with `rank`; for reports that show more than the best."""
    key = rank_key(F.col("m"), F.col("candidate.cited_by"), F.col("ordinal"), F.col("position"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(key.desc())))


