"""From references to planned queries, and from stored responses to candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.config import PARSE, SCHOLAR, SEARCH, WEB, Search
from refloom.functions.summaries import TITLE_TAG, parse_summary
from refloom.operators.control import cache_key
from refloom.schema import CANDIDATE, RESPONSE

STRATEGIES = ("scholar_exact_title", "scholar_title_author", "google_fallback")
# How a site's name is set apart in a page title, and where a date may stand.
SITE_SUFFIX = r"\s+[-|–—]\s+([^-|–—:]{1,40})$"
MAX_SITE_WORDS = 4
GRAPH_DATES = ("originally_published", "publication_date", "first_published", "published", "date")


def query_title(title: Column, cfg: Search = SEARCH) -> Column:
    """Without quotation marks, blanks collapsed, cut between words."""
    text = F.trim(F.regexp_replace(F.regexp_replace(title, '["“”«»]', " "), r"(?U)\s+", " "))
    cut = F.substring(text, 1, cfg.max_query_chars)
    return F.when(F.length(text) <= cfg.max_query_chars, text).otherwise(F.when(cut.contains(" "), F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut))


def planned(refs: DataFrame, cfg: Search = SEARCH) -> DataFrame:
    """A row for each query of a reference (title, surname, entry_type): ordinal, strategy, engine, params, query, cache_key.

    The exact title, then the title with the first author, and for books, theses and reports the web. Years are never a filter: a wrong one would hide the work.
    """
    title, last = query_title(F.col("title"), cfg), F.element_at(F.split(F.trim("surname"), r"(?U)\s+"), -1)
    has = F.coalesce(F.trim("surname"), F.lit("")) != ""
    quoted = F.concat(F.lit('"'), title, F.lit('"'))
    scholar = lambda q: F.create_map(F.lit("engine"), F.lit(SCHOLAR), F.lit("q"), q, F.lit("hl"), F.lit(cfg.language), F.lit("num"), F.lit(str(cfg.results_per_query)))
    web = lambda q: F.create_map(F.lit("engine"), F.lit(WEB), F.lit("q"), q, F.lit("hl"), F.lit(cfg.language), F.lit("gl"), F.lit(cfg.country))
    by_author = F.when(has, F.concat(title, F.lit(' author:"'), last, F.lit('"'))).otherwise(title)
    on_web = F.when(has, F.concat(quoted, F.lit(" "), last)).otherwise(quoted)
    plans = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("strategy"), F.lit(engine).alias("engine"), params.alias("params"))
        for i, (name, engine, params) in enumerate(zip(STRATEGIES, (SCHOLAR, SCHOLAR, WEB), (scholar(quoted), scholar(by_author), web(on_web)), strict=True), 1)
    ]
    wanted = F.filter(F.array(*plans), lambda p: (p["ordinal"] < 3) | F.coalesce(F.col("entry_type").isin(*cfg.web_types), F.lit(False)))
    rows = refs.where(F.coalesce(F.col("title"), F.lit("")) != "").withColumn("plan", F.explode(wanted))
    rows = rows.select(*refs.columns, "plan.ordinal", "plan.strategy", "plan.engine", "plan.params")
    return rows.withColumn("query", F.col("params")["q"]).withColumn("cache_key", cache_key(F.col("params")))


def first_year(texts: Column, as_of_year: int) -> Column:
    """The first plausible year of the first text that has one; texts: an array, nulls allowed."""
    years = F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.regexp_extract_all(t, F.lit(r"(?U)\b((?:1[89]|20)\d{2})\b"), F.lit(1))))
    return F.get(F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y <= as_of_year + 1), F.lit(0))


def clean_web_title(title: Column) -> Column:
    """A page title without a trailing ellipsis and the site's name."""
    bare = F.regexp_replace(F.trim(title), r"\s*(?:\.\.\.|…)$", "")
    site = F.trim(F.regexp_extract(bare, SITE_SUFFIX, 1))
    short = (site != "") & (F.size(F.split(site, r"\s+")) <= MAX_SITE_WORDS)
    return F.trim(F.when(short, F.regexp_replace(bare, SITE_SUFFIX, "")).otherwise(bare))


def source_host(link: Column) -> Column:
    return F.lower(F.try_parse_url(link, F.lit("HOST")))


def safe_url(url: Column) -> Column:
    """The address if it is http or https with a host, else null."""
    return F.when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), url)


def total(count: Column) -> Column:
    return F.when(count >= 0, count)


def parsed_body(body: Column) -> Column:
    """A stored response, only as far as it is read; fields of the wrong type are null."""
    return F.from_json(body, RESPONSE)


def trimmed(body: Column) -> Column:
    """The response with only the fields that are read, as JSON."""
    return F.to_json(parsed_body(body))


def scholar_results(rows: DataFrame) -> DataFrame:
    """rows: any columns and `response`. A row for each scholarly result with a title: those columns, position, candidate."""
    keep = [c for c in rows.columns if c != "response"]
    found = rows.select(*keep, F.posexplode("response.organic_results").alias("position", "r")).where("r.title IS NOT NULL AND r.title <> ''")
    names = F.transform(F.col("r.publication_info.authors"), lambda a: a["name"])
    found = found.withColumn("s", parse_summary(F.col("r.publication_info.summary"), names))
    made = F.struct(
        F.lit(SCHOLAR).alias("engine"), F.regexp_replace("r.title", "(?i)" + TITLE_TAG, "").alias("title"), F.col("r.link").alias("link"), F.col("r.result_id").alias("result_id"),
        F.col("s.authors").alias("authors"), F.col("s.authors_truncated").alias("authors_truncated"), F.col("s.year").alias("year"), F.col("s.venue").alias("venue"),
        F.col("s.venue_truncated").alias("venue_truncated"), F.col("s.source").alias("source"), F.col("r.snippet").alias("snippet"),
        total(F.col("r.inline_links.cited_by.total")).alias("cited_by"), total(F.col("r.inline_links.versions.total")).alias("versions"),
    )
    return found.select(*keep, (F.col("position") + 1).alias("position"), made.cast(CANDIDATE).alias("candidate"))


def web_results(rows: DataFrame, as_of_year: int = PARSE.as_of_year) -> DataFrame:
    """As scholar_results, for web results; a knowledge panel comes first, at position 0."""
    keep = [c for c in rows.columns if c != "response"]
    none = lambda kind: F.lit(None).cast(kind)

    def made(title, link, authors, year, source, snippet) -> Column:
        return F.struct(
            F.lit(WEB).alias("engine"), title.alias("title"), link.alias("link"), none("string").alias("result_id"), authors.alias("authors"), F.lit(False).alias("authors_truncated"),
            year.alias("year"), none("string").alias("venue"), F.lit(False).alias("venue_truncated"), source.alias("source"), snippet.alias("snippet"),
            none("bigint").alias("cited_by"), none("bigint").alias("versions"),
        ).cast(CANDIDATE)

    g = "response.knowledge_graph"
    names = F.split(F.coalesce(F.nullif(F.col(f"{g}.authors"), F.lit("")), F.nullif(F.col(f"{g}.author"), F.lit("")), F.lit("")), ",")
    names = F.filter(F.transform(names, lambda t: F.trim(t)), lambda n: n != "")
    dates = F.array(*(F.col(f"{g}.{d}") for d in GRAPH_DATES))
    panel = made(F.col(f"{g}.title"), F.col(f"{g}.source.link"), names, first_year(dates, as_of_year), F.lit("Google Knowledge Graph"), F.col(f"{g}.description"))
    panels = rows.where(f"{g}.title IS NOT NULL AND {g}.title <> ''").select(*keep, F.lit(0).alias("position"), panel.alias("candidate"))
    found = rows.select(*keep, F.posexplode("response.organic_results").alias("position", "r")).where("r.title IS NOT NULL AND r.title <> ''")
    title = F.coalesce(F.nullif(clean_web_title(F.col("r.title")), F.lit("")), F.col("r.title"))
    year = first_year(F.array("r.date", "r.snippet"), as_of_year)
    source = F.coalesce(F.nullif(F.col("r.source"), F.lit("")), source_host(F.col("r.link")))
    page = made(title, F.col("r.link"), F.array().cast("array<string>"), year, source, F.col("r.snippet"))
    return panels.unionByName(found.select(*keep, (F.col("position") + 1).alias("position"), page.alias("candidate")))


def candidates(looked_up: DataFrame, as_of_year: int = PARSE.as_of_year) -> DataFrame:
    """Queries with a body (engine, body) to a row for each candidate, in the order of results."""
    rows = looked_up.where(F.col("body").isNotNull()).withColumn("response", parsed_body(F.col("body"))).drop("body")
    return scholar_results(rows.where(F.col("engine") == SCHOLAR)).unionByName(web_results(rows.where(F.col("engine") == WEB), as_of_year))
