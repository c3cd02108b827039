"""Comparisons, ranking, verdicts, duplicates and the whole check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.config import SCHOLAR, VERDICTS, Search
from refloom.functions import compare, strings, text, udfs
from refloom.operators import match, references, reports, search
from refloom.plans import check
from refloom.queries.base import PAIRS, REFS, VERDICTS_SQL, folded_sql, long, pairs, query, refs, table, verdicts
from refloom.schema import CANDIDATE, FIELDS

GENERIC = ", ".join(f"'{w}'" for w in sorted(strings.STOPWORDS | strings.GENERIC_VENUE_WORDS))

#: The longest common subsequence, a row of the table at a time: each cell is the greatest of what stands above and left of it.
LCS = """WITH RECURSIVE names AS (SELECT DISTINCT {a} AS a, {b} AS b FROM part), dp AS (
 SELECT a, b, 0 AS i, [0 FOR k IN range(0, length(b) + 1)] AS old FROM names
 UNION ALL
 SELECT a, b, i + 1, [list_max([CASE WHEN k = 0 THEN 0 WHEN substr(a, i + 1, 1) = substr(b, CAST(k AS INTEGER), 1) THEN old[k] + 1 ELSE old[k + 1] END FOR k IN range(0, j + 1)]) FOR j IN range(0, length(b) + 1)]
 FROM dp WHERE i < length(a)), best AS (SELECT a, b, old[length(b) + 1] AS lcs FROM dp WHERE i = length(a))"""


@query(LCS.format(a="p_name", b="p_type") + " SELECT p_partkey, CAST(lcs AS BIGINT) AS lcs, 100.0 * 2 * lcs / (length(a) + length(b)) AS ratio FROM part JOIN best ON a = p_name AND b = p_type")
def title_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs are scored once and joined back."""
    part = table(spark, sf_dir, "part")
    done = part.select("p_name", "p_type").distinct().withColumn("lcs", udfs.lcs_length(F.col("p_name"), F.col("p_type"))).withColumn("ratio", udfs.indel_ratio(F.col("p_name"), F.col("p_type")))
    return part.join(done, ["p_name", "p_type"]).select("p_partkey", long("lcs"), "ratio")


_SORTED = "array_to_string(list_sort(string_split({x}, ' ')), ' ')"


@query(LCS.format(a=_SORTED.format(x="p_name"), b=_SORTED.format(x="(lower(p_type) || ' ' || lower(p_brand))")) + f" SELECT p_partkey, 100.0 * 2 * lcs / (length(a) + length(b)) AS ratio FROM part JOIN best ON a = {_SORTED.format(x='p_name')} AND b = {_SORTED.format(x=chr(40) + 'lower(p_type) || ' + repr(' ') + ' || lower(p_brand))')}")
def token_sort_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("other", F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand")))
    done = part.select("p_name", "other").distinct().withColumn("ratio", udfs.token_sort_ratio(F.col("p_name"), F.col("other")))
    return part.join(done, ["p_name", "other"]).select("p_partkey", "ratio")


@query("SELECT p_partkey, 'match' AS same, 'partial' AS reworded, 'mismatch' AS other, true AS words_same, false AS words_reworded FROM part")
def title_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title with a typo, in British spelling and without its subtitle is the same; with a word put in it is close; another one differs."""
    base = F.concat(F.lit("optimization of the "), "p_name", F.lit(" behavior"))
    variant = F.concat(F.lit("Optimisation of the "), "p_name", F.lit(" behaviour: a subtitle"))
    reworded = F.concat(base, F.lit(" explained differently"))
    other = F.lit("zzz qqq xxx jjj kkk vvv")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    done = part.select("p_name").distinct().select(
        "p_name", compare.title_status(base, variant).alias("same"), compare.title_status(base, reworded).alias("reworded"), compare.title_status(base, other).alias("other"),
        compare.same_words(base, F.concat(F.lit("optimisation of the "), "p_name", F.lit(" behaviour"))).alias("words_same"), compare.same_words(base, reworded).alias("words_reworded"),
    )
    return part.join(done, "p_name").drop("p_name")


@query("SELECT item_id, CAST(1.0 AS DOUBLE) AS overlap FROM benchmark")
def title_overlap_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage stands whole in itself with words around it."""
    around = F.concat(F.lit("before it stands "), "text", F.lit(" and after"))
    return table(spark, sf_dir, "benchmark").select("item_id", compare.title_overlap(F.col("text"), around).alias("overlap"))


@query(PAIRS + " SELECT idx, work_id, CASE WHEN year = work_year THEN 'match' WHEN abs(year - work_year) <= 1 OR idx % 3 = 0 THEN 'partial' ELSE 'mismatch' END AS status, CAST(CASE WHEN year = work_year THEN 1.0 WHEN abs(year - work_year) <= 1 OR idx % 3 = 0 THEN 0.8 ELSE 0.0 END AS DOUBLE) AS score FROM pairs")
def compare_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = match.year_status(F.col("year"), F.col("work_year"), F.col("idx") % 3 == 0)
    return pairs(spark, sf_dir).select("idx", "work_id", status.alias("status"), match.year_score(status).alias("score"))


@query(PAIRS + f", w AS (SELECT idx, work_id, [x FOR x IN string_split({folded_sql('venue')}, ' ') IF x NOT IN ({GENERIC})] AS a, [x FOR x IN string_split({folded_sql('work_venue')}, ' ') IF x NOT IN ({GENERIC})] AS b FROM pairs) SELECT idx, work_id, array_to_string(a, ' ') AS cited, CAST(least(len(a), len(b)) AS BIGINT) AS words, a[1] = b[1] OR (length(a[1]) >= 3 AND (starts_with(a[1], b[1]) OR starts_with(b[1], a[1]))) AS first_agrees FROM w")
def compare_venue_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = text.venue_tokens(F.col("venue")), text.venue_tokens(F.col("work_venue"))
    first = text.same_abbreviated(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
    return pairs(spark, sf_dir).select("idx", "work_id", F.array_join(a, " ").alias("cited"), F.least(F.size(a), F.size(b)).cast("long").alias("words"), first.alias("first_agrees"))


@query(PAIRS + " SELECT idx, CAST(1.0 AS DOUBLE) AS same, CAST(1.0 AS DOUBLE) AS abbreviated, CAST(0.0 AS DOUBLE) AS generic FROM pairs")
def venue_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.concat(F.lit("J. "), F.col("lang"), F.lit(" Stud."))
    return pairs(spark, sf_dir).select("idx", compare.venue_similarity(F.col("venue"), F.col("venue")).alias("same"), compare.venue_similarity(short, F.col("venue")).alias("abbreviated"), compare.venue_similarity(F.lit("Journal"), F.col("venue")).alias("generic"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event types as cited authors, and the first half of the types by name as found ones."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("cited"), F.array_sort(F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type")))).alias("found"))


@query("""WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS cited, coalesce(list_sort(list(DISTINCT event_type) FILTER (event_id % 3 = 0)), []) AS found FROM events GROUP BY user_id),
 h AS (SELECT user_id, len([x FOR x IN cited IF list_contains(found, x)]) AS hits, len(cited) AS n, len(found) AS f FROM s)
 SELECT user_id, CASE WHEN f > 0 THEN round(CAST(hits AS DOUBLE) / n, 4) END AS share, CASE WHEN f = 0 THEN 'unknown' WHEN hits = n THEN 'match' WHEN 2 * hits >= n THEN 'partial' ELSE 'mismatch' END AS status FROM h""")
def compare_authors_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact arm of the author comparison, as array functions."""
    hits = F.size(F.filter("cited", lambda c: F.array_contains("found", c)))
    share = F.when(F.size("found") > 0, hits / F.size("cited"))
    return _shares(spark, sf_dir).select("user_id", F.round(share, 4).alias("share"), match.share_status(share).alias("status"))


@query(PAIRS + " SELECT idx, CASE WHEN idx = work_id THEN 'match' ELSE 'unknown' END AS status FROM pairs")
def compare_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = lambda c: F.concat(F.lit("10.1000/X"), F.lpad(F.col(c).cast("string"), 19, "0"))
    return pairs(spark, sf_dir).select("idx", match.doi_status(doi("idx"), F.concat(F.lit("https://doi.org/"), F.lower(doi("work_id")))).alias("status"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates of their customers: the fields of a comparison come from the columns of an order."""
    o = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1).cast("int")
    three = lambda n: F.element_at(F.array(F.lit("match"), F.lit("partial"), F.lit("mismatch"), F.lit("unknown")), (n + 1).cast("int"))
    m = F.struct(
        F.when(status == "F", "match").when(status == "O", "partial").otherwise("mismatch").alias("title"), (F.floor(F.col("o_totalprice")) % 100 / 100).alias("title_score"),
        three(priority % 4).alias("authors"), three(F.col("o_orderkey") % 4).alias("year"), three(F.floor(F.col("o_totalprice")) % 4).alias("venue"),
        (F.floor(F.col("o_totalprice") / 100) % 100 / 100).alias("confidence"), (F.col("o_orderkey") % 2 == 0).alias("first_author"), F.lit(False).alias("book"),
    )
    candidate = F.struct(F.lit(SCHOLAR).alias("engine"), F.col("o_orderkey").cast("string").alias("title"), (F.col("o_orderkey") % 50).alias("cited_by"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 7).alias("versions"))
    return o.select(F.col("o_custkey").alias("ref"), "o_orderkey", m.alias("m"), candidate.alias("candidate"), (F.year("o_orderdate") - 1990).alias("ordinal"), F.col("o_orderkey").alias("position"))


ORDERS = """orders_m AS (SELECT o_custkey AS ref, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'match' WHEN 'O' THEN 'partial' ELSE 'mismatch' END AS title, CAST(floor(o_totalprice) AS BIGINT) % 100 / 100.0 AS title_score,
 s[CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 4 + 1] AS authors, s[o_orderkey % 4 + 1] AS year, s[CAST(floor(o_totalprice) AS BIGINT) % 4 + 1] AS venue, CAST(floor(o_totalprice / 100) AS BIGINT) % 100 / 100.0 AS confidence,
 o_orderkey % 2 = 0 AS first_author, o_orderkey % 50 AS cited_by, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END AS versions, year(o_orderdate) - 1990 AS ordinal
 FROM (SELECT *, ['match', 'partial', 'mismatch', 'unknown'] AS s FROM orders)),
 judged AS (SELECT *, CAST(authors = 'mismatch' AS INTEGER) + CAST(year = 'mismatch' AS INTEGER) + CAST(venue = 'mismatch' AS INTEGER) AS disagree,
 CAST(authors IN ('match', 'partial') AS INTEGER) + CAST(year IN ('match', 'partial') AS INTEGER) + CAST(venue IN ('match', 'partial') AS INTEGER) AS agree,
 title = 'partial' AND first_author AND year IN ('match', 'partial') AS band FROM orders_m)"""


@query(f"WITH {ORDERS} SELECT o_orderkey, CAST(disagree AS BIGINT) AS disagree, CAST(agree AS BIGINT) AS agree, band FROM judged")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    return _orders(spark, sf_dir).select("o_orderkey", match.disagreeing(m).cast("long").alias("disagree"), match.agreeing(m).cast("long").alias("agree"), match.middle_band(m).alias("band"))


@query(f"""WITH {ORDERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY title = 'match' DESC, CASE WHEN title = 'match' THEN -disagree ELSE CAST(band AS INTEGER) END DESC,
 CASE WHEN title = 'match' THEN agree ELSE title_score END DESC, confidence DESC, CASE WHEN title = 'match' THEN cited_by ELSE 0 END DESC, ordinal, o_orderkey) AS rn FROM judged)
 SELECT ref, o_orderkey AS best, title, (SELECT max(j.versions) FROM judged j WHERE j.ref = ranked.ref AND j.title = 'match') AS versions FROM ranked WHERE rn = 1""")
def best_match_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each reference, and the most versions of a matching one."""
    best = match.best_of(_orders(spark, sf_dir), ["ref"])
    return best.select("ref", F.col("best.position").alias("best"), F.col("best.m.title").alias("title"), "versions")


@query(f"""WITH {ORDERS} SELECT ref, o_orderkey, row_number() OVER (PARTITION BY ref ORDER BY title = 'match' DESC, CASE WHEN title = 'match' THEN -disagree ELSE CAST(band AS INTEGER) END DESC,
 CASE WHEN title = 'match' THEN agree ELSE title_score END DESC, confidence DESC, CASE WHEN title = 'match' THEN cited_by ELSE 0 END DESC, ordinal, o_orderkey) AS rank FROM judged""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.ranked_window(_orders(spark, sf_dir), ["ref"]).select("ref", "o_orderkey", long("rank"))


@query(f"WITH {ORDERS}, stops AS (SELECT ref, min(ordinal) AS stop FROM judged WHERE title = 'match' AND disagree = 0 GROUP BY ref) SELECT j.ref, CAST(count(*) AS BIGINT) AS kept, CAST(max(s.stop) AS BIGINT) AS stop FROM judged j LEFT JOIN stops s ON s.ref = j.ref WHERE s.stop IS NULL OR j.ordinal <= s.stop GROUP BY j.ref")
def short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of queries up to the first sure match."""
    rows = _orders(spark, sf_dir)
    stop = match.confident_ordinal(rows, ["ref"])
    kept = rows.join(stop, "ref", "left").where(F.col("stop").isNull() | (F.col("ordinal") <= F.col("stop")))
    return kept.groupBy("ref").agg(F.count("*").alias("kept"), F.max("stop").cast("long").alias("stop"))


CONFIDENCE = """scored AS (SELECT o_orderkey, o_orderkey % 5 = 0 AS doi, o_orderkey % 3 = 0 AS web, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 101 / CAST(101 AS DOUBLE) END AS t, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 53 / CAST(53 AS DOUBLE) END AS a,
 CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 2 * 1.0 END AS y, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 17 / CAST(17 AS DOUBLE) END AS v FROM orders),
 mean AS (SELECT *, CASE WHEN t IS NULL THEN 0.0 ELSE 0.55 END + CASE WHEN a IS NULL THEN 0.0 ELSE 0.2 END + CASE WHEN y IS NULL THEN 0.0 ELSE 0.15 END + CASE WHEN v IS NULL THEN 0.0 ELSE 0.1 END AS w,
 coalesce(CAST(0.55 AS DOUBLE) * t, 0.0) + coalesce(CAST(0.2 AS DOUBLE) * a, 0.0) + coalesce(CAST(0.15 AS DOUBLE) * y, 0.0) + coalesce(CAST(0.1 AS DOUBLE) * v, 0.0) AS s FROM scored)"""


@query(f"WITH {CONFIDENCE}, c AS (SELECT o_orderkey, doi, web, CASE WHEN w > 0 THEN s / CAST(w AS DOUBLE) ELSE 0.0 END AS m FROM mean), d AS (SELECT o_orderkey, web, CASE WHEN doi THEN greatest(m, 0.98) ELSE m END AS m FROM c) SELECT o_orderkey, CAST(floor((CASE WHEN web THEN least(m, 0.7) ELSE m END) * 1000 + 0.25) AS BIGINT) AS thousandths FROM d")
def combine_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In whole thousandths, so that neither engine's rounding of ties shows."""
    k = F.col("o_orderkey")
    some = lambda n, value: F.when(k % n != 0, value)
    doi, engine = F.when(k % 5 == 0, "match").otherwise("unknown"), F.when(k % 3 == 0, "google").otherwise(SCHOLAR)
    sure = match.confidence(some(7, k % 101 / 101), some(4, k % 53 / 53), some(6, k % 2 * 1.0), some(11, k % 17 / 17), doi, engine)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(sure * 1000 + 0.25).alias("thousandths"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    authors = F.array(F.struct(F.lit("Doe").alias("surname"), F.lit("J").alias("given")))
    fields = F.struct(F.when(k % 13 > 0, F.concat(F.lit("title "), k.cast("string"))).alias("title"), authors.alias("authors"), F.lit(False).alias("et_al"), (k % 30 + 1990).cast("int").alias("year"), F.lit("Some Venue").alias("venue"), F.lit(None).cast("string").alias("doi"), F.when(k % 26 > 0, "article").alias("entry_type"), F.lit(None).cast("struct<title:double,authors:double,year:double,venue:double,doi:double>").alias("confidence"))
    c = F.struct(
        F.when(k % 9 == 0, "google").otherwise(SCHOLAR).alias("engine"), F.concat(F.lit("found "), k.cast("string")).alias("title"), F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("result_id"), F.array(F.lit("R Roe"), F.lit("P Poe"), F.lit("L Loe"), F.lit("M Moe")).alias("authors"),
        F.lit(False).alias("authors_truncated"), (k % 31 + 1990).cast("int").alias("year"), F.lit("Other Place").alias("venue"), F.lit(False).alias("venue_truncated"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("snippet"), (k * 37).alias("cited_by"), (k % 7).alias("versions"),
    ).cast(CANDIDATE)
    best = F.when(k % 10 > 0, F.struct(c.alias("candidate"), F.col("m").alias("m")))
    return rows.select("o_orderkey", fields.cast(FIELDS).alias("fields"), F.when(k % 2 == 0, "bibtex").otherwise("text").alias("source_format"), best.alias("best"), (k % 7).alias("versions"), (k % 3 > 0).alias("complete"), F.lit(match.MISSES["offline"]).alias("incomplete_reason"))


@query(f"""WITH {ORDERS}, r AS (SELECT j.*, o_orderkey AS k, o_orderkey % 10 > 0 AS has, o_orderkey % 9 = 0 AS web FROM judged j),
 v AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'UNPARSEABLE' WHEN has AND title = 'match' AND disagree = 0 THEN 'VERIFIED' WHEN has AND title = 'match' THEN 'METADATA_MISMATCH' WHEN has AND band THEN 'METADATA_MISMATCH' WHEN k % 3 = 0 THEN 'SKIPPED_BUDGET' ELSE 'NOT_FOUND' END AS verdict,
 [x FOR x IN ['title', CASE WHEN authors IN ('match', 'partial') THEN 'authors' END, CASE WHEN year IN ('match', 'partial') THEN 'year' END, CASE WHEN venue IN ('match', 'partial') THEN 'venue' END] IF x IS NOT NULL] AS agreeing,
 [x FOR x IN [CASE WHEN authors = 'unknown' THEN 'authors' END, CASE WHEN venue = 'unknown' THEN 'venue' END] IF x IS NOT NULL] AS unsure FROM r),
 w AS (SELECT *, CASE WHEN len(agreeing) = 1 THEN 'Title matches' ELSE 'Title' || CASE len(agreeing) WHEN 2 THEN '' WHEN 3 THEN ', ' || agreeing[2] ELSE ', ' || agreeing[2] || ', ' || agreeing[3] END || ' and ' || agreeing[len(agreeing)] || ' match' END AS subject FROM v)
 SELECT o_orderkey, verdict, CASE WHEN verdict = 'UNPARSEABLE' AND k % 2 = 0 AND k % 26 = 0 THEN 'The BibTeX entry could not be parsed, so it was not searched.' WHEN verdict = 'UNPARSEABLE' THEN 'No title could be extracted from this reference, so it was not searched.'
 WHEN verdict = 'VERIFIED' AND web THEN subject || ' a Google web result. Found only via Google web search (not in Google Scholar)' || CASE len(unsure) WHEN 0 THEN '' ELSE '; ' || array_to_string(unsure, ' and ') || ' could not be confirmed' END || '.'
 WHEN verdict = 'VERIFIED' THEN subject || ' a Google Scholar record' || CASE WHEN k > 0 THEN ' (cited by ' || format('{{:,}}', k * 37) || ')' ELSE '' END || CASE WHEN year = 'partial' THEN '; Scholar lists ' || (k % 31 + 1990) || ', likely the preprint or published version' ELSE '' END || '.'
 WHEN verdict = 'METADATA_MISMATCH' AND title = 'match' THEN 'Title matches, but ' || array_to_string([x FOR x IN [CASE WHEN authors = 'mismatch' THEN 'authors are R Roe, P Poe, L Loe et al., not Doe' END,
  CASE WHEN year = 'mismatch' THEN 'year is ' || (k % 31 + 1990) || ', not ' || (k % 30 + 1990) END, CASE WHEN venue = 'mismatch' THEN 'venue is Other Place, not Some Venue' END] IF x IS NOT NULL], '; ') || '.' ||
  CASE WHEN k % 7 > 1 AND authors <> 'mismatch' THEN ' (Google Scholar lists this work with ' || (k % 7) || ' versions; this may be a different version.)' ELSE '' END
 WHEN verdict = 'METADATA_MISMATCH' THEN 'Title differs from the closest real paper: ''found ' || k || ''' (' || (k % 31 + 1990) || ').'
 WHEN verdict = 'SKIPPED_BUDGET' THEN 'Not checked: no cached search result for this reference (offline mode).' WHEN NOT has THEN 'No Google Scholar record was found for this title.'
 ELSE 'No Google Scholar record matches this title; the closest result was “found ' || k || '” (' || CAST(round(title_score * 100) AS INTEGER) || '% similar).' END AS reason FROM w""")
def verdict_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules and their reasons, over candidates made of orders."""
    return match.decided(_decisions(spark, sf_dir)).select("o_orderkey", "verdict", "reason")


@query(f"WITH {VERDICTS_SQL} SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (verdict = '{v}') AS BIGINT) AS {v.lower()}" for v in VERDICTS) + ", CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (verdict IN ('VERIFIED', 'METADATA_MISMATCH', 'NOT_FOUND')) AS BIGINT) AS checked FROM verd GROUP BY user_id")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.summarised(verdicts(spark, sf_dir), ["user_id"]).drop("integrity_score")


@query(f"WITH {VERDICTS_SQL}, c AS (SELECT user_id, count(*) FILTER (verdict = 'VERIFIED') AS v, count(*) FILTER (verdict = 'METADATA_MISMATCH') AS m, count(*) FILTER (verdict = 'NOT_FOUND') AS n FROM verd GROUP BY user_id) SELECT user_id, CASE WHEN v + m + n > 0 THEN round(100.0 * (v + CAST(0.5 AS DOUBLE) * m) / CAST(v + m + n AS DOUBLE), 1) END AS integrity_score FROM c")
def integrity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.summarised(verdicts(spark, sf_dir), ["user_id"]).select("user_id", "integrity_score")


@query(f"WITH {REFS}, k AS (SELECT idx, lang, CASE WHEN title = '' THEN 'raw:' ELSE {folded_sql('title')} || '|' || list_last(string_split({folded_sql('surname')}, ' ')) || '|' || (1990 + length(title) % 35) || '|' || {folded_sql('venue')} || '||' END AS key FROM refs) SELECT idx, min(idx) OVER (PARTITION BY lang, key) AS original, key FROM k")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("idx", "original", F.col("dedupe_key").alias("key"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    author = F.struct(F.col("surname").alias("surname"), F.lit("").alias("given"))
    fields = F.struct(F.col("title").alias("title"), F.array(author).alias("authors"), (1990 + F.length("title") % 35).cast("int").alias("year"), F.col("venue").alias("venue"), none.alias("doi"), none.alias("entry_type"))
    rows = refs(spark, sf_dir).withColumn("dedupe_key", references.dedupe_key(fields, F.lit("")))
    return references.with_original(rows, ["lang"])


@query(f"WITH {REFS}, k AS (SELECT idx, lang, CASE WHEN title = '' THEN 'raw:' ELSE {folded_sql('title')} || '|' || list_last(string_split({folded_sql('surname')}, ' ')) || '|' || (1990 + length(title) % 35) || '|' || {folded_sql('venue')} || '||' END AS key FROM refs), o AS (SELECT idx, min(idx) OVER (PARTITION BY lang, key) AS original FROM k) SELECT idx, CASE WHEN idx <> original THEN original END AS duplicate_of, CASE WHEN idx <> original THEN 'Duplicate of reference ' || original || '. ' ELSE '' END || 'Checked as ' || original || '.' AS reason FROM o")
def duplicate_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results are worked out for originals only and handed on to their copies."""
    keyed = _keyed(spark, sf_dir)
    done = references.originals(keyed).select("lang", "idx", F.concat(F.lit("Checked as "), F.col("idx").cast("string"), F.lit(".")).alias("reason"))
    return references.fanned_out(keyed, done, ["lang"]).select("idx", "duplicate_of", "reason")


SARIF_RULES = "CASE verdict WHEN 'NOT_FOUND' THEN 'RL001' WHEN 'METADATA_MISMATCH' THEN 'RL002' WHEN 'UNPARSEABLE' THEN 'RL003' ELSE 'RL004' END"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of a check."""
    k = F.col("event_id").cast("string")
    fields = F.struct(F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("Title | "), k)).alias("title"))
    candidate = F.struct(F.concat(F.lit("Found "), k).alias("title"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://x.org/"), k)).alias("link"))
    return verdicts(spark, sf_dir).select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("idx"), "verdict", (F.floor(F.col("value") * 100) % 101 / 100).alias("confidence"), fields.alias("fields"), F.concat(F.lit("raw text that is long enough to be cut off somewhere near its very end, number "), k, F.lit(" of many")).alias("raw"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("key"), k)).alias("key"), F.when(F.col("event_id") % 5 > 0, F.col("event_id").cast("int")).alias("line"), F.lit("Because\nof it.").alias("reason"), F.struct(candidate.alias("candidate")).alias("best"),
    )


@query(f"""WITH {VERDICTS_SQL}, r AS (SELECT user_id AS doc_id, event_id AS idx, verdict, CASE WHEN event_id % 2 = 0 THEN 'key' || event_id ELSE '' END AS key, CASE WHEN event_id % 3 > 0 THEN 'Title | ' || event_id END AS title,
 'raw text that is long enough to be cut off somewhere near its very end, number ' || event_id || ' of many' AS raw FROM verd)
 SELECT doc_id, idx, {SARIF_RULES} AS rule, CASE verdict WHEN 'NOT_FOUND' THEN 'error' WHEN 'SKIPPED_BUDGET' THEN 'note' ELSE 'warning' END AS level, substr(sha256(key || '|' || coalesce(title, raw)), 1, 32) AS fingerprint,
 CASE WHEN key <> '' THEN '[' || key || '] ' ELSE 'Reference ' || idx || ': ' END || CASE WHEN title IS NOT NULL THEN '“' || title || '”: ' ELSE '' END || 'Because' || chr(10) || 'of it.' AS message FROM r WHERE verdict <> 'VERIFIED'""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_results(_results(spark, sf_dir)).select("doc_id", "idx", "rule", "level", "fingerprint", "message")


@query(rf"""WITH {VERDICTS_SQL}, r AS (SELECT user_id AS doc_id, event_id AS idx, verdict, CAST(floor(value * 100) AS BIGINT) % 101 AS pct, CASE WHEN event_id % 3 > 0 THEN 'Title \| ' || event_id END AS title,
 'raw text that is long enough to be cut off somewhere near its very end, number ' || event_id || ' of many' AS raw FROM verd)
 SELECT doc_id, idx, '| ' || idx || ' | ' || CASE verdict WHEN 'VERIFIED' THEN 'Verified' WHEN 'METADATA_MISMATCH' THEN 'Metadata mismatch' WHEN 'NOT_FOUND' THEN 'Not found' WHEN 'UNPARSEABLE' THEN 'Unparseable' ELSE 'Skipped' END || ' | ' ||
 (pct // 100) || '.' || lpad(CAST(pct % 100 AS VARCHAR), 2, '0') || ' | ' || coalesce(title, CASE WHEN length(raw) <= 80 THEN raw ELSE substr(raw, 1, 77) || '...' END) || ' | Because of it. | ' || CASE WHEN idx % 2 = 0 THEN '[Found ' || idx || '](https://x.org/' || idx || ')' ELSE 'Found ' || idx END || ' |' AS line FROM r""")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.col("best.candidate")
    line = reports.markdown_row(F.col("idx"), F.col("verdict"), F.col("confidence"), reports.cited_title(F.col("fields.title"), F.col("raw")), F.col("reason"), best["title"], best["link"])
    return _results(spark, sf_dir).select("doc_id", "idx", line.alias("line"))


@query(f"WITH {VERDICTS_SQL} SELECT user_id, event_id, CASE verdict WHEN 'NOT_FOUND' THEN 0 WHEN 'METADATA_MISMATCH' THEN 1 WHEN 'UNPARSEABLE' THEN 2 WHEN 'SKIPPED_BUDGET' THEN 3 ELSE 4 END::BIGINT AS severity, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE verdict WHEN 'NOT_FOUND' THEN 0 WHEN 'METADATA_MISMATCH' THEN 1 WHEN 'UNPARSEABLE' THEN 2 WHEN 'SKIPPED_BUDGET' THEN 3 ELSE 4 END, event_id) AS BIGINT) AS place FROM verd")
def severity_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = verdicts(spark, sf_dir).withColumn("severity", reports.severity(F.col("verdict")).cast("long"))
    return rows.select("user_id", "event_id", "severity", F.row_number().over(Window.partitionBy("user_id").orderBy("severity", "event_id")).cast("long").alias("place"))


@query("WITH s AS (SELECT o_custkey AS doc_id, sum(CAST(floor(o_totalprice) AS BIGINT)) % 1001 AS tenths FROM orders GROUP BY o_custkey) SELECT doc_id, (tenths // 10) || CASE WHEN tenths % 10 > 0 THEN '.' || (tenths % 10) ELSE '' END || ' / 100' AS score FROM s")
def score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenths = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg((F.sum(F.floor("o_totalprice")) % 1001).alias("t"))
    return tenths.select("doc_id", reports.score_text(F.col("t") / 10).alias("score"))


#: Titles are cut nowhere, so that a query's text is its title's.
UNCUT = Search(max_query_chars=1 << 30)


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document as a citation, and stored answers to the Scholar queries of each distinct title whose least document is even: its work, in another year
    or by another author for some, and nothing for others."""
    none = F.lit(None).cast("string")
    author = F.struct(F.lit("Smith").alias("surname"), F.lit("J").alias("given"))
    sure = F.struct(*(F.lit(1.0).alias(n) for n in ("title", "authors", "year", "venue", "doi")))
    fields = F.struct(F.col("title"), F.array(author).alias("authors"), F.lit(False).alias("et_al"), F.col("year"), F.col("venue"), none.alias("doi"), F.lit("article").alias("entry_type"), sure.alias("confidence"))
    cited = refs(spark, sf_dir).select(F.lit(0).cast("long").alias("doc_id"), "idx", F.col("title").alias("raw"), F.lit("text").alias("source_format"), none.alias("key"), F.lit(1).alias("line"), fields.cast(FIELDS).alias("fields"), "source")
    named = refs(spark, sf_dir).where("title <> ''").withColumn("u", search.query_title(F.col("title"), UNCUT))
    works = named.groupBy("u").agg(F.min(F.struct("idx", "title", "year", "venue")).alias("w")).select("w.*").where("idx % 2 = 0")
    plan = search.planned(works.select("*", F.lit("Smith").alias("surname"), F.lit("article").alias("entry_type")), UNCUT)
    shift = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(5)), (F.col("idx") % 3 + 1).cast("int"))
    who = F.when(F.col("idx") % 5 == 0, "Z Quux").otherwise("J Smith")
    summary = F.concat(who, F.lit(" - "), F.col("venue"), F.lit(", "), (F.col("year") + shift).cast("string"), F.lit(" - x.org"))
    result = F.struct(F.col("title"), F.struct(summary.alias("summary")).alias("publication_info"))
    answer = F.when(F.col("idx") % 7 == 0, F.array().cast("array<struct<title:string,publication_info:struct<summary:string>>>")).otherwise(F.array(result))
    stored = plan.select(F.col("cache_key").alias("key"), "engine", "query", F.lit("2026-01-01").cast("timestamp").alias("created"), F.to_json(F.struct(answer.alias("organic_results"))).alias("body"))
    return cited, stored


STOP = ", ".join(f"'{w}'" for w in sorted(strings.STOPWORDS))
#: A title with a word that counts is the same as itself; one of stop words only is close to itself; one without words is like nothing.
CHECK = f"""WITH {REFS}, q AS (SELECT *, {folded_sql("title")} AS key, trim(regexp_replace(regexp_replace(title, '["“”«»]', ' ', 'g'), '\\s+', ' ', 'g')) AS u FROM refs),
 g AS (SELECT u, min(idx) AS m FROM q WHERE title <> '' GROUP BY u),
 o AS (SELECT idx, source, min(idx) OVER (PARTITION BY title = '', key, CASE WHEN title = '' THEN 0 ELSE year END, CASE WHEN title = '' THEN '' ELSE venue END) AS original FROM q),
 j AS (SELECT q.*, m, len([w FOR w IN string_split(key, ' ') IF w <> '' AND w NOT IN ({STOP})]) AS counting, m % 5 > 0 AND abs(year - (1990 + m % 35 + CASE m % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 5 END)) <= 1 AS agrees FROM q LEFT JOIN g ON g.u = q.u),
 c AS (SELECT idx, CASE WHEN title = '' THEN 'UNPARSEABLE' WHEN m % 2 = 1 THEN 'SKIPPED_BUDGET' WHEN m % 7 = 0 THEN 'NOT_FOUND' WHEN counting > 0 AND agrees THEN 'VERIFIED' WHEN counting > 0 THEN 'METADATA_MISMATCH' WHEN key <> '' AND agrees THEN 'METADATA_MISMATCH' ELSE 'NOT_FOUND' END AS verdict FROM j),
 v AS (SELECT o.idx, o.source, c.verdict FROM o JOIN c ON c.idx = o.original)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited, stored = _store(spark, sf_dir)
    return check.check_references(cited.drop("source"), stored, searching=UNCUT).join(cited.select("idx", "source"), "idx")


@query(CHECK + " SELECT idx, source, verdict FROM v")
def check_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole check: plan, look up, parse answers, compare, rank, decide."""
    return _checked(spark, sf_dir).select("idx", "source", "verdict")


_COUNTS = ", ".join(f"CAST(count(*) FILTER (verdict = '{v}') AS BIGINT) AS {v.lower()}" for v in VERDICTS)


@query(CHECK + f", n AS (SELECT source, {_COUNTS}, CAST(count(*) AS BIGINT) AS total FROM v GROUP BY source) SELECT *, CASE WHEN verified + metadata_mismatch + not_found > 0 THEN round(100.0 * (verified + CAST(0.5 AS DOUBLE) * metadata_mismatch) / CAST(verified + metadata_mismatch + not_found AS DOUBLE), 1) END AS integrity_score FROM n")
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.summarised(_checked(spark, sf_dir), ["source"]).drop("checked")


@query(f"WITH {REFS} SELECT DISTINCT {folded_sql('title')} AS title FROM refs UNION SELECT {folded_sql('text')} FROM benchmark")
def set_union_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = refs(spark, sf_dir).select(text.fold(F.col("title")).alias("title"))
    return ours.unionByName(table(spark, sf_dir, "benchmark").select(text.fold(F.col("text")).alias("title"))).distinct()


@query("SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored answers: a result with a title, one without, and private fields."""
    body = F.coalesce("text", F.lit(""))
    result = F.struct(F.col("source").alias("title"), F.concat(F.lit("https://x.org/"), F.col("doc_id").cast("string")).alias("link"), body.alias("snippet"), F.struct(F.lit("J Smith - Nature, 2015 - x.org").alias("summary")).alias("publication_info"), F.struct(F.struct(F.col("doc_id").alias("total")).alias("cited_by")).alias("inline_links"), F.lit("secret").alias("thumbnail"))
    untitled = F.struct(F.lit(None).cast("string").alias("title"), F.lit("x").alias("link"), F.lit("").alias("snippet"), F.struct(F.lit("").alias("summary")).alias("publication_info"), F.struct(F.struct(F.lit(1).cast("long").alias("total")).alias("cited_by")).alias("inline_links"), F.lit("secret").alias("thumbnail"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(SCHOLAR).alias("engine"), F.to_json(F.struct(F.array(untitled, result).alias("organic_results"), F.lit("k").alias("api_key"))).alias("body"))


@query("SELECT doc_id, CAST(2 AS BIGINT) AS position, source AS title, coalesce(text, '') AS snippet, doc_id AS cited_by, 'J Smith' AS authors, 'Nature' AS venue, CAST(2015 AS BIGINT) AS year FROM documents")
def json_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("candidate")
    return search.candidates(_answers(spark, sf_dir)).select("doc_id", long("position"), c["title"].alias("title"), c["snippet"].alias("snippet"), c["cited_by"].alias("cited_by"), F.array_join(c["authors"], ", ").alias("authors"), c["venue"].alias("venue"), c["year"].cast("long").alias("year"))


@query("SELECT doc_id, false AS has_key, false AS has_thumbnail, source AS title FROM documents")
def trim_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = search.trimmed(F.col("body"))
    return _answers(spark, sf_dir).select("doc_id", small.contains("api_key").alias("has_key"), small.contains("thumbnail").alias("has_thumbnail"), F.get_json_object(small, "$.organic_results[1].title").alias("title"))


@query("SELECT doc_id, source || ' story' AS title, lang AS author, CAST(1990 + doc_id % 35 AS BIGINT) AS year, CAST(0 AS BIGINT) AS position FROM documents UNION ALL SELECT doc_id, source, NULL, CAST(1990 + doc_id % 35 AS BIGINT), CAST(1 AS BIGINT) FROM documents")
def web_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge panel and a web result."""
    year = (1990 + F.col("doc_id") % 35).cast("string")
    graph = F.struct(F.concat("source", F.lit(" story")).alias("title"), F.col("lang").alias("authors"), F.concat(F.lit("May 1, "), year).alias("published"))
    page = F.struct(F.concat("source", F.lit(" | Shop")).alias("title"), F.concat(F.lit("Jan 2, "), year).alias("date"), F.lit("12345 1850").alias("snippet"), F.lit("https://www.x.org/a").alias("link"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("google").alias("engine"), F.to_json(F.struct(graph.alias("knowledge_graph"), F.array(page).alias("organic_results"))).alias("body"))
    c = F.col("candidate")
    return search.candidates(docs).select("doc_id", c["title"].alias("title"), F.get(c["authors"], F.lit(0)).alias("author"), c["year"].cast("long").alias("year"), long("position"))
