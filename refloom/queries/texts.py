"""Text functions, sources, splitting and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.config import Parse
from refloom.functions import citations, strings, summaries, text, udfs
from refloom.operators import lines, search
from refloom.queries.base import REFS, folded_sql, long, query, refs, table
from refloom.sources import files

STOP = ", ".join(f"'{w}'" for w in sorted(strings.STOPWORDS))
GENERIC = ", ".join(f"'{w}'" for w in sorted(strings.STOPWORDS | strings.GENERIC_VENUE_WORDS))


@query(f"SELECT doc_id, {folded_sql('text')} AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, {folded_sql('text')} AS folded FROM documents")
def fold_text_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Arrow kernel, which knows all of Unicode."""
    return table(spark, sf_dir, "documents").select("doc_id", udfs.fold(F.col("text")).alias("folded"))


@query(f"SELECT item_id, array_to_string([w FOR w IN string_split({folded_sql('text')}, ' ') IF w NOT IN ({STOP})], ' ') AS kept FROM benchmark")
def tokens_nostop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.tokens(F.col("text"), drop_stopwords=True), " ").alias("kept"))


@query("SELECT p_partkey, CAST(p_size % 21 AS VARCHAR) || ' ' || CASE p_size % 10 WHEN 0 THEN '1st' WHEN 1 THEN '2nd' WHEN 2 THEN '3rd' ELSE (p_size % 10 + 1) || 'th' END AS canonical FROM part")
def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number words and ordinals come back as the numbers they were rendered from."""
    number = F.element_at(F.array(*map(F.lit, strings.NUMBERS)), (F.col("p_size") % 21 + 1).cast("int"))
    ordinal = F.element_at(F.array(*map(F.lit, strings.ORDINALS)), (F.col("p_size") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", text.canonical_word(number), text.canonical_word(ordinal)).alias("canonical"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'colored' WHEN 1 THEN 'optimization' WHEN 2 THEN 'theater' WHEN 3 THEN 'modeling' ELSE 'fourth hour' END AS spelt FROM part")
def canonical_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    british = F.element_at(F.array(*map(F.lit, ("coloured", "optimisation", "theatre", "modelling", "fourth"))), (F.col("p_size") % 5 + 1).cast("int"))
    spelt = text.canonical_word(british)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 4, F.concat_ws(" ", F.lit("fourth"), text.canonical_word(F.lit("hour")))).otherwise(spelt).alias("spelt"))


@query("SELECT p_partkey, replace(p_name, ' ', '') || ' 2stream ct' AS words FROM part")
def canonical_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyphens join words, number words become digits, and single letters in a row are one word."""
    title = F.concat(F.translate("p_name", " ", "-"), F.lit(" two-stream C T"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(udfs.canonical_words(title), " ").alias("words"))


@query(rf"""WITH {REFS} SELECT idx, regexp_replace(trim(title || ': ' || venue), '\s*(:|\s[-–—]\s|\?\s)\s*(.|\n)*$', '') AS main FROM refs""")
def main_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs(spark, sf_dir).select("idx", text.main_title(F.concat("title", F.lit(": "), "venue")).alias("main"))


@query(f"WITH {REFS} SELECT idx, list_last(string_split({folded_sql('title')}, ' ')) AS surname_key FROM refs")
def surname_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs(spark, sf_dir).select("idx", text.surname_key(F.col("title")).alias("surname_key"))


@query(r"SELECT doc_id, array_to_string([trim(regexp_replace(x, '[ \t]+', ' ', 'g')) FOR x IN string_split(text, chr(10))], chr(10)) AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", udfs.clean_text(F.col("text")).alias("cleaned"))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\p{L}]', '', 'g') AS letters, length(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\p{L}]', '', 'g')) >= 10 AS plausible FROM pages""")
def plausible_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(title, r"[^\p{L}]", "").alias("letters"), (text.letters(title) >= Parse().min_title_chars).alias("plausible"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\s*(\.\.\.|…)$', '') AS title FROM pages),
 s AS (SELECT *, trim(regexp_extract(title, '\s+[-|–—]\s+([^-|–—:]{1,40})$', 1)) AS site FROM t)
 SELECT page_id, trim(CASE WHEN site <> '' AND len(string_split_regex(site, '\s+')) <= 4 THEN regexp_replace(title, '\s+[-|–—]\s+([^-|–—:]{1,40})$', '') ELSE title END) AS title FROM s""")
def web_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", search.clean_web_title(title).alias("title"))


@query("SELECT page_id, page_id % 2 = 0 AS has_site, 'A plain title' AS title FROM pages")
def web_title_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's name put behind a title goes away again."""
    site = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" | "), F.regexp_extract("url", r"//([\w.]+)", 1))).otherwise("...")
    return table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 2 == 0).alias("has_site"), search.clean_web_title(F.concat(F.lit("A plain title"), site)).alias("title"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN url END AS safe FROM pages")
def safe_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", search.source_host(F.col("url")).alias("host"), search.safe_url(F.col("url")).alias("safe"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'bibtex' WHEN 2 THEN 'pdf' END AS format, CASE WHEN page_id % 4 = 3 THEN 'Zipped formats are not supported.' END AS error, 'f' || page_id || '.x' AS name FROM pages")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of pages in four formats, told apart by their content."""
    head = F.element_at(F.array(F.lit("plain "), F.lit("\n @article{x,\n"), F.lit("%PDF-1.7 "), F.lit("PK\x03\x04")), (F.col("page_id") % 4 + 1).cast("int"))
    made = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/a/b\\c/f"), "page_id", F.lit(".x")).alias("path"), F.concat(head, "url").cast("binary").alias("content"))
    return files.detected(made).select("page_id", "format", "error", "name")


def _with_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in front of a references section whose entries are its own lines, then an appendix."""
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.concat(F.lit("References\n"), body, F.lit("\n7. REFERENCES\n"), body, F.lit("\nAppendix A\nend")).alias("text"))


@query("SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS section FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) GROUP BY doc_id")
def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section after the last heading is the text it was put around."""
    found = lines.section_lines(lines.text_lines(_with_section(spark, sf_dir)))
    return found.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("section"))


def _lists(spark: SparkSession, sf_dir: str, render, keep=None) -> DataFrame:
    """One text for each conversation: its turns rendered as a list."""
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    turns = turns.withColumn("body", F.concat(F.lit("Smith, J. ("), (F.col("turn") + 1990).cast("string"), F.lit("). Item "), F.col("n").cast("string"), F.lit(" of list "), F.col("conv_id").cast("string"), F.lit(".")))
    parts = F.array_sort(F.collect_list(F.struct("n", render(F.col("n"), F.col("body")).alias("t"))))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


LIST_SQL = "SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS idx, 'Smith, J. (' || (turn + 1990) || '). Item ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' of list ' || conv_id || '.' AS raw FROM conversations"


@query(LIST_SQL)
def split_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lists with wrapped, hyphened lines come apart into their items."""
    made = _lists(spark, sf_dir, lambda n, body: F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.regexp_replace(body, "Item", "It-\nem")))
    return lines.split_references(lines.text_lines(made)).select("doc_id", long("idx"), "raw")


@query(LIST_SQL)
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _lists(spark, sf_dir, lambda n, body: F.concat(F.regexp_replace(body, " Item", "\nItem"), F.lit("\n")))
    return lines.split_references(lines.text_lines(made)).select("doc_id", long("idx"), "raw")


@query(LIST_SQL)
def split_author_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _lists(spark, sf_dir, lambda n, body: F.regexp_replace(body, " of list", "\nof list"))
    return lines.split_references(lines.text_lines(made)).select("doc_id", long("idx"), "raw")


@query(LIST_SQL)
def split_inline_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _lists(spark, sf_dir, lambda n, body: F.concat(F.lit("["), n.cast("string"), F.lit("] "), body))
    return lines.split_references(lines.text_lines(made.withColumn("text", F.translate("text", "\n", " ")))).select("doc_id", long("idx"), "raw")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS starts FROM events GROUP BY user_id")
def marker_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events numbered from 1, each third number left out and a stray year after each, open as many references as there are events."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("k", n)
    number = (F.col("k") + F.floor((F.col("k") - 1) / 2)).cast("int")
    marks = rows.groupBy("user_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("k"), number.alias("n")))), lambda x: F.array(F.struct(x["k"].alias("at"), x["n"].alias("n")), F.struct(x["k"].alias("at"), F.lit(20000).alias("n"))))).alias("m"))
    return marks.select("user_id", F.size(lines.sequence_starts(F.col("m"))).cast("long").alias("starts"))


@query("SELECT conv_id AS doc_id, turn AS page, text AS kept FROM conversations WHERE text <> ''")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages get a header with a page number, a footer and a bare number; what is left are the pages."""
    turns = table(spark, sf_dir, "conversations").where("text <> ''").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.translate("text", "\n", "\x01").alias("text"))
    both = F.count("*").over(Window.partitionBy("doc_id"))
    turns = turns.withColumn("many", both)
    page = F.col("page").cast("string")
    made = turns.select("doc_id", "page", "many", F.posexplode(F.array(F.concat(F.lit("Report 7, p. "), page), page, F.col("text"), F.concat(F.lit("Page "), page, F.lit(" of 9")), F.lit("Printed in 2020"))).alias("line", "text"))
    # A single page has no running lines but its numbers.
    made = made.where((F.col("many") > 1) | F.col("line").isin(1, 2, 3))
    return lines.running_lines_removed(made.drop("many")).select("doc_id", "page", F.translate("text", "\x01", "\n").alias("kept"))




def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    idx, year = F.col("idx").cast("string"), F.col("year").cast("string")
    number = F.translate(idx, "0123456789", "abcdefghij")
    return refs(spark, sf_dir).withColumn("word", number).withColumn("raw", c("Smith, A. B., & Jones, C. (", year, "). A study of ", F.col("lang"), " things named item", number, ". ", F.col("venue"), ", 12(3), 1-9. https://doi.org/10.1000/x", idx))


PARSED = f"""WITH {REFS} SELECT idx, 'A study of ' || lang || ' things named item' || translate(CAST(idx AS VARCHAR), '0123456789', 'abcdefghij') AS title, 'Smith; Jones' AS surnames, CAST(year AS BIGINT) AS year, venue, '10.1000/x' || idx AS doi,
 CAST(0.85 AS DOUBLE) AS title_sure, CAST(0.9 AS DOUBLE) AS authors_sure, CAST(0.95 AS DOUBLE) AS year_sure FROM refs"""


@query(PARSED)
def parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A citation in the style of APA gives back the fields it was rendered from."""
    f = citations.parse_fields(F.col("raw"))
    return _rendered(spark, sf_dir).select("idx", f.alias("f")).select(
        "idx", "f.title", F.array_join(F.transform("f.authors", lambda a: a["surname"]), "; ").alias("surnames"), F.col("f.year").cast("long").alias("year"), "f.venue", "f.doi",
        F.col("f.confidence.title").alias("title_sure"), F.col("f.confidence.authors").alias("authors_sure"), F.col("f.confidence.year").alias("year_sure"),
    )


@query(f"WITH {REFS} SELECT idx, CASE WHEN idx % 3 = 0 THEN 'phdthesis' WHEN idx % 3 = 1 THEN 'techreport' ELSE 'book' END AS entry_type, CASE idx % 2 WHEN 0 THEN 'arXiv' ELSE venue END AS venue FROM refs")
def entry_type_and_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.element_at(F.array(F.lit("PhD thesis"), F.lit("Technical report"), F.lit("Some Press")), (F.col("idx") % 3 + 1).cast("int"))
    rest = F.when(F.col("idx") % 2 == 0, F.lit("arXiv:1706.03762")).otherwise(F.concat(F.lit("In: "), "venue", F.lit(", vol. 3, pp. 1-2")))
    raw = F.concat(F.lit('Smith J, "A long enough title," '), rest, F.lit(", 1999. "), hint)
    f = citations.parse_fields(raw)
    return refs(spark, sf_dir).select("idx", f.alias("f")).select("idx", "f.entry_type", "f.venue")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Kalam|Narayan' WHEN 1 THEN 'de la Fontaine|O''Brien' WHEN 2 THEN 'Sharma|Vaswani' ELSE 'Abdul Kalam|Hinton' END AS surnames, c_custkey % 2 = 0 AS et_al FROM customer")
def parse_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ("Kalam, A. P. J., & Narayan, R. K.", "Jean de la Fontaine and Pat O'Brien", "Sharma AK, Vaswani A", "A. P. J. Abdul Kalam, G. Hinton")
    people = F.element_at(F.array(*map(F.lit, shapes)), (F.col("c_custkey") % 4 + 1).cast("int"))
    a = udfs.parse_authors(F.concat(people, F.when(F.col("c_custkey") % 2 == 0, " et al.").otherwise("")))
    return table(spark, sf_dir, "customer").select("c_custkey", a.alias("a")).select("c_custkey", F.array_join(F.transform("a.authors", lambda x: x["surname"]), "|").alias("surnames"), "a.et_al")


SUMMARY_SQL = "SELECT idx, 'A Smith|' || 'B Jones' AS authors, idx % 2 = 0 AS cut, venue, CAST(year AS BIGINT) AS year, 'example.org' AS source FROM refs"


@query(f"WITH {REFS} {SUMMARY_SQL}")
def parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layouts of a result's display line give back what they were made of."""
    cut = F.when(F.col("idx") % 2 == 0, "…").otherwise("")
    year = F.col("year").cast("string")
    classic = F.concat(F.lit("A Smith, B Jones"), cut, F.lit(" - "), "venue", F.lit(", "), year, F.lit(" - example.org"))
    glued = F.concat(F.lit("A Smith, B Jones"), cut, "venue", F.lit(", "), year, F.lit("•example.org"))
    names = F.array(F.lit("A Smith"), F.lit("B Jones"))
    s = summaries.parse_summary(F.when(F.col("idx") % 3 == 0, glued).otherwise(classic), names)
    return refs(spark, sf_dir).select("idx", s.alias("s")).select("idx", F.array_join("s.authors", "|").alias("authors"), F.col("s.authors_truncated").alias("cut"), "s.venue", F.col("s.year").cast("long").alias("year"), "s.source")


@query(f"WITH {REFS} SELECT idx, CAST(1 AS BIGINT) AS n, 'x' || idx AS key, 'Title ' || lang || ' ' || idx AS title, 'Müller, de la Fontaine' AS surnames, CAST(year AS BIGINT) AS year, venue FROM refs")
def parse_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = refs(spark, sf_dir).select(
        F.col("idx").alias("doc_id"),
        F.concat(F.lit("@string{s = {Studies}}\n@article{x"), F.col("idx").cast("string"), F.lit(',\n title = {Title {'), "lang", F.lit("} "), F.col("idx").cast("string"), F.lit('},\n author = "M{\\"u}ller, J\\"org and Jean de la Fontaine",\n journal = "Journal of " # {'), "lang", F.lit("} # { } # s,\n year = "), F.col("year").cast("string"), F.lit("\n}\n")).alias("text"),
    )
    rows = files.bibtex_references(made)
    return rows.select(F.col("doc_id").alias("idx"), F.col("idx").cast("long").alias("n"), "key", "fields.title", F.array_join(F.transform("fields.authors", lambda a: a["surname"]), ", ").alias("surnames"), F.col("fields.year").cast("long").alias("year"), "fields.venue").select("idx", "n", "key", "title", "surnames", "year", "venue")


@query("SELECT item_id, CAST(1 AS BIGINT) AS n_references, CAST(NULL AS VARCHAR) AS error FROM benchmark UNION ALL SELECT -1 - item_id, CAST(0 AS BIGINT), 'No references were found.' FROM benchmark")
def document_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    docs = items.union(items.select(-1 - F.col("doc_id")))
    made = items.select("doc_id", F.lit(1).alias("idx"))
    return files.guarded(made, docs).select(F.col("doc_id").alias("item_id"), long("n_references"), "error")


