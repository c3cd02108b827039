"""Evaluation: labelled rows, their validation and split, and metrics over outcomes (expected, verdict, kind, perturbation, indian)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.config import VERDICTS
from refloom.functions import compare, udfs
from refloom.operators.numbering import numbered

FLAGGED, UNCHECKED = ("NOT_FOUND", "METADATA_MISMATCH"), ("UNPARSEABLE", "SKIPPED_BUDGET")
EXPECTED = ("VERIFIED", "METADATA_MISMATCH", "NOT_FOUND")
PERTURBATIONS = ("reworded_title", "swapped_authors", "wrong_year", "fake_venue", "invented")
Z95 = 1.959964
YEAR_TOLERANCE, INVENTED_MAX_SIMILARITY = 1, 0.8


def rate(n: Column, of: Column) -> Column:
    return F.round(F.try_divide(n.cast("double"), of.cast("double")), 4)


def prf(counts: DataFrame) -> DataFrame:
    """tp, fp, fn with precision, recall and F1; F1 is of the rounded two, and null where they are."""
    rows = counts.withColumn("prec", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("rec", rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return rows.withColumn("f1", F.round(F.try_divide(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")), 4))


def class_scores(outcomes: DataFrame, by: list[str], classes=FLAGGED) -> DataFrame:
    """by, class, tp, fp, fn, prec, rec, f1: one pass over the outcomes for all classes."""
    e, v = F.col("expected"), F.col("verdict")
    counts = [F.struct(F.lit(c).alias("class"), F.count_if((e == c) & (v == c)).alias("tp"), F.count_if((e != c) & (v == c)).alias("fp"), F.count_if((e == c) & (v != c)).alias("fn")) for c in classes]
    return prf(outcomes.groupBy(*by).agg(F.array(*counts).alias("each")).select(*by, F.inline("each")))


def headline(outcomes: DataFrame, by: list[str]) -> DataFrame:
    real, fake = F.col("kind") == "real", F.col("kind") == "fabricated"
    flagged, unchecked = F.col("verdict").isin(*FLAGGED), F.col("verdict").isin(*UNCHECKED)
    out = outcomes.groupBy(*by).agg(
        F.count_if(real).alias("n_real"), F.count_if(fake).alias("n_fabricated"), F.count_if(real & flagged).alias("false_alarms"), F.count_if(real & (F.col("verdict") == "VERIFIED")).alias("verified_real"),
        F.count_if(real & unchecked).alias("unchecked_real"), F.count_if(fake & flagged).alias("detected"), F.count_if(fake & unchecked).alias("unchecked_fabricated"),
    )
    return out.withColumn("false_alarm_rate", rate(F.col("false_alarms"), F.col("n_real"))).withColumn("detection_rate", rate(F.col("detected"), F.col("n_fabricated")))


def headline_sets(outcomes: DataFrame) -> DataFrame:
    """The headline over all rows and over the indian subset, in one pass."""
    both = outcomes.withColumn("subset", F.explode(F.when(F.col("indian"), F.array(F.lit("all"), F.lit("indian"))).otherwise(F.array(F.lit("all")))))
    return headline(both, ["subset"])


def confusion(outcomes: DataFrame) -> DataFrame:
    """expected, then a count for each verdict; every expected class has a row."""
    spark = outcomes.sparkSession
    base = spark.createDataFrame([(e,) for e in EXPECTED], "expected string")
    counts = outcomes.groupBy("expected").agg(*(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS))
    return base.join(counts, "expected", "left").na.fill(0)


def per_perturbation(outcomes: DataFrame) -> DataFrame:
    """perturbation, n_rows, detected, detection_rate; those without rows too."""
    base = outcomes.sparkSession.createDataFrame([(p,) for p in PERTURBATIONS], "perturbation string")
    counts = outcomes.groupBy("perturbation").agg(F.count("*").alias("n_rows"), F.count_if(F.col("verdict").isin(*FLAGGED)).alias("detected"))
    return base.join(counts, "perturbation", "left").na.fill(0).withColumn("detection_rate", rate(F.col("detected"), F.col("n_rows")))


def wilson(rows: DataFrame, k: str, n: str) -> DataFrame:
    """Adds low and high, the 95 % Wilson interval; null without rows."""
    N, p, z2 = F.col(n).cast("double"), F.try_divide(F.col(k).cast("double"), F.col(n).cast("double")), Z95 * Z95
    centre = F.try_divide(p + F.try_divide(F.lit(z2), 2 * N), 1 + F.try_divide(F.lit(z2), N))
    half = F.try_divide(Z95 * F.sqrt(F.try_divide(p * (1 - p), N) + F.try_divide(F.lit(z2), 4 * N * N)), 1 + F.try_divide(F.lit(z2), N))
    return rows.withColumn("low", F.greatest(F.lit(0.0), centre - half)).withColumn("high", F.least(F.lit(1.0), centre + half))


def failure_type() -> Column:
    real, flagged = F.col("kind") == "real", F.col("verdict").isin(*FLAGGED)
    return F.when(real & flagged, "false alarm").when(real & (F.col("verdict") != "VERIFIED"), "real reference not checked").when(~real & ~flagged, "missed fabrication")


def failures(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("type", failure_type()).where(F.col("type").isNotNull())


def class_differences(outcomes: DataFrame) -> DataFrame:
    return outcomes.where((F.col("kind") == "fabricated") & F.col("verdict").isin(*FLAGGED) & (F.col("verdict") != F.col("expected")))


def row_problems(rows: DataFrame) -> DataFrame:
    """id, problems: what is wrong with labelled rows, by themselves and together."""
    real, fake, invented = F.col("kind") == "real", F.col("kind") == "fabricated", F.coalesce(F.col("perturbation") == "invented", F.lit(False))
    wanted = F.when(real, "VERIFIED").when(invented, "NOT_FOUND").otherwise("METADATA_MISMATCH")
    rules = {
        "real without an identifier": real & F.col("doi").isNull() & F.col("arxiv_id").isNull(), "real with a perturbation": real & F.col("perturbation").isNotNull(),
        "fabricated without a perturbation": fake & F.col("perturbation").isNull(), "source not as the kind asks": (fake & ~invented) != F.col("source").isNotNull(), "expected verdict": F.col("expected") != wanted,
        "id": ~F.col("id").rlike("^[a-z0-9-]+$"), "repeated id": F.col("n_id") > 1, "unknown source": F.col("source").isNotNull() & F.col("s_id").isNull(),
    }
    ids = rows.groupBy(F.col("id").alias("c_id")).agg(F.count("*").alias("n_id"))
    sources = rows.where(real).select(F.col("id").alias("s_id")).distinct()
    joined = rows.join(ids, F.col("id") == F.col("c_id")).join(sources, F.col("source") == F.col("s_id"), "left")
    said = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return joined.select("id", said.alias("problems")).where(F.size("problems") > 0)


def validated(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """id, ok, problems. Real rows are held against the registry (id, title, first_author, year); a perturbed row is as good as its source.

    An invented row is good if no registry title given for it (id, title) is close to its own.
    """
    found = registry.select(F.col("id").alias("r_id"), F.col("title").alias("r_title"), F.col("first_author").alias("r_author"), F.col("year").alias("r_year"))
    real = rows.where("kind = 'real'").join(found, F.col("id") == F.col("r_id"), "left")
    near = (compare.title_status(F.col("title"), F.col("r_title")) == "match") | (compare.title_similarity(F.col("title"), F.col("r_title")) >= 0.9)
    names = udfs.exact_surname_keys(F.array(F.coalesce(F.get(F.get("authors", F.lit(0)), F.lit(0)), F.lit("")), F.coalesce("r_author", F.lit(""))))
    author = F.get(names, F.lit(0)) == F.get(names, F.lit(1))
    year = F.abs(F.col("r_year") - F.col("year")) <= YEAR_TOLERANCE
    bad = F.array_compact(F.array(F.when(F.col("r_id").isNull(), "lookup failed"), F.when(F.col("r_id").isNotNull() & ~F.coalesce(near, F.lit(False)), "title differs"), F.when(F.col("r_id").isNotNull() & ~F.coalesce(author, F.lit(False)), "first author differs"), F.when(F.col("r_id").isNotNull() & ~F.coalesce(year, F.lit(False)), "year differs")))
    checked = real.select("id", bad.alias("problems"))
    close = rows.where("perturbation = 'invented'").join(found, F.col("id") == F.col("r_id"), "left").select("id", compare.title_similarity(F.col("title"), F.col("r_title")).alias("s")).groupBy("id").agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("s"))
    invented = close.select("id", F.when(F.col("s") >= INVENTED_MAX_SIMILARITY, F.array(F.lit("a similar title exists"))).otherwise(F.array().cast("array<string>")).alias("problems"))
    parents = checked.select(F.col("id").alias("p_id"), (F.size("problems") == 0).alias("p_ok"))
    derived = rows.where("source IS NOT NULL").join(parents, F.col("source") == F.col("p_id"), "left")
    derived = derived.select("id", F.when(F.coalesce("p_ok", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("the source row did not validate"))).alias("problems"))
    return checked.unionByName(invented).unionByName(derived).withColumn("ok", F.size("problems") == 0)


def kept_rows(rows: DataFrame, validation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows that validated, the others with their problems); a row that was not validated is one of the others."""
    said = validation.select(F.col("id").alias("v_id"), "ok", "problems")
    joined = rows.join(said, F.col("id") == F.col("v_id"), "left").drop("v_id")
    ok = F.coalesce("ok", F.lit(False))
    problems = F.coalesce("problems", F.array(F.lit("not validated")))
    return joined.where(ok).drop("ok", "problems"), joined.where(~ok).withColumn("problems", problems).drop("ok")


def outcomes(results: DataFrame, labelled: DataFrame, by_key: bool = True) -> DataFrame:
    """Results of a check with the labelled row that each is of: id, kind, indian, perturbation, source, expected, verdict. A BibTeX entry has its row's id as its key; a list in plain text
    has its rows in the order of `place`, from 1."""
    label = labelled.select("id", "kind", "indian", "perturbation", "source", "expected", *([] if by_key else [F.col("place").alias("l_place")]))
    same = F.col("key") == F.col("id") if by_key else F.col("idx") == F.col("l_place")
    return results.select("key", "idx", "verdict").join(label, same).select("id", "kind", "indian", "perturbation", "source", "expected", "verdict")


def systematic_split(families: DataFrame, strata: list[str], order: list[str], share: float = 0.4, offset: float = 0.0) -> DataFrame:
    """Adds `part`: strata laid end to end, and every family where the running count of slots steps up is for tuning.

    Places are counted within a stratum and strata are offset by the sizes before them, so no task orders all rows.
    """
    sizes = families.groupBy(*strata).agg(F.count("*").alias("n"))
    before = sizes.select(*strata, (F.sum("n").over(Window.orderBy(*strata)) - F.col("n")).alias("before"))  # a row for each stratum
    at = F.row_number().over(Window.partitionBy(*strata).orderBy(*order)) - 1 + F.col("before")
    rows = families.join(before, strata).withColumn("place", at)
    step = F.floor((F.col("place") + 1) * share + offset) - F.floor(F.col("place") * share + offset)
    return rows.withColumn("part", F.when(step > 0, "tuning").otherwise("test")).drop("before")


def initials(given: Column, dots: bool = True, spaced: bool = True) -> Column:
    parts = F.filter(F.split(F.translate(given, ".-", "  "), " "), lambda p: p != "")
    letters = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("." if dots else "")))
    return F.array_join(letters, " " if dots and spaced else "")


def styled(style: str) -> Column:
    """A labelled row (authors: [family, given] pairs) as a citation in apa, ieee, vancouver or indian style."""
    book = F.col("entry_type").isin("book", "phdthesis", "techreport")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    given = lambda a: F.coalesce(F.get(a, F.lit(1)), F.lit(""))
    family = lambda a: F.get(a, F.lit(0))
    people = lambda f: F.transform("authors", f)
    year, title, venue = F.col("year").cast("string"), F.col("title"), F.col("venue")
    add = lambda c, before, after="": F.when(has(c), F.concat(F.lit(before), F.col(c), F.lit(after))).otherwise("")

    def listed(names: Column, last: str, two: str | None = None) -> Column:
        n = F.size(names)
        many = F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(last), F.element_at(names, -1))
        return F.when(n <= 1, F.array_join(names, "")).when((n == 2) & F.lit(two is not None), F.array_join(names, two or "")).otherwise(many)

    if style == "apa":
        who = listed(people(lambda a: F.concat(family(a), F.lit(", "), initials(given(a)))), ", & ")
        details = F.concat(add("volume", ", "), F.when(has("volume"), add("issue", "(", ")")).otherwise(""), add("pages", ", "))
        return F.when(book, F.concat(who, F.lit(" ("), year, F.lit("). "), title, F.lit(". "), venue, F.lit("."))).otherwise(
            F.concat(who, F.lit(" ("), year, F.lit("). "), title, F.lit(". "), venue, details, F.lit("."), add("doi", " https://doi.org/"))
        )
    if style == "ieee":
        who = listed(people(lambda a: F.concat(initials(given(a)), F.lit(" "), family(a))), ", and ", " and ")
        parts = F.concat(who, F.lit(", “"), title, F.lit(",” "), venue, add("volume", ", vol. "), add("issue", ", no. "), add("pages", ", pp. "), F.lit(", "), year, F.lit("."))
        return F.when(book, F.concat(who, F.lit(", "), title, F.lit(". "), venue, F.lit(", "), year, F.lit("."))).otherwise(parts)
    if style == "vancouver":
        who = F.array_join(people(lambda a: F.concat(family(a), F.lit(" "), initials(given(a), dots=False))), ", ")
        tail = F.concat(add("volume", ";"), F.when(has("volume"), add("issue", "(", ")")).otherwise(""), add("pages", ":"), F.lit("."))
        return F.when(book, F.concat(who, F.lit(". "), title, F.lit(". "), venue, F.lit("; "), year, F.lit("."))).otherwise(F.concat(who, F.lit(". "), title, F.lit(". "), venue, F.lit(". "), year, tail))
    if style == "indian":
        who = listed(people(lambda a: F.concat(family(a), F.lit(", "), initials(given(a), spaced=False))), " and ")
        details = F.concat(add("volume", ", Vol. "), add("issue", " No. "), add("pages", ", pp. "), F.lit("."))
        return F.when(book, F.concat(who, F.lit(" ("), year, F.lit("), "), title, F.lit(", "), venue, F.lit("."))).otherwise(F.concat(who, F.lit(" ("), year, F.lit('), "'), title, F.lit('", '), venue, details))
    raise ValueError(f"unknown style {style!r}")


STYLES = ("apa", "ieee", "vancouver", "indian")


def bibtex_entry() -> Column:
    """A labelled row as a BibTeX entry."""
    braced = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit("  "), name, F.lit(" = {"), F.translate(value, "{}", ""), F.lit("}")))
    kind = F.col("entry_type")
    venue = F.when(kind == "article", "journal").when(kind == "inproceedings", "booktitle").when(kind == "book", "publisher").otherwise("howpublished")
    who = F.array_join(F.transform("authors", lambda a: F.array_join(a, ", ")), " and ")
    fields = [("title", F.col("title")), ("author", who), ("year", F.col("year").cast("string")), (None, F.col("venue")), ("volume", F.col("volume")), ("number", F.col("issue")), ("pages", F.col("pages")), ("doi", F.col("doi"))]
    body = F.array_join(F.array_compact(F.array(*(braced(F.lit(n) if n else venue, v) for n, v in fields))), ",\n")
    return F.concat(F.lit("@"), kind, F.lit("{"), F.col("id"), F.lit(",\n"), body, F.lit("\n}"))


def with_style(rows: DataFrame, order: str, styles=STYLES) -> DataFrame:
    """Adds `style` and `citation`, styles dealt in turn by the whole-number column `order`."""
    turn = F.pmod(F.col("style_turn") - 1, F.lit(len(styles))).cast("int")
    named = numbered(rows, order, "style_turn").withColumn("style", F.element_at(F.array(*map(F.lit, styles)), turn + 1)).drop("style_turn")
    return named.withColumn("citation", reduce(lambda acc, s: acc.when(F.col("style") == s, styled(s)), styles[1:], F.when(F.col("style") == styles[0], styled(styles[0]))))
