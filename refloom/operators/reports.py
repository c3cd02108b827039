"""Results as JSON, Markdown, SARIF and HTML rows. Each line is an expression over its row; only one document's lines are ever gathered together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.config import VERDICTS
from refloom.operators.search import safe_url

LABELS = {"VERIFIED": "Verified", "METADATA_MISMATCH": "Metadata mismatch", "NOT_FOUND": "Not found", "UNPARSEABLE": "Unparseable", "SKIPPED_BUDGET": "Skipped"}
SEVERITY = ("NOT_FOUND", "METADATA_MISMATCH", "UNPARSEABLE", "SKIPPED_BUDGET", "VERIFIED")
SCORE_FORMULA = "The score is the share of looked-up references that hold, in percent; one with wrong details counts half."
#: verdict: rule, name, level, what it says
RULES = {
    "NOT_FOUND": ("RL001", "UnknownWork", "error", "No record of this work turned up"),
    "METADATA_MISMATCH": ("RL002", "WrongDetails", "warning", "The work is on record with other details"),
    "UNPARSEABLE": ("RL003", "UnreadableReference", "warning", "No title could be read from this reference"),
    "SKIPPED_BUDGET": ("RL004", "UncheckedReference", "note", "Nothing was looked up for this reference"),
}
TOOL, VERSION = "refloom", "0.1.0"


def chosen(column: Column, values: dict) -> Column:
    out = F.lit(None)
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def cited_title(title: Column, raw: Column) -> Column:
    cut = F.when(F.length(raw) <= 80, raw).otherwise(F.concat(F.substring(raw, 1, 77), F.lit("...")))
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(cut)


def score_text(score: Column) -> Column:
    """ "86.5 / 100", "70 / 100" or "n/a" """
    return F.coalesce(F.concat(F.regexp_replace(score.cast("decimal(6,1)").cast("string"), r"\.0$", ""), F.lit(" / 100")), F.lit("n/a"))


def severity(verdict: Column) -> Column:
    return chosen(verdict, {v: i for i, v in enumerate(SEVERITY)})


def cell(text: Column) -> Column:
    """Text that is safe in a cell of a Markdown table."""
    escaped = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"\|", r"\\|")
    return F.trim(F.regexp_replace(escaped, "\n", " "))


def markdown_row(idx: Column, verdict: Column, confidence: Column, cited: Column, reason: Column, found: Column, link: Column) -> Column:
    evidence = F.when(found.isNull(), "").when(F.coalesce(link, F.lit("")) != "", F.concat(F.lit("["), cell(found), F.lit("]("), link, F.lit(")"))).otherwise(cell(found))
    return F.concat(F.lit("| "), F.concat_ws(" | ", idx.cast("string"), chosen(verdict, LABELS), F.format_number(confidence, 2), cell(cited), cell(reason), evidence), F.lit(" |"))


def markdown(results: DataFrame, summary: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, markdown: one report for each document."""
    lines = results.withColumn("line", markdown_row(F.col("idx"), F.col("verdict"), F.col("confidence"), cited_title(F.col("fields.title"), F.col("raw")), F.col("reason"), F.col("best.candidate.title"), F.col("best.candidate.link")))
    body = lines.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("body"))
    counts = F.concat_ws("\n", *(F.concat(F.lit(f"| {LABELS[v]} | "), F.col(v.lower()).cast("string"), F.lit(" |")) for v in VERDICTS))
    head = F.concat(
        F.lit("# Citation report: "), cell(F.col(by).cast("string")), F.lit("\n\n**Integrity score: "), score_text(F.col("integrity_score")), F.lit("**. "), F.col("checked").cast("string"), F.lit(" of "),
        F.col("total").cast("string"), F.lit(f" references checked.\n\n_{SCORE_FORMULA}_\n\n| Verdict | References |\n| --- | ---: |\n"), counts,
        F.lit("\n\n## References\n\n| # | Verdict | Confidence | Cited title | Reason | Best match |\n| ---: | --- | ---: | --- | --- | --- |\n"),
    )
    return summary.join(body, by).select(by, F.concat(head, "body", F.lit("\n")).alias("markdown"))


def fingerprint(key: Column, title: Column, raw: Column) -> Column:
    """Stays the same while other lines move."""
    named = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(raw)
    return F.substring(F.sha2(F.concat(F.coalesce(key, F.lit("")), F.lit("|"), named).cast("binary"), 256), 1, 32)


def sarif_results(results: DataFrame, uri: Column | None = None) -> DataFrame:
    """A row for each reference with a problem: doc_id, idx, rule, rule_index, level, message, line, fingerprint and the SARIF result as JSON."""
    uri = F.lit("references") if uri is None else uri
    title, key, v = F.col("fields.title"), F.col("key"), F.col("verdict")
    label = F.when(F.coalesce(key, F.lit("")) != "", F.concat(F.lit("["), key, F.lit("] "))).otherwise(F.concat(F.lit("Reference "), F.col("idx").cast("string"), F.lit(": ")))
    quoted = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("“"), title, F.lit("”: "))).otherwise("")
    rows = results.where(v != "VERIFIED").select(
        "doc_id", "idx", "line", "verdict", "confidence", chosen(v, {k: r[0] for k, r in RULES.items()}).alias("rule"), chosen(v, {k: i for i, k in enumerate(RULES)}).alias("rule_index"),
        chosen(v, {k: r[2] for k, r in RULES.items()}).alias("level"), F.concat(label, quoted, F.col("reason")).alias("message"), fingerprint(key, title, F.col("raw")).alias("fingerprint"), F.regexp_replace(uri, r"\\", "/").alias("uri"),
    )
    region = F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"))).alias("region"))
    made = F.struct(
        F.col("rule").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(region.alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("fingerprint").alias("citation/v1")).alias("partialFingerprints"), F.struct("verdict", "confidence").alias("properties"),
    )
    return rows.withColumn("sarif", F.to_json(made))


def sarif(results: DataFrame, summary: DataFrame, by: str = "doc_id", uri: Column | None = None) -> DataFrame:
    """by, sarif: a SARIF 2.1.0 log for each document."""
    found = sarif_results(results, uri).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sarif"))), lambda x: x["sarif"]), ",").alias("found"))
    rules = F.to_json(F.array(*(F.struct(F.lit(r[0]).alias("id"), F.lit(r[1]).alias("name"), F.struct(F.lit(r[3]).alias("text")).alias("shortDescription"), F.struct(F.lit(r[2]).alias("level")).alias("defaultConfiguration")) for r in RULES.values())))
    head = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL}","version":"{VERSION}","rules":'
    log = F.concat(F.lit(head), rules, F.lit('}},"results":['), F.coalesce("found", F.lit("")), F.lit('],"properties":{"integrityScore":'), F.coalesce(F.col("integrity_score").cast("string"), F.lit("null")), F.lit("}}]}"))
    return summary.join(found, by, "left").select(by, log.alias("sarif"))


def json_report(results: DataFrame, summary: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, report: all of a document's results and its summary as JSON, which reads back to the same rows."""
    rows = results.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("idx", *(c for c in results.columns if c not in (by, "idx"))))).alias("results"))
    whole = F.struct(F.struct(*(c for c in summary.columns if c != by)).alias("summary"), "results")
    return summary.join(rows, by, "left").select(by, F.to_json(whole).alias("report"))


def html(results: DataFrame, summary: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, html: for each document its score, its counts and a table, the worst first; only http and https addresses become links."""
    text = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")
    link, title = safe_url(F.col("best.candidate.link")), text(F.col("best.candidate.title"))
    found = F.when(link.isNotNull(), F.concat(F.lit('<a href="'), text(link), F.lit('">'), title, F.lit("</a>"))).otherwise(title)
    cells = [F.col("idx").cast("string"), chosen(F.col("verdict"), LABELS), text(cited_title(F.col("fields.title"), F.col("raw"))), text(F.col("reason")), found]
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))
    rows = results.withColumn("severity", severity(F.col("verdict"))).withColumn("row", row)
    body = rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("severity", "idx", "row"))), lambda x: x["row"]), "\n").alias("body"))
    counts = F.concat(*(F.concat(F.lit(f'<li class="{v.lower()}">{LABELS[v]}: '), F.col(v.lower()).cast("string"), F.lit("</li>")) for v in VERDICTS))
    name = text(F.col(by).cast("string"))
    head = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Citation report: '), name, F.lit("</title><style>body{font-family:sans-serif}td,th{padding:.2em .6em;text-align:left}</style></head><body>\n<h1>"), name,
        F.lit("</h1>\n<p><strong>Integrity score: "), score_text(F.col("integrity_score")), F.lit("</strong>. "), F.col("checked").cast("string"), F.lit(" of "), F.col("total").cast("string"),
        F.lit(f" references checked. {SCORE_FORMULA}</p>\n<ul>"), counts, F.lit("</ul>\n<table>\n<tr><th>#</th><th>Verdict</th><th>Cited title</th><th>Reason</th><th>Best match</th></tr>\n"),
    )
    return summary.join(body, by, "left").select(by, F.concat(head, F.coalesce("body", F.lit("")), F.lit("\n</table></body></html>\n")).alias("html"))


def evaluation_markdown(outcomes: DataFrame, title: str = "Evaluation") -> str:
    """Headline, types, classes and the confusion matrix as Markdown. Only aggregates reach the driver; `evaluate.failures` lists the rows. All intervals come from one frame."""
    from refloom.operators import evaluate

    heads = {r.subset: r for r in evaluate.headline_sets(outcomes).collect()}
    types = {r.perturbation: r for r in evaluate.per_perturbation(outcomes).collect()}
    scores = {r["class"]: r for r in evaluate.class_scores(outcomes, []).collect()}
    table = {r.expected: r for r in evaluate.confusion(outcomes).collect()}
    shares = [(h.false_alarms, h.n_real) for h in heads.values()] + [(h.detected, h.n_fabricated) for h in heads.values()] + [(t.detected, t.n_rows) for t in types.values()]
    shares += [(s.tp, s.tp + s.fp) for s in scores.values()] + [(s.tp, s.tp + s.fn) for s in scores.values()]
    frame = outcomes.sparkSession.createDataFrame(sorted(set(shares)), "k long, n long")
    bounds = {(r.k, r.n): r for r in evaluate.wilson(frame, "k", "n").collect()}

    def share(k: int, n: int, least: int = 0) -> str:
        return "n/a" if not n else f"{k}/{n}" if n < least else f"{k}/{n} = {100 * k / n:.1f}% [{100 * bounds[k, n].low:.1f}, {100 * bounds[k, n].high:.1f}]"

    lines = [f"### {title}", "", "| Subset | False alarms | Detection | Unchecked |", "| --- | --- | --- | ---: |"]
    lines += [f"| {n} | {share(h.false_alarms, h.n_real)} | {share(h.detected, h.n_fabricated)} | {h.unchecked_real + h.unchecked_fabricated} |" for n in ("all", "indian") if (h := heads.get(n))]
    lines += ["", "| Perturbation | Detected |", "| --- | --- |"]
    lines += [f"| {p.replace('_', ' ')} | {share(types[p].detected, types[p].n_rows, 5)} |" for p in evaluate.PERTURBATIONS]
    lines += ["", "| Class | Precision | Recall | F1 |", "| --- | --- | --- | ---: |"]
    lines += [f"| {c} | {share(s.tp, s.tp + s.fp)} | {share(s.tp, s.tp + s.fn)} | {'n/a' if s.f1 is None else f'{100 * s.f1:.1f}%'} |" for c in evaluate.FLAGGED if (s := scores.get(c))]
    lines += ["", "| Expected | " + " | ".join(VERDICTS) + " |", "| --- |" + " ---: |" * len(VERDICTS)]
    lines += [f"| {e} | " + " | ".join(str(table[e][v.lower()]) for v in VERDICTS) + " |" for e in evaluate.EXPECTED]
    return "\n".join(lines) + "\n"
