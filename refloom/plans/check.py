"""The whole check as one plan: references and stored responses in, verdicts and summaries out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.config import MATCH, PARSE, SEARCH, VERDICT, Match, Parse, Search, Verdict
from refloom.operators import control, live, match, references, search
from refloom.sources.shared import stored

KEYS = ["doc_id", "idx"]


def _keyed(refs: DataFrame) -> DataFrame:
    """The references with their originals. They are written first, as what reads them takes their fields apart many times over."""
    refs = stored(refs, "parsed")
    return stored(references.with_original(refs.withColumn("dedupe_key", references.dedupe_key(F.col("fields"), F.col("raw"))), ["doc_id"]), "references")


def check_references(refs: DataFrame, responses: DataFrame, mode: str = "offline", parse: Parse = PARSE, searching: Search = SEARCH, matching: Match = MATCH, verdicts: Verdict = VERDICT, refused: DataFrame | None = None) -> DataFrame:
    """refs: rows of `refloom.schema.REFERENCE`; responses: rows of the response store. A row for each reference with verdict, confidence, reason,
    mismatched, best, queries, searches_used and duplicate_of.

    Equal citations are checked once. All planned queries are looked up by one join; those after a sure match are dropped by their ordinal, which is what
    asking one after the other would have left out.

    refused (doc_id, idx, refused_at): references whose query of that ordinal the budget refused; it and later ones were not asked.

    References and compared candidates are written to the shared folder: both are read several times, and the string kernels run once.
    """
    keyed = _keyed(refs)
    firsts = references.originals(keyed).drop("dedupe_key", "original")
    plan = search.planned(firsts.withColumn("title", F.col("fields.title")).withColumn("entry_type", F.col("fields.entry_type")).withColumn("surname", F.get("fields.authors", F.lit(0))["surname"]), searching)
    if refused is not None:
        plan = plan.join(refused, KEYS, "left").where(F.col("refused_at").isNull() | (F.col("ordinal") < F.col("refused_at"))).drop("refused_at")
    asked = control.looked_up(plan.select(*KEYS, "fields", "ordinal", "engine", "query", "cache_key"), control.latest(responses))
    # String kernels are slow and their rows small: a count given by hand keeps adaptive execution from putting them all into a few tasks.
    tasks = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = search.candidates(asked.select(*KEYS, "fields", "ordinal", "engine", "body").repartition(tasks, *KEYS), parse.as_of_year)
    found = match.compared(met, matching)
    found = stored(found.drop("fields"), "compared")
    stop = match.confident_ordinal(found, KEYS)
    kept = found.join(stop, KEYS, "left").where(F.col("stop").isNull() | (F.col("ordinal") <= F.col("stop"))).drop("stop")
    best = match.best_of(kept, KEYS)
    queries = asked.select(*KEYS, "ordinal", "query", "source").join(stop, KEYS, "left").where(F.col("stop").isNull() | (F.col("ordinal") <= F.col("stop")))
    queries = queries.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "query"))), lambda q: q["query"]).alias("queries"),
        (F.max("stop").isNotNull() | (F.count_if(F.col("source") == "miss") == 0)).alias("complete"),
    )
    rows = firsts.join(queries, KEYS, "left").join(best, KEYS, "left")
    rows = rows.withColumn("complete", F.coalesce("complete", F.lit(True))).withColumn("incomplete_reason", F.lit(match.MISSES[mode]))
    if refused is not None:
        rows = rows.join(refused.withColumn("is_refused", F.lit(True)).drop("refused_at"), KEYS, "left")
        stopped = F.coalesce("is_refused", F.lit(False))
        rows = rows.withColumn("complete", F.col("complete") & ~stopped).withColumn("incomplete_reason", F.when(stopped, match.OUT_OF_BUDGET).otherwise(F.col("incomplete_reason"))).drop("is_refused")
    out = match.decided(rows, matching, verdicts).drop("complete", "incomplete_reason", "n_candidates")
    shown = F.col("verdict").isin("VERIFIED", "METADATA_MISMATCH", "NOT_FOUND")
    out = out.withColumn("best", F.when(shown, F.col("best"))).withColumn("queries", F.coalesce("queries", F.array().cast("array<string>"))).withColumn("searches_used", F.lit(0))
    results = references.fanned_out(keyed.drop("dedupe_key"), out.drop("fields", "raw", "source_format", "key", "line"), ["doc_id"])
    return results.drop("original")


def check_live(refs: DataFrame, responses: DataFrame, transport: live.Transport, max_searches: int | None = None, parse: Parse = PARSE, searching: Search = SEARCH, matching: Match = MATCH, **doubles) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, the store with the new answers, the answers fetched). Queries of one ordinal are asked together, and only for references without a sure match so far.

    The budget goes to queries in the order of (doc_id, idx): at most `max_searches` are taken, which is the most rows that the one sorted limit gathers.
    """
    left = searching.max_searches if max_searches is None else max_searches
    keyed = _keyed(refs)
    firsts = references.originals(keyed).drop("dedupe_key", "original")
    plan = search.planned(firsts.withColumn("title", F.col("fields.title")).withColumn("entry_type", F.col("fields.entry_type")).withColumn("surname", F.get("fields.authors", F.lit(0))["surname"]), searching)
    plan = stored(plan.select(*KEYS, "fields", "ordinal", "engine", "query", "params", "cache_key"), "plan")
    store, todo, asked, refused = control.latest(responses), plan.select(*KEYS).distinct(), None, None
    for ordinal in range(1, len(search.STRATEGIES) + 1):
        now = plan.where(F.col("ordinal") == ordinal).join(todo, KEYS, "left_semi")
        lacking = control.uncached(now, store).groupBy(F.col("cache_key").alias("key")).agg(F.min(F.struct(*KEYS)).alias("at"), F.min_by(F.struct("engine", "query", "params"), F.struct(*KEYS)).alias("q"))
        granted = stored(lacking.orderBy("at").limit(left).select("key", "q.*"), "granted")
        new = stored(live.fetched(granted.repartition(max(1, min(left, 64)), "key"), transport, searching, **doubles), "answers")
        left -= new.agg(F.coalesce(F.sum("credits"), F.lit(0))).first()[0]
        left = max(0, left)
        turned = stored(now.join(lacking.select(F.col("key").alias("cache_key")), "cache_key", "left_semi").join(granted.select(F.col("key").alias("cache_key")), "cache_key", "left_anti").select(*KEYS, "ordinal"), "refused")
        turned = turned.withColumnRenamed("ordinal", "refused_at")
        store = stored(store.unionByName(new.where("body IS NOT NULL").select("key", "engine", "query", "created", "body")), "store")
        found = stored(match.compared(search.candidates(control.looked_up(plan.where(F.col("ordinal") <= ordinal).join(todo, KEYS, "left_semi"), store).select(*KEYS, "fields", "ordinal", "engine", "body"), parse.as_of_year), matching).drop("fields"), "compared")
        sure = match.confident_ordinal(found, KEYS).select(*KEYS)
        todo = stored(todo.join(turned, KEYS, "left_anti").join(sure, KEYS, "left_anti"), "unresolved")
        asked, refused = (new, turned) if asked is None else (asked.unionByName(new), refused.unionByName(turned))
    return check_references(refs, store, "live", parse, searching, matching, refused=refused), store, asked


def summary(results: DataFrame) -> DataFrame:
    return match.summarised(results, ["doc_id"])
