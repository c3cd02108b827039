"""python -m refloom check FILE... ; cache stats|clear|export STORE.

Exit codes: 0 fine, 1 problems found with --fail-on, 2 wrong use or input, 3 the check failed.
"""

from __future__ import annotations

import argparse
import importlib
import logging
import os
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom import errors, samples
from refloom.config import SEARCH
from refloom.operators import control, reports
from refloom.plans import check
from refloom.schema import RESPONSES
from refloom.settings import load_settings
from refloom.sources import files
from refloom.sources.shared import remove, written

SUFFIXES = {".json": "json", ".md": "markdown", ".markdown": "markdown", ".sarif": "sarif", ".html": "html"}
COLUMNS = {"json": "report", "markdown": "markdown", "sarif": "sarif", "html": "html"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="refloom")
    commands = out.add_subparsers(dest="command", required=True)
    c = commands.add_parser("check", help="check the references of a file, or of all files of a folder")
    c.add_argument("path", nargs="?", help="a file or folder, - for text from standard input; not needed with --demo")
    c.add_argument("--responses", help="Parquet table of stored search responses")
    c.add_argument("--bundle", help="file of recorded responses")
    c.add_argument("--demo", action="store_true", help="answer from the sample recordings only")
    c.add_argument("--offline", action="store_true", help="answer from stored responses only, even with a transport")
    c.add_argument("--transport", help="package.module:function that sends a search, for answers that are not stored")
    c.add_argument("--max-searches", type=int, default=SEARCH.max_searches, help="at most so many searches are sent")
    c.add_argument("--fragments", help="Parquet table of PDF page fragments")
    c.add_argument("-f", "--format", choices=["table", *COLUMNS], help="default: by the output's suffix, or a table")
    c.add_argument("-o", "--output", help="folder for the reports, in any store that Spark writes")
    c.add_argument("--sarif-uri", help="the file that SARIF results point to")
    c.add_argument("--fail-on", type=int, help="exit with 1 from this many problems on")
    c.add_argument("-q", "--quiet", action="store_true", help="print errors and asked-for reports only")
    s = commands.add_parser("cache", help="what a table of stored responses holds")
    s.add_argument("action", choices=["stats", "clear", "export"])
    s.add_argument("store")
    s.add_argument("--keys", help="text file of keys to export, one on a line")
    s.add_argument("-o", "--output", help="folder to export to")
    return out


def _imported(name: str) -> Callable[[dict], dict]:
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError) as error:
        raise errors.InputError(f"no transport {name!r}: {error}") from error


def _said(rows: DataFrame) -> None:
    """All rows, one at a time."""
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def _cache(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.action == "clear":
        spark.createDataFrame([], RESPONSES).write.mode("overwrite").parquet(args.store)
        return errors.FINE
    store = files.read_responses(spark, args.store)
    if args.action == "stats":
        _said(control.cache_stats(store, F.current_timestamp()))
        return errors.FINE
    if not args.keys or not args.output:
        raise errors.InputError("export needs --keys and --output")
    keys = spark.read.text(args.keys).select(F.trim("value").alias("key")).where("key <> ''")
    control.exported(store, keys).write.mode("overwrite").parquet(args.output)
    return errors.FINE


def _check(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.max_searches < 0:
        raise errors.InputError("--max-searches may not be negative")
    path = args.path or (samples.sample_path("list.txt") if args.demo else None)
    if path is None:
        raise errors.InputError("a file to check is needed")
    kind = args.format or next((f for s, f in SUFFIXES.items() if (args.output or "").endswith(s)), "table")
    bundle = args.bundle or (samples.sample_path("answers.json") if args.demo else None)
    try:
        docs = (files.pasted(spark, sys.stdin.read()) if path == "-" else files.read_files(spark, path)).cache()
        docs.count()
        fragments = files.page_fragments(spark, args.fragments) if args.fragments else None
        store = files.read_bundle(spark, bundle) if bundle else files.read_responses(spark, args.responses) if args.responses else spark.createDataFrame([], RESPONSES)
    except AnalysisException as error:
        raise errors.InputError(str(error).partition("\n")[0]) from error
    refs = files.references(docs.where("error IS NULL"), fragments=fragments).cache()
    unread = files.unreadable(docs, fragments).cache()
    readable = docs.join(unread, "doc_id", "left_anti")
    refused = files.guarded(refs, readable).where("error IS NOT NULL").join(docs.select("doc_id", "name"), "doc_id").select("doc_id", "name", "error")
    wrong = 0
    for e in unread.unionByName(refused).toLocalIterator():
        wrong += 1
        print(f"{e.name}: {e.error}", file=sys.stderr)
    refs = refs.join(refused, "doc_id", "left_anti")
    if args.transport and not args.offline and not bundle:
        results, _, asked = check.check_live(refs, store, _imported(args.transport), args.max_searches)
        if args.responses:
            new = asked.where("body IS NOT NULL").select("key", "engine", "query", "created", "body")
            new.write.mode("append").parquet(args.responses)
    else:
        results = check.check_references(refs, store, "demo" if bundle else "offline")
    results = results.cache()
    summary = check.summary(results).cache()
    if kind == "table":
        if not args.quiet:
            _said(results.select("doc_id", "idx", "verdict", "confidence", reports.cited_title(F.col("fields.title"), F.col("raw")).alias("title"), "reason").orderBy("doc_id", "idx"))
            _said(summary.orderBy("doc_id"))
    else:
        uri = F.lit(args.sarif_uri) if args.sarif_uri else None
        made = {"json": reports.json_report, "markdown": reports.markdown, "html": reports.html, "sarif": lambda r, s: reports.sarif(r, s, uri=uri)}[kind](results, summary)
        if args.output:
            made.write.mode("overwrite").json(args.output)
        else:
            for row in made.toLocalIterator():
                print(row[COLUMNS[kind]])
    if wrong:
        return errors.WRONG_INPUT
    if args.fail_on is not None:
        problems = summary.agg(F.sum(F.col("not_found") + F.col("metadata_mismatch"))).first()[0] or 0
        return errors.PROBLEMS_FOUND if problems >= args.fail_on else errors.FINE
    return errors.FINE


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    settings = load_settings(os.environ, ".env")
    secrets = [settings.api_key] if settings.api_key else []
    log = errors.log_to_stderr(secrets, logging.WARNING)
    spark = spark or SparkSession.builder.appName("refloom").getOrCreate()
    before = written(spark)
    try:
        return _cache(args, spark) if args.command == "cache" else _check(args, spark)
    except errors.RefloomError as error:
        print(errors.redact(str(error), secrets), file=sys.stderr)
        return error.exit_code
    except Exception:
        log.exception("the check failed")
        return errors.CHECK_FAILED
    finally:
        spark.catalog.clearCache()
        remove(spark, [path for path in written(spark) if path not in before])


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
