"""Commands over catalog files: ``python -m loomglot.cli stats app/**/strings.xml``."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.texts import truncated, value_text
from .operators import checks, diff, edit, merge, normalize, plan, select, sync
from .schema import CatalogError
from .sources.files import convert, expand, read_catalog, write_catalog


def _show(df: DataFrame, *order: str) -> None:
    """Rows as JSON lines, fetched one part at a time."""
    for row in df.orderBy(*order).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False))


def _backend(name: str):
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def with_new_languages(resources: DataFrame, entries: DataFrame) -> DataFrame:
    """``resources`` and one for each language that only entries have, with the metadata of the first."""
    fresh = entries.groupBy("language").agg(F.min("resource_ord").alias("resource_ord")).join(resources.select("language").distinct(), "language", "left_anti")
    head = resources.agg(F.min_by("domain", "resource_ord").alias("domain"), F.min_by("custom", "resource_ord").alias("custom"))
    added = fresh.crossJoin(F.broadcast(head)).select("resource_ord", "language", "domain", "custom", F.lit(None).cast("string").alias("source_path"))  # one row
    return resources.unionByName(added)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loomglot")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *several: str, out: bool = False, **inputs):
        p = commands.add_parser(name)
        for x in inputs.get("files", ("inputs",)):
            p.add_argument(x, nargs="+" if x == "inputs" else None)
        p.add_argument("--language")
        p.add_argument("--input-format")
        for x in several:
            p.add_argument(x)
        if out:
            p.add_argument("--output", required=True, help="folder")
            p.add_argument("--format", required=True)
            p.add_argument("--name")
        return p

    command("convert", "--include", "--exclude", out=True)
    view = command("view", "--status")
    view.add_argument("--keys-only", action="store_true")
    view.add_argument("--summary", action="store_true", help="counts of what is shown, first")
    command("stats")
    command("validate")
    command("debug")
    command("diff", files=("source", "target"))
    command("sync", "--match-language", out=True, files=("source", "target")).add_argument("--strict", action="store_true")
    command("merge", out=True).add_argument("--strategy", default="last")
    command("normalize", out=True).add_argument("--key-style", default="none")
    translate = command("translate", "--source", "--targets", "--statuses", out=True)
    annotate = command("annotate", "--source", out=True)
    for p in (translate, annotate):
        p.add_argument("--backend", required=True, help="module:function from a text and a language to a text")
        p.add_argument("--workers", type=int, default=4)
    translate.add_argument("--dry-run", action="store_true")
    command("edit", "--key", "--text", "--status", out=True)
    return parser


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Run one command; the result is the exit code."""
    read = lambda paths: read_catalog(spark, expand(paths), args.input_format, args.language if args.command in ("convert", "merge", "normalize") else None)
    if args.command in ("diff", "sync"):
        (source_resources, source), (target_resources, target) = read([args.source]), read([args.target])
        if args.command == "diff":
            found = diff.diff(source, target, args.language)
            _show(found.filter("change <> 'unchanged'"), "language", "id")
            _show(diff.summary(found), "language")
            return 0
        language = sync.match_language(source_resources, args.match_language)
        out = sync.sync(source, target, language=language, source_resources=source_resources, target_resources=target_resources, only=args.language)
        _show(sync.report(out), "processed")
        if args.strict:
            sync.fail_on(out)
        write_catalog(target_resources, out.drop("how", "source_id", "outcome"), args.output, args.format, args.name)
        return 0
    resources, entries = read(args.inputs)
    if args.command == "convert":
        if not (args.include or args.exclude):
            convert(spark, expand(args.inputs), args.output, args.format, args.input_format, args.language, args.name)
            return 0
        resources, entries = (select.include_exclude(x, args.include, args.exclude) for x in (resources, entries))
    elif args.command == "view":
        rows = entries if not args.status else select.by_status(entries, args.status)
        rows = rows if not args.language else select.by_language(rows, args.language)
        shown = truncated(value_text(F.col("kind"), F.col("text"), F.col("forms")), 90).alias("value")
        if args.summary:
            _show(select.view_summary(rows), "total_matches")
        _show(rows.select("language", "id", *([] if args.keys_only else ["status", "comment", shown])), "language", "id")
        return 0
    elif args.command == "stats":
        _show(checks.stats(entries if not args.language else select.by_language(entries, args.language)), "resource_ord")
        _show(checks.stats_summary(entries, args.language), "resources")
        return 0
    elif args.command == "validate":
        faults = [checks.structure_issues(resources, entries), checks.placeholder_issues(entries), checks.plural_issues(entries)]
        for df in faults:
            _show(df, *df.columns[:1])
        return int(any(not df.isEmpty() for df in faults))
    elif args.command == "debug":
        _show(entries.withColumn("text", F.replace("text", F.lit("\\n"), F.lit("\n"))), "resource_ord", "entry_ord")
        return 0
    elif args.command == "merge":
        entries = merge.merge(entries, args.strategy)
        resources = select.non_empty_resources(resources, entries)
    elif args.command == "normalize":
        entries = normalize.normalize_strict(entries, args.key_style).drop("changed")
    elif args.command == "translate":
        source = args.source or select.single_language(resources, args.language)
        jobs = plan.translation_plan(select.by_language(entries, source), entries, args.targets.split(","), tuple(args.statuses.split(",")) if args.statuses else ("new", "stale"))
        _show(jobs.groupBy(F.coalesce("reason", F.lit("job")).alias("reason")).agg(F.count("*").alias("n")), "reason")
        if args.dry_run:
            return 0
        results = plan.run_jobs(jobs, _backend(args.backend), args.workers).persist()  # a backend is called once a job
        entries = plan.apply_results(entries, results, jobs)
        resources = with_new_languages(resources, entries)
    elif args.command == "annotate":
        targets = plan.annotation_targets(entries, args.source or "en")
        asked = targets.select("id", F.lit(args.source or "en").alias("language"), "text", F.lit(None).cast("string").alias("reason"))
        notes = plan.run_jobs(asked, _backend(args.backend), args.workers).persist()
        if failed := notes.filter("error is not null").count():
            raise CatalogError("annotation_failed", f"{failed} jobs failed", count=failed)
        entries = plan.apply_annotations(entries, notes.select("id", F.col("text").alias("comment")))
    elif args.command == "edit":
        entries = edit.set_value(entries, args.language or select.single_language(resources), args.key, args.text, args.status)
    write_catalog(resources, entries, args.output, args.format, args.name)
    return 0


def main(arguments: list[str] | None = None) -> int:
    args = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName("loomglot").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return run(spark, args)
    except CatalogError as e:
        print(json.dumps({"error": e.code, "message": str(e), "context": e.context}), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
