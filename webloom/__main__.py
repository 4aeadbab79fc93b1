"""python -m webloom: crawl stored responses, list crawls, ask, compare, export."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import fingerprint
from webloom.functions.scope import ScopeRules
from webloom.operators import diff
from webloom.plans.crawl import CrawlOptions, crawl_corpus
from webloom.plans.questions import QUESTIONS, crawl_report
from webloom.runtime import local_session
from webloom.sources import export
from webloom.sources.store import Store, default_dir, seed_lines

VERSION = "0.1"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("webloom")
    parser.add_argument("--store", default=default_dir())
    commands = parser.add_subparsers(dest="command", required=True)
    crawl = commands.add_parser("crawl", help="walk a Parquet table of responses from seeds")
    crawl.add_argument("responses")
    crawl.add_argument("--seed", action="append", default=[])
    crawl.add_argument("--seeds-file")
    crawl.add_argument("--label", default="")
    crawl.add_argument("--depth", type=int, default=3)
    crawl.add_argument("--max-pages", type=int, default=2000)
    crawl.add_argument("--subdomains", action="store_true")
    crawl.add_argument("--include", action="append", default=[])
    crawl.add_argument("--exclude", action="append", default=[])
    crawl.add_argument("--path-prefix", default="")
    crawl.add_argument("--ignore-robots", action="store_true")
    commands.add_parser("list", help="crawls, newest first").add_argument("target", nargs="?", default="")
    ask = commands.add_parser("query", help="ask a stored crawl")
    ask.add_argument("ref")
    ask.add_argument("question", choices=list(QUESTIONS), nargs="?", default="summary")
    ask.add_argument("value", nargs="?", default="")
    compare = commands.add_parser("diff", help="compare two crawls; exit 2 if a rule is tripped")
    compare.add_argument("old")
    compare.add_argument("new")
    compare.add_argument("--fail-on", default="")
    compare.add_argument("--ignore-content", action="store_true")
    compare.add_argument("--ignore-findings", action="store_true")
    out = commands.add_parser("export", help="write a crawl in a format")
    out.add_argument("ref")
    out.add_argument("format", choices=export.FORMATS)
    out.add_argument("path")
    commands.add_parser("fingerprints", help="signatures by category")
    commands.add_parser("version")
    return parser


def _show(found: DataFrame | list[str]) -> None:
    if isinstance(found, list):
        print("\n".join(found) or "no way")
    else:
        found.show(1000, truncate=False)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    spark = local_session()
    store = Store(spark, args.store)
    if args.command == "crawl":
        seeds = args.seed or ([r["seed"] for r in seed_lines(spark, args.seeds_file).collect()] if args.seeds_file else [])
        rules = ScopeRules(allow_subdomains=args.subdomains, max_depth=args.depth, include=tuple(args.include), exclude=tuple(args.exclude), path_prefix=args.path_prefix)
        result = crawl_corpus(spark.read.parquet(args.responses), seeds, CrawlOptions(rules, args.max_pages, respect_robots=not args.ignore_robots))
        if not result.graph.nodes.filter("fetched").limit(1).count():
            print("nothing was fetched; not saved", file=sys.stderr)
            return 1
        crawl_id = store.save(result.graph.nodes, result.graph.edges, result.graph.findings, seeds[0], args.label, result.status, seeds)
        _show(crawl_report(*store.load(crawl_id), store.seeds(crawl_id), {"page limit": result.budget_dropped, "queue limit": result.queue_dropped}).unionByName(store.stats(crawl_id).filter(F.col("what").isin("errors", "blocked"))))
        print(crawl_id)
    elif args.command == "list":
        found = store.list(args.target)
        _show(found.select("crawl_id", "target", "label", "status", "nodes", "edges", "findings"))
        print(f"{found.count()} crawls")
    elif args.command == "query":
        crawl_id = store.resolve(args.ref)
        _show(QUESTIONS[args.question](*store.load(crawl_id), args.value, store.seeds(crawl_id)))
    elif args.command == "diff":
        rules = diff.parse_rules(args.fail_on)
        old, new = store.resolve(args.old), store.resolve(args.new)
        if old == new:
            print("both references are the same crawl", file=sys.stderr)
            return 1
        changes = diff.diff(diff.Crawl(*store.load(old)), diff.Crawl(*store.load(new)), diff.DiffOptions(args.ignore_content, args.ignore_findings))
        for name, df in changes.items():
            if n := df.count():
                print(f"{name} ({n})")
                df.select(*[c for c in df.columns if c in ("url", "kind", "host", "value", "changes", "src_url", "dst_url", "rel", "added_out", "removed_out")]).show(50, truncate=False)
        if hit := diff.tripped(changes, ",".join(rules)):
            print(f"tripped: {', '.join(hit)}", file=sys.stderr)
            return 2
    elif args.command == "export":
        crawl_id = store.resolve(args.ref)
        head = store.head(crawl_id)
        export.export(*store.load(crawl_id), args.format, args.path, head["target"], {**head, "seeds": store.seeds(crawl_id)} if args.format == "html" else head)
    else:
        _show(fingerprint.signatures_by_category(spark).orderBy(F.col("category")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
