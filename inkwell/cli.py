"""Command line: index, search, status, rebuild."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Sequence

from inkwell.constants import DEFAULT_LIMIT, DEFAULT_THREADS, MAX_LIMIT, MAX_THREADS
from inkwell.functions.text import format_bytes
from inkwell.operators.index import Index
from inkwell.session import session, ship


def checked_threads(n: int) -> int:
    """Within 1 and the most; anything below is the default."""
    if n <= 0:
        print(f"threads={n} is not valid, taking {DEFAULT_THREADS}", file=sys.stderr)
        return DEFAULT_THREADS
    if n > MAX_THREADS:
        print(f"threads={n} is over the most, taking {MAX_THREADS}", file=sys.stderr)
    return min(n, MAX_THREADS)


def checked_limit(n: int) -> int:
    if not 0 <= n <= MAX_LIMIT:
        print(f"limit={n} is outside 0..{MAX_LIMIT}", file=sys.stderr)
    return min(max(n, 0), MAX_LIMIT)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkwell", description="full-text search over files")
    p.add_argument("--index-dir", default="inkwell-index")
    p.add_argument("--note-dir", action="append", default=[], help="a folder (or file) of notes; may be repeated")
    p.add_argument("--threads", type=int, default=DEFAULT_THREADS, help="local threads, where no cluster is set")
    p.add_argument("--strict", action="store_true", help="the reference's literal behaviour in place of its documented intent")
    sub = p.add_subparsers(dest="command")
    index = sub.add_parser("index", help="build the index, or bring it up to date")
    index.add_argument("paths", nargs="+")
    search = sub.add_parser("search", help="ranked search")
    search.add_argument("query")
    search.add_argument("-l", "--limit", type=int, default=DEFAULT_LIMIT)
    search.add_argument("-f", "--format", choices=("text", "json"), default="text")
    sub.add_parser("status", help="sizes of the index")
    rebuild = sub.add_parser("rebuild", help="index the files anew")
    rebuild.add_argument("paths", nargs="+")
    rebuild.add_argument("--yes", action="store_true", help="confirm")
    return p


def _show_status(index: Index, size: bool = True) -> None:
    s = index.status().first()
    print(f"documents: {s['doc_count']}\nterms: {s['term_count']}")
    if size:
        print(f"segments: {s['segment_count']}\nsize: {format_bytes(s['index_size_bytes'])}")


def main(argv: Sequence[str] | None = None) -> int:
    """0 if all went well, else 1."""
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 0
    if args.command == "rebuild" and not args.yes:
        print("rebuild replaces the index; confirm with --yes", file=sys.stderr)
        return 1
    try:
        spark = session(**{"spark.master": f"local[{checked_threads(args.threads)}]"} if not _on_cluster() else {})
        ship(spark)
        index = Index.open(spark, args.index_dir, note_paths=args.note_dir, strict=args.strict)
        start = time.monotonic()
        match args.command:
            case "index" | "rebuild":
                index.build(args.paths) if args.command == "index" else index.rebuild(args.paths)
                _show_status(index, size=False)
                print(f"time: {round((time.monotonic() - start) * 1000)} ms")
            case "search":
                found = index.search(args.query, checked_limit(args.limit))
                if args.format == "json":
                    print(found.to_json())
                else:
                    print(f'query: "{found.query}"\n\n{found.to_text()}')
                    print(f"{found.total} matches, {round((time.monotonic() - start) * 1000)} ms")
            case "status":
                _show_status(index)
    except Exception as e:  # a command line reports any failure as one line and a code
        print(f"{args.command} failed: {e}", file=sys.stderr)
        return 1
    return 0


def _on_cluster() -> bool:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() is not None or "SPARK_MASTER" in os.environ


if __name__ == "__main__":
    sys.exit(main())
