"""Command line: notes in, annotations out.

Exit codes: 0, all went well; 1, the notes or the dictionary could not be used; 2, the call makes no sense or a path isn't there.
"""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import asdict

from .operators import assertion

DICTIONARY = "WARDLENS_DICTIONARY"


def find_dictionary(given: str | None = None) -> str:
    """The folder with rare_term and concept: the one given, then $WARDLENS_DICTIONARY, then ~/.wardlens, then ./dictionary."""
    for path in (given, os.environ.get(DICTIONARY)):
        if path:
            return path
    for path in (os.path.expanduser("~/.wardlens/dictionary"), "dictionary"):
        if os.path.isdir(path):
            return path
    raise FileNotFoundError(f"no dictionary: name one with --dictionary or ${DICTIONARY}")


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser("wardlens", description=__doc__.split("\n")[0])
    ap.add_argument("inputs", nargs="+", help="files, folders, or - for standard input")
    ap.add_argument("--dictionary")
    where = ap.add_mutually_exclusive_group()
    where.add_argument("--out", help="one merged file instead of standard output; no run is kept")
    where.add_argument("--run-root", help="keep the run below this folder and print nothing")
    where.add_argument("--dry", action="store_true", help="print only, keep nothing")
    ap.add_argument("--json", action="store_true", help="one JSON object a note")
    ap.add_argument("--groups", help="semantic groups to keep, comma-separated")
    polarity = ap.add_mutually_exclusive_group()
    polarity.add_argument("--negated", action="store_true", help="negated mentions only")
    polarity.add_argument("--affirmed", action="store_true", help="others only")
    ap.add_argument("--longest", action="store_true", help="of overlapping matches keep the longest")
    ap.add_argument("--profile", default="default", choices=sorted(assertion.PROFILES))
    for name in ("subject", "history", "uncertain"):
        ap.add_argument(f"--no-{name}", action="store_true", help="leave this attribute unassessed")
    ap.add_argument("--conditional", action="store_true", help="assess this attribute too")
    history = ap.add_mutually_exclusive_group()
    history.add_argument("--history-sections", action="store_true", help="all below a history heading is history")
    history.add_argument("--no-history-sections", action="store_true")
    heads = ap.add_mutually_exclusive_group()
    heads.add_argument("--drop-headers", action="store_true", help="leave out mentions inside a heading")
    heads.add_argument("--keep-headers", action="store_true")
    reach = ap.add_mutually_exclusive_group()
    reach.add_argument("--max-scope", type=int, help="tokens that a negation cue reaches")
    reach.add_argument("--no-max-scope", action="store_true")
    for name in ("coordination", "clauses", "sections"):
        ap.add_argument(f"--no-{name}", action="store_true")
    return ap


def configured(args: argparse.Namespace) -> assertion.Config:
    """The configuration in force: the profile, then what the call changes."""
    change: dict = {}
    if args.groups:
        change["groups"] = tuple(g.strip().upper() for g in args.groups.split(",") if g.strip())
    for flag, field, value in (
        ("longest", "resolve_overlaps", True), ("no_subject", "subject", False), ("no_history", "history", False), ("no_uncertain", "uncertain", False), ("conditional", "conditional", True),
        ("history_sections", "history_sections", assertion.CANDIDATE_HISTORY_SECTIONS), ("no_history_sections", "history_sections", ()), ("drop_headers", "drop_header_mentions", True), ("keep_headers", "drop_header_mentions", False),
        ("no_max_scope", "max_scope", None), ("no_coordination", "coordination", False), ("no_clauses", "clause_bounding", False), ("no_sections", "sections", False),
    ):
        if getattr(args, flag):
            change[field] = value
    if args.max_scope is not None:
        change["max_scope"] = args.max_scope
    if args.no_history and args.history_sections:
        raise ValueError("--history-sections needs history to be assessed")
    return assertion.profile(args.profile, **change)


def by_polarity(annotations, negated: bool = False, affirmed: bool = False):
    """Negated mentions only, or others only; both at once is refused."""
    if negated and affirmed:
        raise ValueError("negated and affirmed exclude each other")
    return annotations.where("negated") if negated else annotations.where("NOT negated") if affirmed else annotations


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    out = out or sys.stdout
    try:
        args = parser().parse_args(argv)
        config = configured(args)
    except SystemExit as e:
        return int(e.code or 0)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import functions as F

    from .session import local_session
    from .sources import readers, writers
    from .streaming.notes import analyze

    spark = spark or local_session(app="wardlens")
    try:
        docs = readers.gather(spark, args.inputs, sys.stdin.read() if "-" in args.inputs else None)
    except FileNotFoundError as e:
        print(f"no such path: {e}", file=sys.stderr)
        return 2
    try:
        folder = find_dictionary(args.dictionary)
        tables = {t: spark.read.parquet(f"{folder}/{t}") for t in ("rare_term", "concept")}
        found = by_polarity(analyze(docs, tables["rare_term"], tables["concept"], config), args.negated, args.affirmed)
        docs = docs.withColumn("source", F.col("doc_id"))
        if args.run_root:
            print(writers.write_run(found, docs, args.run_root, asdict(config) | {"dictionary": folder, "profile": args.profile}), file=sys.stderr)
            return 0
        if args.json:
            lines = writers.json_lines(found, docs).select("source", F.to_json(F.struct("source", "annotations")).alias("line")).orderBy("source")
        else:
            lines = writers.listing(found, docs).orderBy("doc_id", "start")
        sink = open(args.out, "w", encoding="utf-8") if args.out else out
        for row in lines.toLocalIterator():
            print(row.line, file=sink)
        if args.out:
            sink.close()
    except Exception as e:  # one line, not a Java trace
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 1
    return 0
