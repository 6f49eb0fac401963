"""Command line: sources and a configuration in, a JSON array out.

Exit codes: 0 done (also with nothing to show), 1 failed, 2 used wrongly. Standard output carries JSON alone.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from confluo.plans.merge import merge
from confluo.plans.projection import ProjectionConfig, ProjectionError, json_lines, load_config, project_rows
from confluo.plans.validation import validate_projected
from confluo.sources.combine import combine
from confluo.sources.recruiter_csv import read_csv
from confluo.sources.resume import read_resumes
from confluo.storage import materialize

OK, FAILED, USAGE = 0, 1, 2
DEFAULTS = [Path(__file__).resolve().parent.parent / "data" / n for n in ("default.json", "default_config.json")]
log = logging.getLogger("confluo.cli")


class CliError(Exception):
    def __init__(self, message: str, code: int = FAILED):
        super().__init__(message)
        self.code = code


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="confluo", description="Consolidate people records from a recruiter CSV and a resume into JSON of a configured shape.")
    p.add_argument("--csv", metavar="PATH", help="recruiter CSV")
    p.add_argument("--resume", metavar="PATH", help="plain-text resume")
    p.add_argument("--config", metavar="PATH", help="projection configuration (default: the bundled one)")
    p.add_argument("--out", metavar="PATH", help="write to a file instead of standard output")
    p.add_argument("--lines", metavar="FOLDER", help="write a folder of JSON lines from the tasks instead: for results too large for one array")
    p.add_argument("--no-validate", dest="validate", action="store_false", help="skip the check of the output against the configuration")
    return p


def _config(path: str | None) -> ProjectionConfig:
    chosen = Path(path) if path else next((p for p in DEFAULTS if p.is_file()), None)
    if chosen is None:
        raise CliError("no configuration given and no bundled one found")
    if not chosen.is_file():
        raise CliError(f"Config file not found or not readable: {chosen}")
    try:
        return load_config(chosen)
    except json.JSONDecodeError as e:
        raise CliError(f"Config file is not valid JSON ({chosen}): {e}") from None
    except (ValueError, TypeError, OSError) as e:
        raise CliError(f"Config file is structurally invalid ({chosen}): {e}") from None


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> int:
    if args.csv is None and args.resume is None:
        raise CliError("at least one of --csv or --resume must be provided", USAGE)
    config = _config(args.config)
    given = [(p, read) for p, read in ((args.csv, read_csv), (args.resume, read_resumes)) if p is not None]
    for p, _ in given:
        if not Path(p).is_file():
            log.warning("source not found, skipped: %s", p)
    usable = [(p, read) for p, read in given if Path(p).is_file()]
    if not usable:
        raise CliError("None of the provided input sources could be read; nothing to do.")
    spark = spark or SparkSession.builder.appName("confluo").getOrCreate()
    partials = combine(spark, [read(spark, p) for p, read in usable])
    canonical = materialize(merge(materialize(partials)))
    if args.lines is not None:
        check = (lambda record: validate_projected(record, config)) if args.validate else None
        json_lines(canonical, config, check).write.text(args.lines)
        return OK
    results = []
    try:
        for cid, record in project_rows(canonical, config):
            if args.validate and (errors := validate_projected(record, config)):
                raise CliError(f"output failed schema validation for candidate {cid!r}: " + "; ".join(errors))
            results.append(record)
    except ProjectionError as e:
        raise CliError(str(e)) from None
    text = json.dumps(results, ensure_ascii=False, indent=2) + "\n"
    if args.out is None:
        sys.stdout.write(text)
    else:
        try:
            Path(args.out).write_text(text, encoding="utf-8")
        except OSError as e:
            raise CliError(f"Could not write output file {args.out}: {e}") from None
    log.info("%d object(s)", len(results))
    return OK


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    for h in list(log.handlers):
        log.removeHandler(h)
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(logging.Formatter("%(levelname)s %(name)s: %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    log.propagate = False
    args = build_parser().parse_args(argv)
    try:
        return run(args, spark)
    except CliError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code
    except KeyboardInterrupt:
        print("error: interrupted", file=sys.stderr)
        return FAILED
    except Exception as e:
        print(f"error: unexpected failure: {e}", file=sys.stderr)
        return FAILED
