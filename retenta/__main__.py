"""``python -m retenta month 2026-06 places.json OUT``; also ``counts 2026-06``, ``quarter 2026Q2``, ``year 2025``,
``history 2025-01:2026-06`` (the retention report of each of these months), ``rollup 2025-01:2025-12`` (distinct one-off donors
from what the months' ``counts`` have stored), ``view 2026-06-30`` (the commitment view as of a day) and ``outliers 2025`` (known bad rows out of a stored profile).

``places.json`` maps table names to parquet paths or to mappings with a format, see ``Sources``.
"""

from __future__ import annotations

import argparse
import json
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from . import workflows
from .period import Period
from .rule_tables import SCHEMA, vocabulary_of
from .sources import Sources
from .vocab import Vocabulary


def _period(kind: str, text: str) -> Period:
    if kind in ("month", "counts"):
        year, month = text.split("-")
        return Period.month(int(year), int(month))
    if kind in ("history", "rollup"):
        first, last = (_period("month", month) for month in text.split(":"))
        return Period(first.start, last.end_exclusive, text)
    if kind == "quarter":
        year, quarter = text.upper().split("Q")
        return Period.quarter(int(year), int(quarter))
    return Period.year(int(text))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="retenta", description=__doc__)
    parser.add_argument("cadence", choices=("month", "history", "rollup", "counts", "quarter", "year", "view", "outliers"))
    parser.add_argument("period")
    parser.add_argument("places", type=Path)
    parser.add_argument("out")
    parser.add_argument("--own-name", default=Vocabulary.own_name)
    parser.add_argument("--redraw", action="store_true", help="quarter: draw the new donors afresh")
    parser.add_argument("--through-chains", action="store_true", help="quarter: follow merged numbers over several merges")
    parser.add_argument("--loaded-at", type=datetime.fromisoformat, help="view: the load stamp, else midnight of the day")
    parser.add_argument("--rules", help="a table of rules (``rule_tables``) as Parquet; its ladders replace those of the package")
    parser.add_argument("--gift-months", help="view: read only the gifts of these months (2026-05,2026-06) and stored states, or ``all`` to begin with")
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName(f"retenta {args.cadence} {args.period}")
    running = SparkSession.getActiveSession()
    if running is None:
        for key, value in workflows.CLUSTER_SETTINGS.items():
            builder = builder.config(key, value)
    sources = Sources(running or builder.getOrCreate(), json.loads(args.places.read_text(encoding="utf-8")))
    vocab = Vocabulary(own_name=args.own_name)
    if args.rules:
        vocab = vocabulary_of(sources.spark.read.schema(SCHEMA).parquet(args.rules), vocab)
    if args.cadence == "view":
        day = date.fromisoformat(args.period)
        stamp = args.loaded_at or datetime.combine(day, datetime.min.time())
        if args.gift_months:
            months = None if args.gift_months == "all" else [_period("month", m) for m in args.gift_months.split(",")]
            workflows.refresh_commitment_view_by_months(sources, args.out, day, stamp, months, vocab)
        else:
            workflows.refresh_commitment_view(sources, args.out, day, stamp, vocab)
        return
    period = _period(args.cadence, args.period)
    if args.cadence == "month":
        workflows.run_month(sources, period, args.out, vocab)
    elif args.cadence == "history":
        workflows.run_history(sources, period, args.out, vocab)
    elif args.cadence == "rollup":
        workflows.run_oneoff_rollup(sources, period, args.out)
    elif args.cadence == "quarter":
        workflows.run_quarter(sources, period, args.out, args.redraw, args.through_chains, vocab)
    elif args.cadence == "counts":
        workflows.run_month_counts(sources, period, args.out, vocab)
    elif args.cadence == "outliers":
        workflows.remove_rg_outliers(sources, period, args.out)
    else:
        workflows.run_year(sources, period, args.out, vocab)


if __name__ == "__main__":
    main()
