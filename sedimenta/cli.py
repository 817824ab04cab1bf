"""Command line: extract-full and extract-incremental, setup, raw-to-bronze, bronze-to-silver, silver-to-gold or all of these, and maintain."""

from __future__ import annotations

import argparse
import datetime as dt
import json

from sedimenta.plans.settings import TRACKED
from sedimenta.runs import MODES, Lakehouse
from sedimenta.session import build_session
from sedimenta.sources import extract


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sedimenta")
    p.add_argument("command", choices=["extract-full", "extract-incremental", "setup", "maintain", "raw-to-bronze", "bronze-to-silver", "silver-to-gold", "all"])
    p.add_argument("--root", default="", help="folder of the tables")
    p.add_argument("--landing", required=True, help="folder of the landed batches")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--mode", choices=MODES, default="incremental")
    p.add_argument("--batch-ids", type=lambda x: x.split(","))
    p.add_argument("--start", type=dt.date.fromisoformat)
    p.add_argument("--end", type=dt.date.fromisoformat)
    p.add_argument("--optimize", action="store_true")
    p.add_argument("--base-url", help="of the web API to extract from")
    p.add_argument("--tags", type=lambda x: x.split(","), default=list(TRACKED))
    p.add_argument("--since", type=int, help="epoch seconds; by default the stored watermark")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = build_session(a.master)
    if a.command == "extract-full":
        print(json.dumps(extract.full_load(spark, a.base_url, a.landing, a.tags, a.start.isoformat(), a.end.isoformat())))
        return 0
    house = Lakehouse(spark, a.root, a.landing)
    if a.command == "extract-incremental":
        known = house.bronze("questions").read().select("question_id").distinct() if a.root else None
        print(json.dumps(extract.incremental_load(spark, a.base_url, a.landing, a.tags, since=a.since, known=known)))
        return 0
    scope = {"batch_ids": a.batch_ids, "start": a.start, "end": a.end}
    if a.command in ("setup", "all"):
        print(json.dumps(house.setup()))
    if a.command == "maintain":
        print(json.dumps(house.maintain()))
    if a.command in ("raw-to-bronze", "all"):
        print(json.dumps(house.raw_to_bronze(a.mode, **scope)))
    if a.command in ("bronze-to-silver", "all"):
        print(json.dumps(house.bronze_to_silver(a.mode, **scope)))
    if a.command in ("silver-to-gold", "all"):
        print(json.dumps(house.silver_to_gold(optimize=a.optimize)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
