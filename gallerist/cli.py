"""Commands on a library: scan, calibrate, dedupe, review-tree, export-keepers, stats, info, libraries."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from .engine import Engine, doctor, read_any
from .sources.config import load


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gallerist")
    p.add_argument("--store", default=os.path.expanduser("~/.local/share/gallerist"))
    p.add_argument("--config", default="~/.config/gallerist.toml")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "calibrate", "dedupe", "analyze", "stats", "finish-plan"):
        sub.add_parser(name).add_argument("folder")
    for name in ("review-tree", "export-keepers"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("output")
        c.add_argument("--regenerate", action="store_true")
        if name == "review-tree":
            c.add_argument("--include", action="append", default=[])
    info = sub.add_parser("info")
    info.add_argument("folder")
    info.add_argument("file_id", type=int)
    sub.add_parser("libraries")
    sub.add_parser("doctor")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("gallerist").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "doctor":
        checks = doctor(spark, a.store)
        for what, fine, more in checks:
            print("ok  " if fine else "fail", what, more)
        return int(not all(fine for _, fine, _ in checks))
    if a.command == "libraries":
        read_any(spark, a.store).show(100, False)
        return 0
    engine = Engine(spark, a.folder, a.store, load(a.config))
    if a.command == "stats":
        for name, df in engine.stats().items():
            print(name)
            df.show(100, False)
    elif a.command == "info":
        for r in engine.file(a.file_id).select("dump").collect():
            print(r["dump"])
    elif a.command == "finish-plan":
        engine.finish_plan().show(100, False)
    elif a.command == "review-tree":
        print(engine.review_tree(a.output, tuple(a.include), a.regenerate))
    elif a.command == "export-keepers":
        print(engine.export_keepers(a.output, a.regenerate))
    else:
        print(json.dumps(getattr(engine, a.command)()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
