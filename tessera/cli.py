"""python -m tessera.cli compare A.docx B.docx --out REPORT [--config FILE] [--hardware FILE] | index FOLDER OUT"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import config
from .plans import compare as comparing
from .plans import index as indexing


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    c = sub.add_parser("compare")
    c.add_argument("a")
    c.add_argument("b")
    c.add_argument("--out")
    c.add_argument("--config")
    c.add_argument("--hardware")
    i = sub.add_parser("index")
    i.add_argument("folder")
    i.add_argument("out")
    i.add_argument("--config")
    args = p.parse_args(argv)
    cfg = config.load(args.config) if args.config else config.Config()
    hw = config.hardware(args.hardware) if getattr(args, "hardware", None) else {}
    spark = SparkSession.builder.appName("tessera").config(map=config.thread_settings(hw) if hw else {}).getOrCreate()
    if args.what == "compare":
        print(json.dumps(comparing.compare(spark, args.a, args.b, args.out, cfg, hw), ensure_ascii=False, indent=2))
    else:
        print(json.dumps(indexing.build(spark, args.folder, args.out, cfg)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
