"""python -m vettle --input FOLDER --output FOLDER [--config FILE] [--no-github] [--llm PROVIDER] [--top N] [-v]"""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from vettle.plans.screen import screen
from vettle.settings import load
from vettle.sources import files, sinks


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vettle", description="Screen and rank a folder of documents.")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--config")
    p.add_argument("--no-github", action="store_true")
    p.add_argument("--llm", choices=("none", "anthropic", "openai"))
    p.add_argument("--lookups", help="parquet table of handle lookups")
    p.add_argument("--repos", help="parquet table of repositories")
    p.add_argument("--judgements", help="parquet table of model answers")
    p.add_argument("--top", type=int, default=10)
    p.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(args)
    s = load(a.config)
    if a.llm:
        s = dataclasses.replace(s, judge=dataclasses.replace(s.judge, provider=a.llm))
    if a.no_github:
        s = dataclasses.replace(s, repositories=dataclasses.replace(s.repositories, enabled=False))
    spark = SparkSession.builder.appName("vettle").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR")
    table = lambda path: spark.read.parquet(path) if path else None
    report = screen(files.load(spark, a.input, s.min_chars), s, table(a.lookups), table(a.repos), table(a.judgements))
    sinks.write_json(report.sections(), f"{a.output}/results.json")
    sinks.write_csv(report.ranked.unionByName(report.rejected, allowMissingColumns=True), f"{a.output}/results.csv")
    print(sinks.terminal(report.summary, report.ranked, report.failed, a.top))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
