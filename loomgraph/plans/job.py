"""The whole job from work files to figures: python -m loomgraph.plans.job --works .. --out .. (thresholds from LOOMGRAPH_* variables).

Takes new parts of works (and, if given, the parts of earlier works that a manifest names), checks the tables, runs the stages that
aren't done, and prints the reports. Started again, it goes on from where it was.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators import validation
from ..sources import writers
from ..sources.tables import Tables
from ..streaming import parts
from .config import Config
from .stages import Stages


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__.splitlines()[0])
    p.add_argument("--works", required=True, help="folder of works as JSON lines")
    p.add_argument("--suffix", default="*.gz", help="their names")
    p.add_argument("--earlier-manifest", help="manifest of Parquet files with earlier works")
    p.add_argument("--out", required=True, help="folder of every table")
    p.add_argument("--per-batch", type=int, default=25, help="files of a batch")
    p.add_argument("--stages", nargs="*", help="stages to run; all, unless named")
    p.add_argument("--again", action="store_true", help="run them even if they are done")
    p.add_argument("--bucketed", metavar="PREFIX", help="keep the tables with a key as bucketed catalog tables of this prefix")
    return p.parse_args(given)


def run(spark: SparkSession, args: argparse.Namespace, config: Config | None = None) -> dict[str, str]:
    """Name to CSV text of each report."""
    c, out = config or Config.read(), args.out.rstrip("/")
    works = parts.works_parts(spark, f"{out}/ingest", c.first_year, c.last_year, args.per_batch)
    files = parts.listed(spark, args.works, args.suffix)
    new = works.run(files)
    earlier = None
    if args.earlier_manifest:
        taken = parts.earlier_parts(spark, f"{out}/earlier", c.before_year, args.per_batch)
        new += taken.run(parts.manifest_parts(spark, args.earlier_manifest))
        earlier = taken.table("earlier")
    attributes, edges = works.table("attributes"), works.table("edges")
    ledger = validation.validate(attributes, edges, c.first_year, c.last_year)
    left = works.completeness(files).count()
    ledger.record("PASS" if not left else "WARN", "completeness", f"{left} parts are missing or stale")
    stages = Stages(spark, f"{out}/stages", attributes, edges, earlier, c, Tables(spark, args.bucketed) if args.bucketed else None)
    # new parts make every table stale
    ran = stages.run(args.stages, args.again or new > 0)
    reports = {"ledger": ledger.summary(spark), "stages": stages.summary()}
    if all(map(stages.done, Stages.NAMES)):
        reports |= stages.reports()
    return {"ran": " ".join(ran) + "\n"} | {name: writers.small_csv(df, {}) for name, df in reports.items()}


def main(given: list[str] | None = None) -> None:
    args = arguments(given)
    for name, text in run(SparkSession.builder.appName("loomgraph").getOrCreate(), args).items():
        print(f"# {name}\n{text}")


if __name__ == "__main__":
    main()
