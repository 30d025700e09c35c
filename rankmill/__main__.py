"""``python -m rankmill NAME FOLDER [--write PATH] [--rows N]`` runs a query; without arguments, lists them."""

from __future__ import annotations

import argparse
import importlib


def main() -> None:
    from rankmill.plans import catalog, catalog_more, core_problems

    found = catalog.QUERIES | catalog_more.QUERIES | core_problems.QUERIES
    ap = argparse.ArgumentParser(prog="rankmill")
    ap.add_argument("name", nargs="?")
    ap.add_argument("folder", nargs="?")
    ap.add_argument("--write", help="folder for the result as Parquet")
    ap.add_argument("--rows", type=int, default=20, help="rows to show")
    ap.add_argument("--module", action="append", default=[], help="a module with more QUERIES")
    a = ap.parse_args()
    for m in a.module:
        found |= importlib.import_module(m).QUERIES
    if not a.name:
        print("\n".join(sorted(found)))
        return
    if a.name not in found:
        ap.error(f"no query {a.name!r}")
    from pyspark.sql import SparkSession

    from rankmill.ship import ship

    spark = SparkSession.builder.appName(a.name).getOrCreate()
    ship(spark)
    df = found[a.name](spark, a.folder)
    df.write.mode("overwrite").parquet(a.write) if a.write else df.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
