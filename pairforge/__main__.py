"""Runs queries and writes their results: python -m pairforge --list | --run NAME... | --from NAME --to NAME | --verify MANIFEST."""

from __future__ import annotations

import argparse
import sys

from pairforge.plans import catalog, reports  # noqa: F401  (reports adds its queries to the catalog)
from pairforge.sources import tables


def chosen(names: list[str], run: list[str], first: str | None, last: str | None) -> list[str]:
    """The queries asked for, in the order of the catalog; unknown names are an error."""
    if unknown := [n for n in [*run, *filter(None, (first, last))] if n not in names]:
        raise SystemExit(f"unknown: {', '.join(unknown)}")
    if run:
        return [n for n in names if n in run]
    a, b = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    return names[a : b + 1]


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="pairforge")
    p.add_argument("--list", action="store_true")
    p.add_argument("--run", nargs="*", default=[])
    p.add_argument("--from", dest="first")
    p.add_argument("--to", dest="last")
    p.add_argument("--verify", metavar="MANIFEST")
    p.add_argument("--data", default=".")
    p.add_argument("--out", default="results")
    p.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    a = p.parse_args(argv)
    names = list(catalog.QUERIES)
    if a.list:
        print("\n".join(names))
        return 0
    if a.verify:
        found = tables.verify(a.verify)
        print(found)
        return int(bool(found["changed"] or found["missing"]))
    if not (a.run or a.first or a.last):
        p.print_usage()
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("pairforge").getOrCreate()
    for name in chosen(names, a.run, a.first, a.last):
        tables.write_table(catalog.QUERIES[name](spark, a.data), f"{a.out}/{name}", a.format)
        print(name, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
