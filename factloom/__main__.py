"""Command line: list queries, run one, or run the quality gates over a folder of tables."""

from __future__ import annotations

import argparse
import sys

from factloom.session import session


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m factloom", description=__doc__)
    sub = ap.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="run a query; print some rows, or write all as Parquet")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out")
    gate = sub.add_parser("gates", help="run all quality gates; exit 1 if any error is found")
    gate.add_argument("tables")
    args = ap.parse_args(argv)
    from factloom.operators.gates import summary
    from factloom.plans import catalog

    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = session("local[*]", "factloom")
    if args.command == "run":
        df = catalog.QUERIES[args.name](spark, args.tables)
        if args.out:
            df.write.mode("errorifexists").parquet(args.out)
        else:
            df.show(20, 80)
        return 0
    found = None
    for i in range(1, 9):
        issues = catalog.QUERIES[f"o_qg_{i:02}"](spark, args.tables)
        found = issues if found is None else found.unionByName(issues)
    found.groupBy("check", "severity").count().orderBy("check").show()
    return int(summary(found).first().blocked)


if __name__ == "__main__":
    sys.exit(main())
