"""Command line: ``python -m shelfwise list | run NAME | explain NAME``.

``run`` executes a registered query over a folder of source tables and writes
the result as Parquet (``--out``) or shows the first rows; ``explain`` prints
the formatted physical plan.  The session uses the cluster's settings when
run with ``spark-submit``; ``--master`` is for local use.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shelfwise")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered queries")
    for name in ("run", "explain"):
        c = sub.add_parser(name)
        c.add_argument("query")
        c.add_argument("--source", required=True, help="folder of source tables (*.parquet)")
        c.add_argument("--master", default=None)
        c.add_argument("--checkpoint-dir", default=None,
                       help="used only when the session has no spark.checkpoint.dir")
        if name == "run":
            c.add_argument("--out", default=None, help="write the result here as Parquet")
            c.add_argument("--show", type=int, default=20)
    args = p.parse_args(argv)

    from shelfwise.plans.registry import ORACLE, QUERIES

    if args.cmd == "list":
        for q in sorted(QUERIES):
            print(f"{q}{'' if q in ORACLE else '  (no SQL oracle)'}")
        return 0
    if args.query not in QUERIES:
        print(f"unknown query {args.query!r}; see `python -m shelfwise list`", file=sys.stderr)
        return 2

    from shelfwise.session import ensure_checkpoint_dir, get_session, require_checkpoint_dir

    spark = get_session(master=args.master)
    if args.checkpoint_dir:
        ensure_checkpoint_dir(spark, args.checkpoint_dir)
    else:
        require_checkpoint_dir(spark)
    df = QUERIES[args.query](spark, args.source)
    if args.cmd == "explain":
        df.explain("formatted")
    elif args.out:
        df.write.mode("errorifexists").parquet(args.out)
        print(f"wrote {args.query} to {args.out}")
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
