"""Command line: list and run the queries and write jobs.

    python -m orderdesk list
    python -m orderdesk run booking_list --data /root/testdata/sf0.1 -p search=77 -p status=approved
    python -m orderdesk run monthly_revenue --data DIR -p as_of=2001-06-15 --out /tmp/m --format csv
    python -m orderdesk job requests --data DIR --out ROOT --version v1   (or commands, reports)

``run`` calls the plan function of that name with ``-p key=value``
parameters when it has one (reports, lists, documents, audits), otherwise the
registered query. Without ``--out`` the first ``--show`` rows are printed.
"""

from __future__ import annotations

import argparse
import inspect
import sys

from . import catalog
from .operators import audits as A
from .plans import documents as DOC
from .plans import jobs as J
from .plans import lists as L
from .plans import reports as R
from .session import build_session


def plan_functions() -> dict:
    """Public plan functions whose first parameter is the table bundle ``t``."""
    out = {}
    for module in (R, L, DOC, A):
        for name, fn in vars(module).items():
            if inspect.isfunction(fn) and not name.startswith("_") and fn.__module__ == module.__name__:
                params = list(inspect.signature(fn).parameters)
                if params and params[0] == "t":
                    out[name] = fn
    return out


def _coerce(fn, key: str, value: str):
    default = inspect.signature(fn).parameters[key].default
    if isinstance(default, bool):
        return value.lower() in ("1", "true", "yes")
    if isinstance(default, int):
        return int(value)
    return value


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="orderdesk")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("--data", required=True)
    run.add_argument("-p", "--param", action="append", default=[])
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    run.add_argument("--show", type=int, default=20)
    job = sub.add_parser("job")
    job.add_argument("kind", choices=["requests", "commands", "reports"])
    job.add_argument("--data", required=True)
    job.add_argument("--out", required=True)
    job.add_argument("--version", required=True)
    args = ap.parse_args(argv)

    if args.cmd == "list":
        fns = plan_functions()
        for name in sorted(set(catalog.queries()) | set(fns)):
            print(name, "(parametrised)" if name in fns else "")
        return 0

    spark = build_session()
    t = catalog.tables_for(spark, args.data)
    if args.cmd == "job":
        jobs = {"requests": J.process_booking_requests, "commands": J.apply_commands,
                "reports": J.reports_page}
        jobs[args.kind](spark, t, args.out, args.version)
        print(f"committed version {args.version} under {args.out}")
        return 0

    fns = plan_functions()
    if args.name in fns:
        fn = fns[args.name]
        kwargs = dict(p.split("=", 1) for p in args.param)
        df = fn(t, **{k: _coerce(fn, k, v) for k, v in kwargs.items()})
    elif args.name in catalog.queries():
        if args.param:
            print(f"{args.name} takes no parameters", file=sys.stderr)
            return 2
        df = catalog.queries()[args.name](spark, args.data)
    else:
        print(f"unknown query {args.name}", file=sys.stderr)
        return 2
    if args.out:
        writer = df.write.mode("overwrite")
        if args.format == "csv":
            writer.option("header", True).csv(args.out)
        else:
            getattr(writer, args.format)(args.out)
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
