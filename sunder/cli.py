"""``sunder split | audit | list`` over CSV or Parquet files."""

from __future__ import annotations

import argparse
import inspect
import json
import sys

#: Operators whose sizes follow the data.
UNSIZED = ("predefined", "deposition_date", "distinct_label")
OK, FAILED, USAGE, INFEASIBLE, FLAGGED = 0, 1, 2, 3, 4


def _read(spark, path: str):
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from sunder import contract, registry
    from sunder.errors import InfeasibleError, ParameterError, SunderError
    from sunder.operators import audit

    parser = argparse.ArgumentParser(prog="sunder")
    sub = parser.add_subparsers(dest="command", required=True)
    split = sub.add_parser("split")
    split.add_argument("input")
    split.add_argument("output")
    split.add_argument("--operator", default="random")
    split.add_argument("--id", required=True)
    split.add_argument("--column", action="append", default=[], help="key, date, label, tokens or vector of the operator; may be repeated")
    split.add_argument("--param", action="append", default=[], metavar="NAME=JSON", help="a further parameter of the operator")
    split.add_argument("--test", type=float, default=0.2)
    split.add_argument("--valid", type=float, default=0.0)
    split.add_argument("--seed", type=int, default=0)
    check = sub.add_parser("audit")
    check.add_argument("input")
    check.add_argument("split")
    check.add_argument("--id", required=True)
    check.add_argument("--key", required=True)
    check.add_argument("--fail-on", choices=["duplicates", "shared"], action="append", default=[])
    listing = sub.add_parser("list")
    listing.add_argument("--json", action="store_true")
    listing.add_argument("--family")
    listing.add_argument("--strictness")
    args = parser.parse_args(argv)
    if args.command == "list":
        rows = [{"id": o.id, "family": o.family, "strictness": o.strictness, "groups": o.groups} for o in registry.OPERATORS.values() if args.family in (None, o.family) and args.strictness in (None, o.strictness)]
        print(json.dumps(rows) if args.json else "\n".join(f"{r['id']:32}{r['family']:14}{r['strictness']}" for r in rows))
        return OK
    spark = SparkSession.builder.getOrCreate()
    try:
        df = _read(spark, args.input)
        if args.command == "split":
            name = registry.get(args.operator).id
            params = {"train": None, "valid": args.valid, "test": args.test} if name not in UNSIZED else {}
            try:
                params |= {k: json.loads(v) for k, _, v in (x.partition("=") for x in args.param)}
            except json.JSONDecodeError as error:
                raise ParameterError(f"--param takes NAME=JSON: {error}") from error
            if "seed" in inspect.signature(registry.get(name).run).parameters:
                params.setdefault("seed", args.seed)
            try:
                out = registry.split(name, df, args.id, args.column, **params)
            except TypeError as error:
                raise ParameterError(f"{name}: {error}") from error
            if "partition" not in out.columns or set(registry.SEVERAL) & set(out.columns):
                raise ParameterError(f"{name} gives several splits; call it from Python")
            with open(args.output, "w") as f:
                f.write(contract.to_json(out, name, {"id": args.id, "column": args.column, "seed": args.seed, "test": args.test, "valid": args.valid}))
            return OK
        with open(args.split) as f:
            parts = contract.from_json(spark, f.read())
        shared = audit.shared_groups(df, args.id, args.key, parts).first()
        found = {"duplicates": audit.duplicates_across(df, args.id, args.key, parts).count(), "shared": shared.n_shared or 0}
        print(json.dumps(found, sort_keys=True))
        return FLAGGED if any(found[k] for k in args.fail_on) else OK
    except ParameterError as error:
        print(error, file=sys.stderr)
        return USAGE
    except InfeasibleError as error:
        print(error, file=sys.stderr)
        return INFEASIBLE
    except SunderError as error:
        print(error, file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
