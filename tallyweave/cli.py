"""Command line: ``run``, ``demo``, ``validate``; exit codes 0, 1 (run failed) and 2 (settings)."""

from __future__ import annotations

import argparse
import sys

from tallyweave.spec import TallyError, demo_spec, load_spec, with_synthetic


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyweave")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("run")
    one.add_argument("spec")
    one.add_argument("--out", required=True)
    one.add_argument("--decisions")
    demo = sub.add_parser("demo")
    demo.add_argument("--out", required=True)
    demo.add_argument("--seed", type=int, default=42)
    demo.add_argument("--firms", type=int, default=60)
    sub.add_parser("validate").add_argument("spec")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "validate":
            spec = load_spec(args.spec)
            print(f"{args.spec}: {spec.name}, {len(spec.feeds)} feeds")
            return 0
        spec = with_synthetic(demo_spec(), args.seed, args.firms) if args.command == "demo" else load_spec(args.spec)
        from dataclasses import replace

        import tallyweave.sources.synthetic  # noqa: F401
        from tallyweave.pipeline import export, run
        from tallyweave.session import local_session
        from tallyweave.sources.feeds import read_decisions

        if args.command == "demo":
            dbs = tuple(replace(d, checker="synthetic") for d in spec.visibility.databases)
            spec = replace(spec, visibility=replace(spec.visibility, databases=dbs))
        spark = local_session()
        verdicts = read_decisions(spark, args.decisions) if getattr(args, "decisions", None) else None
        result = run(spark, spec, verdicts)
        export(result, spec, args.out)
        for k, v in {**result.funnel, **(result.grades or {})}.items():
            print(f"{k}: {v}")
        if args.command == "demo":
            from tallyweave.operators.grading import MARKS

            return int(any((result.grades or {}).get(k, 0) < MARKS[k] for k in ("precision", "recall")))
        return 0
    except TallyError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
