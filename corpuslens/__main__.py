"""Commands: python -m corpuslens gate|floor|evaluate|report|structure ... Exit codes: 0 well, 1 a gate failed or can't be checked, 2 a gate has no bands, or
another command's call is wrong."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from corpuslens.operators.gates import GateError
from corpuslens.plans import reports


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("corpuslens")
    c = p.add_subparsers(dest="command", required=True)
    gate = c.add_parser("gate", help="a summary's statistics against the bands of a gate")
    gate.add_argument("gate", nargs="?", help="the gate's file")
    gate.add_argument("summary", nargs="?", help="the summary's file")
    gate.add_argument("--gate-file")
    gate.add_argument("--dataset", help="a family, whose gate is <gates-dir>/<dataset>.yaml")
    gate.add_argument("--gates-dir", default="gates")
    gate.add_argument("--run-dir", help="a folder that holds summary.json")
    gate.add_argument("--series", "--stats-name", default="real")
    gate.add_argument("--allow-unset", action="store_true")
    gate.add_argument("--allow-mismatch", "--allow-condition-mismatch", action="store_true")
    gate.add_argument("--output", help="a file for the result besides")
    floor = c.add_parser("floor", help="how far series that differ by seed only lie apart")
    floor.add_argument("summary")
    floor.add_argument("series", nargs="+")
    floor.add_argument("--real", default="real")
    evaluate = c.add_parser("evaluate", help="measures of a synthetic file against a real one")
    evaluate.add_argument("real")
    evaluate.add_argument("synthetic")
    evaluate.add_argument("--out")
    report = c.add_parser("report", help="a corpus and its stand-ins")
    report.add_argument("real")
    report.add_argument("out")
    report.add_argument("synthetic", nargs="*")
    report.add_argument("--metric", default="l2", choices=("l2", "angular"))
    shape = c.add_parser("structure", help="facts about one corpus")
    shape.add_argument("path")
    shape.add_argument("out")
    return p


def _gate(a: argparse.Namespace, spark: SparkSession) -> int:
    """What can't be checked is no verdict: it says so on stderr and exits with 1, and nothing is written."""
    try:
        given = [x for x in (a.gate, a.gate_file, a.dataset and f"{a.gates_dir}/{a.dataset}.yaml") if x]
        summaries = [x for x in (a.summary, a.run_dir and f"{a.run_dir}/summary.json") if x]
        if len(given) != 1 or len(summaries) != 1:
            raise GateError("one gate (a file or a dataset) and one summary (a file or a run's folder) are needed")
        with open(given[0]) as g, open(summaries[0]) as s:
            got = reports.check_gate(spark, g.read(), json.load(s), a.series, a.allow_unset, a.allow_mismatch)
        got = {"gate_file": given[0], "summary": summaries[0], "series": a.series} | got
        if a.output:
            reports.put(a.output, json.dumps(got, indent=2))
    except (GateError, ValueError, OSError) as e:
        print(f"gate: {e}", file=sys.stderr)
        return 1
    print(json.dumps(got, indent=2))
    return got["exit_code"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    read = lambda path: open(path).read()  # noqa: E731, SIM115
    try:
        if a.command == "gate":
            return _gate(a, spark)
        if a.command == "floor":
            got = [r.asDict() for r in reports.noise_floor(spark, json.loads(read(a.summary)), a.series, a.real).collect()]
        elif a.command == "evaluate":
            got = reports.evaluate_files(spark, a.real, a.synthetic, a.out)
        elif a.command == "report":
            got = reports.eda_report(spark, a.real, a.out, a.synthetic, metric=a.metric)
        else:
            got = reports.structure_report(spark, a.path, a.out)
    except (GateError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    print(json.dumps(got, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
