"""python -m quarry normalise|generate|evaluate: records to a table, reports and explanations of records, or scores of explanations."""

from __future__ import annotations

import argparse
import json
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry import ship
from quarry.functions import metrics
from quarry.operators import resolve
from quarry.plans import lifecycle
from quarry.sources import readers, sinks


def _named(name: str):
    """What module:function names: it makes a provider or an encoder."""
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    normalise = commands.add_parser("normalise")
    normalise.add_argument("--input", required=True)
    normalise.add_argument("--output", required=True)
    evaluate = commands.add_parser("evaluate")
    for name in ("truth", "found", "vocabulary", "output"):
        evaluate.add_argument(f"--{name}", required=True)
    evaluate.add_argument("--run", default="run")
    evaluate.add_argument("--metrics", default=",".join(lifecycle.OFFLINE), help="names, by comma")
    evaluate.add_argument("--encoder", action="append", default=[], metavar="MODE=MODULE:FUNCTION", help="an encoder of texts for argument_similarity")
    evaluate.add_argument("--token-encoder", action="append", default=[], metavar="MODE=MODULE:FUNCTION", help="an encoder of texts' tokens")
    evaluate.add_argument("--judge", help="module:function of the provider that judges")
    evaluate.add_argument("--correctness-template", help="file")
    evaluate.add_argument("--plausibility-template", help="file")
    evaluate.add_argument("--rubric", default="", help="keys of the judge's scores, by comma")
    generate = commands.add_parser("generate")
    for name in ("records", "output", "report-template", "explain-template", "primitives", "model"):
        generate.add_argument(f"--{name}", required=True)
    generate.add_argument("--question", default="How does the following perturbation influence the cell in the described context, mechanistically and functionally?")
    generate.add_argument("--tools", type=json.loads, default={}, help="JSON: name of a tool to its table of index, info; in order")
    generate.add_argument("--mode", choices=("report-explain", "explain-only"), default="report-explain")
    generate.add_argument("--reports", help="reports of a former run, for explain-only")
    generate.add_argument("--max-items", type=int, default=0)
    got = parser.parse_args(args)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    ship(spark)
    if got.command == "normalise":
        sinks.write_table(readers.records(readers.table(spark, got.input, readers.RECORD)), got.output)
        return
    if got.command == "generate":
        model = _named(got.model)
        records = readers.table(spark, got.records)
        if "perturbations" in records.columns:
            records = records.select("index", F.to_json("perturbations").alias("perturbation"))
        records = records.orderBy("index").limit(got.max_items) if got.max_items else records
        if (done := sinks.latest(spark, f"{got.output}/explanations", "index")) is not None:
            records = resolve.remaining(records, done, "index")  # go on where a former run ended
        tools = [(name, readers.table(spark, path)) for name, path in got.tools.items()]
        templates = [readers.text_file(spark, p).first().value for p in (got.report_template, got.explain_template, got.primitives)]
        reports = readers.table(spark, got.reports, readers.REPORT) if got.mode == "explain-only" else None
        made = lifecycle.generate(records, tools, *templates, got.question, model, reports=reports)
        number = sinks.next_commit(spark, f"{got.output}/explanations")  # explanations come last: without them a run repeats its number
        for name, rows in zip(("reports", "explanations"), made):
            sinks.commit(rows, f"{got.output}/{name}", number)
        return
    words = [r.action for r in readers.json_list(spark, got.vocabulary, readers.PRIMITIVES).select("action").collect()]  # a small dictionary
    by_mode = lambda given: {mode: _named(name) for mode, _, name in (x.partition("=") for x in given)}
    template = lambda path: readers.text_file(spark, path).first().value if path else ""
    scores = lifecycle.evaluate(
        readers.table(spark, got.truth, readers.EXPLANATION), readers.table(spark, got.found, readers.EXPLANATION), words, tuple(got.metrics.split(",")),
        by_mode(got.encoder), by_mode(got.token_encoder), _named(got.judge) if got.judge else None, template(got.correctness_template), template(got.plausibility_template), tuple(k for k in got.rubric.split(",") if k),
    )
    sinks.write_table(scores, f"{got.output}/scores")
    sinks.write_metrics(metrics.means(scores, skip=("index",)), f"{got.output}/metrics", got.run)


if __name__ == "__main__":
    main()
