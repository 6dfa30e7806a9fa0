"""python -m codeloom COMMAND: run, sweep, repeat, search, baseline, evaluate, summary, list, best, pending, results."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from codeloom.operators import evaluation, store
from codeloom.plans import config, runs
from codeloom.sources.runs import RunStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("--root", default=".", help="folder of data, predictions, results and experiments")
    p.add_argument("--db", help="folder of the run store (default: experiments under the root)")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("run", "one run"), ("sweep", "a run for each combination of key=a,b values"), ("repeat", "the best settings again and again")):
        c = sub.add_parser(name, help=text)
        c.add_argument("overrides", nargs="*", help="key=value")
        if name == "repeat":
            c.add_argument("--times", type=int, default=20)
    c = sub.add_parser("search", help="search for settings")
    c.add_argument("--trials", type=int, default=300)
    c.add_argument("--stage", default="public")
    c.add_argument("--lang", default="python")
    c = sub.add_parser("baseline", help="single-file strategies")
    c.add_argument("--stage", default="practice")
    c.add_argument("--lang", default="python")
    c.add_argument("--strategy", default="random", choices=("random", "bm25", "recent"))
    c.add_argument("--seed", default="0")
    c.add_argument("--trim-prefix", action="store_true")
    c.add_argument("--trim-suffix", action="store_true")
    c = sub.add_parser("evaluate", help="generate completions and score them")
    c.add_argument("--predictions", "-p")
    c.add_argument("--data-dir", "-d", default="data")
    c.add_argument("--stage", "-s", default="practice")
    c.add_argument("--lang", "-l", default="python")
    c.add_argument("--output", "-o")
    c.add_argument("--model", "-m", default=os.environ.get("OLLAMA_MODEL", config.DEFAULTS["evaluation.model"]))
    c.add_argument("--ollama-url", default=os.environ.get("OLLAMA_URL", config.DEFAULTS["evaluation.ollama_url"]))
    sub.add_parser("summary", help="counts of the run store")
    c = sub.add_parser("list", help="runs, newest first")
    for name in ("--stage", "--lang", "--retrieval"):
        c.add_argument(name)
    c.add_argument("--limit", type=int, default=20)
    c = sub.add_parser("best", help="runs by a metric")
    c.add_argument("--metric", default="chrf_score")
    c.add_argument("--limit", type=int, default=10)
    sub.add_parser("pending", help="runs without metrics")
    sub.add_parser("results", help="table of all runs")
    return p


def lines(spark: SparkSession, a: argparse.Namespace):
    """What the command prints."""
    held = RunStore(spark, a.db or f"{a.root}/experiments")
    shown = lambda v: "N/A" if v is None else f"{v:.4f}"
    if a.command == "run":
        yield json.dumps(runs.run(spark, config.compose(a.overrides), a.root))
    elif a.command == "sweep":
        yield from map(json.dumps, runs.sweep(spark, a.overrides, a.root))
    elif a.command == "repeat":
        yield from map(json.dumps, runs.repeat(spark, a.root, a.times, a.overrides))
    elif a.command == "search":
        best, score = runs.search_runs(spark, a.root, a.trials, a.stage, a.lang)
        yield json.dumps({"chrf": score, **best})
    elif a.command == "baseline":
        yield runs.baseline(spark, a.root, a.strategy, a.stage, a.lang, a.seed, a.trim_prefix, a.trim_suffix)
    elif a.command == "evaluate":
        found = a.predictions or runs.default_predictions(spark, f"{a.root}/predictions")
        if not found:
            raise SystemExit("name the predictions: there is not one file alone in the predictions folder")
        s = config.compose([f"data.data_dir={a.data_dir}", f"data.stage={a.stage}", f"data.lang={a.lang}"])
        output = a.output or f"{a.root}/{config.result_paths(found)[0]}"
        yield json.dumps(runs.evaluate(spark, found, f"{a.root}/{config.points_path(s)}", f"{a.root}/{config.answers_path(s)}", output, evaluation.http_generator(a.ollama_url, a.model), a.model))
    elif a.command == "summary":
        got = held.summary()
        yield f"Total runs: {got['total_runs']}\nEvaluated runs: {got['evaluated_runs']}"
        yield from (f"  {r['name']}: {r['count']} runs, avg chrF: {shown(r['avg_chrf'])}" for r in got["by_retrieval"])
        yield from (f"  {r['stage']}/{r['lang']}: {r['count']} runs" for r in got["by_data"])
    elif a.command == "list":
        found = held.get_runs(a.stage, a.lang, a.retrieval, a.limit)
        yield from (f"{r['run_id']:<45} {r['retrieval_name']:<12} {r['max_hop']:<4} {shown(r['chrf_score']):<8} {r['prediction_file']}" for r in found.collect())
    elif a.command == "best":
        yield from (f"{r['run_id']:<45} {r[a.metric]:<10.4f} {r['retrieval_name']:<12} {r['max_hop']}" for r in held.best(a.metric, limit=a.limit).collect())
    elif a.command == "pending":
        yield from (f"{r['run_id']}: {r['prediction_file']}" for r in held.pending().toLocalIterator())
    elif a.command == "results":
        heading, table = store.full_results_table(held.runs())
        yield heading
        yield from (r["line"] for r in table.toLocalIterator())


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    for line in lines(spark, a):
        sys.stdout.write(line + "\n")


if __name__ == "__main__":
    main()
