"""Drivers: a run (retrieval, predictions, scores, evaluation), its evaluation, sweeps, search and repeated runs."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeloom.operators import evaluation
from codeloom.operators.tables import written
from codeloom.plans import config, retrieval
from codeloom.sources import files as sources
from codeloom.sources.runs import RunStore

Generator = Callable[[list[str]], list[str]]


def _under(root: str, path: str) -> str:
    return path if path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, by Spark's own file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def evaluate(spark: SparkSession, predictions: str, points: str, answers: str, output: str, generator: Generator, model: str = "") -> dict:
    """Writes the results (one JSON line a sample) and the summary beside them; returns the summary. Points, answers and predictions
    that differ in number are an error."""
    sources.register(spark)
    began = time.time()
    asked = sources.points(spark, points).select(F.col("sample").alias("sample_idx"), "id", "prefix", "suffix")
    joined = evaluation.eval_join(asked, sources.numbered(spark, answers, sources.ANSWERS), sources.numbered(spark, predictions, sources.PREDICTIONS).na.fill("", ["context"]))
    scored = written(evaluation.results(joined, generator), "results")  # a model is asked once
    sources.write_lines(scored, output, "sample_idx")
    row = evaluation.summary(scored).first()
    out = {"mean_chrf": row["mean_chrf"], "num_samples": row["num_samples"], "model": model, "predictions_file": predictions, "elapsed_seconds": round(time.time() - began, 1)}
    write_text(spark, config.result_paths(predictions, output)[1], json.dumps(out, indent=2))
    return out


def run(spark: SparkSession, settings: dict, root: str, generator: Generator | None = None) -> dict:
    """One run: predictions and score records of all points, the run's row, and its evaluation if that is enabled (with generator, or
    the settings' model server; one that fails leaves the run without metrics). A run that fails is logged as failed."""
    sources.register(spark)
    store = RunStore(spark, _under(root, "experiments"))
    points_path = _under(root, config.points_path(settings))
    target = _under(root, f"{settings['data.predictions_dir']}/{config.prediction_name(settings)}")
    record = config.run_record(settings, target, 0)
    try:
        points = written(sources.points(spark, points_path), "points")
        record["num_samples"] = points.count()
        files = spark.read.format("repository").option("ext", ".py").load(_under(root, config.repositories_path(settings)))
        contexts, scores = retrieval.find_context(files, points, settings)
        sources.write_lines(retrieval.predictions(points, contexts, settings), target, "sample")
        store.log_scores(record["run_id"], scores)
        store.log_run(record)
    except Exception as e:
        store.log_run(record | {"status": "failed", "error_message": str(e)[:2000], "num_samples": 0})
        raise
    out = {"run_id": record["run_id"], "predictions": target, "num_samples": record["num_samples"], "mean_chrf": None}
    if settings["evaluation.enabled"]:
        model = settings["evaluation.model"]
        ask = generator or evaluation.http_generator(settings["evaluation.ollama_url"], model, settings["evaluation.temperature"])
        try:
            results = _under(root, config.result_paths(target)[0])
            out["mean_chrf"] = evaluate(spark, target, points_path, _under(root, config.answers_path(settings)), results, ask, model)["mean_chrf"]
        except Exception as e:  # the run stands without its evaluation
            out["evaluation_error"] = str(e)[:2000]
        else:
            store.update_metrics(record["run_id"], chrf=out["mean_chrf"])
    return out


def sweep(spark: SparkSession, arguments: Iterable[str], root: str, generator: Generator | None = None) -> list[dict]:
    """One run for each combination of the arguments' values."""
    return [run(spark, config.compose(overrides), root, generator) for overrides in config.sweep(arguments)]


def repeat(spark: SparkSession, root: str, times: int = 20, overrides: Iterable[str] = (), generator: Generator | None = None) -> list[dict]:
    """The best published settings several times, for the spread of their score."""
    settings = config.compose([*(f"{k}={v}" for k, v in config.BEST.items()), *overrides])
    return [run(spark, settings, root, generator) for _ in range(times)]


def baseline(spark: SparkSession, root: str, strategy: str, stage: str = "practice", lang: str = "python", seed: str = "0", trim_prefix: bool = False, trim_suffix: bool = False) -> str:
    """Predictions of a single-file strategy; returns where they are."""
    extensions = {"python": ".py", "kotlin": ".kt"}
    if lang not in extensions:
        raise ValueError(f"no such language: {lang}")
    sources.register(spark)
    settings = config.compose([f"data.stage={stage}", f"data.lang={lang}"])
    files = spark.read.format("repository").option("ext", extensions[lang]).load(_under(root, config.repositories_path(settings)))
    points = sources.points(spark, _under(root, config.points_path(settings)))
    target = _under(root, f"{settings['data.predictions_dir']}/{config.baseline_name(lang, stage, strategy, trim_prefix, trim_suffix)}")
    sources.write_lines(retrieval.baseline(files, points, strategy, seed, trim_prefix, trim_suffix), target, "sample")
    return target


def default_predictions(spark: SparkSession, folder: str) -> str | None:
    """The only prediction file of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []
    found = [n for n in names if n.endswith(".jsonl")]
    return f"{folder.rstrip('/')}/{found[0]}" if len(found) == 1 else None


# The search space (lowest, highest, step) and the settings tried first.
SPACE = {"context.max_files": (1, 15, 1), "context.max_tokens": (400, 6000, 100), "context.query_window": (50, 800, 50), "retrieval.scoring.bm25_weight": (0.2, 0.9, 0.05), "retrieval.scoring.graph_weight": (0.0, 0.6, 0.05), "retrieval.graph.max_hop": (0, 5, 1), "retrieval.graph.hop_decay": (0.2, 0.9, 0.1), "retrieval.graph.reverse_import_weight": (0.0, 0.6, 0.1)}
FIRST = {"context.max_files": 7, "context.max_tokens": 1500, "context.query_window": 150, "retrieval.scoring.bm25_weight": 0.6, "retrieval.scoring.graph_weight": 0.4, "retrieval.graph.max_hop": 2, "retrieval.graph.hop_decay": 0.6, "retrieval.graph.reverse_import_weight": 0.0}


def proposal(done: list[tuple[dict, float]], rng: random.Random) -> dict:
    """The next trial: the known settings, then random ones, then every second one a neighbour of one of the best fifth."""
    if not done:
        return dict(FIRST)
    draw = {k: round(low + step * rng.randint(0, round((high - low) / step)), 4) for k, (low, high, step) in SPACE.items()}
    if len(done) >= 10 and len(done) % 2:
        near = rng.choice(sorted(done, key=lambda x: -x[1])[: max(1, len(done) // 5)])[0]
        draw = {k: draw[k] if rng.random() < 0.25 else near[k] for k in SPACE}
    return {k: int(v) if isinstance(SPACE[k][2], int) else v for k, v in draw.items()}


def search(score: Callable[[list[str]], float | None], trials: int = 300, seed: int = 0, done: list[tuple[dict, float]] | None = None, overrides: Iterable[str] = ()) -> tuple[dict, float]:
    """The best settings of so many trials; score(overrides) runs one, and one that raises or has no score counts as 0. `done`, if
    given, holds earlier trials and gets the new ones, so that a search can go on."""
    done, rng = [] if done is None else done, random.Random(seed)
    for _ in range(len(done)):
        rng.random()
    while len(done) < trials:
        at = proposal(done, rng)
        symbol = config.symbol_remainder(at["retrieval.scoring.bm25_weight"], at["retrieval.scoring.graph_weight"])
        try:
            value = score([*overrides, *(f"{k}={v}" for k, v in at.items()), f"retrieval.scoring.symbol_weight={symbol}"]) or 0.0
        except Exception:  # a trial that fails does not end the search
            value = 0.0
        done.append((at, value))
    return max(done, key=lambda x: x[1])


def search_runs(spark: SparkSession, root: str, trials: int = 300, stage: str = "public", lang: str = "python", generator: Generator | None = None) -> tuple[dict, float]:
    return search(lambda overrides: run(spark, config.compose(overrides), root, generator)["mean_chrf"], trials, overrides=[f"data.stage={stage}", f"data.lang={lang}"])


