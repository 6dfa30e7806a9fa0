"""Joining points, answers and predictions; generation by a pluggable function; results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.functions.text import STOPS, fim_prompt, stop_cut
from codeloom.operators.chrf import chrf_score


def eval_join(points: DataFrame, answers: DataFrame, predictions: DataFrame) -> DataFrame:
    """sample_idx, context, prefix, suffix, middle. A prediction's own prefix or suffix wins over the point's. All three must have
    the same rows; the count is taken where the result is used, and a mismatch raises."""
    p = predictions.select("sample_idx", "context", F.col("prefix").alias("_p"), F.col("suffix").alias("_s"))
    both = points.join(answers, "sample_idx", "full").join(p, "sample_idx", "full")
    extra = [c for c in points.columns if c not in ("sample_idx", "prefix", "suffix")]
    complete = F.col("prefix").isNotNull() & F.col("middle").isNotNull() & F.col("context").isNotNull()
    guard = F.when(complete, F.lit(True)).otherwise(F.raise_error(F.lit("points, answers and predictions do not match")).cast("boolean"))
    return both.where(guard).select("sample_idx", *extra, "context", F.coalesce("_p", "prefix").alias("prefix"), F.coalesce("_s", "suffix").alias("suffix"), "middle")


def generated(prompts: DataFrame, generator: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds generated: what the function makes of a batch of prompts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(generated=generator(batch["prompt"].tolist()))

    return prompts.mapInPandas(run, StructType([*prompts.schema.fields]).add("generated", "string"))


def http_generator(url: str, model: str, temperature: float = 0.0, new_tokens: int = 128, window: int = 8192, timeout: float = 300) -> Callable[[list[str]], list[str]]:
    """A generator that asks a model server (POST /api/generate) for one prompt after the other; it runs in the workers."""

    def generate(prompts: list[str]) -> list[str]:
        import json
        import urllib.request

        out = []
        for prompt in prompts:
            options = {"temperature": temperature, "num_predict": new_tokens, "num_ctx": window, "stop": list(STOPS), "num_keep": -1}
            body = json.dumps({"model": model, "prompt": prompt, "raw": True, "stream": False, "options": options}).encode()
            request = urllib.request.Request(f"{url.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as got:
                out.append(json.loads(got.read()).get("response", ""))
        return out

    return generate


def results(joined: DataFrame, generator: Callable[[list[str]], list[str]]) -> DataFrame:
    """sample_idx, id, generated, ground_truth, chrf of eval_join's rows (with id): prompts, generation, cut at stop marks, score."""
    prompts = joined.select("sample_idx", F.coalesce("id", F.lit("?")).alias("id"), "middle", fim_prompt(F.col("prefix"), F.col("suffix"), F.col("context")).alias("prompt"))
    made = generated(prompts, generator).select("sample_idx", "id", stop_cut(F.col("generated")).alias("generated"), F.col("middle").alias("ground_truth"))
    return made.withColumn("chrf", F.round(chrf_score("ground_truth", "generated"), 4))


def summary(results: DataFrame) -> DataFrame:
    """mean_chrf, num_samples of results (chrf)."""
    return results.agg(F.round(F.avg("chrf"), 4).alias("mean_chrf"), F.count("*").alias("num_samples"))
