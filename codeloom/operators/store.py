"""Queries and changes of the run store: runs (run_id, stage, lang, retrieval_name, chrf, ...) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("chrf", "chrf_score", "bleu", "bleu_score", "exact_match")


def _equal(df: DataFrame, conditions: dict) -> DataFrame:
    """Conditions that are empty do not count."""
    for column, value in conditions.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def filtered(runs: DataFrame, limit: int = 0, time: str = "ts", **equal: str | None) -> DataFrame:
    """Newest first; a limit of 0 does not count."""
    runs = _equal(runs, equal).orderBy(F.desc(time), "run_id")
    return runs.limit(limit) if limit else runs


def by_id(runs: DataFrame, run_id) -> DataFrame:
    return runs.where(F.col("run_id") == run_id).limit(1)


def best(runs: DataFrame, metric: str, limit: int, **equal: str | None) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    return _equal(runs.where(F.col(metric).isNotNull()), equal).orderBy(F.desc(metric), "run_id").limit(limit)


def pending(runs: DataFrame, metric: str = "chrf", time: str = "ts") -> DataFrame:
    return runs.where(F.col(metric).isNull() & (F.col("status") == "completed")).orderBy(F.desc(time), "run_id")


def summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("total"), F.count("chrf").alias("evaluated"))


def whole_summary(runs: DataFrame, metric: str = "chrf") -> DataFrame:
    """One row: total_runs, evaluated_runs, by_retrieval (name, count, avg_chrf) and by_data (stage, lang, count), sorted. The runs
    are read once; their groups are few."""
    groups = runs.groupBy("retrieval_name", "stage", "lang").agg(F.count("*").alias("n"), F.count(metric).alias("e"), F.sum(metric).alias("t"))
    both = groups.select("n", "e", "t", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("retrieval_name").cast("string").alias("a"), F.lit("").alias("b")), F.struct(F.lit(1).alias("k"), F.col("stage").alias("a"), F.col("lang").alias("b")))).alias("g"))
    added = both.groupBy("g").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("t").alias("t"))
    kind = lambda k, row: F.array_sort(F.collect_list(F.when(F.col("g.k") == k, row)))
    retrieval = F.struct(F.col("g.a").alias("name"), F.col("n").alias("count"), (F.col("t") / F.col("e")).alias("avg_chrf"))
    data = F.struct(F.col("g.a").alias("stage"), F.col("g.b").alias("lang"), F.col("n").alias("count"))
    return added.agg(F.coalesce(F.sum(F.when(F.col("g.k") == 0, F.col("n"))), F.lit(0)).alias("total_runs"), F.coalesce(F.sum(F.when(F.col("g.k") == 0, F.col("e"))), F.lit(0)).alias("evaluated_runs"), kind(0, retrieval).alias("by_retrieval"), kind(1, data).alias("by_data"))


def scores_of(scores: DataFrame, limit: int = 0, **equal: str | None) -> DataFrame:
    """By run, sample and rank; empty conditions and a limit of 0 do not count."""
    scores = _equal(scores, equal).orderBy("run_id", "sample_id", "rank")
    return scores.limit(limit) if limit else scores


def run_key(lang, stage, name, seed):
    """lang-stage-name-hash; seed: settings and time."""
    return F.concat_ws("-", lang, stage, name, F.substr(F.md5(seed), F.lit(1), F.lit(12)))


def by_retrieval(runs: DataFrame) -> DataFrame:
    return runs.groupBy("retrieval_name").agg(F.count("*").alias("n"), F.round(F.avg("chrf"), 4).alias("avg_chrf"))


def by_data(runs: DataFrame) -> DataFrame:
    return runs.groupBy("stage", "lang").agg(F.count("*").alias("n"))


def upsert(runs: DataFrame, new: DataFrame) -> DataFrame:
    """new replaces runs of the same run_id but for their metrics, which stay as they are, null or not."""
    held = [m for m in METRICS if m in runs.columns]
    old = runs.select("run_id", F.lit(True).alias("_known"), *(F.col(m).alias(f"_{m}") for m in held))
    changed = new.join(old, "run_id", "left").withColumns({m: F.when(F.col("_known"), F.col(f"_{m}")).otherwise(F.col(m)) for m in held if m in new.columns})
    return runs.join(new.select("run_id"), "run_id", "left_anti").unionByName(changed.select(runs.columns))


def update_metrics(runs: DataFrame, run_id, **values: float | None) -> DataFrame:
    """Sets the metrics that are given, by their column's name or the name without _score."""
    given = {next((c for c in (m, f"{m}_score") if c in runs.columns), m): v for m, v in values.items() if v is not None}
    for m in given:
        if m not in METRICS:
            raise ValueError(f"no such metric: {m}")
    return runs.withColumns({m: F.when(F.col("run_id") == run_id, F.lit(v)).otherwise(F.col(m)) for m, v in given.items()}) if given else runs


def delete(runs: DataFrame, run_id) -> DataFrame:
    """Rows without run_id stay."""
    return runs.where(~F.col("run_id").eqNullSafe(F.lit(run_id)))


def migrate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns that old lacks become null."""
    return new.limit(0).unionByName(old, allowMissingColumns=True)


def append(scores: DataFrame, new: DataFrame) -> DataFrame:
    """Plain rows: what is logged twice is there twice."""
    return scores.unionByName(new)


def results_table(runs: DataFrame) -> DataFrame:
    """run_id and a line of fixed width: stage, metric or pending, time."""
    shown = F.when(F.col("chrf").isNull(), F.lit("pending")).otherwise(F.format_string("%.4f", "chrf"))
    return runs.select("run_id", F.concat(F.rpad("stage", 8, " "), F.lit(" "), F.lpad(shown, 12, " "), F.lit("  "), F.left("ts", F.lit(16))).alias("line"))


#: Columns of the full results table: heading, width, decimals (none: as it is); absent values show as a question mark.
_SHOWN = {"max_hop": ("Hop", 3, None), "bm25_weight": ("BM25", 5, 2), "graph_weight": ("Grph", 5, 2), "symbol_weight": ("Sym", 5, 2), "hop_decay": ("Decay", 5, 1), "reverse_import_weight": ("Rev", 5, 1), "max_files": ("Files", 5, None), "max_tokens": ("MaxT", 5, None)}


def full_results_table(runs: DataFrame) -> tuple[str, DataFrame]:
    """Heading, and run_id and line of each run, newest first."""
    cells = [F.rpad("stage", 8, " ")]
    for name, (_, width, digits) in _SHOWN.items():
        value = F.col(name).cast("string") if digits is None else F.format_string(f"%.{digits}f", F.col(name))
        cells.append(F.lpad(F.when(F.col(name).isNull(), F.lit("?")).otherwise(value), width, " "))
    mark = F.concat(F.when(F.col("trim_prefix"), F.lit("P")).otherwise(""), F.when(F.col("trim_suffix"), F.lit("S")).otherwise(""))
    cells.append(F.lpad(F.when(mark == "", F.lit("-")).otherwise(mark), 4, " "))
    cells.append(F.lpad(F.when(F.col("chrf_score").isNull(), F.lit("pending")).otherwise(F.format_string("%.4f", "chrf_score")), 8, " "))
    cells += [F.lpad(F.col("num_samples").cast("string"), 5, " "), F.concat(F.lit(" "), F.left("timestamp", F.lit(16)))]
    heading = " ".join(["Stage   ", *(h.rjust(w) for h, w, _ in _SHOWN.values()), "Trim", "    chrF", "    N", " Run at"])
    return heading, runs.orderBy(F.desc("timestamp"), "run_id").select("run_id", F.concat_ws(" ", *cells).alias("line"))
