"""The run store: experiments and retrieval scores as Parquet tables in a folder.

experiments is small and changes as a whole: a change writes a new version beside the old one, and readers take the newest version
that is complete (has _SUCCESS), so a lost writer leaves the store as it was. One writer at a time. retrieval_scores only grows, in
folders by run, which a filter on run_id prunes.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import store

RUNS = """id long, run_id string, timestamp string, stage string, lang string, retrieval_name string, max_hop int, bm25_weight double, graph_weight double,
import_weight double, call_weight double, inheritance_weight double, type_ref_weight double, max_files int, max_tokens int, min_lines int,
fallback_enabled boolean, min_pool_size int, query_window int, hop_decay double, reverse_import_weight double, symbol_weight double,
trim_prefix boolean, trim_suffix boolean, trim_lines int, prediction_file string, num_samples int, config_json string,
chrf_score double, bleu_score double, exact_match double, status string, error_message string, created_at timestamp"""
SCORES = "sample_id string, repo string, completion_file string, retrieved_file string, rank int, bm25_score double, graph_score double, combined_score double, included_in_context boolean, run_id string"


class RunStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        top = self._path(f"{self.folder}/experiments")
        names = [x.getPath().getName() for x in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.folder}/experiments/{n}/_SUCCESS")))

    def runs(self) -> DataFrame:
        """All runs; columns that an older version lacks are null."""
        empty, versions = self.spark.createDataFrame([], RUNS), self._versions()
        return store.migrate(self.spark.read.parquet(f"{self.folder}/experiments/v={versions[-1]}"), empty) if versions else empty

    def _swap(self, runs: DataFrame) -> None:
        versions = self._versions()
        new = versions[-1] + 1 if versions else 0
        runs.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/experiments/v={new}")
        for v in versions[:-1]:  # the version before stays for those who read it now
            self._fs.delete(self._path(f"{self.folder}/experiments/v={v}"), True)

    def log_run(self, record: dict) -> int:
        """Adds the run, or changes the one of its run_id but for its metrics; returns its id."""
        old = self.runs()
        known = old.where(F.col("run_id") == record["run_id"]).select("id", "created_at").first()
        last = old.agg(F.max("id")).first()[0] or 0
        row = record | {"id": known["id"] if known else last + 1, "created_at": known["created_at"] if known else datetime.now()}
        schema = self.spark.createDataFrame([], RUNS).schema
        values = [float(row[f.name]) if f.dataType.typeName() == "double" and row.get(f.name) is not None else row.get(f.name) for f in schema]
        new = self.spark.createDataFrame([values], schema)
        self._swap(store.upsert(old, new))
        return row["id"]

    def update_metrics(self, run_id: str, **values: float | None) -> bool:
        """False where nothing is given or there is no such run."""
        changed = store.update_metrics(self.runs(), run_id, **values)
        if all(v is None for v in values.values()) or self.get_run(run_id) is None:
            return False
        self._swap(changed)
        return True

    def delete_run(self, run_id: str) -> bool:
        if self.get_run(run_id) is None:
            return False
        self._swap(store.delete(self.runs(), run_id))
        return True

    def get_run(self, run_id: str) -> dict | None:
        row = store.by_id(self.runs(), run_id).first()
        return row.asDict() if row else None

    def get_runs(self, stage: str | None = None, lang: str | None = None, retrieval_name: str | None = None, limit: int = 0) -> DataFrame:
        return store.filtered(self.runs(), limit, "timestamp", stage=stage, lang=lang, retrieval_name=retrieval_name)

    def best(self, metric: str = "chrf_score", stage: str | None = None, lang: str | None = None, limit: int = 10) -> DataFrame:
        return store.best(self.runs(), metric, limit, stage=stage, lang=lang)

    def pending(self) -> DataFrame:
        return store.pending(self.runs(), "chrf_score", "timestamp")

    def summary(self) -> dict:
        """The four results in one job, as nested rows."""
        return store.whole_summary(self.runs(), "chrf_score").first().asDict(recursive=True)

    def log_scores(self, run_id: str, records: DataFrame) -> int:
        """Appends the records of a run; returns how many."""
        empty = self.spark.createDataFrame([], SCORES)
        rows = store.append(empty, records.withColumn("run_id", F.lit(run_id)).select(*(F.col(f.name).cast(f.dataType) for f in empty.schema)))
        before = self.scores(run_id).count()
        rows.write.mode("append").partitionBy("run_id").parquet(f"{self.folder}/retrieval_scores")
        return self.scores(run_id).count() - before

    def scores(self, run_id: str | None = None, sample_id: str | None = None, limit: int = 0) -> DataFrame:
        path = f"{self.folder}/retrieval_scores"
        held = self.spark.read.schema(SCORES).parquet(path) if self._fs.exists(self._path(path)) else self.spark.createDataFrame([], SCORES)
        return store.scores_of(held, limit, run_id=run_id, sample_id=sample_id)
