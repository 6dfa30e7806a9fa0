"""Single-file strategies. The choice is random but seeded: the file whose name and seed have the smallest hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LINES = 10


def _draw(seed: str):
    return F.min(F.struct(F.md5(F.concat("path", F.lit(seed))), "path"))["path"].alias("path")


def random_file(files: DataFrame, seed: str) -> DataFrame:
    """repo_key, path of one of a repository's files."""
    return files.groupBy("repo_key").agg(_draw(seed))


def recent_file(files: DataFrame, points: DataFrame, seed: str) -> DataFrame:
    """sample, repo_key, path: one of the files in modified, or else a random one. points: sample, repo_key, modified."""
    named = points.select("sample", "repo_key", F.explode("modified").alias("path"))
    recent = named.join(files.select("repo_key", "path"), ["repo_key", "path"], "left_semi").groupBy("sample", "repo_key").agg(_draw(seed))
    other = random_file(files, seed).withColumnRenamed("path", "other")
    both = points.select("sample", "repo_key").join(recent, ["sample", "repo_key"], "left").join(other, "repo_key", "left")
    return both.select("sample", "repo_key", F.coalesce("path", "other").alias("path"))
