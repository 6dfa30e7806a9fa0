"""The import graph: edges from imports, and scores by bounded walks from a start file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def module_map(files: DataFrame) -> DataFrame:
    """repo_key, module, path: the last path of a module wins; the empty module is none."""
    return files.where("module <> ''").groupBy("repo_key", "module").agg(F.max("path").alias("path"))


def import_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """repo_key, src, dst. An import names a module, or else every module below it; the prefix case is an equi-join on the
    ancestors of each module."""
    asked = imports.select("repo_key", "src", "candidate").distinct()
    exact = asked.join(modules.withColumnRenamed("module", "candidate"), ["repo_key", "candidate"])
    missed = asked.join(modules.select("repo_key", F.col("module").alias("candidate")), ["repo_key", "candidate"], "left_anti")
    parts = F.split("module", r"\.")
    above = modules.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).where(F.col("depth") < F.size(parts))
    above = above.select("repo_key", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), ".").alias("candidate"), "path")
    both = exact.select("repo_key", "src", F.col("path").alias("dst")).union(missed.join(above, ["repo_key", "candidate"]).select("repo_key", "src", F.col("path").alias("dst")))
    return both.where("src <> dst").distinct()


def graph_scores(edges: DataFrame, starts: DataFrame, max_hops: int = 2, decay: float = 0.65, reverse: float = 0.35) -> DataFrame:
    """repo_key, start, node, score: over visited nodes u at undirected distance h < max_hops, the best of decay**h along an edge
    and reverse * decay**h against it. edges: repo_key, src, dst; starts: repo_key, start. Walks stay in their repository."""
    if decay > 1:
        raise ValueError("decay above 1 has no closed form")
    both = edges.select("repo_key", "src", "dst").union(edges.select("repo_key", "dst", "src")).distinct()
    seen = starts.select("repo_key", "start", F.col("start").alias("node"), F.lit(0).alias("hop")).where(F.lit(max_hops > 0))
    front = seen
    for hop in range(1, max_hops):
        new = front.join(both.withColumnRenamed("src", "node"), ["repo_key", "node"]).select("repo_key", "start", F.col("dst").alias("node")).distinct()
        front = new.join(seen, ["repo_key", "start", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.union(front)
    weight = F.pow(F.lit(decay), F.col("hop"))
    along = seen.join(edges.withColumnRenamed("src", "node"), ["repo_key", "node"]).select("repo_key", "start", F.col("dst").alias("to"), weight.alias("w"))
    against = seen.join(edges.withColumnRenamed("dst", "node"), ["repo_key", "node"]).select("repo_key", "start", F.col("src").alias("to"), (weight * reverse).alias("w"))
    return along.union(against).where("start <> to").groupBy("repo_key", "start", F.col("to").alias("node")).agg(F.round(F.max("w"), 6).alias("score"))
