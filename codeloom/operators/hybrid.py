"""Ranking files by BM25, import graph and shared symbols together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.tables import few

NEIGHBOUR_BOOST = 0.05


def symbol_scores(asked: DataFrame, files: DataFrame) -> DataFrame:
    """sample, repo_key, path, symbol: the share of the query's identifiers that a file defines or imports, where it has any.

    asked: sample, repo_key, ids; files: repo_key, path, symbols (arrays). An equi-join on the identifier, not of all files.
    """
    wanted = asked.select("sample", "repo_key", F.size(F.array_distinct("ids")).alias("n"), F.explode(F.array_distinct("ids")).alias("id"))
    held = files.select("repo_key", "path", F.explode(F.array_distinct("symbols")).alias("id"))
    return held.join(few(wanted), ["repo_key", "id"]).groupBy("sample", "repo_key", "path").agg((F.count("*") / F.first("n")).alias("symbol"))


def scored(bm25: DataFrame, graph: DataFrame, symbols: DataFrame, neighbours: DataFrame, weights: tuple[float, float, float] = (0.55, 0.30, 0.15), boost: float = NEIGHBOUR_BOOST) -> DataFrame:
    """sample, repo_key, path, bm25_norm, graph_symbol, final of every file that has one of the scores.

    Each input has sample, repo_key, path; bm25 also bm25_norm, graph also graph, symbols also symbol; neighbours are the files that
    the completion file imports. The inputs are laid one below the other and added up by file: one shuffle, however many there are.
    """
    zero = F.lit(0.0)

    def rows(df: DataFrame, **column) -> DataFrame:
        return df.select("sample", "repo_key", "path", *(column.get(n, zero).alias(n) for n in ("b", "g", "s", "n")))

    every = rows(bm25, b=F.col("bm25_norm")).union(rows(graph, g=F.col("graph"))).union(rows(symbols, s=F.col("symbol"))).union(rows(neighbours, n=F.lit(boost)))
    added = every.groupBy("sample", "repo_key", "path").agg(*(F.max(n).alias(n) if n == "n" else F.sum(n).alias(n) for n in ("b", "g", "s", "n")))
    final = weights[0] * F.col("b") + weights[1] * F.col("g") + weights[2] * F.col("s") + F.col("n")
    return added.select("sample", "repo_key", "path", F.col("b").alias("bm25_norm"), F.round(F.col("g") + F.col("s"), 6).alias("graph_symbol"), F.round(final, 6).alias("final"))


def of_corpus(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """found without files that the lexical index leaves out (too few lines): these are graph nodes but are not ranked."""
    return found.join(corpus.select("repo_key", "path"), ["repo_key", "path"], "left_semi")
