"""Packing ranked files into a character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import file_chunk


def without_own(ranked: DataFrame, own: str) -> DataFrame:
    """ranked without the completion files themselves, and without the column that names them."""
    return ranked.where(F.col(own).isNull() | (F.col("path") != F.col(own))).drop(own)


def included(ranked: DataFrame, max_files: int, budget: int, least: int = 512) -> DataFrame:
    """ranked: sample, rank, path, content (the completion file left out). Adds chunk, cut to what remains, and included: a file
    comes in while files and budget last; one that overflows is cut if at least `least` characters remain."""
    w = Window.partitionBy("sample").orderBy("rank")
    whole = ranked.withColumn("chunk", file_chunk(F.col("path"), F.col("content")))
    placed = whole.withColumn("before", F.coalesce(F.sum(F.length("chunk")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("i", F.row_number().over(w) - 1)
    fits = (F.col("i") < max_files) & ((F.col("before") + F.length("chunk") <= budget) | (budget - F.col("before") >= least))
    return placed.withColumn("included", fits).withColumn("chunk", F.when(fits, F.substring("chunk", F.lit(1), F.lit(budget) - F.col("before"))))


def assemble(packed: DataFrame) -> DataFrame:
    """sample, context."""
    parts = F.array_sort(F.collect_list(F.when(F.col("included"), F.struct("rank", "chunk"))))
    return packed.groupBy("sample").agg(F.array_join(F.transform(parts, lambda x: x["chunk"]), "").alias("context"))
