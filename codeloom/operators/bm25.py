"""BM25 over repositories: statistics by repository, scores of files for queries, normalised by the query's maximum.

An index is a frame of repo_key, path, terms (the file's words in order, with repeats). It is read twice: once for the statistics,
where terms are counted before they are shuffled, and once for the query terms' occurrences, where all other terms are dropped
before anything is shuffled. Where words are dear to find, write the index first (tables.written).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import tokenize
from codeloom.operators.tables import few, written

K1, B, EPSILON = 1.5, 0.75, 0.25


def index(corpus: DataFrame) -> DataFrame:
    """repo_key, path, terms of a corpus (repo_key, path, content)."""
    return corpus.select("repo_key", "path", tokenize(F.col("content")).alias("terms"))


def term_stats(held: DataFrame) -> DataFrame:
    """repo_key, term, df, idf, avgdl of an index; a negative idf becomes EPSILON times the mean of all.

    One pass, written: each file gives its distinct terms, and a row without a term that carries its length.
    """
    rows = held.select("repo_key", F.size("terms").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("terms"))).alias("term"))
    counted = written(rows.groupBy("repo_key", "term").agg(F.count("*").alias("df"), F.sum("dl").alias("length")), "terms")
    # the row without a term has the number of files and their length; one row a repository meets its terms without a shuffle
    n = few(counted.where("term is null").select("repo_key", F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl")))
    raw = counted.where("term is not null").drop("length").join(n, "repo_key").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = few(raw.groupBy("repo_key").agg(F.avg("raw").alias("mean")))
    return raw.join(mean, "repo_key").select("repo_key", "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")


def asked_terms(queries: DataFrame) -> DataFrame:
    """sample, repo_key, term, qf of queries (sample, repo_key, query)."""
    return queries.select("sample", "repo_key", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("sample", "repo_key", "term").agg(F.count("*").alias("qf"))


def hits(held: DataFrame, queries: DataFrame) -> DataFrame:
    """sample, repo_key, path, bm25 of the files of an index that hold a term of the query."""
    asked = asked_terms(queries)
    terms = few(asked.select("repo_key", "term").distinct())
    weighed = asked.join(term_stats(held).join(terms, ["repo_key", "term"], "left_semi"), ["repo_key", "term"])
    words = held.select("repo_key", "path", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    found = words.join(terms, ["repo_key", "term"], "left_semi").groupBy("repo_key", "path", "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.join(weighed, ["repo_key", "term"]).groupBy("sample", "repo_key", "path").agg(F.round(F.sum(part), 6).alias("bm25"))


def normalised(found: DataFrame) -> DataFrame:
    """Adds bm25_norm, the share of the query's best score (files without a term score 0, so a best below 0 does not count)."""
    top = found.groupBy("sample", "repo_key").agg(F.max("bm25").alias("top"))
    return found.join(top, ["sample", "repo_key"]).withColumn("bm25_norm", F.round(F.col("bm25") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0), 6)).drop("top")


def every_file(found: DataFrame, held: DataFrame, queries: DataFrame) -> DataFrame:
    """found with every file of each query's repository; scores that are missing become 0. As many rows as files times queries: for
    the best few use best()."""
    every = held.select("repo_key", "path").join(queries.select("sample", "repo_key"), "repo_key")
    return every.join(found, ["sample", "repo_key", "path"], "left").na.fill(0.0)


def scores(held: DataFrame, queries: DataFrame) -> DataFrame:
    """sample, repo_key, path, bm25, bm25_norm for every file of a query's repository; queries: sample, repo_key, query."""
    return every_file(normalised(hits(held, queries)), held, queries).select("sample", "repo_key", "path", "bm25", "bm25_norm")


def top_k(scored: DataFrame, k: int, by: str = "bm25_norm") -> DataFrame:
    """The k best of each query, rank from 0, ties by path. Spark limits each task to k a query before it shuffles."""
    w = Window.partitionBy("sample", "repo_key").orderBy(F.desc(by), "path")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("long"))


def best(found: DataFrame, held: DataFrame, queries: DataFrame, k: int, by: str = "bm25_norm") -> DataFrame:
    """top_k of every_file, without making a row for every file: where k files score above 0 no other can be among the best. The
    rest of the queries, with fewer, are held against every file. found is written once, as it is read for either."""
    found = written(found, "found")
    above = written(top_k(found.where(F.col(by) > 0), k, by), "above")
    full = above.where(F.col("rank") == k - 1).select("sample", "repo_key")
    rest = queries.select("sample", "repo_key").join(full, ["sample", "repo_key"], "left_anti")
    if rest.isEmpty():
        return above
    others = top_k(every_file(found.join(rest, ["sample", "repo_key"], "left_semi"), held, rest), k, by)
    return above.join(full, ["sample", "repo_key"], "left_semi").unionByName(others)
