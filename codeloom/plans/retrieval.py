"""From repositories and completion points to ranked files, contexts, score records and predictions.

All points of all repositories go through one plan: nothing loops over samples, and a repository or file that is missing or does
not parse leaves its point with an empty context instead of failing the run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths, text
from codeloom.functions.syntax import ast_metadata
from codeloom.operators import baselines, bm25, context, graph, hybrid
from codeloom.operators.tables import written
from codeloom.plans.config import CHARS_PER_TOKEN

TOP = 25


@dataclass
class Index:
    """Written tables; files: repo_key, path, module, content, line_count, symbols, names, terms, parse_error; edges: repo_key,
    src, dst."""

    files: DataFrame
    edges: DataFrame

    def corpus(self, min_lines: int) -> DataFrame:
        """The lexical index: files of min_lines lines or more. The graph and the symbols know all files."""
        return self.files.where(F.col("line_count") >= min_lines).select("repo_key", "path", "terms")


def build(files: DataFrame) -> Index:
    """files: repo_key, path, content, line_count, as the repository source reads them. Each file is parsed and tokenised once."""
    known = files.select("repo_key", "path", paths.module_name(F.col("path")).alias("module"), "content", "line_count", ast_metadata("content").alias("m"))
    known = known.select("repo_key", "path", "module", "content", "line_count", F.col("m.symbols").alias("symbols"), F.array_union("m.symbols", F.map_keys("m.aliases")).alias("names"), F.col("m.imports").alias("imports"), F.col("m.parse_error").alias("parse_error"))
    known = written(known.withColumn("terms", text.tokenize(text.enriched_text(F.col("content"), F.col("symbols")))), "files")
    each = known.select("repo_key", F.col("path").alias("src"), F.col("module").alias("here"), F.explode("imports").alias("i"))
    base = F.when(F.col("i.kind") == "import", F.col("i.module")).otherwise(paths.resolve_relative(F.col("here"), F.col("i.module"), F.col("i.level")))
    asked = each.select("repo_key", "src", F.explode(paths.import_candidates(F.col("i.kind"), base, F.col("i.name"))).alias("candidate")).where("candidate <> ''")
    edges = graph.import_edges(asked, graph.module_map(known.select("repo_key", "module", "path")))
    return Index(known.drop("imports"), written(edges, "edges"))


def retrieve(index: Index, points: DataFrame, settings: dict, k: int = TOP) -> DataFrame:
    """sample, repo_key, path, bm25_norm, graph_symbol, final, rank of the k best files of each point; points: sample, repo_key,
    own (the completion file), prefix, suffix."""
    held = index.corpus(settings["context.min_lines"])
    queries = points.select("sample", "repo_key", text.query_text(F.col("prefix"), F.col("suffix")).alias("query"))
    walked = graph.graph_scores(index.edges, points.select("repo_key", F.col("own").alias("start")).distinct(), settings["retrieval.graph.max_hop"], settings.get("retrieval.graph.hop_decay", 0.65), settings.get("retrieval.graph.reverse_import_weight", 0.35))
    mine = points.select("sample", "repo_key", "own")
    near = mine.join(index.edges.withColumnRenamed("src", "own"), ["repo_key", "own"]).select("sample", "repo_key", F.col("dst").alias("path"))
    walked = mine.join(walked.withColumnRenamed("start", "own"), ["repo_key", "own"]).select("sample", "repo_key", F.col("node").alias("path"), F.col("score").alias("graph"))
    asked = queries.select("sample", "repo_key", text.query_identifiers(F.col("query")).alias("ids"))
    symbols = hybrid.symbol_scores(asked, index.files.select("repo_key", "path", F.col("names").alias("symbols")))
    weights = tuple(settings[f"retrieval.scoring.{n}_weight"] for n in ("bm25", "graph", "symbol"))
    found = hybrid.of_corpus(hybrid.scored(bm25.normalised(bm25.hits(held, queries)), walked, symbols, near, weights), held)
    return bm25.best(found, held, queries, k, "final")


def packed(index: Index, ranked: DataFrame, points: DataFrame, settings: dict) -> DataFrame:
    """ranked without the completion files, with chunk and included."""
    mine = context.without_own(ranked.join(points.select("sample", "own"), "sample"), "own")
    whole = mine.join(index.files.select("repo_key", "path", "content"), ["repo_key", "path"])
    return context.included(whole, settings["context.max_files"], settings["context.max_tokens"] * CHARS_PER_TOKEN)


def score_records(ranked: DataFrame, pack: DataFrame, points: DataFrame) -> DataFrame:
    """One row for each retrieved file, as the run store keeps them (without run_id)."""
    every = ranked.join(points.select("sample", "repo", "own"), "sample").join(pack.select("sample", "path", "included"), ["sample", "path"], "left")
    return every.select(F.concat(F.lit("sample_"), F.col("sample").cast("string")).alias("sample_id"), "repo", F.col("own").alias("completion_file"), F.col("path").alias("retrieved_file"), "rank", F.col("bm25_norm").alias("bm25_score"), F.col("graph_symbol").alias("graph_score"), F.col("final").alias("combined_score"), F.coalesce("included", F.lit(False)).alias("included_in_context"))


def find_context(files: DataFrame, points: DataFrame, settings: dict) -> tuple[DataFrame, DataFrame]:
    """(sample, context) of every point, empty where nothing is found, and the score records."""
    index = build(files)
    ranked = written(retrieve(index, points, settings), "ranked")
    pack = packed(index, ranked, points, settings)
    made = points.select("sample").join(context.assemble(pack), "sample", "left").na.fill("", ["context"])
    return made, score_records(ranked, pack.drop("chunk", "content"), points)


def predictions(points: DataFrame, contexts: DataFrame, settings: dict) -> DataFrame:
    """sample, context, and prefix and suffix where they are trimmed (null: the key is absent)."""
    n, none = settings["trim.trim_lines"], F.lit(None).cast("string")
    prefix = text.trim_lines(F.coalesce("prefix", F.lit("")), n, True) if settings["trim.prefix"] else none
    suffix = text.trim_lines(F.coalesce("suffix", F.lit("")), n, False) if settings["trim.suffix"] else none
    return points.join(contexts, "sample", "left").select("sample", F.coalesce("context", F.lit("")).alias("context"), prefix.alias("prefix"), suffix.alias("suffix"))


def baseline(files: DataFrame, points: DataFrame, strategy: str, seed: str = "0", trim_prefix: bool = False, trim_suffix: bool = False) -> DataFrame:
    """Predictions of a single-file strategy: random, bm25 or recent (points then have modified). Files that are no strict UTF-8 or
    have fewer than MIN_LINES lines are not chosen; a repository without any gives an empty context."""
    chosen = files.where(F.col("strict_utf8") & (F.col("readline_count") >= baselines.MIN_LINES))
    if strategy == "random":
        found = points.select("sample", "repo_key").join(baselines.random_file(chosen, seed), "repo_key")
    elif strategy == "recent":
        found = baselines.recent_file(chosen, points.select("sample", "repo_key", "modified"), seed)
    elif strategy == "bm25":
        held = written(bm25.index(chosen), "index")
        queries = points.select("sample", "repo_key", F.concat_ws(" ", "prefix", "suffix").alias("query"))
        found = bm25.best(bm25.normalised(bm25.hits(held, queries)), held, queries, 1)
    else:
        raise ValueError(f"no such strategy: {strategy}")
    contexts = found.select("sample", "repo_key", "path").join(files.select("repo_key", "path", "content"), ["repo_key", "path"])
    contexts = contexts.select("sample", text.file_chunk(F.col("path"), F.col("content"), False).alias("context"))
    none = F.lit(None).cast("string")
    prefix = text.trim_lines_always(F.col("prefix"), 10, True) if trim_prefix else none
    suffix = text.trim_lines_always(F.col("suffix"), 10, False) if trim_suffix else none
    return points.join(contexts, "sample", "left").select("sample", F.coalesce("context", F.lit("")).alias("context"), prefix.alias("prefix"), suffix.alias("suffix"))
