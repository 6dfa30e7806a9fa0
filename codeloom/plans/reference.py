"""Queries over the driver's tables for the retrieval, evaluation and store operators, with the same in SQL.

Files are the documents (repository = language); completion points are benchmark texts whose item_id is divisible by 20, asked in
every repository; edges join parts on neighbouring lines of an order; runs are the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import paths, text
from codeloom.functions.syntax import ast_metadata as ast_of
from codeloom.operators import baselines, bm25, context, evaluation, graph, hybrid, store
from codeloom.operators.chrf import chrf as chrf_of
from codeloom.operators.tables import few, spread, written
from codeloom.plans import config

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("lang").alias("repo_key"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content")))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    return items.crossJoin(few(table(spark, sf_dir, "documents").select("lang").distinct())).select(F.col("item_id").alias("sample"), F.col("lang").alias("repo_key"), F.col("text").alias("query"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("lang"), (F.col("o_custkey") % 4).alias("retrieval_name"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("chrf"), F.lit("completed").alias("status"))


RUNS = "runs AS (SELECT o_orderkey AS run_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, o_orderstatus AS stage, o_orderpriority AS lang, o_custkey % 4 AS retrieval_name, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS chrf, 'completed' AS status FROM orders)"
FILES = "files AS (SELECT lang AS repo_key, 'doc_' || doc_id || '.py' AS path, text AS content FROM documents)"
TOKENS = r"[x FOR x IN regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+') IF x <> '']"
_LINES = "len(string_split(regexp_replace(content, '\\n$', ''), chr(10)))"
BM25 = f"""{FILES}, corpus AS (SELECT * FROM files), asked AS (SELECT item_id AS sample, lang AS repo_key, text AS query FROM benchmark, (SELECT DISTINCT lang FROM documents) WHERE item_id % 20 = 0),
occ AS (SELECT repo_key, path, unnest({TOKENS.format('content')}) AS term FROM corpus),
post AS (SELECT repo_key, path, term, count(*) AS tf FROM occ GROUP BY ALL),
dl AS (SELECT repo_key, path, len({TOKENS.format('content')}) AS dl FROM corpus),
nn AS (SELECT repo_key, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY repo_key),
dfs AS (SELECT repo_key, term, count(*) AS df FROM post GROUP BY ALL),
raws AS (SELECT repo_key, term, df, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs JOIN nn USING (repo_key)),
means AS (SELECT repo_key, avg(raw) AS mean FROM raws GROUP BY repo_key),
stats AS (SELECT repo_key, term, df, avgdl, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raws JOIN means USING (repo_key)),
qocc AS (SELECT sample, repo_key, unnest({TOKENS.format('query')}) AS term FROM asked),
qf AS (SELECT sample, repo_key, term, count(*) AS qf FROM qocc GROUP BY ALL),
hit AS (SELECT sample, repo_key, path, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM post JOIN qf USING (repo_key, term) JOIN stats USING (repo_key, term) JOIN dl USING (repo_key, path) GROUP BY ALL),
every AS (SELECT sample, repo_key, path, round(coalesce(s, 0), 6) AS bm25 FROM dl JOIN (SELECT sample, repo_key FROM asked) USING (repo_key) LEFT JOIN hit USING (sample, repo_key, path)),
tops AS (SELECT sample, repo_key, max(bm25) AS top FROM every GROUP BY ALL),
scored AS (SELECT sample, repo_key, path, bm25, round(bm25 / CASE WHEN top > 0 THEN top ELSE 1 END, 6) AS bm25_norm FROM every JOIN tops USING (sample, repo_key)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample, repo_key ORDER BY bm25_norm DESC, path) - 1 AS rank FROM scored)"""
#: Files of 10 lines or more, as the single-file strategies see them.
LONG_BM25 = BM25.replace("corpus AS (SELECT * FROM files)", f"corpus AS (SELECT * FROM files WHERE {_LINES} >= 10)")


@query(f"WITH {FILES} SELECT path, array_to_string({TOKENS.format('content')}, ' ') AS tokens FROM files")
def tokenize(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.array_join(text.tokenize(F.col("content")), " ").alias("tokens"))


_STOP = ", ".join(f"'{x}'" for x in sorted({*text.KEYWORDS, *text.TYPE_NAMES}))


_IDS = "list_sort([x FOR x IN list_distinct(regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]*')) IF x NOT IN (" + _STOP + ") AND length(x) > 1])"


@query(f"WITH {FILES} SELECT path, array_to_string({_IDS.format('content')}, ' ') AS ids FROM files")
def query_identifiers(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.array_join(text.query_identifiers(F.col("content")), " ").alias("ids"))


@query(f"WITH {FILES} SELECT path, md5(content || chr(10) || array_to_string({_IDS.format('content')}, ' ')) AS enriched_md5 FROM files")
def enriched_text(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.md5(text.enriched_text(F.col("content"), text.query_identifiers(F.col("content")))).alias("enriched_md5"))


@query(f"WITH {FILES} SELECT path, len(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS line_count FROM files")
def line_count(spark, sf_dir):
    return files(spark, sf_dir).select("path", text.line_count(F.col("content")).cast("long").alias("line_count"))


@query(f"WITH {FILES} SELECT path FROM files WHERE len(string_split(regexp_replace(content, '\\n$', ''), chr(10))) >= 5")
def min_lines(spark, sf_dir):
    return files(spark, sf_dir).where(text.line_count(F.col("content")) >= 5).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE path LIKE '%.py'")
def ext_filter(spark, sf_dir):
    return files(spark, sf_dir).where(paths.has_extension(F.col("path"), ".py")).select("path")


@query("SELECT doc_id, replace(source || '/' || lang, '/', '__') || '-' || doc_id AS repo_key FROM documents")
def repo_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.repo_key(F.concat_ws("/", "source", "lang"), F.col("doc_id").cast("string")).alias("repo_key"))


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN lang || '/' || doc_id ELSE source || '/' || lang || '/' || doc_id END AS path FROM documents")
def normalize_path(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.normalize_path("src1", F.concat_ws("\\", "source", "lang", F.col("doc_id").cast("string"))).alias("path"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN r_name || '.' || n_name ELSE r_name || '.' || n_name || '.' || c_name END AS module FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def module_name(spark, sf_dir):
    c = _customers(spark, sf_dir)
    path = F.concat_ws("/", "r_name", "n_name", F.when(F.col("c_custkey") % 3 == 0, "__init__.py").otherwise(F.concat("c_name", F.lit(".py"))))
    return c.select("c_custkey", paths.module_name(path).alias("module"))


def _customers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN r_name || '.' || n_name || '.x' WHEN 2 THEN r_name || '.x' ELSE 'x' END AS module FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def resolve_relative(spark, sf_dir):
    c = _customers(spark, sf_dir)
    return c.select("c_custkey", paths.resolve_relative(F.concat_ws(".", "r_name", "n_name", "c_name"), F.lit("x"), (F.col("c_custkey") % 4).cast("int")).alias("module"))


_IMPORTS = "imports AS (SELECT c_custkey AS src, CASE c_custkey % 3 WHEN 0 THEN [r_name] WHEN 1 THEN [r_name || '.' || n_name, r_name] ELSE [n_name] END AS candidates FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _imports(spark, sf_dir):
    kind = F.when(F.col("c_custkey") % 3 == 0, "import").otherwise("from")
    base = F.when(F.col("c_custkey") % 3 == 2, "").otherwise(F.col("r_name"))
    return _customers(spark, sf_dir).select(F.col("c_custkey").alias("src"), paths.import_candidates(kind, base, F.col("n_name")).alias("candidates"))


@query(f"WITH {_IMPORTS} SELECT src, array_to_string(candidates, ' ') AS candidates FROM imports")
def import_candidates(spark, sf_dir):
    return _imports(spark, sf_dir).select("src", F.array_join("candidates", " ").alias("candidates"))


@query("SELECT s_nationkey AS module, max(s_suppkey) AS path FROM supplier GROUP BY s_nationkey")
def module_map(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit("r").alias("repo_key"), F.col("s_nationkey").alias("module"), F.col("s_suppkey").alias("path"))
    return graph.module_map(s.withColumn("module", F.col("module").cast("string"))).select(F.col("module").cast("int").alias("module"), "path")


@query(f"""WITH {_IMPORTS}, cand AS (SELECT DISTINCT src, unnest(candidates) AS candidate FROM imports), modules AS (SELECT n_nationkey AS path, r_name || '.' || n_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey),
hit AS (SELECT src, path AS dst FROM cand JOIN modules ON candidate = module UNION SELECT src, path FROM cand JOIN modules ON starts_with(module, candidate || '.') WHERE candidate NOT IN (SELECT module FROM modules))
SELECT src, dst FROM hit WHERE src <> dst""")
def import_edges(spark, sf_dir):
    asked_for = _imports(spark, sf_dir).select(F.lit("r").alias("repo_key"), "src", F.explode("candidates").alias("candidate"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    modules = n.select(F.lit("r").alias("repo_key"), F.concat_ws(".", "r_name", "n_name").alias("module"), F.col("n_nationkey").cast("long").alias("path"))
    return graph.import_edges(asked_for, modules).select("src", "dst")


_EDGES = "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"


def _neighbours(line: DataFrame) -> DataFrame:
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    b = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select(F.lit("r").alias("repo_key"), "src", "dst").distinct()


@query(f"""WITH {_EDGES}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), start AS (SELECT p_partkey AS s FROM part WHERE p_partkey % 20 = 0),
seen AS (SELECT s, s AS node, 0 AS hop FROM start UNION ALL SELECT DISTINCT s, dst, 1 FROM start JOIN both_ways ON src = s WHERE dst <> s),
w AS (SELECT s, dst AS node, power(0.65, hop) AS w FROM seen JOIN edges ON src = node UNION ALL SELECT s, src, power(0.65, hop) * 0.35 FROM seen JOIN edges ON dst = node)
SELECT s AS start, node, round(max(w), 6) AS score FROM w WHERE s <> node GROUP BY s, node""")
def graph_scores(spark, sf_dir):
    starts = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.lit("r").alias("repo_key"), F.col("p_partkey").alias("start"))
    return graph.graph_scores(_neighbours(table(spark, sf_dir, "lineitem")), starts).drop("repo_key")


@query(f"WITH {BM25} SELECT repo_key, term, df, round(idf, 6) AS idf FROM stats")
def bm25_stats(spark, sf_dir):
    return bm25.term_stats(bm25.index(files(spark, sf_dir))).select("repo_key", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT sample, repo_key, path, bm25, bm25_norm FROM scored")
def bm25_scores(spark, sf_dir):
    return bm25.scores(written(bm25.index(files(spark, sf_dir)), "index"), asked(spark, sf_dir))


def _best(spark, sf_dir, k, least=0):
    corpus, points = files(spark, sf_dir), asked(spark, sf_dir)
    corpus = corpus.where(text.readline_count(F.col("content")) >= least) if least else corpus
    held = written(bm25.index(corpus), "index")
    return bm25.best(bm25.normalised(bm25.hits(held, points)), held, points, k)


@query(f"WITH {BM25} SELECT sample, repo_key, path, bm25_norm, rank FROM ranked WHERE rank < 25")
def bm25_topk(spark, sf_dir):
    return _best(spark, sf_dir, 25).select("sample", "repo_key", "path", "bm25_norm", "rank")


@query(f"WITH {LONG_BM25} SELECT sample, repo_key, path FROM ranked WHERE rank = 0")
def baseline_bm25(spark, sf_dir):
    return _best(spark, sf_dir, 1, baselines.MIN_LINES).select("sample", "repo_key", "path")


@query(f"""WITH {BM25}, chunks AS (SELECT sample || '-' || repo_key AS sample, rank, '<|file_sep|>' || path || chr(10) || content || chr(10) AS chunk FROM ranked JOIN files USING (repo_key, path) WHERE rank < 25 AND path <> 'doc_' || sample || '.py'),
placed AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY rank) AS i, coalesce(sum(length(chunk)) OVER (PARTITION BY sample ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks)
SELECT sample, md5(string_agg(substr(chunk, 1, CAST(32000 - before AS BIGINT)), '' ORDER BY rank)) AS context_md5 FROM placed WHERE i <= 6 AND (before + length(chunk) <= 32000 OR 32000 - before >= 512) GROUP BY sample""")
def assemble_context(spark, sf_dir):
    own = F.concat(F.lit("doc_"), F.col("sample").cast("string"), F.lit(".py"))
    ranked = context.without_own(_best(spark, sf_dir, 25).withColumn("own", own), "own").join(files(spark, sf_dir), ["repo_key", "path"])
    packed = context.included(ranked.withColumn("sample", F.concat_ws("-", F.col("sample").cast("string"), "repo_key")), 6, 32000)
    return context.assemble(packed).select("sample", F.md5("context").alias("context_md5"))


@query("SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 3 THEN array_to_string(list_slice(string_split(text, chr(10)), -3, -1), chr(10)) END AS last_lines, CASE WHEN len(string_split(text, chr(10))) > 3 THEN array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) END AS first_lines FROM documents")
def trim_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.trim_lines(F.col("text"), 3, True).alias("last_lines"), text.trim_lines(F.col("text"), 3, False).alias("first_lines"))


@query("SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 10 THEN array_to_string(list_slice(string_split(text, chr(10)), -10, -1), chr(10)) ELSE text END AS last_lines FROM documents")
def trim_lines_baseline(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.trim_lines_always(F.col("text"), 10, True).alias("last_lines"))


@query("SELECT item_id, left(text, length(text) // 2) || chr(10) || substr(text, length(text) // 2 + 1) AS query FROM benchmark")
def query_text(spark, sf_dir):
    half = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "benchmark").select("item_id", text.query_text(F.substring("text", F.lit(1), half), F.substr("text", half + 1)).alias("query"))


@query("SELECT doc_id, left('<|file_sep|>' || source || chr(10) || text, 80) AS snippet FROM documents")
def context_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(text.file_chunk(F.col("source"), F.col("text"), False)).alias("snippet"))


@query("""SELECT p_partkey, list_sort(['C' || p_partkey, 'V' || p_size, 'run' || p_partkey % 3, 'x' || p_partkey % 4])::VARCHAR AS symbols, 'm' || p_partkey || ':pkg' || p_partkey % 7 || '.mod,f' || p_partkey % 5 || ':util.f' || ',os:os.path' AS aliases, 4 AS n_imports, CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS n_errors FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT p_partkey, '[]', '', 0, 1 FROM part WHERE p_partkey % 10 = 0""")
def ast_metadata(spark, sf_dir):
    """Of a small module made of each part; every tenth does not parse."""
    p, i = table(spark, sf_dir, "part").select("p_partkey", "p_size"), lambda c: F.col(c).cast("string")
    k = F.col("p_partkey")
    lines = (F.concat(F.lit("import pkg"), (k % 7).cast("string"), F.lit(".mod as m"), i("p_partkey")), F.concat(F.lit("from .util import f as f"), (k % 5).cast("string")), F.lit("import os, os.path"), F.concat(F.lit("class C"), i("p_partkey"), F.when(k % 10 == 0, F.lit(" oops")).otherwise(F.lit(":"))), F.concat(F.lit("    def run"), (k % 3).cast("string"), F.lit("(self):")), F.concat(F.lit("        x"), (k % 4).cast("string"), F.lit(", self.y = 1, 2")), F.concat(F.lit("        x"), (k % 4).cast("string"), F.lit(" = 3")), F.concat(F.lit("V"), i("p_size"), F.lit(": int = 0")))
    m = p.select("p_partkey", F.col("p_size"), ast_of(F.concat_ws("\n", *lines)).alias("m"))
    named = F.array(F.concat(F.lit("m"), i("p_partkey")), F.concat(F.lit("f"), (k % 5).cast("string")), F.lit("os"))
    # os and os.path bind one name; the later import wins
    aliases = F.array_join(F.transform(named, lambda n: F.concat(n, F.lit(":"), F.element_at("m.aliases", n))), ",")
    return m.select("p_partkey", F.concat(F.lit("["), F.array_join("m.symbols", ", "), F.lit("]")).alias("symbols"), F.when(F.col("m.parse_error").isNull(), aliases).otherwise("").alias("aliases"), F.size("m.imports").cast("int").alias("n_imports"), F.col("m.parse_error").isNotNull().cast("int").alias("n_errors"))


@query("SELECT doc_id, '<|file_sep|>' || source || chr(10) || text AS context FROM documents")
def baseline_context(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.file_chunk(F.col("source"), F.col("text"), False).alias("context"))


@query("""WITH t AS (SELECT doc_id, '<filename>' || text AS ctx, '<fim_suffix>' || lang || '<fim_prefix>' || source || '<fim_middle>' AS tail FROM documents), u AS (SELECT *, 8014.0::DOUBLE - length(tail) / 2.2::DOUBLE AS room FROM t)
SELECT doc_id, md5(CASE WHEN length(tail) / 2.2::DOUBLE + length(ctx) / 2.2::DOUBLE <= 8014 THEN ctx WHEN room > 0 THEN right(ctx, CAST(trunc(room * 2.2::DOUBLE) AS BIGINT)) ELSE '' END || tail) AS prompt_md5 FROM u""")
def fim_prompt(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.fim_prompt(F.col("source"), F.col("lang"), F.concat(F.lit(text.FILE_MARK), "text"))).alias("prompt_md5"))


@query("SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || lang ELSE left(text, 40) END) AS cut_md5 FROM documents WHERE text NOT LIKE '%<|endoftext|>%' AND text NOT LIKE '%<f%' UNION ALL SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN cut WHEN 1 THEN CASE WHEN cut = text THEN text || lang ELSE cut END ELSE CASE WHEN length(cut) < 40 THEN cut ELSE left(text, 40) END END) FROM (SELECT *, regexp_extract(text, '(?s)^(.*?)(<fim_prefix>|<fim_suffix>|<fim_middle>|<filename>|<[|]endoftext[|]>|$)', 1) AS cut FROM documents WHERE text LIKE '%<|endoftext|>%' OR text LIKE '%<f%')")
def stop_cut(spark, sf_dir):
    """Marks after the text, after the text and the language, and inside the text; and whatever marks the texts hold."""
    end = [F.lit(m) for m in ("<fim_middle>", "<|endoftext|>", "<filename>")]
    body = F.when(F.col("doc_id") % 3 == 0, F.concat("text", end[0], "lang")).when(F.col("doc_id") % 3 == 1, F.concat("text", "lang", end[1], "source")).otherwise(F.concat(F.left("text", F.lit(40)), end[2], "text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.stop_cut(body)).alias("cut_md5"))


_GRAMS = " UNION ALL ".join(f"SELECT id, {n} AS n, unnest([substr(t, i, {n}) FOR i IN range(1, length(t) - {n - 2})]) AS gram FROM {{0}} WHERE length(t) >= {n}" for n in range(1, 7))


CHRF = f"""WITH p AS (SELECT conv_id * 100000 + turn AS id, text AS ref, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM conversations), q AS (SELECT * FROM p WHERE hyp IS NOT NULL),
rt AS (SELECT id, regexp_replace(ref, '\\s+', '', 'g') AS t FROM q), ht AS (SELECT id, regexp_replace(hyp, '\\s+', '', 'g') AS t FROM q),
rg AS (SELECT id, n, gram, count(*) AS r FROM ({_GRAMS.format('rt')}) GROUP BY ALL), hg AS (SELECT id, n, gram, count(*) AS h FROM ({_GRAMS.format('ht')}) GROUP BY ALL),
s AS (SELECT id, n, sum(least(coalesce(r, 0), coalesce(h, 0))) AS m, sum(r) AS rs, sum(h) AS hs FROM rg FULL JOIN hg USING (id, n, gram) GROUP BY id, n HAVING sum(r) > 0 AND sum(h) > 0),
a AS (SELECT id, avg(m / hs) AS p, avg(m / rs) AS q FROM s GROUP BY id)
SELECT id, round(coalesce(CASE WHEN 4 * a.p + a.q > 0 THEN 5 * a.p * a.q / (4 * a.p + a.q) ELSE 0 END, 0), 4) AS chrf FROM q LEFT JOIN a USING (id)"""


@query(CHRF)
def chrf(spark, sf_dir):
    return chrf_of(_turns(spark, sf_dir))


@query(f"SELECT round(avg(chrf), 4) AS mean_chrf, count(*) AS num_samples FROM ({CHRF})")
def eval_summary(spark, sf_dir):
    return evaluation.summary(chrf_of(_turns(spark, sf_dir)))


def _turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("hyp", F.lead("text").over(w)).where("hyp is not null")
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.col("text").alias("ref"), "hyp")


@query(f"WITH {RUNS} SELECT * FROM runs")
def runs_all(spark, sf_dir):
    return store.filtered(runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT * FROM runs WHERE stage = 'O' AND lang = '1-URGENT'")
def runs_filtered(spark, sf_dir):
    return store.filtered(runs(spark, sf_dir), stage="O", lang="1-URGENT", retrieval_name="")


@query(f"WITH {RUNS} SELECT * FROM runs WHERE run_id = 7")
def run_by_id(spark, sf_dir):
    return store.by_id(runs(spark, sf_dir), 7)


@query(f"WITH {RUNS} SELECT * FROM runs WHERE chrf IS NULL AND status = 'completed'")
def runs_pending(spark, sf_dir):
    return store.pending(runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT * FROM runs WHERE chrf IS NOT NULL ORDER BY chrf DESC, run_id LIMIT 10")
def runs_best(spark, sf_dir):
    return store.best(runs(spark, sf_dir), "chrf", 10)


@query(f"WITH {RUNS} SELECT count(*) AS total, count(chrf) AS evaluated FROM runs")
def runs_summary(spark, sf_dir):
    return store.summary(runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT retrieval_name, count(*) AS n, round(avg(chrf), 4) AS avg_chrf FROM runs GROUP BY ALL")
def runs_by_retrieval(spark, sf_dir):
    return store.by_retrieval(runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT stage, lang, count(*) AS n FROM runs GROUP BY ALL")
def runs_by_data(spark, sf_dir):
    return store.by_data(runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT run_id, ts, CASE WHEN run_id % 5 = 0 THEN 'new' ELSE stage END AS stage, lang, retrieval_name, chrf, status FROM runs")
def runs_upsert(spark, sf_dir):
    old = runs(spark, sf_dir)
    new = old.where("run_id % 5 = 0").withColumn("stage", F.lit("new")).withColumn("chrf", F.lit(None).cast("double"))
    return store.upsert(old, new)


@query(f"WITH {RUNS} SELECT * REPLACE (CASE WHEN run_id = 7 THEN 0.5 ELSE chrf END AS chrf) FROM runs")
def runs_update_metrics(spark, sf_dir):
    return store.update_metrics(runs(spark, sf_dir), 7, chrf=0.5)


@query(f"WITH {RUNS} SELECT * FROM runs WHERE run_id <> 7")
def runs_delete(spark, sf_dir):
    return store.delete(runs(spark, sf_dir), 7)


@query(f"WITH {RUNS} SELECT run_id, ts, stage, lang, retrieval_name, CAST(NULL AS DOUBLE) AS chrf, CAST(NULL AS VARCHAR) AS status FROM runs")
def runs_migrate(spark, sf_dir):
    new = runs(spark, sf_dir)
    return store.migrate(new.drop("chrf", "status"), new)


@query(f"WITH {RUNS} SELECT run_id, chrf FROM runs WHERE chrf IS NOT NULL ORDER BY ts DESC, run_id LIMIT 1")
def latest_metric(spark, sf_dir):
    return store.filtered(runs(spark, sf_dir).where("chrf is not null"), limit=1).select("run_id", "chrf")


@query("SELECT l_orderkey AS run_id, l_returnflag AS sample_id, l_partkey AS path, l_linenumber AS rank FROM lineitem WHERE l_returnflag = 'R'")
def scores_filtered(spark, sf_dir):
    return store.scores_of(_scores(spark, sf_dir), sample_id="R")


@query("SELECT l_orderkey AS run_id, l_returnflag AS sample_id, l_partkey AS path, l_linenumber AS rank FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_returnflag, l_linenumber) AS i FROM lineitem WHERE l_orderkey = 7)")
def scores_of_run(spark, sf_dir):
    return store.scores_of(_scores(spark, sf_dir), run_id=7)


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("sample_id"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("rank"))


@query(f"""WITH {RUNS}, r AS (SELECT CAST(retrieval_name AS VARCHAR) AS name, count(*) AS n, round(avg(chrf), 4) AS avg_chrf FROM runs GROUP BY ALL), d AS (SELECT stage, lang, count(*) AS n FROM runs GROUP BY ALL)
SELECT (SELECT count(*) FROM runs) AS total_runs, (SELECT count(chrf) FROM runs) AS evaluated_runs, (SELECT string_agg(name || ':' || n || ':' || printf('%.2f', avg_chrf), ',' ORDER BY name) FROM r) AS by_retrieval, (SELECT string_agg(stage || '/' || lang || ':' || n, ',' ORDER BY stage, lang) FROM d) AS by_data""")
def runs_whole_summary(spark, sf_dir):
    s = store.whole_summary(runs(spark, sf_dir))
    retrieval = F.transform("by_retrieval", lambda x: F.concat_ws(":", x["name"], x["count"].cast("string"), F.format_string("%.2f", F.round(x["avg_chrf"], 4))))
    data = F.transform("by_data", lambda x: F.concat(x["stage"], F.lit("/"), x["lang"], F.lit(":"), x["count"].cast("string")))
    return s.select("total_runs", "evaluated_runs", F.array_join(retrieval, ",").alias("by_retrieval"), F.array_join(data, ",").alias("by_data"))


@query(f"WITH {RUNS} SELECT stage || '-' || lang || '-' || retrieval_name || '-' || substr(md5(ts || run_id), 1, 12) AS id FROM runs")
def run_id(spark, sf_dir):
    key = store.run_key(F.col("stage"), F.col("lang"), F.col("retrieval_name").cast("string"), F.concat("ts", F.col("run_id").cast("string")))
    return runs(spark, sf_dir).select(key.alias("id"))


@query("SELECT b / 10.0::DOUBLE AS bm25, g / 10.0::DOUBLE AS graph, round(greatest(1 - b / 10.0::DOUBLE - g / 10.0::DOUBLE, 0), 2) AS symbol FROM range(0, 11) x(b), range(0, 11) y(g)")
def sweep_grid(spark, sf_dir):
    tenths = ",".join(str(i / 10) for i in range(11))
    each = [config.compose(o) for o in config.sweep([f"retrieval.scoring.bm25_weight={tenths}", f"retrieval.scoring.graph_weight={tenths}"])]
    rows = [(float(s["retrieval.scoring.bm25_weight"]), float(s["retrieval.scoring.graph_weight"])) for s in each]
    return spark.createDataFrame([(b, g, float(config.symbol_remainder(b, g))) for b, g in rows], "bm25 double, graph double, symbol double")


SYMBOLS = f"""wanted AS (SELECT sample, repo_key, len({_IDS.format('query')}) AS n, unnest({_IDS.format('query')}) AS id FROM asked),
held AS (SELECT repo_key, path, unnest({_IDS.format('content')}) AS id FROM files),
symbols AS (SELECT sample, repo_key, path, count(*) / any_value(n)::DOUBLE AS symbol FROM held JOIN wanted USING (repo_key, id) GROUP BY ALL)"""
#: The lexical index of the hybrid ranking holds files of 5 lines or more, with their symbols; the graph and the symbols know all.
HYBRID_BM25 = BM25.replace("corpus AS (SELECT * FROM files)", f"corpus AS (SELECT repo_key, path, content || chr(10) || array_to_string({_IDS.format('content')}, ' ') AS content FROM files WHERE {_LINES} >= 5)")
HYBRID = f"""{HYBRID_BM25}, {SYMBOLS}, edges AS (SELECT a.doc_id AS src, b.doc_id AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2 AND b.lang = a.lang AND b.doc_id <> a.doc_id),
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), starts AS (SELECT DISTINCT sample AS s FROM asked),
seen AS (SELECT s, s AS node, 0 AS hop FROM starts UNION ALL SELECT DISTINCT s, dst, 1 FROM starts JOIN both_ways ON src = s WHERE dst <> s),
w AS (SELECT s, dst AS node, power(0.65, hop) AS w FROM seen JOIN edges ON src = node UNION ALL SELECT s, src, power(0.65, hop) * 0.35 FROM seen JOIN edges ON dst = node),
graph AS (SELECT s AS sample, 'doc_' || node || '.py' AS path, round(max(w), 6) AS graph FROM w WHERE s <> node GROUP BY s, node),
near AS (SELECT DISTINCT s AS sample, 'doc_' || dst || '.py' AS path, 0.05::DOUBLE AS boost FROM starts JOIN edges ON src = s),
mixed AS (SELECT sample, repo_key, path, bm25_norm, round(coalesce(graph, 0) + coalesce(symbol, 0), 6) AS graph_symbol, round(0.55::DOUBLE * bm25_norm + 0.3::DOUBLE * coalesce(graph, 0) + 0.15::DOUBLE * coalesce(symbol, 0) + coalesce(boost, 0), 6) AS final FROM scored LEFT JOIN graph USING (sample, path) LEFT JOIN symbols USING (sample, repo_key, path) LEFT JOIN near USING (sample, path)),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY sample, repo_key ORDER BY final DESC, path) - 1 AS rank FROM mixed)"""


def _symbols(spark, sf_dir):
    wanted = asked(spark, sf_dir).select("sample", "repo_key", text.query_identifiers(F.col("query")).alias("ids"))
    return hybrid.symbol_scores(wanted, files(spark, sf_dir).select("repo_key", "path", text.query_identifiers(F.col("content")).alias("symbols")))


def _hybrid(spark, sf_dir):
    """The scored files, the index and the points. Documents import the one of half their number in the same repository; a sample's
    completion file has its number."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    edges = d.withColumn("dst", F.floor(F.col("doc_id") / 2)).join(d.toDF("dst", "lang"), ["dst", "lang"]).where("dst <> doc_id").select(F.col("lang").alias("repo_key"), F.col("doc_id").alias("src"), "dst")
    points = asked(spark, sf_dir)
    starts = points.select("repo_key", F.col("sample").alias("start"))
    named = lambda c: F.concat(F.lit("doc_"), F.col(c).cast("string"), F.lit(".py")).alias("path")
    scores = graph.graph_scores(edges, starts).select(F.col("start").alias("sample"), "repo_key", named("node"), F.col("score").alias("graph"))
    near = starts.withColumnRenamed("start", "src").join(edges, ["repo_key", "src"]).select(F.col("src").alias("sample"), "repo_key", named("dst"))
    known = files(spark, sf_dir).select("repo_key", "path", "content", text.query_identifiers(F.col("content")).alias("symbols"), text.line_count(F.col("content")).alias("lines"))
    known = written(known.select("repo_key", "path", "symbols", "lines", text.tokenize(text.enriched_text(F.col("content"), F.col("symbols"))).alias("terms")), "index")
    held = known.where("lines >= 5")
    wanted = points.select("sample", "repo_key", text.query_identifiers(F.col("query")).alias("ids"))
    found = hybrid.scored(bm25.normalised(bm25.hits(held, points)), scores, hybrid.symbol_scores(wanted, known), near)
    return hybrid.of_corpus(found, held), held, points


@query(f"WITH {BM25}, {SYMBOLS} SELECT sample, repo_key, path, round(symbol, 6) AS symbol FROM symbols")
def symbol_scores(spark, sf_dir):
    return _symbols(spark, sf_dir).withColumn("symbol", F.round("symbol", 6))


@query(f"WITH {HYBRID} SELECT sample, repo_key, path, bm25_norm, graph_symbol, final FROM mixed")
def hybrid_rank(spark, sf_dir):
    return bm25.every_file(*_hybrid(spark, sf_dir)).select("sample", "repo_key", "path", "bm25_norm", "graph_symbol", "final")


@query(f"WITH {HYBRID} SELECT sample, repo_key, path, final, rank FROM hybrid WHERE rank < 25")
def hybrid_topk(spark, sf_dir):
    return bm25.best(*_hybrid(spark, sf_dir), 25, "final").select("sample", "repo_key", "path", "final", "rank")


@query(f"""WITH {HYBRID}, best AS (SELECT h.*, length('<|file_sep|>' || path || chr(10) || content || chr(10)) AS len FROM hybrid h JOIN files USING (repo_key, path) WHERE rank < 25),
allowed AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY sample, repo_key ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY sample, repo_key ORDER BY rank) AS i FROM best WHERE path <> 'doc_' || sample || '.py')
SELECT 'sample_' || b.sample AS sample_id, b.repo_key AS repo, b.path AS retrieved_file, b.rank, b.bm25_norm AS bm25_score, b.graph_symbol AS graph_score, b.final AS combined_score, coalesce(a.i <= 6 AND (a.before + a.len <= 32000 OR 32000 - a.before >= 512), false) AS included_in_context FROM best b LEFT JOIN allowed a ON a.sample = b.sample AND a.repo_key = b.repo_key AND a.path = b.path""")
def score_records(spark, sf_dir):
    best = bm25.best(*_hybrid(spark, sf_dir), 25, "final").withColumn("at", F.concat_ws("-", F.col("sample").cast("string"), "repo_key"))
    allowed = context.without_own(best.withColumn("own", F.concat(F.lit("doc_"), F.col("sample").cast("string"), F.lit(".py"))), "own").join(files(spark, sf_dir), ["repo_key", "path"])
    kept = context.included(allowed.select(F.col("at").alias("sample"), "rank", "path", "content"), 6, 32000).select(F.col("sample").alias("at"), "path", "included")
    found = best.join(kept, ["at", "path"], "left")
    return found.select(F.concat(F.lit("sample_"), F.col("sample").cast("string")).alias("sample_id"), F.col("repo_key").alias("repo"), F.col("path").alias("retrieved_file"), "rank", F.col("bm25_norm").alias("bm25_score"), F.col("graph_symbol").alias("graph_score"), F.col("final").alias("combined_score"), F.coalesce("included", F.lit(False)).alias("included_in_context"))


_LONG = f"SELECT * FROM files WHERE {_LINES} >= 10"


def _long(spark, sf_dir):
    return files(spark, sf_dir).where(text.readline_count(F.col("content")) >= baselines.MIN_LINES)


@query(f"WITH {FILES}, long AS ({_LONG}) SELECT repo_key, arg_min(path, md5(path || '7')) AS path FROM long GROUP BY repo_key")
def baseline_random(spark, sf_dir):
    return baselines.random_file(_long(spark, sf_dir), "7")


@query(f"""WITH {FILES}, long AS ({_LONG}), points AS (SELECT item_id AS sample, lang AS repo_key FROM benchmark, (SELECT DISTINCT lang FROM documents) WHERE item_id % 20 = 0),
named AS (SELECT sample, repo_key, 'doc_' || unnest([sample, sample + 1, sample + 2]) || '.py' AS path FROM points),
recent AS (SELECT sample, repo_key, arg_min(path, md5(path || '7')) AS path FROM named JOIN long USING (repo_key, path) GROUP BY ALL),
other AS (SELECT repo_key, arg_min(path, md5(path || '7')) AS other FROM long GROUP BY repo_key)
SELECT sample, repo_key, coalesce(path, other) AS path FROM points LEFT JOIN recent USING (sample, repo_key) LEFT JOIN other USING (repo_key)""")
def baseline_recent(spark, sf_dir):
    names = F.array(*(F.concat(F.lit("doc_"), (F.col("sample") + i).cast("string"), F.lit(".py")) for i in range(3)))
    return baselines.recent_file(_long(spark, sf_dir), asked(spark, sf_dir).select("sample", "repo_key", names.alias("modified")), "7")


@query("SELECT item_id AS sample_idx, text AS context, CASE WHEN item_id % 2 = 0 THEN left(text, 9) ELSE left(text, 20) END AS prefix, right(text, 20) AS suffix, substr(text, 21, 10) AS middle FROM benchmark")
def eval_join(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "sample_idx")
    points = b.select("sample_idx", F.left("text", F.lit(20)).alias("prefix"), F.right("text", F.lit(20)).alias("suffix"))
    predictions = b.select("sample_idx", F.col("text").alias("context"), F.when(F.col("sample_idx") % 2 == 0, F.left("text", F.lit(9))).alias("prefix"), F.lit(None).cast("string").alias("suffix"))
    return evaluation.eval_join(points, b.select("sample_idx", F.substring("text", 21, 10).alias("middle")), predictions)


@query(f"WITH {RUNS} SELECT run_id, rpad(stage, 8, ' ') || ' ' || lpad(coalesce(printf('%.4f', chrf), 'pending'), 12, ' ') || '  ' || left(ts, 16) AS line FROM runs")
def results_table(spark, sf_dir):
    return store.results_table(runs(spark, sf_dir))


@query("SELECT l_orderkey AS run_id, l_partkey AS path FROM lineitem UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def scores_append(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    named = [F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("path")]
    return store.append(line.select(*named), line.where("l_returnflag = 'R'").select(*named))
