"""Every query with SQL against DuckDB, and small cases of the operators."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths, text
from codeloom.functions.syntax import ast_metadata, metadata
from codeloom.operators import bm25, context, evaluation, graph, store
from codeloom.plans.reference import QUERIES, SQL
from codeloom.sources.files import register

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    plain = lambda v: None if pd.isna(v) else round(float(v), 4) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted(str(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(SQL[name]).df())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_modules(spark):
    for path, want in (("a/b.py", "a.b"), ("a/__init__.py", "a"), ("__init__.py", ""), ("a.b.py", "a.b")):
        assert one(spark, paths.module_name(F.lit(path))) == want
    assert one(spark, paths.resolve_relative(F.lit("pkg"), F.lit("util"), F.lit(1))) == "util"  # from pkg/__init__.py


def test_lines(spark):
    for s in ("", "a", "a\n", "a\n\nb", "a\r\nb\rc", "a b\n"):
        assert one(spark, text.line_count(F.lit(s))) == len(s.splitlines())


def test_prompt_keeps_all_context_when_no_room_is_left(spark):
    tail = len("<fim_suffix><fim_prefix><fim_middle>")
    prefix = "p" * (int(8014 * 2.2) - tail)
    got = one(spark, text.fim_prompt(F.lit(prefix), F.lit(""), F.lit("c" * 50)))
    assert got.startswith("c" * 50)


def test_packing_like_the_greedy_loop(spark):
    files = [(0, i, f"f{i}", "x" * n) for i, n in enumerate((300, 900, 2000, 10, 5))]
    got = context.included(spark.createDataFrame(files, "sample long, rank long, path string, content string"), 4, 2500).orderBy("rank").collect()
    used, want = 0, []
    for _, i, p, c in files:
        chunk = f"<|file_sep|>{p}\n{c}\n"
        if i >= 4 or (used + len(chunk) > 2500 and 2500 - used < 512):
            break
        want.append(chunk[: 2500 - used])
        used += len(chunk)
    assert [r["chunk"] for r in got if r["included"]] == want


def test_graph_scores_of_all_lines(spark):
    line = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey"])
    at = {k: set(g) for k, g in line.groupby(["l_orderkey", "l_linenumber"])["l_partkey"]}
    edges = {(a, b) for (o, n), parts in at.items() for a in parts for b in at.get((o, n + 1), ()) if a != b}
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)
    want = {}
    for s in pd.read_parquet(f"{SF}/part.parquet")["p_partkey"]:
        if s % 20 == 0:
            hops = {x: 0.65 for x in out.get(s, set()) | back.get(s, set())} | {s: 1.0}
            for u, w in hops.items():
                for v, x in [(v, w) for v in out.get(u, ())] + [(v, w * 0.35) for v in back.get(u, ())]:
                    if v != s:
                        want[s, v] = max(want.get((s, v), 0), x)
    got = {(r["start"], r["node"]): r["score"] for r in QUERIES["graph_scores"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - w) < 1e-6 for k, w in want.items())


def test_one_path_in_two_repositories(spark):
    edges = spark.createDataFrame([("r1", "a.py", "b.py"), ("r2", "a.py", "c.py"), ("r2", "c.py", "d.py")], "repo_key string, src string, dst string")
    starts = spark.createDataFrame([("r1", "a.py")], "repo_key string, start string")
    assert [(r["repo_key"], r["node"]) for r in graph.graph_scores(edges, starts).collect()] == [("r1", "b.py")]
    files = [("r1", "a.py", "one two"), ("r2", "a.py", "one one three"), ("r2", "z.py", "")]
    held = bm25.index(spark.createDataFrame(files, "repo_key string, path string, content string"))
    asked = spark.createDataFrame([(0, "r2", "three"), (1, "r1", "nothing")], "sample long, repo_key string, query string")
    best = bm25.best(bm25.normalised(bm25.hits(held, asked)), held, asked, 5).orderBy("sample", "rank").collect()
    assert [(r["sample"], r["repo_key"], r["path"]) for r in best] == [(0, "r2", "a.py"), (0, "r2", "z.py"), (1, "r1", "a.py")]
    every = bm25.scores(held, asked).orderBy("sample", F.desc("bm25_norm"), "path").collect()
    assert [(r["sample"], r["path"]) for r in every] == [(r["sample"], r["path"]) for r in best]


def test_graph_rejects_growth(spark):
    with pytest.raises(ValueError):
        graph.graph_scores(None, None, decay=1.5)


def test_metric_names(spark):
    with pytest.raises(ValueError):
        store.best(spark.range(1), "speed", 1)


def test_repository_source(spark, tmp_path):
    register(spark)
    pkg = tmp_path / "owner__name-abc" / "pkg"
    (pkg / ".hid").mkdir(parents=True)
    for name, body in (("__init__.py", b"from .util import f as g\n"), (".dot.py", b"x = 1"), (".hid/h.py", b""), ("crlf.py", b"a = 1\r\nb: int = 2\r\n"), ("bad.py", b"s = '\xff'\n"), ("no.txt", b"x")):
        (pkg / name).write_bytes(body)
    got = {r["path"]: r for r in spark.read.format("repository").load(str(tmp_path)).collect()}
    assert sorted(got) == ["pkg/.dot.py", "pkg/.hid/h.py", "pkg/__init__.py", "pkg/bad.py", "pkg/crlf.py"]
    assert {r["repo_key"] for r in got.values()} == {"owner__name-abc"} and not got["pkg/bad.py"]["strict_utf8"]
    assert got["pkg/crlf.py"]["content"] == "a = 1\nb: int = 2\n" and got["pkg/crlf.py"]["line_count"] == 2
    assert [got[f"pkg/{n}"]["readline_count"] for n in (".dot.py", ".hid/h.py", "crlf.py")] == [1, 0, 2]


def test_numbered_lines(spark, tmp_path):
    register(spark)
    (tmp_path / "p.jsonl").write_text('{"a": "é\u2028"}\n{"a": null}\n')
    got = spark.read.format("numbered_lines").load(str(tmp_path)).select("sample_idx", F.from_json("value", "a string")["a"].alias("a")).orderBy("sample_idx").collect()
    assert [(r["sample_idx"], r["a"]) for r in got] == [(0, "é\u2028"), (1, None)]


def test_metadata(spark):
    source = "import a.b, c.d as e\nfrom . import u\nfrom .v import w as x\nclass K:\n    def m(self):\n        y = 1\n        (p, q) = 1, 2\n        self.r = 3\nz: int = 0\n"
    frame = spark.createDataFrame([(source,), ("print 'x'",), ("\ufeffx = 1",), (None,), ("",)], "s string")
    got = [r["m"] for r in frame.select(ast_metadata("s").alias("m")).collect()]
    assert got[0]["symbols"] == ["K", "m", "y", "z"] and got[0]["aliases"] == {"a": "a.b", "e": "c.d", "u": "u", "x": "v.w"}
    assert [i["level"] for i in got[0]["imports"]] == [0, 0, 1, 1]
    for deep in ("+".join(["1"] * 20000), "x = " + "-" * 60000 + "1", "a\x00b"):
        assert metadata(deep)["parse_error"] and not metadata(deep)["symbols"]
    assert [bool(r["parse_error"]) for r in got] == [False, True, True, False, False] and not any(r["symbols"] for r in got[1:])


def test_evaluation(spark):
    points = spark.createDataFrame([(0, "p", "s"), (1, "p", "s")], "sample_idx long, prefix string, suffix string")
    answers = spark.createDataFrame([(0, "m"), (1, "n")], "sample_idx long, middle string")
    predicted = spark.createDataFrame([(0, "c", "q", None), (1, "c", None, "")], "sample_idx long, context string, prefix string, suffix string")
    got = evaluation.eval_join(points, answers, predicted).orderBy("sample_idx").collect()
    assert [(r["prefix"], r["suffix"]) for r in got] == [("q", "s"), ("p", "")]
    with pytest.raises(Exception, match="do not match"):
        evaluation.eval_join(points, answers.limit(1), predicted).collect()
    made = evaluation.generated(points.select("sample_idx", F.col("prefix").alias("prompt")), lambda texts: [t * 2 for t in texts])
    assert {r["generated"] for r in made.collect()} == {"pp"}
    assert evaluation.summary(spark.createDataFrame([(0.5,), (1.0,)], "chrf double")).first()["mean_chrf"] == 0.75
