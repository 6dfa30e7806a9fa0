"""A repository end to end: retrieval against a plain computation, predictions, evaluation, run store, settings and commands."""

import ast
import json
import math
import random
import re

import pytest

from codeloom import __main__ as command
from codeloom.operators import store
from codeloom.plans import config, retrieval, runs
from codeloom.sources import files as sources
from codeloom.sources.runs import RunStore

FILES = {
    "pkg/__init__.py": "from .util import f\n" + "# start\n" * 6,
    "pkg/util.py": "import os\n\n\ndef f(value):\n    return value * 2\n\n\nLIMIT = 10\n",
    "pkg/core.py": "from . import util\nfrom .util import f as g\n\n\nclass Engine:\n    def start(self):\n        return g(util.LIMIT)\n",
    "ns/sub/leaf.py": "def leaf_value():\n    total = 0\n    for i in range(3):\n        total += i\n    return total\n",
    "user.py": "import ns\nfrom pkg.core import Engine\n\n\ndef main():\n    engine = Engine()\n    return engine.start()\n",
    "dup.py": "x = 1\n" * 7,
    "dup/__init__.py": "y = 2\n" * 7,
    "star.py": "from pkg import *\nfrom pkg.util import LIMIT\n\n\ndef twice(v):\n    return f(v) * LIMIT\n",
    "hub.py": "import pkg.core\nimport user\nh = 1\n",
    "py2.py": "print 'x'\n" * 6,
    ".hid/_private.py": "secret_value = 1\n" * 6,
    "empty.py": "",
    "deep.py": "x = " + "-" * 60000 + "1\n" * 6,
    "big.py": "engine = 1  # value\n" * 3000,
}
POINTS = [
    {"id": "a", "repo": "o/r", "revision": "abc", "path": "user.py", "modified": ["pkg/util.py", "star.py"], "prefix": "\n".join(f"line{i}" for i in range(12)) + "\nengine = Engine()", "suffix": "engine.start(value, LIMIT)\n"},
    {"repo": "o/r", "revision": "abc", "path": "pkg/core.py", "modified": [], "prefix": "def leaf_value total", "suffix": ""},
    {"id": "c", "repo": "o/none", "revision": "abc", "path": "x.py", "modified": [], "prefix": "p", "suffix": "s"},
    {"id": "d", "repo": "o/other", "revision": "abc", "path": "user.py", "modified": [], "prefix": "engine", "suffix": ""},
]
SMALL = ["context.max_tokens=600", "context.max_files=3"]


@pytest.fixture()
def root(tmp_path):
    data = tmp_path / "data"
    for repo, held in (("o__r-abc", FILES), ("o__other-abc", {"user.py": "import engine\n" * 6, "engine.py": "class Engine:\n    pass\n" * 3})):
        for name, body in held.items():
            path = data / "repositories-python-practice" / repo / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(body, encoding="utf-8")
    (data / "python-practice.jsonl").write_text("".join(json.dumps(p) + "\n" for p in POINTS), encoding="utf-8")
    (data / "answers-python-practice.jsonl").write_text("".join(json.dumps({"middle": m}) + "\n" for m in ("engine.start()", "total", "", "x y")), encoding="utf-8")
    return str(tmp_path)


def stub_of():
    def stub(prompts):  # not a module's function: workers do not import the tests
        return ["engine.stop()<fim_middle>rest" if "Engine()" in p else "total" for p in prompts]

    return stub


stub = stub_of()


def plain_ranking(files, own, query, s):
    """The best files in order, by loops over dicts."""
    module = {}
    for path in sorted(files):
        name = re.sub(r"(^|\.)__init__$", "", path[:-3].replace("/", "."))
        if name:
            module[name] = path
    of = {p: m for m, p in module.items()} | {p: re.sub(r"(^|\.)__init__$", "", p[:-3].replace("/", ".")) for p in files}
    out, names, symbols = {p: set() for p in files}, {}, {}
    for path, body in files.items():
        names[path], symbols[path] = set(), set()
        try:
            tree = ast.parse(body)
        except (SyntaxError, RecursionError, MemoryError):
            continue
        asked = []
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.ClassDef)):
                symbols[path].add(n.name)
            elif isinstance(n, ast.Assign):
                symbols[path].update(t.id for t in n.targets if isinstance(t, ast.Name))
            elif isinstance(n, ast.Import):
                asked += [[a.name] for a in n.names]
                names[path].update(a.asname or a.name.split(".")[0] for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                up = of[path].split(".")[:-1]
                base = [*up[: max(0, len(up) - n.level + 1)], *(n.module or "").split(".")] if n.level else (n.module or "").split(".")
                base = ".".join(b for b in base if b)
                for a in n.names:
                    asked.append([*([f"{base}.{a.name}" if base else a.name] if a.name != "*" else []), *([base] if base else [])])
                    names[path].add(a.asname or a.name)
        names[path] |= symbols[path]
        for m in (m for c in asked for m in c):
            out[path] |= {module[m]} if m in module else {p for k, p in module.items() if k.startswith(m + ".")}
        out[path].discard(path)
    back = {p: {q for q in files if p in out[q]} for p in files}
    graph, level, seen = {}, {own} & set(files), {own}
    for hop in range(s["retrieval.graph.max_hop"]):
        for u in level:
            for near, w in ((out, 1.0), (back, s["retrieval.graph.reverse_import_weight"])):
                for v in near[u] - {own}:
                    graph[v] = max(graph.get(v, 0), w * s["retrieval.graph.hop_decay"] ** hop)
        level = {v for u in level for v in out[u] | back[u]} - seen
        seen |= level
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    corpus = {p: words(b + "\n" + " ".join(sorted(symbols[p]))) for p, b in files.items() if len(b.splitlines()) >= s["context.min_lines"]}
    n, mean = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    df = {}
    for w in corpus.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: low if v < 0 else v for t, v in idf.items()}
    raw = {p: sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in words(query) if t in idf) for p, w in corpus.items()}
    top = max(raw.values()) if max(raw.values()) > 0 else 1.0
    ids = {t for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", query) if len(t) > 1} - {"def", "for", "in", "return", "int", "None"}
    final = {p: s["retrieval.scoring.bm25_weight"] * raw[p] / top + s["retrieval.scoring.graph_weight"] * graph.get(p, 0) + s["retrieval.scoring.symbol_weight"] * len(ids & names[p]) / max(1, len(ids)) + 0.05 * (p in out.get(own, ())) for p in corpus}
    return sorted(((round(v, 4), p) for p, v in final.items()), key=lambda x: (-x[0], x[1]))


def test_retrieval_like_a_plain_computation(spark, root):
    sources.register(spark)
    for overrides in ([], ["retrieval=graph_only"], ["retrieval=bm25_only"], ["retrieval.graph.max_hop=1", "context.min_lines=1"]):
        s = config.compose(overrides)
        points = sources.points(spark, f"{root}/data/python-practice.jsonl")
        index = retrieval.build(spark.read.format("repository").load(f"{root}/data/repositories-python-practice"))
        got = retrieval.retrieve(index, points, s).collect()
        for i in (0, 1):
            want = plain_ranking(FILES, POINTS[i]["path"], POINTS[i]["prefix"] + "\n" + POINTS[i]["suffix"], s)
            mine = sorted((r["rank"], r["path"], r["final"]) for r in got if r["sample"] == i)
            assert [r[0] for r in mine] == list(range(len(want)))
            assert {p: pytest.approx(v, abs=2e-4) for v, p in want} == {p: v for _, p, v in mine}, overrides
        # a file of another repository with the same path is no neighbour, and a repository that is missing has no files
        assert {r["path"] for r in got if r["sample"] == 3} <= {"user.py", "engine.py"}
        assert not [r for r in got if r["sample"] == 2]


def test_a_run_with_its_evaluation(spark, root):
    out = runs.run(spark, config.compose([*SMALL, "trim.prefix=true"]), root, stub)
    assert out["predictions"].endswith("predictions/python-practice-simple_hybrid-hop2-bm0.55-gr0.3-short-prefix.jsonl") and out["num_samples"] == 4
    made = sources.numbered(spark, out["predictions"], sources.PREDICTIONS).orderBy("sample_idx").collect()
    assert [r["sample_idx"] for r in made] == [0, 1, 2, 3]
    assert made[0]["context"].startswith("<|file_sep|>") and "<|file_sep|>user.py" not in made[0]["context"] and len(made[0]["context"]) <= 2400
    assert made[0]["prefix"].split("\n")[0] == "line3" and made[1]["prefix"] is None and made[2]["context"] == "" and made[0]["suffix"] is None
    held = RunStore(spark, f"{root}/experiments")
    run = held.get_run(out["run_id"])
    assert run["status"] == "completed" and run["num_samples"] == 4 and run["chrf_score"] == out["mean_chrf"] and "retrieval:" in run["config_json"]
    records = held.scores(out["run_id"], "sample_0").collect()
    assert [r["rank"] for r in records] == list(range(len(records))) and records[0]["repo"] == "o/r" and records[0]["completion_file"] == "user.py"
    inside = {c.split("\n")[0] for c in made[0]["context"].split("<|file_sep|>")[1:]}
    assert {r["retrieved_file"] for r in records if r["included_in_context"]} == inside and 0 < len(inside) <= 3
    lines = sources.numbered(spark, f"{root}/results/python-practice-simple_hybrid-hop2-bm0.55-gr0.3-short-prefix-results.jsonl", "id string, generated string, ground_truth string, chrf double").orderBy("sample_idx").collect()
    assert [(r["id"], r["generated"]) for r in lines] == [("a", "engine.stop()"), ("?", "total"), ("c", "total"), ("d", "total")]
    assert [r["chrf"] for r in lines][1:3] == [1.0, 0.0]
    with open(f"{root}/results/python-practice-simple_hybrid-hop2-bm0.55-gr0.3-short-prefix-summary.json") as f:
        summary = json.load(f)
    assert summary["num_samples"] == 4 and summary["mean_chrf"] == out["mean_chrf"] == pytest.approx(sum(r["chrf"] for r in lines) / 4, abs=1e-4)
    # an evaluation that fails leaves the run without metrics, a run that fails is logged
    bad = runs.run(spark, config.compose(SMALL), root, lambda prompts: 1 / 0)
    assert bad["mean_chrf"] is None and held.get_run(bad["run_id"])["chrf_score"] is None and "ZeroDivision" in bad["evaluation_error"]
    with pytest.raises(Exception):
        runs.run(spark, config.compose(["data.lang=none"]), root, stub)
    assert held.get_runs(lang="none").first()["status"] == "failed"
    assert runs.default_predictions(spark, f"{root}/predictions") is None and runs.default_predictions(spark, f"{root}/nowhere") is None


def test_baselines(spark, root):
    for strategy in ("random", "bm25", "recent"):
        path = runs.baseline(spark, root, strategy, trim_prefix=True)
        assert path.endswith(f"python-practice-{strategy}-short-prefix.jsonl")
        made = sources.numbered(spark, path, sources.PREDICTIONS).orderBy("sample_idx").collect()
        assert made[0]["context"].startswith("<|file_sep|>big.py\n") and made[2]["context"] == ""  # the only file of ten lines
        assert made[0]["prefix"].split("\n")[0] == "line3" and made[1]["prefix"] == POINTS[1]["prefix"]
    with pytest.raises(ValueError):
        runs.baseline(spark, root, "other")
    with pytest.raises(ValueError):
        runs.baseline(spark, root, "random", lang="cobol")


def test_run_store(spark, tmp_path):
    held = RunStore(spark, str(tmp_path / "db"))
    record = config.run_record(config.compose(), "p.jsonl", 3, now="2025-01-01T00:00:00")
    assert record["run_id"].startswith("python-practice-simple_hybrid-") and record["run_id"] == config.run_record(config.compose(), "q", 1, now="2025-01-01T00:00:00")["run_id"]
    assert held.summary()["total_runs"] == 0 and held.get_run("x") is None and not held.delete_run("x") and held.scores().count() == 0
    assert held.log_run(record) == 1 and held.log_run(record | {"run_id": "b", "timestamp": "2025-01-02", "stage": "public"}) == 2
    assert not held.update_metrics("none", chrf=0.5) and not held.update_metrics("b") and held.update_metrics("b", chrf=0.5, bleu=0.25)
    with pytest.raises(ValueError):
        held.update_metrics("b", status=1.0)
    assert held.log_run(record | {"run_id": "b", "timestamp": "2025-01-03", "stage": "start", "chrf_score": 0.9}) == 2
    b = held.get_run("b")
    assert (b["stage"], b["chrf_score"], b["bleu_score"], b["id"]) == ("start", 0.5, 0.25, 2)
    assert [r["run_id"] for r in held.get_runs().collect()][0] == "b" and held.get_runs(stage="practice", limit=1).count() == 1
    assert [r["run_id"] for r in held.best().collect()] == ["b"] and held.best(stage="practice").count() == 0
    assert [r["run_id"] for r in held.pending().collect()] == [record["run_id"]]
    got = held.summary()
    assert (got["total_runs"], got["evaluated_runs"]) == (2, 1) and got["by_retrieval"] == [{"name": "simple_hybrid", "count": 2, "avg_chrf": 0.5}]
    assert got["by_data"] == [{"stage": "practice", "lang": "python", "count": 1}, {"stage": "start", "lang": "python", "count": 1}]
    scores = spark.createDataFrame([("sample_1", "o/r", "a.py", "b.py", r, 0.5, 0.1, 0.6, True) for r in (2, 0, 1)], ", ".join(x for x in __import__("codeloom.sources.runs", fromlist=["SCORES"]).SCORES.split(", ")[:-1]))
    assert held.log_scores("b", scores) == 3 and held.log_scores("b", scores.limit(1)) == 1 and held.log_scores("a", scores) == 3
    assert [r["rank"] for r in held.scores("a").collect()] == [0, 1, 2] and held.scores("b", "sample_1", 2).count() == 2 and held.scores("b", "none").count() == 0
    heading, table = store.full_results_table(held.runs())
    line = [r["line"] for r in table.collect()]
    assert line[0].startswith("start   ") and "0.5000" in line[0] and "pending" in line[1] and len(heading.split()) == 14
    # an older version without the later columns still reads
    spark.createDataFrame([(1, "old")], "id long, run_id string").write.parquet(str(tmp_path / "old" / "experiments" / "v=0"))
    assert RunStore(spark, str(tmp_path / "old")).get_run("old")["symbol_weight"] is None
    assert held.delete_run("b") and held.get_run("b") is None and held.runs().count() == 1


def test_commands(spark, root, capsys):
    held = RunStore(spark, f"{root}/experiments")
    record = config.run_record(config.compose(), "p.jsonl", 3)
    held.log_run(record)
    for arguments, want in ((["pending"], "p.jsonl"), (["list", "--stage", "practice"], "N/A"), (["summary"], "Total runs: 1"), (["results"], "pending"), (["best"], "")):
        command.main(["--root", root, *arguments])
        assert want in capsys.readouterr().out
    held.update_metrics(record["run_id"], chrf=0.25)
    command.main(["--root", root, "best"])
    assert "0.2500" in capsys.readouterr().out
    command.main(["--root", root, "run", "evaluation.enabled=false", *SMALL])
    assert json.loads(capsys.readouterr().out)["num_samples"] == 4
    command.main(["--root", root, "baseline", "--strategy", "recent"])
    assert "python-practice-recent.jsonl" in capsys.readouterr().out
    command.main(["--root", root, "sweep", "retrieval.graph.max_hop=0,1", "evaluation.enabled=false", *SMALL])
    assert len(capsys.readouterr().out.splitlines()) == 2


def test_settings():
    s = config.compose(["retrieval=hybrid", "context.max_files=7", "trim.suffix=true", "+context.extra=x", "evaluation.temperature=0.2"])
    assert (s["retrieval.name"], s["retrieval.scoring.graph_weight"], s["context.max_files"], s["trim.suffix"], s["context.extra"]) == ("hybrid", 0.4, 7, True, "x")
    assert "retrieval.graph.fallback_enabled" not in s and config.run_record(s, "", 0)["fallback_enabled"] is True
    for wrong in (["retrieval=x"], ["context.max=1"], ["nonsense"]):
        with pytest.raises(ValueError):
            config.compose(wrong)
    assert config.sweep(["a=1,2", "b=3", "c=x,y"]) == [["b=3", "a=1", "c=x"], ["b=3", "a=1", "c=y"], ["b=3", "a=2", "c=x"], ["b=3", "a=2", "c=y"]]
    assert len(config.sweep(["+experiment=sweep_weights"])) == 25 and config.sweep([]) == [[]]
    assert config.prediction_name(config.compose(["retrieval.scoring.bm25_weight=0.5", "retrieval.scoring.graph_weight=0.5", "trim.suffix=true"])) == "python-practice-simple_hybrid-hop2-short-suffix.jsonl"
    assert config.result_paths("predictions/a.b.jsonl") == ("results/a.b-results.jsonl", "results/a.b-summary.json")
    assert config.as_text(s).startswith("data:\n  stage: practice\n") and "  suffix: true\n" in config.as_text(s)
    assert config.symbol_remainder(0.9, 0.6) == 0 and config.symbol_remainder(0.55, 0.3) == 0.15


def test_search_goes_on_and_survives_failures():
    asked = []

    def score(overrides):
        asked.append(dict(o.split("=") for o in overrides))
        if len(asked) == 3:
            raise RuntimeError
        return None if len(asked) == 4 else float(asked[-1]["retrieval.scoring.bm25_weight"])

    done = []
    runs.search(score, 20, done=done, overrides=["data.stage=public"])
    best, value = runs.search(score, 40, done=done)
    assert len(done) == 40 and asked[0]["retrieval.scoring.bm25_weight"] == "0.6" and asked[0]["data.stage"] == "public"
    assert value == max(v for _, v in done) >= 0.8 and done[2][1] == done[3][1] == 0.0
    for at, _ in done:
        for k, (low, high, step) in runs.SPACE.items():
            assert low <= at[k] <= high and abs((at[k] - low) / step - round((at[k] - low) / step)) < 1e-6
    assert runs.proposal([], random.Random(1)) == runs.FIRST


def test_model_server(spark):
    import http.server
    import threading

    from codeloom.operators.evaluation import http_generator

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": asked["prompt"].upper() + asked["options"]["stop"][0]}).encode())

        def log_message(self, *a):
            pass

    with http.server.HTTPServer(("127.0.0.1", 0), Server) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        assert http_generator(f"http://127.0.0.1:{server.server_port}", "m")(["ab"]) == ["AB<fim_prefix>"]
        server.shutdown()
