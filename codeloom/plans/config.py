"""Settings of a run: defaults, retrieval variants, overrides, sweeps, and the names and records that follow from them."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable
from datetime import datetime

# The default settings, what the retrieval variants set, and the published sweeps.
DEFAULTS = {
    "data.stage": "practice", "data.lang": "python", "data.data_dir": "data", "data.predictions_dir": "predictions",
    "context.max_files": 5, "context.max_tokens": 8000, "context.min_lines": 5, "context.query_window": 150,
    "trim.prefix": False, "trim.suffix": False, "trim.trim_lines": 10,
    "evaluation.enabled": True, "evaluation.ollama_url": "http://localhost:11434", "evaluation.model": "JetBrains/Mellum-4b-sft-python", "evaluation.temperature": 0.0,
}
VARIANTS = {
    "simple_hybrid": {"graph.max_hop": 2, "graph.reverse_import_weight": 0.35, "graph.hop_decay": 0.65, "graph.direct_import_boost": 0.05, "graph.fallback_enabled": False, "graph.min_pool_size": 10, "scoring.bm25_weight": 0.55, "scoring.graph_weight": 0.30, "scoring.symbol_weight": 0.15},
    "hybrid": {"graph.max_hop": 2, "graph.reverse_import_weight": 0.35, "graph.hop_decay": 0.65, "graph.direct_import_boost": 0.05, "scoring.bm25_weight": 0.5, "scoring.graph_weight": 0.4, "scoring.symbol_weight": 0.1},
    "graph_only": {"graph.max_hop": 2, "graph.reverse_import_weight": 0.35, "graph.hop_decay": 0.65, "graph.direct_import_boost": 0.05, "scoring.bm25_weight": 0.0, "scoring.graph_weight": 1.0, "scoring.symbol_weight": 0.0},
    "bm25_only": {"graph.max_hop": 0, "graph.reverse_import_weight": 0.0, "graph.hop_decay": 0.0, "graph.direct_import_boost": 0.0, "scoring.bm25_weight": 1.0, "scoring.graph_weight": 0.0, "scoring.symbol_weight": 0.0},
}
SWEEPS = {
    "sweep_edge_types": {"retrieval.graph.reverse_import_weight": [0.0, 0.2, 0.35, 0.5, 0.75, 1.0]},
    "sweep_weights": {"retrieval.scoring.bm25_weight": [1.0, 0.7, 0.55, 0.3, 0.0], "retrieval.scoring.graph_weight": [0.0, 0.15, 0.30, 0.55, 0.85]},
    "sweep_hops": {"retrieval.graph.max_hop": [0, 1, 2, 3]},
}
BEST = {"context.max_files": 14, "context.max_tokens": 1800, "retrieval.graph.max_hop": 0, "retrieval.scoring.bm25_weight": 0.85, "retrieval.scoring.graph_weight": 0.0, "retrieval.scoring.symbol_weight": 0.15, "evaluation.temperature": 0.2}
CHARS_PER_TOKEN = 4


def _value(text: str):
    plain = {"true": True, "false": False, "null": None}
    if text.lower() in plain:
        return plain[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def compose(overrides: Iterable[str] = ()) -> dict:
    """Settings by dotted key after overrides of the form key=value; retrieval=name chooses a variant, +key=value adds a new key, an
    unknown key is an error."""
    pairs = [o.split("=", 1) for o in overrides]
    variant = "simple_hybrid"
    for pair in pairs:
        if len(pair) != 2:
            raise ValueError(f"not key=value: {pair[0]}")
        variant = pair[1] if pair[0] == "retrieval" else variant
    if variant not in VARIANTS:
        raise ValueError(f"no such retrieval: {variant}")
    out = DEFAULTS | {"retrieval.name": variant} | {f"retrieval.{k}": v for k, v in VARIANTS[variant].items()}
    known = set(DEFAULTS) | {"retrieval.name"} | {f"retrieval.{k}" for v in VARIANTS.values() for k in v}
    for key, value in pairs:
        if key == "retrieval":
            continue
        if key.lstrip("+") not in known and not key.startswith("+"):
            raise ValueError(f"no such setting: {key}")
        out[key.lstrip("+")] = _value(value)
    return out


def sweep(arguments: Iterable[str]) -> list[list[str]]:
    """One list of overrides for each combination: key=a,b,c gives several values, experiment=name those of a published sweep; the
    last key varies fastest."""
    fixed, many = [], {}
    for a in arguments:
        key, _, value = a.partition("=")
        if key.lstrip("+") == "experiment":
            if value not in SWEEPS:
                raise ValueError(f"no such experiment: {value}")
            many |= {k: [str(x) for x in v] for k, v in SWEEPS[value].items()}
        elif "," in value:
            many[key] = value.split(",")
        else:
            fixed.append(a)
    return [[*fixed, *(f"{k}={v}" for k, v in zip(many, combination, strict=True))] for combination in itertools.product(*many.values())]


def symbol_remainder(bm25: float, graph: float) -> float:
    """The symbol weight that makes the three sum to 1, not below 0."""
    return round(max(1 - bm25 - graph, 0.0), 2)


def as_text(settings: dict) -> str:
    """The settings as nested YAML."""
    tree: dict = {}
    for key, value in settings.items():
        *path, last = key.split(".")
        at = tree
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value

    def lines(node: dict, indent: str):
        for k, v in node.items():
            if isinstance(v, dict):
                yield f"{indent}{k}:"
                yield from lines(v, indent + "  ")
            else:
                yield f"{indent}{k}: {'null' if v is None else str(v).lower() if isinstance(v, bool) else v}"

    return "\n".join(lines(tree, "")) + "\n"


def prediction_name(settings: dict) -> str:
    s = settings
    bm25, graph = s["retrieval.scoring.bm25_weight"], s["retrieval.scoring.graph_weight"]
    parts = [s["data.lang"], s["data.stage"], s["retrieval.name"], f"hop{s['retrieval.graph.max_hop']}"]
    parts += [f"bm{bm25}-gr{graph}"] * ((bm25, graph) != (0.5, 0.5))
    parts += ["short-prefix"] * bool(s["trim.prefix"]) + ["short-suffix"] * bool(s["trim.suffix"])
    return "-".join(map(str, parts)) + ".jsonl"


def baseline_name(lang: str, stage: str, strategy: str, trim_prefix: bool = False, trim_suffix: bool = False) -> str:
    return "-".join([lang, stage, strategy, *["short-prefix"] * trim_prefix, *["short-suffix"] * trim_suffix]) + ".jsonl"


def result_paths(predictions: str, output: str | None = None) -> tuple[str, str]:
    """Where results and summary of a prediction file go."""
    name = predictions.rstrip("/").rsplit("/", 1)[-1]
    name = name.rsplit(".", 1)[0] if "." in name.lstrip(".") else name
    results = output or f"results/{name}-results.jsonl"
    return results, results.replace("-results.jsonl", "-summary.json") if "-results.jsonl" in results else results + "-summary.json"


def points_path(settings: dict) -> str:
    return f"{settings['data.data_dir']}/{settings['data.lang']}-{settings['data.stage']}.jsonl"


def answers_path(settings: dict) -> str:
    return f"{settings['data.data_dir']}/answers-{settings['data.lang']}-{settings['data.stage']}.jsonl"


def repositories_path(settings: dict) -> str:
    return f"{settings['data.data_dir']}/repositories-{settings['data.lang']}-{settings['data.stage']}"


def run_record(settings: dict, prediction_file: str, num_samples: int, status: str = "completed", error: str | None = None, now: str | None = None) -> dict:
    """A row of the run store; run_id depends on the settings and the time."""
    s, text, now = settings, as_text(settings), now or datetime.now().isoformat()
    key = hashlib.md5(f"{text}{now}".encode()).hexdigest()[:12]
    graph = lambda name, other: s.get(f"retrieval.graph.{name}", other)
    return {
        "run_id": f"{s['data.lang']}-{s['data.stage']}-{s['retrieval.name']}-{key}", "timestamp": now, "stage": s["data.stage"], "lang": s["data.lang"], "retrieval_name": s["retrieval.name"],
        "max_hop": s["retrieval.graph.max_hop"], "bm25_weight": s["retrieval.scoring.bm25_weight"], "graph_weight": s["retrieval.scoring.graph_weight"],
        "import_weight": 1.0, "call_weight": 0.0, "inheritance_weight": 0.0, "type_ref_weight": 0.0,
        "max_files": s["context.max_files"], "max_tokens": s["context.max_tokens"], "min_lines": s["context.min_lines"],
        "fallback_enabled": graph("fallback_enabled", True), "min_pool_size": graph("min_pool_size", 10), "query_window": s.get("context.query_window", 150),
        "hop_decay": graph("hop_decay", 0.65), "reverse_import_weight": graph("reverse_import_weight", 0.35), "symbol_weight": s.get("retrieval.scoring.symbol_weight", 0.15),
        "trim_prefix": s["trim.prefix"], "trim_suffix": s["trim.suffix"], "trim_lines": s["trim.trim_lines"],
        "prediction_file": prediction_file, "num_samples": num_samples, "config_json": text, "chrf_score": None, "bleu_score": None, "exact_match": None, "status": status, "error_message": error,
    }
