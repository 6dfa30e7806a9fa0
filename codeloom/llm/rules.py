"""Operator 10: quality rules by gradient-boosted trees over document statistics.

Statistics of a whole text come from its words `[^\\x20\\x09-\\x0D]+`, lines and characters. Trees of small depth are boosted on
the logistic loss over binned statistics; splits on the statistics in FALLING are allowed only if the side with more of it gets
the lower value, and every leaf stays within the bounds its ancestors set, so the score never rises with them. The fitted trees
are flattened into arrays (feature, cut, left, right, value), and many documents walk down all trees together in numpy.

The base rule stands before the trees: fewer than 10 words, or more than a fifth of the words in five-word windows that occur
twice, fails. The trees are fitted on a bounded sample (`sample` labelled documents by a hash of doc_id); all documents are scored.

Ties: a probability equal to the threshold is kept; labels of equal hash are taken in the order of doc_id; a value equal to a cut
goes left. A text of any length is measured whole. No documents give no rows. Null text has no words and fails the base rule, as do empty and blank texts. Labels with null quality are skipped; without labels
or with labels of one
quality alone (which gives a warning) the base rule alone decides. Of rows that share a doc_id one is learnt from, the one with the
smallest statistics, so the driver gets no more rows than labels. Repeated rows get equal answers; extra columns are not read.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import map_texts, selected

WINDOW = 5
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("log_words", "mean_word", "symbols_per_word", "dup_lines", "repeat_words", "distinct_words", "same_as_before", "capitals", "digits", "marked_words", "lone_marks", "mean_line", "ends_with_stop")
#: The score must not rise with these.
FALLING = ("symbols_per_word", "dup_lines", "repeat_words", "same_as_before", "lone_marks")
_SYMBOLS = b"#*$%&|<>"
_CLASSES = [bytes(set(range(256)) - set(keep)) for keep in (_SYMBOLS, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(0x80, 0xC0)))]
_LINE = re.compile(rb"[^\x20\x09-\x0D]")


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """FIELDS and STATISTICS of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at exactly these six characters
    n = len(words)
    if not n:
        return [0] * len(FIELDS), [0.0] * len(STATISTICS)
    symbols, capitals, digits, inner = (len(raw.translate(None, drop)) for drop in _CLASSES)
    word_bytes = sum(map(len, words))
    word_chars = word_bytes - inner  # continuation bytes start no code point, and none is white space
    lines = [x for x in raw.split(b"\n") if _LINE.search(x)]
    dup = len(lines) - len(set(lines))
    distinct = len(set(words))
    key = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeat = 0
    if n > WINDOW and distinct < n:
        at = np.zeros(n - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            at = (at ^ (at >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + key[i : n - WINDOW + 1 + i]
        order = np.argsort(at, kind="stable")
        equal = at[order][1:] == at[order][:-1]
        if equal.any():
            twice = np.zeros(n + 1, np.int64)
            both = np.zeros(len(order), bool)
            both[order[1:][equal]] = True
            both[order[:-1][equal]] = True
            starts = np.flatnonzero(both)
            np.add.at(twice, starts, 1)
            np.add.at(twice, starts + WINDOW, -1)
            repeat = int(np.count_nonzero(np.cumsum(twice)[:n]))
    same = int(np.count_nonzero(key[1:] == key[:-1]))
    lone = sum(words.count(w) for w in (b"|", b"-", b"*", b"#", b"&"))
    marked = sum(w[-1] in _SYMBOLS or w[-2:] == b"!!" for w in words)
    stats = [np.log1p(n), word_chars / n, symbols / n, dup / max(1, len(lines)), repeat / n, distinct / n if n >= 20 else 1.0, same / n, capitals / max(1, word_chars), digits / max(1, word_chars), marked / n, lone / n, np.log1p(n / max(1, len(lines))), float(words[-1][-1:] in (b".", b"!", b"?"))]
    return [n, word_chars, symbols, dup, repeat], stats


@dataclass
class Forest:
    """All trees' nodes in flat arrays; a leaf is its own child. roots: where each tree begins."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of quality for each row."""
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 2.0, falling: tuple[int, ...] = tuple(STATISTICS.index(f) for f in FALLING)) -> Forest:
    """Second-order boosting on histograms of the statistics' quantiles."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), start)
    nodes: list[list] = []  # feature, cut, left, right, value
    roots = []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, 0, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2:
            gs, hs = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - (gr * wr + 0.5 * (hr + ridge) * wr**2) + gs * value + 0.5 * (hs + ridge) * value**2
                bad = (hl < least) | (hr < least)
                if j in falling:
                    bad |= wl < wr
                gain[bad] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(wl[k]), float(wr[k]))
        if best[0] > 1e-6:
            _, j, k, wl, wr = best
            go = binned[rows, j] <= k
            middle = (wl + wr) / 2
            bounds = ((middle, high), (low, middle)) if j in falling else ((low, high), (low, high))
            nodes[me][:2] = [j, float(edges[j][k])]
            nodes[me][2] = split(rows[go], g, h, level + 1, *bounds[0])
            nodes[me][3] = split(rows[~go], g, h, level + 1, *bounds[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(split(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
        one = _flat(nodes, [roots[-1]], depth, 0.0)
        total += one.score(x)
    return _flat(nodes, roots, depth, start)


def _flat(nodes: list[list], roots: list[int], depth: int, start: float) -> Forest:
    f, c, a, b, v = zip(*nodes, strict=True)
    return Forest(np.array(f), np.array(c), np.array(a), np.array(b), np.array(v), np.array(roots), depth, start)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Forest | None:
    """The sampled labels are few by the bound, so they are sent to the documents and not the documents to them."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        return lambda ids, texts, quality: {"doc_id": ids, "quality": quality, "x": [measure(t)[1] for t in texts]}

    each = map_texts(known, "doc_id long, quality int, x array<double>", make, "quality").groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("m"))
    rows = sorted((r["doc_id"], r["quality"], *r["x"]) for r in each.select("doc_id", "m.*").collect())
    if not rows:
        return None
    table = np.array(rows, float)
    if len(np.unique(table[:, 1] >= 1)) < 2:
        warnings.warn("the labelled documents are all of one quality: the base rule alone decides", stacklevel=2)
        return None
    return grow(table[:, 2:], (table[:, 1] >= 1).astype(float))


def judge(forest: Forest | None, texts: list[str | None], least: float) -> dict[str, np.ndarray]:
    """FIELDS, base_failed, probability and kept of each text."""
    got = [measure(t) for t in texts]
    fields = np.array([a for a, _ in got], np.int64).reshape(-1, len(FIELDS))
    n, repeat = fields[:, 0], fields[:, 4]
    failed = (n < 10) | (100 * repeat > 20 * n)
    p = np.ones(len(got)) if forest is None or not got else 1 / (1 + np.exp(-forest.score(np.array([b for _, b in got]))))
    return {k: fields[:, i] for i, k in enumerate(FIELDS)} | {"base_failed": failed, "probability": p, "kept": ~failed & (p >= least)}


def score(docs: DataFrame, forest: Forest | None, least: float = 0.5) -> DataFrame:
    """doc_id, FIELDS, base_failed, probability (of quality), kept (base rule passed and probability >= least)."""

    def make():
        return lambda doc_ids, texts: {"doc_id": doc_ids} | judge(forest, texts, least)

    return map_texts(docs, f"doc_id long, {', '.join(f'{k} long' for k in FIELDS)}, base_failed boolean, probability double, kept boolean", make)


def select(docs: DataFrame, forest: Forest | None, least: float = 0.5) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns."""
    return selected(docs, lambda: lambda texts: judge(forest, texts, least)["kept"])
