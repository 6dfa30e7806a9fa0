"""Operator 1: quality by ordinal cumulative-link regression on graded ratings.

Grades come from `labels`: 0 for quality 0, 1 for quality 1 that is toxic, 2 for quality 1 that is not. One weight vector over
hashed text features and ordered thresholds give P(grade > k) = 1 / (1 + exp(threshold[k] - score)); from these come the expected
grade and the tail probability by which documents are selected.

Features are the words' letters in lower case, the words' marks and shapes (capitals, digits), and buckets of the shares of
repeated words, marks and capitals, all hashed to 2**16; a document's vector holds 1 + log(count), scaled to length 1. Words that
the sample has mostly in toxic documents are also counted as such, without scaling, so a long text does not dilute a few of them.
The model is fitted on a bounded sample (`sample` labelled documents chosen by a hash of doc_id); every document is scored.

Ties: a tail equal to the threshold is kept; labels of equal hash are taken in the order of doc_id. A text of any length is read
whole, word by word. No documents give no rows, and no model where none is labelled. Null text counts as empty. Empty or blank text has no features and gets the lowest grade: expected grade 0, tail 0, not kept.
Labels with null quality are skipped, null toxic counts as 0, several labels of one document count as its lowest grade. Without
labels every document with a word is kept (expected grade 2, tail 1). Of rows that share a doc_id one is learnt from, the one with
the smallest features, so the driver gets no more rows than labels. Repeated rows get equal answers; extra columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import Cache, map_texts, selected

BITS = 16
SIZE = 1 << BITS
GRADES = 3
BUCKETS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


#: A strong feature is in STRONG toxic sample documents or more, and in ODDS times the share of them as of grade-2 documents.
STRONG, ODDS = 10, 10


def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) >> (32 - BITS)


def word_features(word: str) -> bytes:
    """Slots of a word's letters, marks and shape, then 0/1 for: has marks, is all capitals (as 32-bit numbers)."""
    core = word.strip("\"'()[]{}.,;:!?%&*$#|<>-_/\\=+~^@")
    at = word.find(core) if core else 0
    marks = word[:at] + word[at + len(core) :] if core else word
    slots = []
    if core:
        slots.append(slot("w " + (core.lower() if core.isalpha() else "".join("0" if c.isdigit() else c for c in core.lower()))))
    odd = marks.strip(".,")
    if odd:
        slots.append(slot("m " + odd))
    upper = len(core) > 1 and core.isupper()
    if upper:
        slots.append(slot("s upper"))
    return np.array([len(slots), *slots, *[0] * (3 - len(slots)), bool(odd), upper], np.uint32).tobytes()


class Features:
    """Sparse rows: slots and values of each text."""

    def __init__(self):
        self.words = Cache(word_features)
        self.shares = [[slot(f"{name} {k}") for k in range(len(BUCKETS) + 1)] for name in ("repeated", "marks", "capitals", "same as before")]

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        got = np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.uint32).reshape(-1, 6)
        first = got[:, 1]
        used = np.concatenate([first[got[:, 0] > 0], got[:, 2][got[:, 0] > 1], got[:, 3][got[:, 0] > 2]])
        slots, counts = np.unique(used, return_counts=True)
        n = len(words)
        same = np.count_nonzero(first[1:] == first[:-1]) / n
        measured = (1 - len(set(words)) / n if n >= 20 else 0.0, got[:, 4].sum() / n, got[:, 5].sum() / n, same)
        extra = [s[k] for s, k in zip(self.shares, np.searchsorted(BUCKETS, measured), strict=True)]
        values = 1 + np.log(counts)
        values = values / np.sqrt((values * values).sum()) if len(values) else values
        return np.concatenate([slots, extra]).astype(np.int64), np.concatenate([values, np.full(len(extra), 0.3)])


COUNTS = np.array([slot(f"strong {k}") for k in range(4)])


def strong_slots(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each slot, whether it is a strong feature."""
    held, n = np.zeros((GRADES, SIZE)), np.zeros(GRADES)
    for grade, i, _ in rows:
        held[grade, np.unique(i)] += 1
        n[grade] += 1
    share = (held + 0.5) / (n[:, None] + 1)
    return (held[1] >= STRONG) & (share[1] >= ODDS * share[2])


def with_strong(strong: np.ndarray, i: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sparse row with the number of its strong words (up to 3) as a feature of value 1."""
    words = i[: max(0, len(i) - 4)]  # the last four are the shares
    return np.append(i, COUNTS[min(3, int(strong[words].sum()))]), np.append(x, 1.0)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # rising
    strong: np.ndarray  # by slot

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.4, penalty: float = 1e-6) -> Ordinal:
    """AdaGrad on the likelihood of the grades; the gap between thresholds is an exponential, so their order holds."""
    strong = strong_slots(rows)
    rows = [(grade, *with_strong(strong, i, x)) for grade, i, x in rows]
    w, n = np.zeros(SIZE), np.full(SIZE, 1e-2)
    shape, m = np.array([-1.0, 0.0]), np.full(2, 1e-2)  # lowest threshold, log of the gap
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for k in order.tolist():
            grade, i, x = rows[k]
            score = float(w[i] @ x)
            t = np.array([shape[0], shape[0] + np.exp(shape[1])])
            s = 1 / (1 + np.exp(np.clip(t - score, -60, 60)))  # P(grade > k)
            d = s * (1 - s)
            p = max(1e-9, (1 - s[0], s[0] - s[1], s[1])[grade])
            # dP/dscore and dP/dthresholds
            ds = (-d[0], d[0] - d[1], d[1])[grade]
            dt = np.array(((d[0], 0.0), (-d[0], d[1]), (0.0, -d[1]))[grade])
            g = -ds / p * x + penalty * w[i]
            n[i] += g * g
            w[i] -= rate * g / np.sqrt(n[i])
            h = -np.array([dt.sum(), dt[1] * np.exp(shape[1])]) / p
            m += h * h
            shape -= 0.1 * h / np.sqrt(m)
    return Ordinal(w, np.array([shape[0], shape[0] + np.exp(shape[1])]), strong)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade."""
    grade = F.when(F.col("quality") < 1, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) >= 1, 1).otherwise(2)
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Ordinal | None:
    """The sampled labels are few by the bound, so they are sent to the documents and not the documents to them."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        features = Features()

        def f(doc_ids, texts, grades):
            got = [features(t or "") for t in texts]
            return {"doc_id": doc_ids, "grade": grades, "slots": [i.astype(np.int32).tobytes() for i, _ in got], "values": [x.astype(np.float32).tobytes() for _, x in got]}

        return f

    each = map_texts(known, "doc_id long, grade int, slots binary, values binary", make, "grade").where("length(slots) > 0")
    rows = each.groupBy("doc_id").agg(F.min(F.struct("grade", "slots", "values")).alias("x")).select("doc_id", "x.*").collect()
    rows = sorted(((r["doc_id"], r["grade"], r["slots"], r["values"]) for r in rows), key=lambda r: r[:3])
    ready = [(g, np.frombuffer(i, np.int32), np.frombuffer(x, np.float32).astype(float)) for _, g, i, x in rows]
    return train(ready) if ready else None


def scorer(model: Ordinal | None):
    """f(texts) -> P(grade > k) of each text (rows) and k."""
    features = Features()

    def f(texts: list[str | None]) -> np.ndarray:
        got = [features(t or "") for t in texts]
        some = np.array([len(i) > 0 for i, _ in got], bool)
        if model is None:
            above = np.ones((len(got), GRADES - 1))
        else:
            above = model.above(np.array([model.weights[i] @ x for i, x in (with_strong(model.strong, *r) for r in got)]))
        return np.where(some[:, None], above, 0.0)

    return f


def score(docs: DataFrame, model: Ordinal | None, least: float = 0.5, grade: int = 2) -> DataFrame:
    """doc_id, expected_grade, tail (P(grade >= `grade`)), kept (tail >= least)."""

    def make():
        above_of = scorer(model)

        def f(doc_ids, texts):
            above = above_of(texts)
            tail = above[:, grade - 1]
            return {"doc_id": doc_ids, "expected_grade": above.sum(1), "tail": tail, "kept": tail >= least}

        return f

    return map_texts(docs, "doc_id long, expected_grade double, tail double, kept boolean", make)


def select(docs: DataFrame, model: Ordinal | None, least: float = 0.5, grade: int = 2) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns."""

    def make():
        above_of = scorer(model)
        return lambda texts: above_of(texts)[:, grade - 1] >= least

    return selected(docs, make)
