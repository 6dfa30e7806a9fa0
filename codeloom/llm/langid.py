"""Operator 2: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Training: document frequencies are counted over all labelled learning documents; the model is fitted with FTRL-Proximal (L1 and
L2 penalties) on a bounded sample (`sample` documents, equally many from each language, chosen by a hash of doc_id), of which a
fifth calibrates the temperature. Prediction: one pass over whole texts; n-grams of one, two and three letters are hashed to
2**15 features, whose weights are summed without building a vector.

Every language with a learning document is learned; the model takes 0.5 MB for each on the driver while it is fitted, so columns of
many thousand languages need a larger driver. Ties between languages go to the first by name, equal hashes in the sample to the
first language by name. Texts of any length are read whole. No documents give no rows. Null texts and texts without a letter get 'und' and score 0. Rows with null lang take no part in training; null doc_id counts as
not held out for prediction and takes no part in training. Repeated rows get equal answers. With no labelled document every text
gets 'und'. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import map_texts, share

BITS = 15
SIZE = 1 << BITS
ORDERS = (1, 2, 3)
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _letters() -> np.ndarray:
    """Each code point: itself if a letter, else a space."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[~np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)] = 32
    return table


class Grams:
    """Hashed n-grams of many texts at once; a text is lower-cased and what is no letter becomes a space."""

    def __init__(self):
        self.table = _letters()

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each order the features at every place, the texts' bounds, and whether each has a letter."""
        low = [" " + t.lower() + "  " for t in texts]
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in low])])
        points = self.table[points]
        some = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        hashed, mixed = [], np.zeros(len(points), np.uint32)
        for n in ORDERS:
            after = np.roll(points, 1 - n)  # past a text's end come its own two spaces
            mixed = (mixed + after * MIX[n - 1]) * np.uint32(0x27D4EB2F)
            mixed ^= mixed >> np.uint32(15)
            hashed.append((mixed * np.uint32(0x165667B1) >> np.uint32(32 - BITS)).astype(np.int32))
        return hashed, bounds, some


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # SIZE x languages, times the inverse document frequency
    bias: np.ndarray
    temperature: float
    documents: int

    def predict(self, grams: Grams, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts or not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        hashed, bounds, some = grams(texts)
        total = np.zeros((len(texts), len(self.langs)))
        for h in hashed:
            for c in range(len(self.langs)):
                total[:, c] += np.add.reduceat(self.weights[:, c][h], bounds[:-1], dtype=np.float64)
        logits = (total / np.maximum(len(ORDERS) * np.diff(bounds), 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, p.max(1), 0.0)


def learning(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))


def document_frequencies(docs: DataFrame, merge: int = 8) -> tuple[np.ndarray, int]:
    """How many documents hold each feature: counts by task, added up by a few tasks, then by the driver."""

    def count(batches):
        grams, df, n = Grams(), np.zeros(SIZE, np.int64), 0
        seen = np.zeros(SIZE, bool)
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                hashed, bounds, _ = grams(texts[at : at + 256])
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    seen[:] = False
                    for h in hashed:
                        seen[h[s:e]] = True
                    df += seen
                n += len(bounds) - 1
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "df": [df.tobytes()]})

    def add(batches):
        df, n = np.zeros(SIZE, np.int64), 0
        for b in batches:
            for m, x in zip(b.column("n").to_pylist(), b.column("df").to_pylist(), strict=True):
                df += np.frombuffer(x, np.int64)
                n += m
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "df": [df.tobytes()]})

    rows = docs.select("text").mapInArrow(count, "n long, df binary").repartition(merge).mapInArrow(add, "n long, df binary").collect()
    return sum((np.frombuffer(r["df"], np.int64) for r in rows), np.zeros(SIZE, np.int64)), sum(r["n"] for r in rows)


def sampled(docs: DataFrame, sample: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, features, shares) of the sample; at most `sample` sparse rows (one of each language at least) of bounded length reach
    the driver."""
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return []
    per = max(1, sample // len(counts))
    part = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * per / n))))
    chosen = docs.where(F.col("lang").isin([*counts]) & (share("doc_id") < part[F.col("lang")])).withColumn("order", F.xxhash64("doc_id"))

    def make():
        grams = Grams()

        def f(doc_ids, texts, langs, order):
            hashed, bounds, _ = grams(texts)
            out = {"lang": langs, "order": order, "features": [], "shares": []}
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                i, c = np.unique(np.concatenate([h[s:e] for h in hashed]), return_counts=True)
                out["features"].append(i.astype(np.int32).tobytes())
                out["shares"].append((c / c.sum()).astype(np.float32).tobytes())
            return out

        return f

    rows = map_texts(chosen, "lang string, order long, features binary, shares binary", make, "lang", "order").collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["order"], r["lang"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per:
            out.append((r["lang"], np.frombuffer(r["features"], np.int32), np.frombuffer(r["shares"], np.float32)))
    return out


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 4) -> np.ndarray:
    """Weights (SIZE + 1) x classes, the last row the bias."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for y, i, x in rows:
            w = weights(i)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(slice(None))


def fit(docs: DataFrame, sample: int = 2000, scale: float = 20.0) -> Model:
    """docs: doc_id, text, lang; the rest is chosen by learning()."""
    known = learning(docs)
    df, n = document_frequencies(known)
    rows = sampled(known, sample)
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((SIZE, 0)), np.zeros(0), 1.0, n)
    idf = np.log((1 + n) / (1 + df)) + 1
    ready = [(langs.index(lang), np.append(i, SIZE), np.append(x * idf[i] * scale, 1.0)) for lang, i, x in rows]
    held = ready[::5] if len(ready) >= 50 else []
    weights = ftrl([r for k, r in enumerate(ready) if not held or k % 5], len(langs))
    temperature = 1.0
    if held:
        logits, truth = np.array([x @ weights[i] for _, i, x in held]), np.array([y for y, _, _ in held])

        def loss(t: float) -> float:
            s = logits / t
            s = s - s.max(1, keepdims=True)
            nll = np.log(np.exp(s).sum(1))[:, None] - s
            true = nll[np.arange(len(s)), truth]
            few = 1 / (len(s) + 2)  # as if one more document were wrong: a sample without errors gives no certainty
            return float(((1 - few) * true + few * (nll.sum(1) - true) / max(1, s.shape[1] - 1)).mean())

        temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    return Model(langs, (weights[:-1] * idf[:, None] * scale).astype(np.float32), weights[-1], temperature, n)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def make():
        grams = Grams()

        def f(doc_ids, texts):
            pred, score = [], []
            for at in range(0, len(texts), 256):
                p, s = model.predict(grams, [t or "" for t in texts[at : at + 256]])
                pred += p
                score += s.tolist()
            return {"doc_id": doc_ids, "lang_pred": pred, "score": score}

        return f

    out = map_texts(docs, "doc_id long, lang_pred string, score double", make)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
