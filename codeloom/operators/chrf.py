"""Character n-gram F-score of generated text. Each pair is scored within its row: nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ORDERS, BETA = 6, 2


def score(ref: str, hyp: str) -> float:
    """0 to 1; precision and recall are averaged over the orders that both sides have. White space does not count."""
    a, b = (np.frombuffer("".join(t.split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (ref, hyp))
    precision, recall = [], []
    grams = [a, b]  # numbers of the n-grams at each place, equal for equal n-grams
    for n in range(1, ORDERS + 1):
        if n > 1:
            grams = [g[:-1] << 21 | c[n - 1 :] for g, c in zip(grams, (a, b), strict=True)]
        if not all(map(len, grams)):
            break
        _, number = np.unique(np.concatenate(grams), return_inverse=True)
        grams = [number[: len(grams[0])], number[len(grams[0]) :]]
        size = int(number.max()) + 1
        both = int(np.minimum(*(np.bincount(g, minlength=size) for g in grams)).sum())
        precision.append(both / len(grams[1]))
        recall.append(both / len(grams[0]))
    if not precision or not any(precision):
        return 0.0
    p, r = float(np.mean(precision)), float(np.mean(recall))
    return (1 + BETA**2) * p * r / (BETA**2 * p + r)


@F.pandas_udf(DoubleType())
def chrf_score(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """A null counts as empty."""
    return pd.Series([score(r or "", h or "") for r, h in zip(ref, hyp, strict=True)], dtype="float64")


def chrf(pairs: DataFrame) -> DataFrame:
    """id, chrf (0 to 1, four digits) of pairs (id, ref, hyp)."""
    return pairs.select("id", F.round(chrf_score("ref", "hyp"), 4).alias("chrf"))
