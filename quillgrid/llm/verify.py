"""Exact likeness of candidate pairs, batch by batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import steps, texts_of
from .cores import distinct_windows


def likeness_of_pairs(a: list[str], b: list[str], n: int) -> np.ndarray:
    """Likeness by ``n`` of each pair of texts, from one sort of all their windows."""
    out = np.zeros(len(a))
    for x, y in steps([p + q for p, q in zip(a, b, strict=True)]):
        tokens, owner = distinct_windows(a[x:y] + b[x:y], n)
        size = y - x
        pair = owner % size
        na = np.bincount(pair[owner < size], minlength=size)
        nb = np.bincount(pair[owner >= size], minlength=size)
        key = (pair.astype(np.uint64) << np.uint64(44)) | tokens
        key.sort()
        both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(44)).astype(np.int64), minlength=size)
        some = (na > 0) & (nb > 0)
        out[x:y][some] = both[some] / (na + nb - both)[some]
    return out


def with_likeness(pairs: DataFrame, left: str, right: str, n: int) -> DataFrame:
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(likeness_of_pairs(texts_of(a), texts_of(b), n))

    return pairs.withColumn("likeness", score(left, right))
