"""Optimal prefix codes of limited length, by group, from histograms in long form (group, symbol, n)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewright.plans.columns import pick

LIMIT = 15


def code_lengths(counts: Sequence[int], limit: int = LIMIT) -> list[int]:
    """Lengths of an optimal code of at most ``limit`` bits by package-merge; 0 for counts of 0, 1 for a lone symbol."""
    order = sorted((n, s) for s, n in enumerate(counts) if n > 0)
    lengths = np.zeros(len(counts), np.int64)
    if len(order) < 2:
        lengths[[s for _, s in order]] = 1
        return lengths.tolist()
    if 1 << limit < len(order):
        raise ValueError("more symbols than codes")
    weights, used = np.array([n for n, _ in order], np.int64), np.eye(len(order), dtype=np.int32)
    w, u = weights, used
    for _ in range(limit - 1):
        n = len(w) // 2 * 2
        w, u = np.concatenate([weights, w[0:n:2] + w[1:n:2]]), np.concatenate([used, u[0:n:2] + u[1:n:2]])
        by = np.argsort(w, kind="stable")
        w, u = w[by], u[by]
    lengths[[s for _, s in order]] = u[: 2 * len(order) - 2].sum(axis=0)
    return lengths.tolist()


def canonical_codes(lengths: Sequence[int]) -> list[int]:
    """Codes in order of length, then symbol; 0 for symbols without one."""
    codes, code, last = [0] * len(lengths), 0, 0
    for length, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - last
        codes[s], code, last = code, code + 1, length
    return codes


def prefix_codes(histogram: DataFrame, group: str, symbol: str = "byte", n: str = "n", limit: int = LIMIT) -> DataFrame:
    """(group, symbol, n, length, code). A group holds an alphabet, so it fits in a task whatever was counted."""
    kind = histogram.schema[group].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("symbol")
        lengths = code_lengths(rows["n"].tolist(), limit)
        return rows.assign(length=lengths, code=canonical_codes(lengths))

    rows = pick(histogram, group, symbol, n).toDF(group, "symbol", "n").select(group, F.col("symbol").cast("int"), F.col("n").cast("long"))
    return rows.groupBy(group).applyInPandas(run, f"`{group}` {kind}, symbol int, n long, length int, code int")
