"""Vectors in shards: validity, indexes as rows, and blocks of queries against every shard."""

from __future__ import annotations

import io
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytewright.plans.scratch import materialize


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as f:
        return {k: f[k] for k in f.files}


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def against_shards(
    rows: DataFrame,
    queries: DataFrame,
    build: Callable[[pd.DataFrame, int], bytes],
    search: Callable[[dict[str, np.ndarray], pd.DataFrame, int], pd.DataFrame],
    schema: str,
    shard_rows: int,
    block_rows: int,
    least_tasks: int = 12,
    few_rows: int = 2_000,
) -> DataFrame:
    """Every query against every shard.

    ``rows`` and ``queries`` have id and v (array<double>); vectors of different lengths never meet. Rows go to shards
    of up to about ``shard_rows`` by a hash of their id; ``build`` makes a shard's index, which is written as one row
    of the shared folder. Queries go to blocks of about ``block_rows``; each pair of a shard and a block is one task's
    work, of bounded size. Smaller tables are cut for ``least_tasks`` tasks, but not into shards below ``few_rows``."""
    n_rows, n_queries = rows.count(), queries.count()
    shards = max(math.ceil(n_rows / shard_rows), min(least_tasks, n_rows // few_rows), 1)
    blocks = max(math.ceil(n_queries / block_rows), math.ceil(least_tasks / shards) if n_queries > least_tasks else 1)
    dealt = rows.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def built(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "blob": [build(part, int(key[1]))]})

    index = materialize(dealt.groupBy("dim", "shard").applyInPandas(built, "dim int, shard int, blob binary"), "index")

    def searched(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")})
        return search(unpacked(left["blob"].iloc[0]), right, int(key[1]))

    asked = queries.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    offered = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ("dim", "shard", "block")
    return offered.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(searched, schema)
