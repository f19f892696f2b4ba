"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

Inner products become distances by one more component: with R the largest norm, x gets sqrt(R^2 - |x|^2) and a query 0,
and |q - x|^2 = |q|^2 + R^2 - 2 <q, x>. A tree halves its rows by their distance from a vantage point until ``LEAF`` or
fewer are left, and keeps, for both halves, the least and largest distance. For a query the triangle inequality gives
each leaf a lower bound; the nearest two leaves by that bound are scanned, then all leaves whose bound times
``factor`` is below the k-th distance found so far. A factor of one is exact; a larger one prunes more. With ``FACTOR``
recall against brute force is measured in the tests.

Every row is indexed; shards and blocks of queries are bounded. Scores are inner products of the original vectors in
double precision; rows that tie with the k-th are all compared, so ties go to the smaller id.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an
id or of another length than the query; of rows that repeat an id the smallest vector counts; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytewright.llm.vectors import against_shards, matrix, packed, usable
from bytewright.plans.columns import pick
from bytewright.sources.tables import table

NAME = "op6_vptree"
K, EVERY, FACTOR, LEAF = 20, 20, 1.05, 128
SHARD_ROWS, BLOCK_ROWS = 200_000, 20_000


def build_tree(x: np.ndarray, radius: float, seed: int, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """``x`` reordered so that leaves are runs (``order``, ``leaf_start``), and for each leaf and each of its vantage
    points the range of distances: ``owner``, ``vantage``, ``low``, ``high``."""
    rng = np.random.default_rng(seed)
    full = np.hstack([x, np.sqrt(np.maximum(radius**2 - (x**2).sum(1), 0))[:, None]])
    order, starts, vantages, ranges = [], [0], [], []
    stack: list[tuple[np.ndarray, list]] = [(np.arange(len(x)), [])]
    while stack:
        rows, path = stack.pop()
        if len(rows) <= leaf:
            order.append(rows)
            ranges += [(len(starts) - 1, *p) for p in path]
            starts.append(starts[-1] + len(rows))
            continue
        point = full[rng.choice(rows)]
        d = np.sqrt(((full[rows] - point) ** 2).sum(1))
        by = np.argsort(d, kind="stable")
        half = len(rows) // 2
        for side in (by[half:], by[:half]):
            stack.append((rows[side], [*path, (len(vantages), d[side].min(), d[side].max())]))
        vantages.append(point)
    owner, vantage, low, high = (np.array(c) for c in zip(*ranges, strict=True)) if ranges else (np.zeros(0, int),) * 4
    return {"order": np.concatenate(order), "leaf_start": np.array(starts), "points": np.array(vantages).reshape(-1, full.shape[1]), "owner": owner, "vantage": vantage, "low": low, "high": high}


def search_tree(tree: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, radius: float, k: int, factor: float, scanned: list[float] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, scores) of its k nearest, best first. ``x`` and ``ids`` are in leaf order. ``scanned`` gets the share of
    leaves that each query scanned."""
    starts, n = tree["leaf_start"], len(q)
    leaves = len(starts) - 1
    bound = np.zeros((n, leaves))
    reach = (q**2).sum(1) + radius**2
    if len(tree["points"]):
        far = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (tree["points"] ** 2).sum(1) - 2 * q @ tree["points"][:, :-1].T, 0))
        for o, v, low, high in zip(tree["owner"], tree["vantage"], tree["low"], tree["high"], strict=True):
            np.maximum(bound[:, o], np.maximum(far[:, v] - high, low - far[:, v]), out=bound[:, o])
    best = np.full((n, k), -np.inf)
    done = np.zeros((n, leaves), bool)
    kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]

    def scan(leaf: int, who: np.ndarray) -> None:
        a, b = starts[leaf], starts[leaf + 1]
        s = q[who] @ x[a:b].T
        s[q_ids[who][:, None] == ids[a:b]] = -np.inf
        done[who, leaf] = True
        rows, cols = np.nonzero(s >= best[who, -1][:, None] - 1e-9)
        both = np.concatenate([best[who], s], axis=1)
        best[who] = -np.partition(-both, k - 1, axis=1)[:, :k]
        best[who, -1] = best[who].min(1)
        cuts = np.searchsorted(rows, np.arange(len(who) + 1))
        for i, w in enumerate(who):
            if cuts[i] < cuts[i + 1]:
                c = cols[cuts[i] : cuts[i + 1]]
                kept[w].append((a + c, s[i, c]))

    first = np.argsort(bound, axis=1)[:, : min(2, leaves)]
    for leaf in range(leaves):
        if len(who := np.flatnonzero((first == leaf).any(1))):
            scan(leaf, who)
    for leaf in np.argsort(bound.mean(0)):
        limit = np.sqrt(np.maximum(reach - 2 * best[:, -1], 0))
        if len(who := np.flatnonzero(~done[:, leaf] & (bound[:, leaf] * factor <= limit))):
            scan(int(leaf), who)
    if scanned is not None:
        scanned.extend(done.mean(1).tolist())
    out = []
    for i in range(n):
        at = np.concatenate([a for a, _ in kept[i]]) if kept[i] else np.zeros(0, int)
        s = np.concatenate([b for _, b in kept[i]]) if kept[i] else np.zeros(0)
        at = at[(s >= best[i, -1] - 1e-9) & (s > -np.inf)]
        exact = (x[at] * q[i]).sum(1)  # one sum for all shards, so equal vectors tie
        top = np.lexsort((ids[at], -exact))[:k]
        out.append((ids[at][top], exact[top]))
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` and ``queries`` have id and v; returns query_id, rank, id, score. A row of the query's own id is none of
    its neighbours."""
    keep = lambda df: df.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows, queries = keep(rows), keep(queries).groupBy("id").agg(F.min("v").alias("v"))
    largest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    radius = float(np.sqrt(largest or 0.0))

    def build(part: pd.DataFrame, shard: int) -> bytes:
        part = part.assign(v=part["v"].map(tuple)).sort_values(["id", "v"]).drop_duplicates("id")
        x, ids = matrix(part["v"]), part["id"].to_numpy()
        tree = build_tree(x, radius, shard)
        return packed(x=x[tree["order"]], ids=ids[tree["order"]], **tree)

    def search(index: dict[str, np.ndarray], asked: pd.DataFrame, shard: int) -> pd.DataFrame:
        x, ids = index.pop("x"), index.pop("ids")
        q_ids = asked["id"].to_numpy()
        found = search_tree(index, x, ids, matrix(asked["v"]), q_ids, radius, k, factor)
        sizes = [len(a) for a, _ in found]
        return pd.DataFrame({"query_id": np.repeat(q_ids, sizes), "id": np.concatenate([a for a, _ in found]), "score": np.concatenate([s for _, s in found])})

    found = against_shards(rows, queries, build, search, "query_id long, id long, score double", shard_rows, block_rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose vec_id is divisible by 20: query_id, rank, vec_id, score."""
    rows = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").toDF("id", "v")
    return nearest(rows, rows.where(F.col("id") % EVERY == 0)).withColumnRenamed("id", "vec_id")
