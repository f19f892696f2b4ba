"""Near duplicates among embeddings: hierarchical navigable small-world graphs per shard.

Equal vectors are one node with a count. Nodes go to shards by a hash; each shard has a graph of its own, and every node
queries every shard. So there are no more shards than ``SHARD_ROWS`` calls for: small tables are spread over tasks by blocks of
queries, as a beam's cost hardly grows with its graph, but one more shard is one more beam for every node. A query's beam starts at ``BEAM`` and doubles, for all queries of a task, until an audit passes:
brute force over the shard takes queries at random until ``AUDIT`` of them have links to others than themselves, or all
are taken; of these links, and of each such query's on average, a share of ``RECALL`` at least must be among those found.
The rarer links are, the more queries are audited, up to all of a task. A query whose whole beam reaches the threshold widens on its own, and
where a beam wider than ``WIDEST``, or than a quarter of the shard, is called for, the query is compared with all of
the shard instead, so no number of partners is too large. All candidates are
verified by cosine in double precision.

Links are counted and united block by block of ``LOCKSTEP`` queries, and a block's pairs are dropped then: a task hands on
numbers of links and one link for each node of a component that it has seen, never all pairs. Components are unions over all tasks.

Many queries step through a graph together: each round expands the best unexpanded nodes of all beams. Graphs are
built layer by layer, in batches that search what stands already and each other; neighbours are chosen so that none is
nearer to a chosen one than to the node.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't meet; a row without vec_id stays, without links, component or kept; rows that repeat a vec_id
count as vectors of their own; an empty table gives an empty result; other columns, labels too, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright.llm.components import Forest, components
from bytewright.llm.vectors import against_shards, matrix, packed, usable
from bytewright.plans.columns import pick
from bytewright.plans.scratch import materialize
from bytewright.sources.tables import table

NAME = "op1_hnsw"
THRESHOLD, DEGREE, BUILD_BEAM, BEAM, AUDIT = 0.9, 12, 32, 32, 400
RECALL, WIDEST = 0.99, 128
SHARD_ROWS, BLOCK_ROWS, LOCKSTEP = 50_000, 50_000, 256


def _top(ids: np.ndarray, sims: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    by = np.argsort(-sims, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1), by


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int, at_once: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` most similar nodes that each query's beam meets, best first (-1 pads): ids and similarities.
    ``links``: neighbours by node, -1 pads. ``entry``: nodes to start at, by query."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True
    sims = np.where(entry >= 0, np.einsum("qed,qd->qe", x[entry], q), -np.inf)
    seen[rows, entry] = True
    ids, sims, _ = _top(entry, sims, width)
    open_ = ids >= 0
    while True:
        live = np.flatnonzero(open_.any(1))
        if not len(live):
            return ids, sims
        order = np.where(open_[live], sims[live], -np.inf)
        pick_ = np.argsort(-order, axis=1, kind="stable")[:, :at_once]
        chosen = np.where(np.take_along_axis(order, pick_, 1) > -np.inf, np.take_along_axis(ids[live], pick_, 1), -1)
        open_[live[:, None], pick_] = False
        near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(live), -1)
        near = np.where(seen[live[:, None], near], -1, near)
        seen[live[:, None], near] = True
        seen[:, -1] = True
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        keep = max(1, int((near >= 0).sum(1).max()))
        near = -np.sort(-near, axis=1)[:, :keep]
        s = np.where(near >= 0, np.einsum("qed,qd->qe", x[near], q[live]), -np.inf)
        all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], s], 1)
        fresh = np.concatenate([open_[live], near >= 0], 1)
        new_ids, new_sims, by = _top(all_ids, all_sims, width)
        w = new_ids.shape[1]
        if w > ids.shape[1]:
            pad = ((0, 0), (0, w - ids.shape[1]))
            ids, sims, open_ = np.pad(ids, pad, constant_values=-1), np.pad(sims, pad, constant_values=-np.inf), np.pad(open_, pad)
        ids[live], sims[live], open_[live] = -1, -np.inf, False
        ids[live[:, None], np.arange(w)], sims[live[:, None], np.arange(w)] = new_ids, new_sims
        open_[live[:, None], np.arange(w)] = np.take_along_axis(fresh, by, 1) & (new_ids >= 0)


def _spread(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of candidates, best first, those no nearer to a chosen one than to the node, then the best of the others."""
    n, c = ids.shape
    vectors = x[ids]
    between = np.einsum("ncd,nkd->nck", vectors, vectors)
    chosen = np.zeros((n, c), bool)
    for j in range(c):
        close = (chosen[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(1)
        chosen[:, j] = (ids[:, j] >= 0) & ~close & (chosen[:, :j].sum(1) < degree)
    rank = np.where(ids < 0, 2, np.where(chosen, 0, 1))
    by = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(ids, by, 1)


def _layer(x: np.ndarray, members: np.ndarray, above: list[np.ndarray], degree: int) -> np.ndarray:
    """Links of one layer. ``members``: its nodes, those of the layers above first."""
    most = 2 * degree
    links = np.full((len(x) + 1, most), -1, np.int32)
    used = np.zeros(len(x) + 1, np.int64)
    at, size = 0, 16
    while at < len(members):
        batch = members[at : at + size]
        b = len(batch)
        sims = x[batch] @ x[batch].T
        sims[np.tril_indices(b)] = -np.inf
        sims = sims.T  # each sees those before it in the batch
        ids, s, _ = _top(np.broadcast_to(batch, (b, b)), sims, BUILD_BEAM)
        ids = np.where(s > -np.inf, ids, -1)
        if at:
            entry = descend(x, above, x[batch]) if above else np.full((b, 1), members[0])
            found, f = beam_search(x, links, x[batch], entry, BUILD_BEAM)
            ids, s, _ = _top(np.concatenate([found, ids], 1), np.concatenate([f, s], 1), BUILD_BEAM)
        chosen = _spread(x, ids, s, degree)
        links[batch, : chosen.shape[1]] = chosen
        used[batch] = (chosen >= 0).sum(1)
        ends, begins = chosen.ravel(), np.repeat(batch, chosen.shape[1])
        begins, ends = begins[ends >= 0], ends[ends >= 0]
        by = np.argsort(ends, kind="stable")
        begins, ends = begins[by], ends[by]
        nodes, first, counts = np.unique(ends, return_index=True, return_counts=True)
        spot = used[ends] + np.arange(len(ends)) - np.repeat(first, counts)
        fits = spot < most
        links[ends[fits], spot[fits]] = begins[fits]
        used[nodes] = np.minimum(used[nodes] + counts, most)
        over = np.flatnonzero(~np.isin(nodes, ends[fits]) | np.isin(nodes, ends[~fits]))
        if len(over):
            wide = np.full((len(over), most + int(counts[over].max())), -1, np.int64)
            for i, o in enumerate(over):
                own = np.concatenate([links[nodes[o]], begins[first[o] : first[o] + counts[o]]])
                own = np.unique(own[own >= 0])
                wide[i, : len(own)] = own
            s = np.where(wide >= 0, np.einsum("ncd,nd->nc", x[wide], x[nodes[over]]), -np.inf)
            ids, s, _ = _top(wide, s, most + 8)
            kept = _spread(x, ids, s, degree + degree // 2)
            links[nodes[over]] = -1
            links[nodes[over], : kept.shape[1]] = kept
            used[nodes[over]] = (kept >= 0).sum(1)
        at, size = at + b, min(256, 2 * size)
    return links[:-1]


def descend(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """The node at which each query enters the layer below ``layers`` (top first), as one column."""
    entry = np.full((len(q), 1), -1)
    for number, layer in enumerate(layers):
        if number == 0:
            entry = np.full((len(q), 1), int(layer[-1, 0]))
        entry = beam_search(x, layer[:-1], q, entry, 1, 1)[0]
    return entry


def build_graph(x: np.ndarray, degree: int = DEGREE, seed: int = 0) -> list[np.ndarray]:
    """Layers of links, top first, over unit vectors. Above the ground layer, the last row holds the entry node."""
    rng = np.random.default_rng(seed)
    level = np.minimum(np.floor(-np.log(1 - rng.random(len(x))) / np.log(degree)).astype(int), 8)
    order = np.lexsort((np.arange(len(x)), -level))
    layers: list[np.ndarray] = []
    for height in range(int(level.max()), -1, -1):
        members = order[level[order] >= height]
        made = _layer(x, members, layers, degree)
        if height:
            made = np.vstack([made, np.full((1, made.shape[1]), members[0], made.dtype)])
        layers.append(made)
    if len(layers) == 1:
        layers.insert(0, np.vstack([np.full_like(layers[0], -1), np.full((1, layers[0].shape[1]), order[0], layers[0].dtype)]))
    return layers


def partners(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all similarities of at least ``threshold`` that are found; each query widens by need."""
    found_q, found_x = [], []
    todo = np.arange(len(q))
    entry = descend(x, layers[:-1], q)
    while len(todo):
        if beam > WIDEST or 4 * beam >= len(x):
            for a in range(0, len(todo), LOCKSTEP):
                r, c = np.nonzero(q[todo[a : a + LOCKSTEP]] @ x.T >= threshold - 1e-5)
                found_q.append(todo[a + r])
                found_x.append(c)
            break
        wider = []
        for a in range(0, len(todo), LOCKSTEP):
            part = todo[a : a + LOCKSTEP]
            ids, sims = beam_search(x, layers[-1], q[part], entry[part], beam)
            good = (sims >= threshold - 1e-5) & (ids >= 0)
            full = good.sum(1) >= beam
            good[full] = False
            r, c = np.nonzero(good)
            found_q.append(part[r])
            found_x.append(ids[r, c])
            wider.append(part[full])
        todo, beam = np.concatenate(wider), 2 * beam
    return np.concatenate(found_q), np.concatenate(found_x)


def audited(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, threshold: float, beam: int = BEAM, audit: int = AUDIT, own: np.ndarray | None = None) -> int:
    """The beam, doubled from ``beam`` on, with which the audit passes. ``own``: each query's own node (-1: none)."""
    own = np.full(len(q), -1) if own is None else own
    order = np.random.default_rng(0).permutation(len(q))
    true, at = np.zeros(len(q), np.int64), 0
    while at < len(order) and np.count_nonzero(true) < audit and not (beam > WIDEST or 4 * beam >= len(x)):
        some = order[at : at + LOCKSTEP]
        near = q[some] @ x.T >= threshold + 1e-5
        held = own[some] >= 0
        near[np.flatnonzero(held), own[some[held]]] = False
        true[some] = near.sum(1)
        at += len(some)
    linked = np.flatnonzero(true)
    while not (beam > WIDEST or 4 * beam >= len(x)):
        got = np.zeros(len(linked), np.int64)
        for a in range(0, len(linked), LOCKSTEP):
            some = linked[a : a + LOCKSTEP]
            who, what = partners(x, layers, q[some], threshold, beam)
            got[a : a + LOCKSTEP] = np.bincount(who[own[some][who] != what], minlength=len(some))
        got = np.minimum(got, true[linked])
        if got.sum() >= RECALL * true.sum() and (got / true[linked]).sum() >= RECALL * len(linked):
            break
        beam *= 2
    return beam


class Labels:
    """Components of ``n`` things, united pair by pair in arrays."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.of[a], self.of[b]
        apart = a != b
        if apart.any():
            pairs = np.unique(np.stack([a[apart], b[apart]], 1), axis=0)
            forest = Forest()
            for x, y in pairs.tolist():
                forest.join(x, y)
            new = np.arange(len(self.of))
            for x, y in forest.links():
                new[x] = y
            self.of = new[self.of]

    def links(self, ids: np.ndarray) -> np.ndarray:
        """(id, id of the first of its component) of all that aren't the first."""
        more = np.flatnonzero(self.of != np.arange(len(self.of)))
        return np.stack([ids[more], ids[self.of[more]]], 1)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``rows`` has id and v. Returns (id, key), the rows' nodes, and (key, node, copies, linked, component): nodes by numbers of
    their own, how many rows each stands for, how many rows its links reach, and the smallest id of its component."""
    rows = rows.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("key", F.struct(F.xxhash64("v").alias("h"), F.hash("v").alias("g"), F.size("v").alias("n")))
    nodes = rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")

    def unit(v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(1, keepdims=True)
        return v / np.sqrt((v**2).sum(1, keepdims=True))

    def build(part: pd.DataFrame, shard: int) -> bytes:
        part = part.sort_values("id")
        v = matrix(part["v"])
        with np.errstate(over="ignore"):
            short = v.astype(np.float32)
        layers = build_graph(unit(v).astype(np.float32), seed=shard)
        return packed(v=short if (short == v).all() else v, ids=part["id"].to_numpy(), copies=part["copies"].to_numpy(), **{f"layer{i}": a for i, a in enumerate(layers)})

    def search(index: dict[str, np.ndarray], asked: pd.DataFrame, shard: int) -> pd.DataFrame:
        layers = [index[f"layer{i}"] for i in range(len(index) - 3)]
        ids, q_ids, x, q = index["ids"], asked["id"].to_numpy(), unit(index["v"].astype(np.float64)), unit(matrix(asked["v"]))
        at = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)  # a shard's ids are in order
        own = np.where(ids[at] == q_ids, at, -1)
        low, low_q = x.astype(np.float32), q.astype(np.float32)
        beam = audited(low, layers, low_q, threshold, own=own)
        labels, reach = Labels(len(x) + len(q)), np.zeros(len(q), np.int64)
        labels.join(np.flatnonzero(own >= 0) + len(x), own[own >= 0])
        for at in range(0, len(q), LOCKSTEP):
            who, what = partners(low, layers, low_q[at : at + LOCKSTEP], threshold, beam)
            who = who + at
            other = own[who] != what
            who, what = who[other], what[other]
            exact = np.concatenate([np.zeros(0, bool)] + [(q[who[a : a + 65536]] * x[what[a : a + 65536]]).sum(1) >= threshold for a in range(0, len(who), 65536)])
            who, what = who[exact], what[exact]
            reach += np.bincount(who, index["copies"][what], len(q)).astype(np.int64)
            labels.join(who + len(x), what)
        links = labels.links(np.concatenate([ids, q_ids]))
        links = links[links[:, 0] != links[:, 1]]
        some = reach > 0
        return pd.DataFrame({"a": np.concatenate([links[:, 0], q_ids[some]]), "b": np.concatenate([links[:, 1], q_ids[some]]), "reach": np.concatenate([np.zeros(len(links), np.int64), reach[some]])})

    vectors = nodes.select("id", "v", "copies")
    found = materialize(against_shards(vectors, vectors.drop("copies"), build, search, "a long, b long, reach long", shard_rows, block_rows, few_rows=shard_rows), "found")
    reach = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("reach").alias("reach"))
    groups = materialize(components(found.where("a != b")).withColumnRenamed("node", "id"), "groups")
    least = materialize(groups.join(nodes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
    whole = groups.join(least, "component").select("id", "smallest")
    out = nodes.select("key", "id", "least", "copies").join(reach, "id", "left").join(whole, "id", "left")
    out = out.select("key", F.col("id").alias("node"), "copies", F.coalesce("reach", F.lit(0)).alias("linked"), F.coalesce("smallest", "least").alias("component"))
    return rows.select("id", "key"), out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings: vec_id, n_links, component_id, kept."""
    rows = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").toDF("id", "v")
    fine, nodes = near_duplicates(rows)
    linked = fine.join(nodes, "key").select("id", (F.col("copies") - 1 + F.col("linked")).alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where(F.col("id").isNull() | ~usable(F.col("v"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(rest).withColumnRenamed("id", "vec_id")
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT * FROM r WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.n AS a, b.n AS b FROM v AS a JOIN v AS b ON a.n <> b.n AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c(n, root) AS (SELECT n, vec_id FROM r UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.n)
SELECT r.vec_id, coalesce(l.n_links, 0) AS n_links, m.root AS component_id, r.vec_id = m.root AS kept
FROM r LEFT JOIN (SELECT a, count(*) AS n_links FROM p GROUP BY a) l ON l.a = r.n JOIN (SELECT n, min(root) AS root FROM c GROUP BY n) m ON m.n = r.n
"""
