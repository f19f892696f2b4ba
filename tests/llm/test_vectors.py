"""Near duplicates and neighbours of vectors, and components, against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bytewright.llm import components, hnsw, vptree

ROWS = "id long, v array<float>"


def _vectors(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 24))
    for c in range(12):  # groups about the threshold, and copies
        base = rng.normal(size=24)
        for i in range(c, n, 40):
            x[i] = base * rng.uniform(0.5, 3) + rng.normal(size=24) * rng.uniform(0, 0.35)
    x[1::100] = x[1]
    return x.astype(np.float32)


ODD = [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [math.nan] * 24), (5004, [math.inf] + [1.0] * 23), (5005, [1.0, 2.0]), (5006, [2.0, 4.0]), (None, [1.0] * 24), (5007, [None] * 24)]


def _table(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + ODD, ROWS)


def test_near_duplicates(spark, monkeypatch):
    x = _vectors()
    monkeypatch.setattr(hnsw, "table", lambda *_: _table(spark, x).withColumn("label", F.lit(1)).toDF("vec_id", "embedding", "label"))
    rows = {r.vec_id: r for r in hnsw.query(spark, "").collect()}
    assert len(rows) == len(x) + len(ODD)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = np.array([rows[i].n_links for i in range(len(x))])
    assert got.sum() >= 0.99 * near.sum() and (got <= near.sum(1)).all() and near.sum() > 500
    forest = components.Forest()
    for a, b in np.argwhere(near).tolist():
        forest.join(a, b)
    assert sum(rows[i].component_id != forest.root(i) for i in range(len(x))) <= 3
    assert rows[5005].n_links == rows[5006].n_links == 1 and rows[5006].component_id == 5005 and not rows[5006].kept
    assert all(rows[i].n_links == 0 and rows[i].component_id == i and rows[i].kept for i in (5000, 5001, 5002, 5003, 5004, 5007))
    assert rows[None].n_links == 0


def test_graph_recall_without_brute_force():
    x = _vectors(3000, 2)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    layers = hnsw.build_graph(x)
    entry = hnsw.descend(x, layers[:-1], x[:300])
    found, _ = hnsw.beam_search(x, layers[-1], x[:300], entry, 64)
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), true.tolist())]) > 0.95


def _pairs(n, seed=5, dim=24):
    """Rows of which three in ten have one partner and the others none."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    k = n * 15 // 100
    x[-k:] = x[:k] + rng.normal(size=(k, dim)) * 0.2
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("lost", [0.2, 0.5])
def test_audit_sees_missed_links(monkeypatch, lost):
    x = _pairs(3000)
    own, plain = np.arange(len(x)), hnsw.partners
    beams = []

    def lossy(x, layers, q, threshold, beam):
        beams.append(beam)
        who, what = np.nonzero(q @ x.T >= threshold - 1e-5)
        kept = (who == what) | (np.random.default_rng(1).random(len(who)) >= lost)
        return (who[kept], what[kept]) if beam == hnsw.BEAM else plain(x, layers, q, threshold, beam)

    monkeypatch.setattr(hnsw, "partners", lossy)
    layers = hnsw.build_graph(x)
    beam = hnsw.audited(x, layers, x, 0.9, own=own)
    who, what = plain(x, layers, x, 0.9, beam)
    who, what = who[who != what], what[who != what]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() > 500 and beam > hnsw.BEAM and len(who) >= 0.99 * near.sum() and len(set(beams)) > 1


def test_near_duplicates_by_the_graph(spark):
    x = _pairs(6000)
    rows, nodes = hnsw.near_duplicates(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>"))
    got = np.zeros(len(x), int)
    for r in rows.join(nodes, "key").collect():
        got[r.id] = r.linked
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert 6000 / 3 > 4 * hnsw.BEAM and got.sum() >= 0.99 * near.sum() and (got <= near.sum(1)).all()


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (vptree.FACTOR, 0.9)])
def test_neighbours(spark, factor, least):
    x = _vectors(700, 3)
    df = _table(spark, x)
    got = {}
    for r in vptree.nearest(df, df.where("id % 20 = 0"), factor=factor, shard_rows=100, block_rows=10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    full = x.astype(float)
    hits = total = 0
    for q in range(0, len(x), 20):
        s = full @ full[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -np.round(s, 9)))[:20]
        mine = [got[q][k][0] for k in range(1, 21)]
        hits, total = hits + len(set(want.tolist()) & set(mine)), total + 20
        assert all(abs(got[q][k][1] - s[got[q][k][0]]) < 1e-9 for k in range(1, 21))
        if factor == 1.0:
            assert mine == want.tolist()
    assert hits >= least * total
    assert got.keys() == set(range(0, len(x), 20))


def test_fewer_neighbours_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 2.0]), (7, [0.0, 2.0]), (7, [0.0, 2.0]), (20, [5.0])], ROWS)
    got = [(r.query_id, r.rank, r.id, r.score) for r in vptree.nearest(df, df.where("id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 0.0), (0, 2, 7, 0.0)]
    assert vptree.nearest(df.limit(0), df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {n: forest.root(n) for e in edges for n in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows_that_repeat_an_id(spark, monkeypatch):
    near = [0.1] + [1.0] * 23
    for rows, links in (
        ([(7, [1.0] * 24), (7, [1.0] + [-1.0] * 23), (8, near)], [(7, 0, 7), (7, 1, 7), (8, 1, 7)]),
        ([(7, [1.0] * 24), (7, near)], [(7, 1, 7), (7, 1, 7)]),
        ([], []),
    ):
        df = spark.createDataFrame(rows, ROWS).toDF("vec_id", "embedding")
        monkeypatch.setattr(hnsw, "table", lambda *_, df=df: df)
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in hnsw.query(spark, "").collect()) == links


def test_labels_against_a_forest():
    rng = np.random.default_rng(2)
    labels, forest = hnsw.Labels(300), components.Forest()
    for _ in range(12):
        a, b = rng.integers(0, 300, (2, 12))
        labels.join(a, b)
        for x, y in zip(a.tolist(), b.tolist()):
            forest.join(x, y)
    assert [forest.root(i) for i in range(300)] == labels.of.tolist()


def test_tree_prunes_and_is_exact_at_factor_one():
    """Clustered vectors of few dimensions, many leaves: fewer are scanned than there are, with the results of brute force."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 6))[rng.integers(0, 40, 6000)] * 4 + rng.normal(size=(6000, 6)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, tree = np.arange(len(x)), vptree.build_tree(x, 1.0, 0)
    rows, q = tree["order"], x[:200]
    scanned = []
    found = vptree.search_tree(tree, x[rows], ids[rows], q, ids[:200], 1.0, 20, 1.0, scanned)
    assert len(tree["leaf_start"]) > 40 and np.mean(scanned) < 0.5
    for i in range(200):
        s = (x * q[i]).sum(1)
        s[i] = -np.inf
        assert found[i][0].tolist() == np.lexsort((ids, -s))[:20].tolist()


@pytest.mark.parametrize("shard_rows,shards", [(50_000, 1), (3_000, 2)])
def test_no_more_beams_than_shards_call_for(spark, monkeypatch, shard_rows, shards):
    """A table below the size of a shard has one graph, and each node one beam; the vectors' doubles are compared, whatever is shipped."""
    x = _pairs(5000)
    made = []
    plain = hnsw.against_shards

    def counted(rows, queries, build, search, *rest, **more):
        def asked(index, part, shard):
            out = search(index, part, shard)
            counts = pd.DataFrame({"a": [-1 - shard], "b": [-1 - shard], "reach": [len(part)]})
            return pd.concat([out, counts])

        return plain(rows, queries, build, asked, *rest, **more)

    monkeypatch.setattr(hnsw, "against_shards", counted)
    monkeypatch.setattr(hnsw, "materialize", lambda df, name, plain=hnsw.materialize: made.append((name, plain(df, name))) or made[-1][1])
    for cast in ("double", "float"):
        made.clear()
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>").withColumn("v", F.col("v").cast(f"array<{cast}>"))
        rows, nodes = hnsw.near_duplicates(df, shard_rows=shard_rows)
        beams = {r.a: r.n for r in dict(made)["found"].where("a < 0").groupBy("a").agg(F.sum("reach").alias("n")).collect()}
        assert beams == {-1 - s: len(x) for s in range(shards)}
        v = x if cast == "double" else x.astype(np.float32).astype(float)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = v @ v.T >= 0.9
        np.fill_diagonal(near, False)
        got = np.zeros(len(x), int)
        for r in rows.join(nodes, "key").collect():
            got[r.id] = r.linked
        assert got.sum() >= 0.99 * near.sum() and (got <= near.sum(1)).all()
