"""N-gram Jaccard join: candidates share prefix tokens under several global orders of the tokens, and these filters are
intersected before any text is read.

Documents with the same shingle set are one node. For sets of n and v tokens with a Jaccard similarity of t or more, the
intersection has at least a = ceil(t (n + v) / (1 + t)) tokens, and under any one order the first n - a + m and v - a + m
tokens of both have m in common, for any m up to a. m is 1 + one fiftieth of the smaller set.

First order: rare tokens before frequent ones (by count; of ``FREQUENT`` of a block's sets at least). Prefixes are shuffled by
token with the tokens' places; tokens of one node alone end there. Further orders: permutations of the hash. Each node's
prefixes under these are kept with it, and a candidate pair must share enough of them, too. Only then texts are fetched, and the
intersection counted.

No pairs are formed inside groups of copies. The node with the fewest rarer tokens before a shared one leads the token's
list (the text that others were copied from); every node is verified with the one that leads most of its lists. Lists whose nodes
lie in one component then are done. In the others, pairs are formed between different components only, of nodes whose sizes and
places in the list allow it; where these would be many, up to ``ROUNDS`` more leads at random contract the lists first. The
pairs' number is not bounded beyond that: they all are compared.

Frequent tokens are counted by blocks of about ``BLOCK`` hashes; nothing but the order, and how tokens are dealt to tasks,
depends on that. At most (mean set size) / ``FREQUENT`` tokens go to every task. A token with more than ``SPLIT`` sets is dealt out
to several lists, whose leads meet in one more.

A word's hash is keyed, with 64 bits, and so has a shingle; sets are told by 128 bits, where the first 64 of two different sets
agree by their others. Intersections are counted on shingles' hashes.

Defined cases: documents without words have no shingles and are linked with nothing; a null doc_id is in no one's
component id, but its text links others, and its row gets the id of its component, if it has any; repeated rows and doc_ids
are rows of their own; empty tables give empty results; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright.llm.components import components
from bytewright.llm.shingles import mixed, node_of, shingle_sets
from bytewright.plans.columns import pick
from bytewright.plans.scratch import forget, materialize
from bytewright.plans.workers import alone
from bytewright.sources.tables import table

NAME = "op5_jaccard"
SIZE, PERCENT, ORDERS, FREQUENT, ROUNDS = 5, 75, 3, 0.001, 3
SPLIT = 20_000  # sets of a token in one list
BROADCAST_ROWS = 500_000  # of two numbers, 16 bytes each; more of them are joined by a shuffle
BLOCK, SEEN = 2_000_000, 100_000  # hashes and sets that are counted together
_STEP = math.log(1.05)  # sizes within a twentieth share a class


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _batch(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names)


def least_shared(n: int) -> int:
    return 1 + n // 50


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - (percent * n + 99) // 100 + least_shared(n))


def overlap(n: int, v: int, percent: int) -> int:
    """The least intersection of two similar sets."""
    return -(-percent * (n + v) // (100 + percent))


def heads_of(s: np.ndarray, percent: int, orders: int) -> bytes:
    """A set's prefixes under the further orders, each token by the upper half of its place there."""
    p = prefix_length(len(s), percent)
    heads = []
    for turn in range(1, orders):
        m = mixed(s, turn)
        heads.append(np.sort(np.partition(m, p - 1)[:p] >> np.uint64(32)).astype("<u4"))
    return b"".join(h.tobytes() for h in heads)


def heads_allow(x: bytes, n: int, y: bytes, v: int, percent: int, orders: int) -> bool:
    """Whether sets of n and v tokens share as many prefix tokens as similar ones do, under every further order."""
    a, b = np.frombuffer(x, "<u4").reshape(orders - 1, -1), np.frombuffer(y, "<u4").reshape(orders - 1, -1)
    least = max(1, overlap(n, v, percent) - max(n - a.shape[1], v - b.shape[1]))
    return all(np.isin(p, q).sum() >= least for p, q in zip(a, b, strict=True))


def sets_of(docs: DataFrame, size: int, percent: int, orders: int, frequent: float, tell: Callable[[np.ndarray], tuple[int, int]]) -> DataFrame:
    """Rows of kind 0 for documents: doc_id, h (of the text), node, check, n (the set's size), and heads where the task
    sees the set for the first time; of kind 1 for tokens that are frequent somewhere: node is the token, n a count."""
    names = ["kind", "doc_id", "h", "node", "check", "n", "heads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        block: list[np.ndarray] = []
        held = 0

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(block), return_counts=True)
            often = counts >= max(4, frequent * len(block))
            tokens, counts = tokens[often].view(np.int64), counts[often]
            none = pa.nulls(len(tokens), pa.int64())
            return _batch(names, pa.array(np.ones(len(tokens), np.int32)), none, none, pa.array(tokens), none, pa.array(counts, pa.int64()), pa.nulls(len(tokens), pa.binary()))

        for batch in _slices(batches):
            nodes, checks, sizes, heads = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(batch.column("text"), size):
                    node, check = tell(s)
                    nodes.append(node)
                    checks.append(check)
                    sizes.append(len(s))
                    heads.append(None)
                    if len(s) and node not in seen:
                        seen.add(node)
                        block.append(s)
                        held += len(s)
                        heads[-1] = heads_of(s, percent, orders)
            kinds = pa.array(np.zeros(len(nodes), np.int32))
            yield _batch(names, kinds, batch.column("doc_id"), batch.column("h"), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(heads, pa.binary()))
            if held > BLOCK or len(block) > SEEN:
                yield counted()
                seen.clear()
                block, held = [], 0
        if block:
            yield counted()

    return docs.select("doc_id", "h", "text").mapInArrow(alone(run), "kind int, doc_id long, h long, node long, check long, n long, heads binary")


def prefix(s: np.ndarray, often: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of a sorted set under the first order, and their counts (0: rare). ``often``: frequent tokens, sorted;
    ``rank``: their counts."""
    p = prefix_length(len(s), percent)
    if not len(often):
        return s[:p], np.zeros(p, np.int64)
    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
    common = often[at] == s
    rare = s[~common][:p]
    late, counts = s[common], rank[at[common]]
    by = np.lexsort((late, counts))[: p - len(rare)]
    return np.concatenate([rare, late[by]]), np.concatenate([np.zeros(len(rare), np.int64), counts[by]])


def _prefixes(docs: DataFrame, often: np.ndarray, rank: np.ndarray, renamed: dict[tuple[int, int], int], percent: int, size: int, split: int, tell: Callable[[np.ndarray], tuple[int, int]]) -> DataFrame:
    """(token, part, q, node, n, i): the i-th tokens of sets of n; q is i by n in thousandths, part the token's list."""
    names = ["token", "part", "q", "node", "n", "i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            tokens, nodes, sizes, parts = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(batch.column("text"), size):
                    node, check = tell(s)
                    node = renamed.get((node, check), node)
                    if len(s) and node not in seen:
                        seen.add(node)
                        t, counts = prefix(s, often, rank, percent)
                        tokens.append(t)
                        parts.append(np.where(counts > split, 1 + node % np.maximum(1, -(-counts // split)), 0))
                        nodes.append(node)
                        sizes.append(len(s))
            if len(seen) > SEEN:
                seen.clear()
            if not tokens:
                continue
            each = [len(t) for t in tokens]
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in each])
            n = np.repeat(np.array(sizes, np.int32), each)
            q = (place.astype(np.int64) * 1000 // n).astype(np.int32)
            yield _batch(names, pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(parts).astype(np.int32)), pa.array(q), pa.array(np.repeat(np.array(nodes, np.int64), each)), pa.array(n), pa.array(place))

    return docs.select("text").mapInArrow(alone(run), "token long, part int, q int, node long, n int, i int")


def _shared(rows: DataFrame) -> DataFrame:
    """Of rows in order of token, part, q and node, without repeats: those of lists of several nodes and of parts, each with the
    list's first row as its lead."""
    names = ["token", "part", "node", "n", "i", "lead", "lead_n", "lead_i"]
    kinds = (np.int64, np.int32, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row so far
        lead: list | None = None  # the lead of its list, if that isn't this row

        def out(c: list[np.ndarray]) -> pa.RecordBatch:
            return _batch(names, *(pa.array(x.astype(k)) for x, k in zip(c, kinds, strict=True)))

        for batch in batches:
            c = [batch.column(n).to_numpy() for n in ("token", "part", "node", "n", "i")]
            if not len(c[0]):
                continue
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c, strict=True)]
            token, part, node = c[:3]
            start = np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
            new = start | np.concatenate([[True], node[1:] != node[:-1]])
            c, start = [x[new] for x in c], start[new]
            group = np.cumsum(start) - 1
            first = np.flatnonzero(start)
            leads = [x[first].copy() for x in c[2:]]
            several = (np.bincount(group) > 1) | (c[1][first] > 0)
            if lead is not None:
                for x, y in zip(leads, lead, strict=True):
                    x[0] = y
                several[0] = True
            keep = several[group]
            keep[-1] = False  # it is held
            yield out([x[keep] for x in c] + [x[group][keep] for x in leads])
            held = [x[-1:] for x in c]
            lead = [x[-1] for x in leads] if lead is not None and group[-1] == 0 or not start[-1] else None
        if held is not None and (lead is not None or held[1][0] > 0):
            yield out(held + ([np.array([x]) for x in lead] if lead is not None else held[2:]))

    return rows.mapInArrow(alone(run), "token long, part int, node long, n int, i int, lead long, lead_n int, lead_i int")


def _allowed(percent: int, n: str, i: str, v: str, j: str) -> Column:
    """Whether the i-th token of a set of n and the j-th of one of v can be among those that count for the pair."""
    a = f"(({percent} * ({n} + {v}) + {99 + percent}) div {100 + percent})"
    m = f"(1 + least({n}, {v}) div 50)"
    return F.expr(f"{i} < {n} - {a} + {m} and {j} < {v} - {a} + {m} and 100 * {n} >= {percent} * {v} and 100 * {v} >= {percent} * {n}")


def _few(spark: SparkSession, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class _Texts:
    """Nodes' sizes, heads and texts, and the comparison of pairs."""

    def __init__(self, docs: DataFrame, found: DataFrame, nodes: DataFrame, renamed: dict[tuple[int, int], int], percent: int, orders: int, size: int, tell: Callable[[np.ndarray], tuple[int, int]]):
        self.tell, self.docs, self.found, self.nodes, self.renamed = tell, docs, found, nodes, renamed
        self.percent, self.orders, self.size = percent, orders, size

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b) of nodes."""
        pairs = materialize(pairs.select("a", "b"), "jaccard-pairs")
        for step in (self._by_heads, self._by_texts):
            pairs = step(pairs)
            forget(self.docs.sparkSession)
        return pairs

    def _joined(self, pairs: DataFrame, held: DataFrame) -> DataFrame:
        """Pairs (a, b) with what ``held`` has of both nodes: node, n, blob."""
        held = materialize(held, "jaccard-held")
        return pairs.join(held.toDF("a", "n_a", "blob_a"), "a").join(held.toDF("b", "n_b", "blob_b"), "b").select("a", "b", "n_a", "n_b", "blob_a", "blob_b")

    def _wanted(self, pairs: DataFrame) -> DataFrame:
        return materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "jaccard-wanted")

    def _compared(self, both: DataFrame, test) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, 200):
                rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
                keep = pa.array([test(n, v, x, y) for n, v, x, y in rows], pa.bool_())
                yield _batch(["a", "b"], batch.column(0), batch.column(1)).filter(keep)

        return materialize(both.mapInArrow(alone(run), "a long, b long"), "jaccard-links")

    def _by_heads(self, pairs: DataFrame) -> DataFrame:
        if self.orders < 2:
            return pairs
        percent, orders = self.percent, self.orders
        heads = self.found.where("heads is not null").join(_few(self.docs.sparkSession, self._wanted(pairs)), "node", "left_semi").select("node", F.col("n").cast("int"), "heads").dropDuplicates(["node"])
        return self._compared(self._joined(pairs, heads), lambda n, v, x, y: heads_allow(x, n, y, v, percent, orders))

    def _by_texts(self, pairs: DataFrame) -> DataFrame:
        percent, size, renamed, tell = self.percent, self.size, self.renamed, self.tell

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, 500):
                found = list(shingle_sets(batch.column("text"), size))
                keys = [tell(s) for s in found]
                yield _batch(["node", "n", "blob"], pa.array([renamed.get(k, k[0]) for k in keys], pa.int64()), pa.array([len(s) for s in found], pa.int32()), pa.array([s.tobytes() for s in found], pa.binary()))

        def test(n: int, v: int, x: bytes, y: bytes) -> bool:
            both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            return 100 * both >= percent * (n + v - both)

        wanted = self._wanted(pairs)
        rows = materialize(self.nodes.join(wanted, "node", "left_semi").select(F.coalesce("one.doc_id", F.lit(0)).alias("_id"), F.col("one.h").alias("_h")), "jaccard-rows")
        texts = self.docs.join(_few(self.docs.sparkSession, rows), (F.coalesce("doc_id", F.lit(0)) == F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi").select("text")
        held = texts.mapInArrow(alone(sets), "node long, n int, blob binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])
        return self._compared(self._joined(pairs, held), test)


def _best(led: DataFrame, percent: int) -> DataFrame:
    """From rows (node, n, i, lead, lead_n, lead_i) of lists to pairs: each node with the one that leads most of its lists."""
    led = led.where("node != lead").where(_allowed(percent, "n", "i", "lead_n", "lead_i"))
    led = led.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("count"))
    return led.groupBy("node").agg(F.max(F.struct("count", "lead")).alias("best")).select(F.col("node").alias("a"), F.col("best.lead").alias("b"))


def _labelled(rows: DataFrame, groups: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``c_<column>``, the component of each of these columns' nodes."""
    for c in columns:
        own = _few(rows.sparkSession, groups).select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"c_{c}")) if groups is not None else None
        rows = rows.join(own, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}").withColumn(f"c_{c}", F.coalesce(f"c_{c}", c))
    return rows


def _open_lists(held: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of tokens whose nodes lie in several components, with the component."""
    tokens = materialize(_labelled(held.select("token", "node", "lead"), groups, "node", "lead").where("c_node != c_lead").select("token").distinct(), "jaccard-open")
    return materialize(_labelled(held.join(_few(held.sparkSession, tokens), "token", "left_semi").select("token", "node", "n", "i").distinct(), groups, "node").withColumnRenamed("c_node", "component"), "jaccard-lists")


def _sides(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For (token, node, n, i, component): the rows as the larger set of a pair, once for each class of sizes that the smaller one
    may have; those that can be the smaller one; and (token, class, main), the component of most rows there."""
    most = F.expr(f"least(n, ({100 + percent} * (n - i + n div 50)) div {percent} - n)")
    low = F.expr(f"({percent} * n + 99) div 100")
    size_class = lambda c: F.floor(F.log(c) / _STEP).cast("int")
    rows = rows.withColumn("most", most)
    large = rows.where(F.col("most") >= low).withColumn("class", F.explode(F.sequence(size_class(low), size_class(F.col("most")))))
    small = rows.where(F.expr(f"({100 + percent} * (n - i + n div 50)) div {percent} - n >= n")).withColumn("class", size_class(F.col("n")))
    each = small.groupBy("token", "class", "component").agg(F.count(F.lit(1)).alias("k"))
    main = each.groupBy("token", "class").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("rows")).select("token", "class", F.col("m.component").alias("main"), "rows")
    return large, small, main


def _pairs(rows: DataFrame, percent: int, limit: float | None) -> DataFrame | None:
    """Candidate pairs (a, b) between components, or ``None`` if more than ``limit`` comparisons for each row would be made."""
    large, small, main = _sides(rows, percent)
    main = materialize(main, "jaccard-main")
    mark = lambda df: materialize(df.join(main, ["token", "class"]).select("token", "class", "node", "n", "i", "component", "main"), "jaccard-side")
    x, y = mark(large), mark(small)
    apart = "component != main"
    if limit is not None:
        ways = x.where(apart).join(main.select("token", "class", "rows"), ["token", "class"]).agg(F.sum("rows")).first()[0] or 0
        other = y.where(apart).groupBy("token", "class").agg(F.count(F.lit(1)).alias("k"))
        ways += x.where("component = main").groupBy("token", "class").agg(F.count(F.lit(1)).alias("l")).join(other, ["token", "class"]).agg(F.sum(F.col("k") * F.col("l"))).first()[0] or 0
        if ways > limit * (x.count() + y.count()) + 1_000_000:
            return None
    key = ["token", "class"]
    left, right = lambda df: df.select(*key, F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("i").alias("i_a"), F.col("component").alias("c_a")), lambda df: df.select(*key, F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("i").alias("i_b"), F.col("component").alias("c_b"))
    fits = _allowed(percent, "n_a", "i_a", "n_b", "i_b") & F.expr("c_a != c_b and (n_a > n_b or n_a = n_b and a > b)")
    found = None
    for p, q in ((left(x.where(apart)), right(y)), (left(x.where("component = main")), right(y.where(apart)))):
        part = p.join(q, (p["token"] == q["token"]) & (p["class"] == q["class"]) & fits).select("a", "b", "n_b")
        found = part if found is None else found.union(part)
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"), F.first("n_b").alias("n_b")).where("count >= 1 + n_b div 50").select("a", "b")


def classes(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, orders: int = ORDERS, frequent: float = FREQUENT, split: int = SPLIT, tell: Callable[[np.ndarray], tuple[int, int]] = node_of) -> DataFrame:
    """``docs`` has doc_id and text; returns doc_id, h (xxhash64 of the text), n_shingles, component (a number that the rows of one
    component share, null without shingles) and component_id, a row for each row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    found = materialize(sets_of(docs, size, percent, orders, frequent, tell), "jaccard-nodes")
    members = found.where("kind = 0").select("doc_id", "h", "node", "check", "n")
    n_docs = members.count()
    listed = found.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent * n_docs).toPandas()
    tokens = listed["node"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(tokens)
    often, rank = tokens[by], listed["n"].to_numpy(np.int64)[by]
    # Two sets with the same first 64 bits: their nodes are named by the others. By chance there are none below a billion sets.
    double = members.where("n > 0").groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x != y").select("node")
    double = members.where("n > 0").join(double, "node", "left_semi").select("node", "check").distinct().collect()
    renamed = {(r["node"], r["check"]): r["check"] for r in double}
    if renamed:
        names = F.create_map(*(F.lit(v) for k, x in renamed.items() for v in (f"{k[0]} {k[1]}", x)))
        found = found.withColumn("node", F.coalesce(F.try_element_at(names, F.concat_ws(" ", "node", "check")), F.col("node")))
        members = found.where("kind = 0").select("doc_id", "h", "node", "check", "n")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("one")
    nodes = materialize(members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"), one), "jaccard-sets")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = _prefixes(docs, often, rank, renamed, percent, size, split, tell).repartition(parts, "token", "part").sortWithinPartitions("token", "part", "q", "node")
    held = materialize(_shared(rows), "jaccard-tokens")
    del rows
    forget(spark)
    if len(rank) and rank.max() > split:  # the leads of a token's parts meet
        tops = held.where("part > 0").select("token", F.struct(F.expr("lead_i * 1000L div lead_n").alias("q"), F.col("lead").alias("node"), F.col("lead_n").alias("n"), F.col("lead_i").alias("i")).alias("top")).distinct()
        first = materialize(tops.groupBy("token").agg(F.min("top").alias("first")), "jaccard-first")
        more = tops.join(first, "token").select("token", F.lit(-1).alias("part"), "top.node", "top.n", "top.i", F.col("first.node").alias("lead"), F.col("first.n").alias("lead_n"), F.col("first.i").alias("lead_i"))
        held = held.unionByName(materialize(more, "jaccard-tops"))
    texts = _Texts(docs, found, nodes, renamed, percent, orders, size, tell)
    links = texts.similar(_best(held, percent))
    groups = materialize(components(links), "jaccard-groups")
    rest = _open_lists(held, groups)
    pairs = None
    for turn in range(ROUNDS):
        pairs = _pairs(rest, percent, 4.0)
        if pairs is not None:
            break
        leads = rest.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("r"), "node", "n", "i")).alias("one"))
        leads = materialize(leads.groupBy("token").agg(F.max(F.struct("k", "one", "component")).alias("l")), "jaccard-leads")
        led = rest.join(leads, "token").where("component != l.component").select("node", "n", "i", F.col("l.one.node").alias("lead"), F.col("l.one.n").alias("lead_n"), F.col("l.one.i").alias("lead_i"))
        new = texts.similar(_best(led, percent))
        if not new.take(1):
            break
        links = links.union(new)
        groups = materialize(components(links), "jaccard-groups")
        rest = _open_lists(held.join(_few(spark, materialize(rest.select("token").distinct(), "jaccard-open")), "token", "left_semi"), groups)
    pairs = materialize(pairs if pairs is not None else _pairs(rest, percent, None), "jaccard-pairs")
    forget(spark)
    if pairs.take(1):
        links = links.union(texts.similar(pairs))
        groups = materialize(components(links), "jaccard-groups")
    named = groups.join(nodes.select("node", "least"), "node")
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "jaccard-ids")
    linked = materialize(groups.join(least, "component").select("node", "component", "component_id"), "jaccard-linked")
    ids = nodes.where("rows > 1").join(linked.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"), F.col("least").alias("component_id"))
    ids = materialize(ids.unionByName(linked), "jaccard-named").select(F.col("node").alias("_node"), F.col("component").alias("_component"), "component_id")
    out = members.join(_few(spark, ids), (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("_component", "node")).alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` has doc_id and text; returns doc_id, n_shingles, component_id, a row for each row; ``settings``
    are those of ``classes``."""
    return classes(docs, **settings).select("doc_id", "n_shingles", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id."""
    return jaccard_components(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
