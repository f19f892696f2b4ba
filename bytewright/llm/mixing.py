"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources, in code point order with null last, weigh ``weights`` in turn and share ``share`` of all words
(``[^\\x20\\x09-\\x0D]+``; a null text has none). A target stops at ``most`` times its source's size; what is left over
goes to the other sources by weight, until none is above.

A source takes as many complete epochs as its target holds, then a fraction of one more: each document has the key
-ln(u) / w, where u is a hash of the document's id in (0, 1) and w its quality weight, and in ascending order of
this key documents are taken while that brings the source's sum nearer to its target. So a document is taken whole,
0 to ``most`` times.

No task holds a source. Keys fall into about sqrt(n) ranges of a source of n documents, spread about its median key; the sums of
ranges tell which one holds the cut, and just the documents in that range are sorted.

Defined cases: an empty or null text has size 0 and nothing is taken from it; a null doc_id hashes as an empty one;
ties of the key are ordered by doc_id and size, so equal rows share their lot in any order; an empty table gives an
empty result; a source whose documents are all empty has target 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytewright.plans.columns import WORD, pick
from bytewright.plans.scratch import materialize
from bytewright.sources.tables import table

NAME = "op2_mixing"
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, "mix-1"


def quality_weight(text: Column, size: Column) -> Column:
    """1 where words have six characters with the space behind them on average, less the further from it."""
    return F.when(size > 0, 1 / (1 + F.abs(F.char_length(text) / size - 6.0))).otherwise(F.lit(1.0))


def _key(doc_id: Column, weight: Column, seed: str) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 48)) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From (source, source_size, n, median) to the same with ``target``. One task orders the sources, one row for each."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(most))
    low = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before, every = low.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    found = weighed.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    open_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    rest = share * F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0))
    return found.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(rest * F.col("w") / open_w)).select("source", "source_size", "n", "median", "target")


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``sized`` has doc_id, source, size and weight and any others; returns all but weight, with source_size, target
    and ``taken``, a multiple of size."""
    keep = [c for c in sized.columns if c != "weight"]
    rows = sized.select(*keep, _key(F.col("doc_id"), F.col("weight"), seed).alias("key"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.percentile_approx("key", 0.5).alias("median"))
    plan = materialize(targets(totals, weights, share, most), "mix-targets")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_source")
    ranges = F.ceil(F.sqrt("n"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("range", F.least(ranges - 1, F.floor(ranges * F.col("key") / (F.col("median") + F.col("key")))))
    sums = rows.groupBy("_source", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    so_far = F.sum("words").over(Window.partitionBy("_source").orderBy("range"))
    cut = sums.withColumn("upto", so_far).where("upto > rest")
    cut = cut.groupBy(F.col("_source").alias("_cut_source")).agg(F.min(F.struct("range", F.expr("upto - words").alias("before"))).alias("cut"))
    rows = rows.join(cut, F.col("_source").eqNullSafe(F.col("_cut_source")), "left")
    sure = rows.where("cut is null or range != cut.range").withColumn("again", (F.col("cut").isNull() | (F.col("range") < F.col("cut.range"))).cast("long"))
    order = Window.partitionBy("_source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("range = cut.range").withColumn("again", (2 * (F.col("cut.before") + F.sum("size").over(order)) - F.col("size") <= 2 * F.col("rest")).cast("long"))
    out = sure.unionByName(edge)
    return out.select(*keep, "source_size", "target", ((F.col("epochs") + F.col("again")) * F.col("size")).alias("taken"), (F.col("epochs") + F.col("again")).alias("copies"))


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size and weight of each document, and the columns named besides."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", *more, "text", size.alias("size")).withColumn("weight", quality_weight(F.col("text"), F.col("size")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: doc_id, size, source_size, target, taken."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    small = materialize(sized(docs).drop("text"), "mix-sizes")
    return mix(small).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, length(text) AS chars FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
    / (CASE WHEN size > 0 THEN 1.0 / (1.0 + abs(chars::DOUBLE / size - 6.0)) ELSE 1.0::DOUBLE END) AS key FROM d
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, ([3.0::DOUBLE, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ()) - coalesce(sum(cap) OVER before, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, cap / w <= level AS capped FROM l),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE
    (1.5::DOUBLE * (sum(source_size) OVER ()) - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * w / (sum(CASE WHEN NOT capped THEN w END) OVER ()) END AS target FROM c
), e AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  CAST(size * (epochs + CASE WHEN 2 * upto - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e
"""
