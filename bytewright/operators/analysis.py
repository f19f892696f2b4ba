"""Byte-level analytics as DataFrame operations: histograms, entropy, runs, block splits, costs, d-mers.

Counts within one value are taken over Arrow batches; across values they are partial aggregates, so a column of any
size is one shuffle of at most 256 rows for each task and group. ``byte_rows`` is the plain SQL form, a row a byte."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from bytewright.plans.columns import pick


def bytes_of(data: Column) -> Column:
    """A binary value's bytes as an array of integers. Hexadecimal pairs are read in one pass each."""
    digits = F.hex(data)
    n = F.octet_length(data)
    at = F.when(n > 0, F.sequence(F.lit(1), 2 * n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int"))


def byte_rows(rows: DataFrame, data: str, *keys: str) -> DataFrame:
    """(keys, pos, byte), one row for each byte; pos from 0."""
    return rows.select(*keys, F.posexplode(F.split(F.regexp_replace(F.hex(data), "(..)(?!$)", "$1,"), ",")).alias("pos", "pair")).where("pair != ''").select(*keys, "pos", F.conv("pair", 16, 10).cast("int").alias("byte"))


def _mapped(rows: DataFrame, data: str, keys: tuple[str, ...], schema: str, of_value: Callable) -> DataFrame:
    """Rows of ``of_value(bytes)``, an iterable of int tuples, behind the keys of each row."""
    kinds = ", ".join(f"{rows.schema[k].name} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, *(x.split()[0] for x in schema.split(", "))]
        for batch in batches:
            found = [of_value(np.frombuffer(v or b"", np.uint8)) for v in batch.column(data).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            numbers = np.concatenate([np.zeros((0, len(names) - len(keys)), np.int64), *found])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *(pa.array(c) for c in numbers.T)], names)

    return rows.select(*keys, data).mapInArrow(run, ", ".join(x for x in (kinds, schema) if x))


def byte_histogram(rows: DataFrame, data: str, *keys: str) -> DataFrame:
    """(keys, byte, n)."""

    def counted(v: np.ndarray) -> np.ndarray:
        n = np.bincount(v, minlength=256)
        held = np.flatnonzero(n)
        return np.stack([held, n[held]], 1)

    return _mapped(rows, data, keys, "byte long, n long", counted).groupBy(*keys, "byte").agg(F.sum("n").alias("n"))


def entropy(histogram: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_bytes, bits): Shannon's bits a byte from counts."""
    sums = histogram.groupBy(*keys).agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("_s"))
    return sums.select(*keys, "n_bytes", (F.log2(F.col("n_bytes").cast("double")) - F.col("_s") / F.col("n_bytes")).alias("bits"))


def runs(rows: DataFrame, data: str, key: str, least: int = 3) -> DataFrame:
    """(key, start, length, byte) of runs of one byte, at least ``least`` long."""

    def found(v: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(v)))
        keep = lengths >= least
        return np.stack([starts[keep], lengths[keep], v[starts[keep]].astype(np.int64)], 1)

    return _mapped(rows, data, (key,), "start long, length long, byte long", found)


def block_distances(rows: DataFrame, data: str, key: str, size: int = 512) -> DataFrame:
    """(key, block, distance, split): how far each block's byte counts are from those of the block before, as a splitter
    sees it; ``split`` where 512 times the distance reaches 200 times the count."""

    def found(v: np.ndarray) -> np.ndarray:
        n = -(-len(v) // size)
        counts = np.bincount(np.arange(len(v)) // size * 256 + v, minlength=256 * n).reshape(n, 256)
        distance = np.abs(np.diff(counts, axis=0)).sum(1) if n > 1 else np.zeros(0, np.int64)
        return np.stack([np.arange(1, len(distance) + 1), distance], 1)

    return _mapped(rows, data, (key,), "block long, distance long", found).withColumn("split", 512 * F.col("distance") >= 200 * size)


def deflate_costs(histogram: DataFrame, key: str) -> DataFrame:
    """(key, stored_bits, fixed_bits, kind) of values coded as literals alone: the kind that a block writer would take."""
    bits = F.when(F.col("byte") < 144, 8).otherwise(9)
    sums = histogram.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * bits).alias("literal_bits"))
    stored = F.ceil(F.col("n") / 65535) * 40 + 8 * F.col("n")
    fixed = 3 + F.col("literal_bits") + 7
    return sums.select(key, stored.cast("long").alias("stored_bits"), fixed.cast("long").alias("fixed_bits"), F.when(stored < fixed, "stored").otherwise("fixed").alias("kind"))


def dmers(rows: DataFrame, data: str, at_once: int = 4_000_000) -> DataFrame:
    """(dmer, n): strings of eight bytes, as hexadecimal digits, by how many positions they stand at. The most frequent
    are what a trained dictionary holds. Tasks count ``at_once`` positions before they hand on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["dmer", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                v = np.frombuffer(value or b"", np.uint8)
                if len(v) < 8:
                    continue
                held.append(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(v, 8)).view(">u8").ravel().astype(np.uint64))
                size += len(held[-1])
                if size >= at_once:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    counts = rows.select(data).mapInArrow(run, "dmer long, n long").groupBy("dmer").agg(F.sum("n").alias("n"))
    return counts.select(F.lpad(F.hex("dmer"), 16, "0").alias("dmer"), "n")


def match_distances(rows: DataFrame, data: str, key: str, window: int = 32768) -> DataFrame:
    """(key, n_positions, n_matched, mean_distance): positions whose next four bytes stood before within the window."""
    four = byte_rows(rows, data, key)
    order = Window.partitionBy(key).orderBy("pos")
    gram = F.col("byte") + F.lead("byte", 1).over(order) * 256 + F.lead("byte", 2).over(order) * 65536 + F.lead("byte", 3).over(order).cast("long") * 16777216
    grams = four.select(key, "pos", gram.alias("gram")).where("gram is not null")
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy(key, "gram").orderBy("pos"))
    out = grams.withColumn("gap", gap)
    hit = F.col("gap") <= window
    return out.groupBy(key).agg(F.count(F.lit(1)).alias("n_positions"), F.count(F.when(hit, 1)).alias("n_matched"), F.avg(F.when(hit, F.col("gap"))).alias("mean_distance"))


def periods(rows: DataFrame, text: str, key: str, most: int = 300) -> DataFrame:
    """(key, period): the least period up to ``most`` of values that repeat one pattern as a whole."""
    n = F.char_length(text)
    tried = F.sequence(F.lit(1), F.lit(most))
    fits = F.filter(tried, lambda p: (p < n) & (F.substring(F.col(text), p + 1, n - p) == F.substring(F.col(text), F.lit(1), n - p)))
    return rows.where(n > 1).select(key, F.try_element_at(fits, F.lit(1)).alias("period")).where("period is not null")


def size_report(sizes: DataFrame, *keys: str) -> DataFrame:
    """Totals by all levels of ``keys`` from n_in and n_out: sums, and median, 99th percentile and most of the ratio."""
    ratio = F.col("n_out") / F.col("n_in")
    return sizes.where("n_in > 0").rollup(*keys).agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.percentile(ratio, F.lit(0.5)).alias("median"), F.percentile(ratio, F.lit(0.99)).alias("p99"), F.max(ratio).alias("most"))


def objects(documents: DataFrame) -> DataFrame:
    """Documents as (path, content)."""
    return pick(documents, "doc_id", "text").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def cut_points(data: Column, bits: int = 12) -> Column:
    """Where content-defined chunks of about 2^bits bytes begin (0 left out): a cut follows eight bytes whose hash ends in zeros
    from its top bit down, so a change moves the cuts beside it and no others. Null stays null; short values have no cuts."""

    @pandas_udf("array<long>")
    def run(values: pd.Series) -> pd.Series:
        def one(v: bytes) -> np.ndarray:
            a = np.frombuffer(v, np.uint8).astype(np.uint32)
            if len(a) < 8:
                return np.zeros(0, np.int64)
            gram = a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)
            hashed = gram[:-4] * np.uint32(0x9E3779B1) + gram[4:] * np.uint32(0x85EBCA77)
            found = np.flatnonzero(hashed >> np.uint32(32 - bits) == 0) + 8
            return found[found < len(a)]

        return values.map(lambda v: None if v is None else one(bytes(v)))

    return run(data)
