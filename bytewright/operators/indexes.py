"""Seek indexes of gzip objects as tables, and dictionary training.

A point is a block boundary of a DEFLATE stream: the bit it begins at, the decoded bytes before it, and the last 32 KiB
of these, which suffice to decode from there on. Points are at least ``spacing`` decoded bytes apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from bytewright.functions import deflate
from bytewright.operators.framing import gzip_members
from bytewright.plans.columns import pick

POINTS = "path string, point int, bit long, out_offset long, history binary"


def _body(data: bytes, at: int) -> int:
    """Where a gzip member's DEFLATE stream begins."""
    flags, end = data[at + 3], at + 10
    if flags & 4:
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            end = data.index(b"\0", end) + 1
    return end + (2 if flags & 2 else 0)


def points_of(data: bytes, spacing: int) -> Iterator[tuple[int, int, bytes]]:
    """(bit, out_offset, history) over all members; each member's first block is one."""
    before, last = 0, None
    for _, at, _, _, _, _ in gzip_members(data):
        blocks: list[deflate.Block] = []
        start = _body(data, at)
        out, _ = deflate.inflate(data[start:], blocks=blocks)
        for b in blocks:
            if b.out == 0 or last is None or before + b.out - last >= spacing:
                last = before + b.out
                yield 8 * start + b.bit, last, out[max(0, b.out - 32768) : b.out]
        before += len(out)


def build_index(objects: DataFrame, spacing: int = 1 << 20) -> DataFrame:
    """Rows by ``POINTS`` of path and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(points_of(data, spacing)) if data else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                    ["path", "point", "bit", "out_offset", "history"],
                )

    return pick(objects, "path", "content").mapInArrow(run, POINTS)


def read_from(data: bytes, bit: int, out_offset: int, history: bytes, offset: int, length: int) -> bytes:
    """Decoded bytes from ``offset`` on, at most to the end of the point's member."""
    first = bit >> 3
    out, _ = deflate.inflate(data[first:], bit=bit & 7, history=history, stop=offset - out_offset + length)
    return out[offset - out_offset :][:length]


def read_ranges(objects: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, offset, length, data) for each (path, offset, length) asked: the last point at or before it is found by an
    as-of lookup, and decoding begins there."""
    from bytewright.operators.chunked import find

    @pandas_udf("binary")
    def read(content: pd.Series, bit: pd.Series, out: pd.Series, history: pd.Series, offset: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([read_from(bytes(c), b, o, bytes(h), at, n) for c, b, o, h, at, n in zip(content, bit, out, history, offset, length, strict=True)])

    at = find(index.select("path", "out_offset", "bit", "history"), asked.select("path", "offset").distinct()).where("bit is not null")
    found = asked.join(at, ["path", "offset"]).join(pick(objects, "path", "content"), "path")
    return found.select("path", "offset", "length", read("content", "bit", "out_offset", "history", "offset", "length").alias("data"))


def train_dictionary(samples: DataFrame, column: str, size: int = 16384, sample: int = 2000) -> bytes:
    """A zstd dictionary of ``size`` bytes at most, from the up to ``sample`` values with the least hash."""
    import zstandard

    rows = samples.where(F.octet_length(column) >= 8).orderBy(F.xxhash64(column)).select(column).limit(sample).collect()
    return zstandard.train_dictionary(size, [bytes(r[0]) for r in rows]).as_bytes()


def dictionary_gain(samples: DataFrame, column: Column, dictionary: bytes, level: int = 3) -> DataFrame:
    """One row: bytes of all values, compressed without and with the dictionary."""
    from bytewright.functions.codecs import compress

    sizes = samples.select(F.octet_length(column).alias("n"), F.octet_length(compress(column, "zstd", level)).alias("plain"), F.octet_length(compress(column, "zstd", level, dictionary=dictionary)).alias("primed"))
    return sizes.agg(F.sum("n").alias("n"), F.sum("plain").alias("plain"), F.sum("primed").alias("primed"))


