"""Chunk-parallel encoding, and indexes for reading ranges.

``parallel_gzip`` cuts objects into chunks, each a row; a chunk is primed with the 32 KiB before it and ends at a byte,
so the chunks of an object joined in order are one gzip member, whatever the partitions were. Checksums of chunks are
combined, never computed over the whole."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from bytewright.functions.checksums import combine_crc
from bytewright.functions.codecs import gzip_header

CHUNK, HISTORY, BGZF_INPUT = 131072, 32768, 65280
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def chunks(objects: DataFrame, size: int = CHUNK, history: int = HISTORY) -> DataFrame:
    """(path, seq, last, chunk, before) of path and content."""
    n = F.greatest(F.ceil(F.octet_length("content") / size), F.lit(1)).cast("int")
    rows = objects.select("path", "content", n.alias("n")).select("path", "content", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"))
    cut = F.substring("content", F.col("seq") * size + 1, F.lit(size))
    before = F.substring("content", F.greatest(F.col("seq") * size - history, F.lit(0)) + 1, F.least(F.col("seq") * size, F.lit(history)))
    return rows.select("path", "seq", (F.col("seq") == F.col("n") - 1).alias("last"), cut.alias("chunk"), before.alias("before"))


def parallel_gzip(objects: DataFrame, level: int = 6, size: int = CHUNK) -> DataFrame:
    """(path, content): one gzip member for each object."""

    @pandas_udf("binary")
    def encode(chunk: pd.Series, before: pd.Series, last: pd.Series) -> pd.Series:
        def one(c: bytes, b: bytes, end: bool) -> bytes:
            z = zlib.compressobj(level, zlib.DEFLATED, -15, 8, 0, *([bytes(b)] if len(b) else []))
            return z.compress(bytes(c)) + z.flush(zlib.Z_FINISH if end else zlib.Z_SYNC_FLUSH)

        return pd.Series([one(*x) for x in zip(chunk, before, last, strict=True)])

    @pandas_udf("binary")
    def join(parts: pd.Series) -> pd.Series:
        def one(rows: list) -> bytes:
            crc = total = 0
            for r in rows:
                crc, total = combine_crc(crc, r["crc"], r["n"]), total + r["n"]
            return gzip_header(level) + b"".join(bytes(r["data"]) for r in rows) + struct.pack("<II", crc, total & 0xFFFFFFFF)

        return parts.map(one)

    rows = chunks(objects, size).select("path", "seq", F.crc32("chunk").alias("crc"), F.octet_length("chunk").cast("long").alias("n"), encode("chunk", "before", "last").alias("data"))
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "crc", "n", "data"))).alias("parts")).select("path", join("parts").alias("content"))


def bgzf_block(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    if len(body) > 65510:
        z = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bgzf(objects: DataFrame, level: int = 6) -> DataFrame:
    """(path, seq, block, out_offset, in_offset, voffset): blocks of at most 64 KiB, with virtual offsets by running sums."""
    from pyspark.sql import Window

    @pandas_udf("binary")
    def encode(chunk: pd.Series) -> pd.Series:
        return chunk.map(lambda c: bgzf_block(bytes(c), level))

    rows = chunks(objects, BGZF_INPUT, 0).select("path", "seq", F.octet_length("chunk").alias("n"), encode("chunk").alias("block"))
    before = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("block")).over(before), F.lit(0))
    out = F.coalesce(F.sum("n").over(before), F.lit(0))
    return rows.select("path", "seq", "block", out.alias("out_offset"), at.alias("in_offset"), F.shiftleft(at, 16).alias("voffset"))


def bgzf_objects(objects: DataFrame, level: int = 6) -> DataFrame:
    """(path, content): the blocks of each object joined, with the empty block at the end; an empty object is that alone."""

    @pandas_udf("binary")
    def join(parts: pd.Series) -> pd.Series:
        return parts.map(lambda rows: b"".join(bytes(r["block"]) for r in rows if r["n"]) + BGZF_END)

    @pandas_udf("binary")
    def encode(chunk: pd.Series) -> pd.Series:
        return chunk.map(lambda c: bgzf_block(bytes(c), level))

    rows = chunks(objects, BGZF_INPUT, 0).select("path", "seq", F.octet_length("chunk").alias("n"), encode("chunk").alias("block"))
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "block"))).alias("parts")).select("path", join("parts").alias("content"))


def find(points: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (path, offset) asked, the unit of ``points`` (path, out_offset, ...) that holds it: the last at or before.
    An as-of join as a union and a window: each side is shuffled once by path, no pairs."""
    from pyspark.sql import Window

    more = [c for c in points.columns if c not in ("path", "out_offset")]
    left = points.select("path", F.col("out_offset").alias("offset"), F.lit(0).alias("side"), F.struct("out_offset", *more).alias("point"))
    right = asked.select("path", "offset", F.lit(1).alias("side"), F.lit(None).cast(left.schema["point"].dataType).alias("point"))
    order = Window.partitionBy("path").orderBy("offset", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.union(right).withColumn("point", F.last("point", True).over(order)).where("side = 1")
    return found.select("path", "offset", "point.*")


def zstd_seekable(objects: DataFrame, frame: int = CHUNK, level: int = 3) -> DataFrame:
    """(path, content): independent frames and a seek table in a skippable frame."""

    @pandas_udf("binary")
    def encode(chunk: pd.Series) -> pd.Series:
        import zstandard as z

        return chunk.map(lambda c: z.ZstdCompressor(level=level).compress(bytes(c)))

    @pandas_udf("binary")
    def join(parts: pd.Series) -> pd.Series:
        def one(rows: list) -> bytes:
            table = b"".join(struct.pack("<II", len(r["data"]), r["n"]) for r in rows) + struct.pack("<IBI", len(rows), 0, 0x8F92EAB1)
            return b"".join(bytes(r["data"]) for r in rows) + struct.pack("<II", 0x184D2A5E, len(table)) + table

        return parts.map(one)

    rows = chunks(objects, frame, 0).select("path", "seq", F.octet_length("chunk").alias("n"), encode("chunk").alias("data"))
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "data"))).alias("parts")).select("path", join("parts").alias("content"))


def seek_table(content: bytes) -> list[tuple[int, int, int, int]]:
    """(in_offset, in_len, out_offset, out_len) of each frame, from the table at the end."""
    count, flags, magic = struct.unpack_from("<IBI", content, len(content) - 9)
    if magic != 0x8F92EAB1:
        raise ValueError("InvalidSeekTable")
    width, at, out, rows = 12 if flags & 128 else 8, 0, 0, []
    start = len(content) - 9 - count * width
    for i in range(count):
        n, size = struct.unpack_from("<II", content, start + i * width)
        rows.append((at, n, out, size))
        at, out = at + n, out + size
    return rows


def read_range(content: bytes, offset: int, length: int) -> bytes:
    """Decodes just the frames that intersect the range."""
    import zstandard as z

    parts, first = [], None
    for at, n, out, size in seek_table(content):
        if out < offset + length and out + size > offset:
            first = out if first is None else first
            parts.append(z.ZstdDecompressor().decompress(content[at : at + n], max_output_size=size) if size else b"")
    return b"".join(parts)[offset - first : offset - first + length] if parts else b""
