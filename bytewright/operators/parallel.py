"""Objects encoded and decoded by their independent parts, each part a row.

``decode`` cuts objects at boundaries that headers tell (xz blocks by the index, bzip2 blocks by their magic numbers,
Snappy chunks, zstd and LZ4 frames, BGZF members), spreads the parts over all tasks and joins them again. A part is made
a whole object of its codec, so that the library verifies it. Whatever is refused on the way (a cut, a part, a sum over
parts) is answered by the serial decoder, whose word counts: damaged objects get the same result as without the cuts."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from bytewright.functions import codecs
from bytewright.operators import framing
from bytewright.operators.chunked import chunks
from bytewright.operators.framing import Bad
from bytewright.plans.columns import pick

SNAPPY_ID = b"\xff\x06\0\0sNaPpY"
BZIP2_END = 0x177245385090
PIECES = "path string, seq int, in_offset long, piece binary, refused string"
BATCH = 8 << 20  # bytes of pieces in a batch
Piece = tuple[int, bytes]  # in_offset, the piece as an object of its own


def _vli(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def xz_stream(flags: bytes, blocks: list[tuple[bytes, int, int]]) -> bytes:
    """One xz stream of blocks (bytes, unpadded size, decoded size)."""
    index = b"\0" + _vli(len(blocks)) + b"".join(_vli(unpadded) + _vli(size) for _, unpadded, size in blocks)
    index += bytes(-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + flags
    head = b"\xfd7zXZ\0" + flags + struct.pack("<I", zlib.crc32(flags))
    return head + b"".join(b for b, _, _ in blocks) + index + struct.pack("<I", zlib.crc32(tail)) + tail + b"YZ"


def _xz_parts(data: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, int, int]]]:
    for _, at, n, size, _, attrs in framing.xz_blocks(data):
        yield at, bytes([0, int(attrs["check"])]), (data[at : at + n], int(attrs["unpadded"]), size)


def _xz(data: bytes) -> Iterator[Piece]:
    for at, flags, block in _xz_parts(data):
        yield at, xz_stream(flags, [block])


def _bits(data: bytes, start: int, stop: int) -> int:
    last = -(-stop // 8)
    return int.from_bytes(data[start // 8 : last], "big") >> 8 * last - stop & (1 << stop - start) - 1


def _bzip2(data: bytes) -> Iterator[Piece]:
    found = [(kind, int(attrs["bit"]), crc) for kind, _, _, _, crc, attrs in framing.bzip2_blocks(data)]
    at, level, folded = 0, b"", 0  # at: the bit that the next block or end must begin at, where that is known
    for i, (kind, bit, crc) in enumerate(found):
        if not level:
            if bit != at + 32 or data[at // 8 : at // 8 + 3] != b"BZh" or data[at // 8 + 3] not in b"123456789":
                raise Bad(at // 8, "InvalidHeader")
            level, folded = data[at // 8 + 3 : at // 8 + 4], 0
        if kind == "end":
            if folded != crc:
                raise Bad(bit // 8, "ChecksumMismatch")
            at, level = -(-(bit + 80) // 8) * 8, b""
            continue
        if i + 1 == len(found):
            raise Bad(len(data), "Truncated")
        stop = found[i + 1][1]
        folded = (folded << 1 | folded >> 31) & 0xFFFFFFFF ^ crc
        n = stop - bit + 80
        body = (_bits(data, bit, stop) << 80 | BZIP2_END << 32 | crc) << -n % 8
        yield bit // 8, b"BZh" + level + body.to_bytes(-(-n // 8), "big")
    if level or at != 8 * len(data):
        raise Bad(at // 8, "Truncated")


def _snappy(data: bytes) -> Iterator[Piece]:
    for kind, at, n, _, _, _ in framing.snappy_chunks(data):
        if kind in ("compressed", "stored"):
            yield at, SNAPPY_ID + data[at : at + n]


def _frames(walk: Callable) -> Callable[[bytes], Iterator[Piece]]:
    def run(data: bytes) -> Iterator[Piece]:
        for kind, at, n, _, _, _ in walk(data):
            if kind == "frame":
                yield at, data[at : at + n]

    return run


def _bgzf(data: bytes) -> Iterator[Piece]:
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"\x1f\x8b\x08\x04" or data[at + 10 : at + 16] != b"\x06\0BC\x02\0" or at + 18 > len(data):
            raise Bad(at, "InvalidHeader")
        n = int.from_bytes(data[at + 16 : at + 18], "little") + 1
        if n < 26 or at + n > len(data):
            raise Bad(at, "Truncated")
        yield at, data[at : at + n]
        at += n


#: Of each format its cutter and the codec of its pieces.
FORMATS: dict[str, tuple[Callable[[bytes], Iterator[Piece]], str]] = {
    "xz": (_xz, "xz"),
    "bzip2": (_bzip2, "bzip2"),
    "snappy_stream": (_snappy, "snappy_stream"),
    "zstd": (_frames(framing.zstd_frames), "zstd"),
    "lz4": (_frames(lambda d: framing.lz4_blocks(d, True)), "lz4"),
    "bgzf": (_bgzf, "gzip"),
}


def pieces(objects: DataFrame, format: str) -> DataFrame:
    """Rows by ``PIECES`` of path and content; where cutting ends early, a last row says why. Null content gives no row."""
    cut = FORMATS[format][0]

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        seq = 0
        try:
            for seq, (at, piece) in enumerate(cut(data), 1):
                yield path, seq - 1, at, piece, None
        except Bad as e:
            yield path, seq, e.at, None, e.reason

    def batch(held: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["path", "seq", "in_offset", "piece", "refused"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for row in rows(path, data) if data is not None else ():
                    held.append(row)
                    size += len(row[3] or b"") + 64
                    if size > BATCH:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    return pick(objects, "path", "content").mapInArrow(run, PIECES)


def _tried(objects: DataFrame, format: str, max_output: int) -> DataFrame:
    """Pieces decoded, spread by path and place: a large object has as many tasks as it has parts."""
    cut = pieces(objects, format).repartition("path", "seq")
    return cut.select("path", "seq", "in_offset", "refused", codecs.try_decompress(F.col("piece"), FORMATS[format][1], max_output=max_output).alias("t"))


def decode_blocks(objects: DataFrame, format: str, skip: int = 0, max_output: int = codecs.MAX_OUTPUT) -> DataFrame:
    """(path, seq, in_offset, out_offset, data, error): decoded parts as rows, never joined, from that part on which holds
    decoded byte ``skip``. A part that is refused has its error, and those behind it no out_offset."""
    before = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    good = F.coalesce(F.min(F.coalesce(F.col("t.finished"), F.lit(False))).over(before), F.lit(True))
    at = F.when(good, F.coalesce(F.sum("t.out_len").over(before), F.lit(0)))
    rows = _tried(objects, format, max_output).select("path", "seq", "in_offset", at.alias("out_offset"), F.col("t.data").alias("data"), F.coalesce("refused", "t.error").alias("error"))
    return rows.where(F.coalesce(F.col("out_offset") + F.octet_length("data") > skip, F.lit(True))) if skip else rows


def decode(objects: DataFrame, format: str, max_output: int = codecs.MAX_OUTPUT) -> DataFrame:
    """(path, data, out_len, how, error, reason), a row for each object: ``how`` is ``blocks``, or ``serial`` where the serial
    decoder answered: for objects without parts, with anything refused, or with a path that other objects have too. Null
    content gives null data; an empty table none."""
    objects = pick(objects, "path", "content")

    @pandas_udf("binary")
    def join(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: None if p is None else b"".join(bytes(x["data"]) for x in p))

    done = _tried(objects, format, max_output).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("seq", "t.data"))).alias("parts"),
        F.sum("t.out_len").alias("n"),
        (F.min(F.coalesce(F.col("t.finished"), F.lit(False))) & (F.max("seq") + 1 == F.count(F.lit(1)))).alias("whole"),
    )
    whole = F.coalesce(F.col("whole") & (F.col("n") <= max_output), F.lit(False))
    rows = objects.join(done, "path", "left").withColumn("whole", whole)
    rows = rows.select("path", "whole", "n", join(F.when(F.col("whole"), F.col("parts"))).alias("joined"), codecs.try_decompress(F.when(~F.col("whole"), F.col("content")), FORMATS[format][1], max_output=max_output).alias("t"))
    return rows.select("path", F.coalesce("joined", "t.data").alias("data"), F.when(F.col("whole"), F.col("n")).otherwise(F.col("t.out_len")).alias("out_len"), F.when(F.col("whole"), "blocks").otherwise("serial").alias("how"), "t.error", "t.reason")


def encode(objects: DataFrame, codec: str, size: int = 1 << 20, level: int | None = None) -> DataFrame:
    """(path, content): chunks of ``size`` bytes encoded each as a row and joined to one object: xz to one stream of blocks,
    Snappy to one stream (64 KiB chunks at most), zstd and bzip2 to frames and streams that stand one after another."""
    if codec not in ("xz", "snappy_stream", "zstd", "bzip2"):
        raise ValueError(f"no parallel encoder for {codec}")

    def part(data: bytes) -> bytes:
        if codec == "bzip2":
            return bz2.compress(data, level or 9)
        if codec == "xz":
            return lzma.compress(data, preset=level)
        packed = codecs.compress_bytes(data, codec, level)
        return packed[len(SNAPPY_ID) :] if codec == "snappy_stream" else packed

    def whole(parts: list[bytes]) -> bytes:
        if codec == "snappy_stream":
            return SNAPPY_ID + b"".join(parts)
        if codec == "xz":
            return xz_stream(parts[0][6:8], [b for p in parts for _, _, b in _xz_parts(p)])
        return b"".join(parts)

    @pandas_udf("binary")
    def pack(chunk: pd.Series) -> pd.Series:
        return chunk.map(lambda c: part(bytes(c)))

    @pandas_udf("binary")
    def join(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: whole([bytes(x["data"]) for x in p]))

    rows = chunks(pick(objects, "path", "content"), size, 0).select("path", "seq", pack("chunk").alias("data"))
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("parts")).select("path", join("parts").alias("content"))
