"""Indexes stored with streams: that of Snappy streams (an own chunk at the end), and seek points of gzip objects as a file.

Offsets in an index are as-of points: ``chunked.find`` looks them up for whole tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from bytewright.functions import deflate
from bytewright.operators.framing import gzip_members, snappy_chunks
from bytewright.operators.indexes import _body, points_of
from bytewright.plans.columns import pick

#: Fixed values of the format: chunk type, words at both ends, most entries, least distance of two.
KIND, HEAD, TAIL, MOST, APART = 0x99, b"s2idx\0", b"\0xdi2s", 1 << 16, 1 << 20
#: The same of the file of seek points; containers and accepted containers by their numbers there.
POINTS_HEAD, CONTAINERS, ACCEPTS = b"WIDX\x01\0\0\0", ("raw", "zlib", "gzip"), ("raw", "zlib", "gzip", "zlib_or_raw", "gzip_or_zlib")
ENTRIES = "path string, seq int, out_offset long, in_offset long"
Entry = tuple[int, int]  # in_offset, out_offset


class InvalidIndex(ValueError):
    pass


def _put(n: int) -> bytes:
    """A signed number, zigzag, seven bits a byte."""
    n, out = n << 1 if n >= 0 else ~(n << 1), bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _get(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for i in range(10):
        if at + i >= len(data):
            raise InvalidIndex("Truncated")
        value |= (data[at + i] & 127) << 7 * i
        if data[at + i] < 128:
            return (value >> 1 if value & 1 == 0 else ~(value >> 1)), at + i + 1
    raise InvalidIndex("number")


def _half(n: int) -> int:
    return n // 2 if n >= 0 else -(-n // 2)


def thinned(entries: list[Entry], apart: int = APART, most: int = MOST) -> list[Entry]:
    """Entries at least ``apart`` decoded bytes from the one before, then every k-th where there are more than ``most``."""
    kept: list[Entry] = []
    for e in entries:
        if not kept or e[1] - kept[-1][1] >= apart:
            kept.append(e)
    return kept[:: -(-len(kept) // most)] if kept else kept


def dump(entries: list[Entry], out_len: int, in_len: int, block: int) -> bytes:
    """The index chunk. Offsets are held as differences from a guess: ``block`` further, and half the error learnt."""
    regular = all(out == i * block for i, (_, out) in enumerate(entries))
    body = HEAD + _put(out_len) + _put(in_len) + _put(block) + _put(len(entries)) + bytes([not regular])
    if not regular:
        body += b"".join(_put(out - (entries[i - 1][1] + block if i else 0)) for i, (_, out) in enumerate(entries))
    guess = _half(block)
    for i, (at, _) in enumerate(entries):
        error = at - (entries[i - 1][0] + guess if i else 0)
        body += _put(error)
        guess += _half(error) if i else 0
    size = len(body) + 4 + 10
    return bytes([KIND]) + (size - 4).to_bytes(3, "little") + body + struct.pack("<I", size) + TAIL


def load(chunk: bytes) -> tuple[list[Entry], int, int, int]:
    """Entries, decoded and encoded length, block; anything not in order or out of bounds is ``InvalidIndex``."""
    if len(chunk) < 20 or chunk[0] != KIND or chunk[4:10] != HEAD or int.from_bytes(chunk[1:4], "little") + 4 > len(chunk):
        raise InvalidIndex("header")
    out_len, at = _get(chunk, 10)
    in_len, at = _get(chunk, at)
    block, at = _get(chunk, at)
    count, at = _get(chunk, at)
    if out_len < 0 or in_len < -1 or block < 0 or not 0 <= count <= MOST or at >= len(chunk) or chunk[at] > 1:
        raise InvalidIndex("fields")
    given, at = chunk[at], at + 1
    outs, ins, guess = [], [], _half(block)
    for i in range(count):
        error, at = _get(chunk, at) if given else (0, at)
        outs.append(error + (outs[-1] + block if i else 0))
        if outs[-1] < 0 or outs[-1] > out_len or i and outs[-1] <= outs[-2]:
            raise InvalidIndex("offsets")
    for i in range(count):
        error, at = _get(chunk, at)
        ins.append(error + (ins[-1] + guess if i else 0))
        guess += _half(error) if i else 0
        if ins[-1] < 0 or in_len >= 0 and ins[-1] > in_len or i and ins[-1] <= ins[-2]:
            raise InvalidIndex("offsets")
    if len(chunk) < at + 10 or struct.unpack_from("<I", chunk, at)[0] != at + 10 or chunk[at + 4 : at + 10] != TAIL:
        raise InvalidIndex("trailer")
    return list(zip(ins, outs, strict=True)), out_len, in_len, block


def load_from_end(stream: bytes) -> tuple[list[Entry], int, int, int]:
    """The index that a stream ends with, found by its trailer."""
    if len(stream) < 20 or stream[-6:] != TAIL:
        raise InvalidIndex("trailer")
    size = struct.unpack_from("<I", stream, len(stream) - 10)[0]
    if not 20 <= size <= len(stream):
        raise InvalidIndex("size")
    return load(stream[len(stream) - size :])


def find(entries: list[Entry], out_len: int, offset: int) -> Entry:
    """The last entry at or before a decoded offset; negative ones count from the end."""
    offset += out_len if offset < 0 else 0
    if not 0 <= offset <= out_len:
        raise InvalidIndex("offset")
    return max((e for e in entries if e[1] <= offset), key=lambda e: e[1], default=(0, 0))


def entries_of(stream: bytes) -> tuple[list[Entry], int]:
    """An entry for each data chunk of a Snappy stream, and the decoded length."""
    found, out = [], 0
    for kind, at, _, size, _, _ in snappy_chunks(stream):
        if kind in ("compressed", "stored"):
            found.append((at, out))
            out += size or 0
    return found, out


def indexed(stream: Column, apart: int = APART) -> Column:
    """A Snappy stream with its index behind it."""

    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        def one(v: bytes) -> bytes:
            entries, out = entries_of(v)
            kept = thinned(entries, apart)
            return v + dump(kept, out, len(v), kept[1][1] if len(kept) > 1 else out)

        return values.map(lambda v: None if v is None else one(bytes(v)))

    return run(stream)


def stored_entries(objects: DataFrame) -> DataFrame:
    """Rows by ``ENTRIES`` of the indexes that streams (path, content) end with; streams without one give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if data is None or data[-6:] != TAIL:
                    continue
                found = load_from_end(data)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array([e[1] for e in found], pa.int64()), pa.array([e[0] for e in found], pa.int64())],
                    ["path", "seq", "out_offset", "in_offset"],
                )

    return pick(objects, "path", "content").mapInArrow(run, ENTRIES)


def dump_points(data: bytes, spacing: int = 1 << 20) -> bytes:
    """Seek points of a gzip object as a file: after the head the lengths, the number of points and the accepted container;
    of each point both offsets, the member's checksum and length so far, the members before, the history and unread bits."""
    starts, before = [], 0
    for _, at, _, size, _, _ in gzip_members(data):
        starts.append((before, _body(data, at)))
        before += size or 0
    plain = b"".join(deflate.inflate(data[s:])[0] for _, s in starts)
    records = []
    for bit, out, history in points_of(data, spacing):
        member = max(i for i, (b, s) in enumerate(starts) if b <= out and 8 * s <= bit)
        first, bits = starts[member][0], -bit % 8
        if out == 0 or -(-bit // 8) >= len(data):
            continue
        pending = data[bit // 8] >> 8 - bits if bits else 0
        records.append(struct.pack("<QQIIIHBBB", -(-bit // 8), out, zlib.crc32(plain[first:out]), out - first & 0xFFFFFFFF, member, len(history), 15 | bits << 4, pending, CONTAINERS.index("gzip")) + history)
    return POINTS_HEAD + struct.pack("<QQQB", len(data), len(plain), len(records), ACCEPTS.index("gzip")) + b"".join(records)


def load_points(file: bytes) -> tuple[list[tuple[int, int, bytes]], dict]:
    """(bit, out_offset, history) of each point, as ``indexes.read_from`` takes them, and the file's own fields."""
    if len(file) < 33 or file[:8] != POINTS_HEAD:
        raise InvalidIndex("head")
    in_len, out_len, count, accept = struct.unpack_from("<QQQB", file, 8)
    if accept >= len(ACCEPTS) or count > (len(file) - 33) // 33:
        raise InvalidIndex("fields")
    at, points, last = 33, [], (0, 0)
    for _ in range(count):
        if len(file) - at < 33:
            raise InvalidIndex("Truncated")
        begin, out, _, _, _, n, packed, pending, container = struct.unpack_from("<QQIIIHBBB", file, at)
        window, bits = packed & 15, packed >> 4
        if not 8 <= window <= 15 or bits > 7 or n > 1 << window or pending >> bits or container >= len(CONTAINERS):
            raise InvalidIndex("point")
        if not last[0] <= begin < in_len or not last[1] < out <= out_len or n > len(file) - at - 33:
            raise InvalidIndex("order")
        points.append((8 * begin - bits, out, file[at + 33 : at + 33 + n]))
        at, last = at + 33 + n, (begin, out)
    if at != len(file):
        raise InvalidIndex("length")
    return points, {"in_len": in_len, "out_len": out_len, "accept": ACCEPTS[accept]}


def points_file(content: Column, spacing: int = 1 << 20) -> Column:
    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else dump_points(bytes(v), spacing))

    return run(content)


