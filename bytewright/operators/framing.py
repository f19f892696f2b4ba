"""Units of compressed objects as rows: members, frames, blocks and chunks, from headers alone where the format allows.

``units(df, format)`` takes path and content and gives a row for each unit by ``SCHEMA``; an object that is refused ends
with a row of kind ``refused``, whose attrs hold the reason and whose in_offset the place."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from bytewright.plans.columns import pick

SCHEMA = "path string, seq int, format string, kind string, in_offset long, in_len long, out_offset long, out_len long, checksum long, attrs map<string,string>"
Unit = tuple[str, int, int, int | None, int | None, dict]  # kind, in_offset, in_len, out_len, checksum, attrs


class Bad(Exception):
    def __init__(self, at: int, reason: str):
        super().__init__(reason)
        self.at, self.reason = at, reason


def _need(data: bytes, at: int, n: int) -> None:
    if at + n > len(data):
        raise Bad(len(data), "Truncated")


def gzip_members(data: bytes) -> Iterator[Unit]:
    at = 0
    while at < len(data):
        _need(data, at, 10)
        if data[at : at + 3] != b"\x1f\x8b\x08":
            raise Bad(at, "InvalidHeader")
        flags, mtime = data[at + 3], struct.unpack_from("<I", data, at + 4)[0]
        end, attrs = at + 10, {"mtime": str(mtime), "os": str(data[at + 9]), "xfl": str(data[at + 8])}
        if flags & 4:
            _need(data, end, 2)
            n = struct.unpack_from("<H", data, end)[0]
            extra = data[end + 2 : end + 2 + n]
            attrs["extra"] = extra.hex()
            if extra[:4] == b"BC\x02\0":
                attrs["bsize"] = str(struct.unpack_from("<H", extra, 4)[0] + 1)
            end += 2 + n
        for bit, name in ((8, "name"), (16, "comment")):
            if flags & bit:
                stop = data.find(b"\0", end)
                if stop < 0:
                    raise Bad(len(data), "Truncated")
                attrs[name] = data[end:stop].decode("latin-1")
                end = stop + 1
        if flags & 2:
            _need(data, end, 2)
            if zlib.crc32(data[at:end]) & 0xFFFF != struct.unpack_from("<H", data, end)[0]:
                raise Bad(end, "ChecksumMismatch")
            end += 2
        z = zlib.decompressobj(-15)
        try:
            size = len(z.decompress(data[end:]))
        except zlib.error:
            raise Bad(end, "InvalidStream") from None
        stop = len(data) - len(z.unused_data)
        _need(data, stop, 8)
        if not z.eof:
            raise Bad(stop, "Truncated")
        yield "member", at, stop + 8 - at, size, struct.unpack_from("<I", data, stop)[0], attrs
        at = stop + 8


def zstd_frames(data: bytes, blocks: bool = False) -> Iterator[Unit]:
    at = 0
    while at < len(data):
        _need(data, at, 5)
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            _need(data, at, 8)
            n = struct.unpack_from("<I", data, at + 4)[0]
            _need(data, at, 8 + n)
            if not blocks:
                yield "skippable", at, 8 + n, 0, None, {"variant": str(magic & 15)}
            at += 8 + n
            continue
        if magic != 0xFD2FB528:
            raise Bad(at, "InvalidHeader")
        flags = data[at + 4]
        single, checksum, id_size, size_code = flags >> 5 & 1, flags >> 2 & 1, (0, 1, 2, 4)[flags & 3], flags >> 6
        if flags & 8:
            raise Bad(at + 4, "Unsupported")
        pos = at + 5 + (1 - single)
        _need(data, pos, 0)
        dictionary = int.from_bytes(data[pos : pos + id_size], "little")
        pos += id_size
        n = (1 if single else 0, 2, 4, 8)[size_code]
        size = int.from_bytes(data[pos : pos + n], "little") + (256 if n == 2 else 0) if n else None
        pos += n
        while True:
            _need(data, pos, 3)
            head = int.from_bytes(data[pos : pos + 3], "little")
            kind, length = ("raw", "rle", "compressed", "reserved")[head >> 1 & 3], head >> 3
            if kind == "reserved":
                raise Bad(pos, "InvalidStream")
            body = 1 if kind == "rle" else length
            _need(data, pos + 3, body)
            if blocks:
                yield kind, pos, 3 + body, None if kind == "compressed" else length, None, {"last": str(head & 1)}
            pos += 3 + body
            if head & 1:
                break
        crc = None
        if checksum:
            _need(data, pos, 4)
            crc = struct.unpack_from("<I", data, pos)[0]
            pos += 4
        if not blocks:
            yield "frame", at, pos - at, size, crc, {"dictionary_id": str(dictionary), "single_segment": str(single)}
        at = pos


def lz4_blocks(data: bytes, frames: bool = False) -> Iterator[Unit]:
    at = 0
    while at < len(data):
        _need(data, at, 7)
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            n = struct.unpack_from("<I", data, at + 4)[0]
            _need(data, at, 8 + n)
            yield "skippable", at, 8 + n, 0, None, {}
            at += 8 + n
            continue
        if magic != 0x184D2204:
            raise Bad(at, "InvalidHeader")
        flags, size_byte = data[at + 4], data[at + 5]
        if flags >> 6 != 1:
            raise Bad(at + 4, "Unsupported")
        pos, size = at + 6, None
        if flags & 8:
            _need(data, pos, 8)
            size, pos = struct.unpack_from("<Q", data, pos)[0], pos + 8
        pos += 4 if flags & 1 else 0
        pos += 1
        most = 1 << (8 + 2 * (size_byte >> 4 & 7))
        while True:
            _need(data, pos, 4)
            n = struct.unpack_from("<I", data, pos)[0]
            if n == 0:
                pos += 4
                break
            length, stored = n & 0x7FFFFFFF, n >> 31
            if length > most:
                raise Bad(pos, "InvalidStream")
            total = 4 + length + (4 if flags & 16 else 0)
            _need(data, pos, total)
            if not frames:
                yield "stored" if stored else "compressed", pos, total, length if stored else None, None, {}
            pos += total
        crc = None
        if flags & 4:
            _need(data, pos, 4)
            crc, pos = struct.unpack_from("<I", data, pos)[0], pos + 4
        if frames:
            yield "frame", at, pos - at, size, crc, {"block_size": str(most), "independent": str(flags >> 5 & 1)}
        at = pos


def snappy_chunks(data: bytes) -> Iterator[Unit]:
    from bytewright.functions.codecs import Refused, _varint

    at = 0
    while at < len(data):
        _need(data, at, 4)
        kind, n = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        _need(data, at + 4, n)
        name = {0: "compressed", 1: "stored", 254: "padding", 255: "identifier", 153: "index"}.get(kind, "skippable" if kind >= 128 else None)
        if name is None:
            raise Bad(at, "Unsupported")
        if at == 0 and name != "identifier":
            raise Bad(0, "InvalidHeader")
        size = crc = None
        if kind < 2:
            crc = struct.unpack_from("<I", data, at + 4)[0]
            try:
                size = n - 4 if kind else _varint(data[at + 8 : at + 13])[0]
            except Refused as e:
                raise Bad(at + 8, e.error) from None
        yield name, at, 4 + n, size or 0, crc, {}
        at += 4 + n


def xz_blocks(data: bytes) -> Iterator[Unit]:
    """From the indexes in front of the footers, without decoding a block; of all streams, with padding behind them."""

    def number(pos: int) -> tuple[int, int]:
        value = 0
        for i in range(9):
            _need(data, pos + i, 1)
            value |= (data[pos + i] & 127) << 7 * i
            if data[pos + i] < 128:
                return value, pos + i + 1
        raise Bad(pos, "InvalidIndex")

    def stream(end: int) -> tuple[int, int, list[tuple[int, int]]]:
        """Start, check and records of the stream that ends there."""
        if end < 32 or data[end - 2 : end] != b"YZ":
            raise Bad(0, "InvalidHeader")
        flags, size = data[end - 4 : end - 2], 4 * (struct.unpack_from("<I", data, end - 8)[0] + 1)
        index = end - 12 - size
        sound = index >= 12 and data[index] == 0 and zlib.crc32(data[index : end - 16]) == struct.unpack_from("<I", data, end - 16)[0]
        if not sound or zlib.crc32(data[end - 8 : end - 2]) != struct.unpack_from("<I", data, end - 12)[0]:
            raise Bad(max(index, 0), "InvalidIndex")
        records, (count, pos) = [], number(index + 1)
        for _ in range(count):
            unpadded, pos = number(pos)
            out, pos = number(pos)
            records.append((unpadded, out))
        start = index - 12 - sum(u + 3 & ~3 for u, _ in records)
        if start < 0 or data[start : start + 8] != b"\xfd7zXZ\0" + flags or zlib.crc32(flags) != struct.unpack_from("<I", data, start + 8)[0]:
            raise Bad(max(start, 0), "InvalidHeader")
        return start, flags[1], records

    streams, end = [], len(data)
    while end or not streams:
        while end >= 4 and data[end - 4 : end] == bytes(4):  # padding
            end -= 4
        streams.append(stream(end))
        end = streams[-1][0]
    for start, check, records in reversed(streams):
        at = start + 12
        for unpadded, out in records:
            yield "block", at, unpadded + 3 & ~3, out, None, {"unpadded": str(unpadded), "check": str(check)}
            at += unpadded + 3 & ~3


def bzip2_blocks(data: bytes) -> Iterator[Unit]:
    """Blocks begin at any bit: their magic numbers are looked for at all eight shifts."""
    found = []
    for shift in range(8):
        view = (int.from_bytes(data, "big") << shift & (1 << 8 * len(data)) - 1).to_bytes(len(data), "big") if shift else data
        for magic, kind in ((b"\x31\x41\x59\x26\x53\x59", "block"), (b"\x17\x72\x45\x38\x50\x90", "end")):
            pos = view.find(magic)
            while pos >= 0:
                found.append((8 * pos + shift, kind, int.from_bytes(view[pos + 6 : pos + 10], "big")))
                pos = view.find(magic, pos + 1)
    if data[:3] != b"BZh":
        raise Bad(0, "InvalidHeader")
    found.sort()
    for i, (bit, kind, crc) in enumerate(found):
        stop = found[i + 1][0] if i + 1 < len(found) else 8 * len(data)
        yield kind, bit // 8, (stop - bit) // 8, None, crc, {"bit": str(bit)}


FORMATS: dict[str, Callable[[bytes], Iterator[Unit]]] = {
    "gzip": gzip_members,
    "bgzf": gzip_members,
    "zstd": zstd_frames,
    "zstd_blocks": lambda d: zstd_frames(d, True),
    "lz4": lambda d: lz4_blocks(d, True),
    "lz4_blocks": lz4_blocks,
    "snappy": snappy_chunks,
    "xz": xz_blocks,
    "bzip2": bzip2_blocks,
}


def units(objects: DataFrame, format: str) -> DataFrame:
    walk = FORMATS[format]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "seq", "format", "kind", "in_offset", "in_len", "out_offset", "out_len", "checksum", "attrs"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.map_(pa.string(), pa.string())]
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, out = [], 0
                try:
                    for seq, (kind, at, n, size, crc, attrs) in enumerate(walk(data or b"")):
                        rows.append((path, seq, format, kind, at, n, out, size, crc, list(attrs.items())))
                        out = None if out is None or size is None else out + size
                except Bad as e:
                    rows.append((path, len(rows), format, "refused", e.at, None, None, None, None, [("reason", e.reason)]))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return pick(objects, "path", "content").mapInArrow(run, SCHEMA)
