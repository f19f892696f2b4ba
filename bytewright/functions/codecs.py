"""Whole-buffer codecs over binary columns.

``compress`` and ``decompress`` raise on bad input; ``try_decompress`` answers a struct instead: data, in_len, out_len,
finished, error, reason. By default all members, frames or streams that stand one after another are read; ``one``
reads the first. ``max_output`` bounds what a row may expand to."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from bytewright.functions import deflate, lzw
from bytewright.functions.checksums import CRC32C, crc_bytes

MAX_OUTPUT = 1 << 30
TRIED = "data binary, in_len long, out_len long, finished boolean, error string, reason string"
_STRATEGIES = {"default": 0, "filtered": 1, "huffman_only": 2, "rle": 3, "fixed": 4}
_WBITS = {"raw": -15, "zlib": 15, "gzip": 31}


class Refused(Exception):
    def __init__(self, error: str, reason: str):
        super().__init__(f"{error}: {reason}")
        self.error, self.reason = error, reason


def gzip_header(level: int = 6, mtime: int = 0, os: int = 255, name: bytes | None = None, comment: bytes | None = None, extra: bytes | None = None, header_crc: bool = False) -> bytes:
    flags = 2 * header_crc | 4 * (extra is not None) | 8 * (name is not None) | 16 * (comment is not None)
    out = struct.pack("<4BIBB", 31, 139, 8, flags, mtime, 2 if level >= 9 else 4 if level == 1 else 0, os)
    out += struct.pack("<H", len(extra)) + extra if extra is not None else b""
    out += b"".join(x + b"\0" for x in (name, comment) if x is not None)
    return out + (struct.pack("<H", zlib.crc32(out) & 65535) if header_crc else b"")


def detect(accept: str, first: bytes) -> str:
    """The container by the first two bytes: ``zlib_or_raw`` is zlib where they form its header, ``gzip_or_zlib`` gzip where
    they are its magic number."""
    if accept == "gzip_or_zlib":
        return "gzip" if first[:2] == b"\x1f\x8b" else "zlib"
    header = len(first) >= 2 and (first[0] << 8 | first[1]) % 31 == 0 and first[0] & 15 == 8 and first[0] >> 4 <= 7
    return "zlib" if header else "raw"


def snappy_concat(blocks: list[bytes]) -> bytes:
    """One Snappy block that decodes to all of these in order: their lengths summed, their elements as they are."""
    sizes = [_varint(b) for b in blocks]
    total, head = sum(n for n, _ in sizes), bytearray()
    if total >= 1 << 32:
        raise Refused("OutputTooSmall", "length")
    while total >= 128:
        head.append(total & 127 | 128)
        total >>= 7
    return bytes([*head, total]) + b"".join(b[at:] for b, (_, at) in zip(blocks, sizes, strict=True))


def _deflate(data: bytes, container: str, level: int, strategy: str, dictionary: bytes | None, **header) -> bytes:
    level = min(level, 9)  # the library has no parser for levels 10 to 12, which ask for smaller output: they get its best
    z = zlib.compressobj(level, zlib.DEFLATED, -15 if container == "gzip" else _WBITS[container], 9, _STRATEGIES[strategy], *([dictionary] if dictionary else []))
    body = z.compress(data) + z.flush()
    return gzip_header(level, **header) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF) if container == "gzip" else body


def _snappy(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.compress(data, codec="snappy", asbytes=True)


def _mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def _snappy_stream(data: bytes) -> bytes:
    out = [b"\xff\x06\0\0sNaPpY"]
    for at in range(0, len(data), 65536):
        block = data[at : at + 65536]
        packed = _snappy(block)
        kind, body = (0, packed) if len(packed) < len(block) else (1, block)
        out.append(struct.pack("<I", kind | (len(body) + 4) << 8) + struct.pack("<I", _mask(crc_bytes(block, CRC32C))) + body)
    return b"".join(out)


_CHECKS = {"none": lzma.CHECK_NONE, "crc32": lzma.CHECK_CRC32, "crc64": lzma.CHECK_CRC64, "sha256": lzma.CHECK_SHA256}


def compress_bytes(data: bytes, codec: str, level: int | None = None, strategy: str = "default", dictionary: bytes | None = None, **options) -> bytes:
    """Options: of gzip its header's fields (``gzip_header``); of zstd checksum, content_size and dictionary_id, each whether it
    is written; of xz check (none, crc32, crc64, sha256) and filters; of lzma filters, as the lzma module takes them."""
    known = {"gzip": {"mtime", "os", "name", "comment", "extra", "header_crc"}, "zstd": {"checksum", "content_size", "dictionary_id"}, "xz": {"check", "filters"}, "lzma": {"filters"}}.get(codec, set())
    if set(options) - known:
        raise ValueError(f"no options {sorted(set(options) - known)} of {codec}")
    if codec in _WBITS:
        return _deflate(data, codec, 6 if level is None else level, strategy, dictionary, **options)
    if codec == "zstd":
        import zstandard as z

        flags = {"write_checksum": options.get("checksum", True), "write_content_size": options.get("content_size", True), "write_dict_id": options.get("dictionary_id", True)}
        return z.ZstdCompressor(level=level or 3, dict_data=z.ZstdCompressionDict(dictionary) if dictionary else None, **flags).compress(data)
    if codec == "bzip2":
        return bz2.compress(data, level or 9)
    if codec == "xz":
        return lzma.compress(data, check=_CHECKS[options.get("check", "crc64")], preset=level, filters=options.get("filters"))
    if codec == "lzma":
        return lzma.compress(data, lzma.FORMAT_ALONE, preset=level, filters=options.get("filters"))
    if codec == "snappy":
        return _snappy(data)
    if codec == "snappy_stream":
        return _snappy_stream(data)
    if codec in ("lz4", "lz4_block", "brotli"):
        import pyarrow as pa

        name = {"lz4": "lz4", "lz4_block": "lz4_raw", "brotli": "brotli"}[codec]
        return bytes(pa.Codec(name, level).compress(data, asbytes=True) if codec == "brotli" and level is not None else pa.compress(data, codec=name, asbytes=True))
    raise ValueError(f"no encoder for {codec}")


def _inflate(data: bytes, container: str, members: str, dictionary: bytes | None, limit: int) -> tuple[bytes, int, bool]:
    out, at = [], 0
    room = limit
    while True:
        z = zlib.decompressobj(_WBITS[container], *([dictionary] if dictionary and container != "gzip" else []))
        try:
            piece = z.decompress(data[at:], room + 1)
        except zlib.error as e:
            text = str(e)
            if "code 2" in text or "need dictionary" in text:
                raise Refused("DictionaryMismatch", "dictionary") from None
            raise Refused("ChecksumMismatch" if "incorrect data check" in text else "InvalidStream", text.split(": ")[-1]) from None
        out.append(piece)
        room -= len(piece)
        if room < 0:
            raise Refused("OutputTooSmall", "max_output")
        if not z.eof:
            raise Refused("Truncated", "unexpected end")
        at = len(data) - len(z.unused_data)
        if container != "gzip" or members == "one" or at == len(data):
            return b"".join(out), at, True


def _varint(data: bytes) -> tuple[int, int]:
    value = 0
    for i in range(5):
        if i >= len(data):
            raise Refused("Truncated", "length")
        value |= (data[i] & 127) << 7 * i
        if data[i] < 128:
            if value >= 1 << 32:
                break
            return value, i + 1
    raise Refused("InvalidStream", "length")


def _unsnappy(data: bytes, limit: int) -> bytes:
    import pyarrow as pa

    size, _ = _varint(data)
    if size > limit:
        raise Refused("OutputTooSmall", "max_output")
    return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)


def _unsnappy_stream(data: bytes, limit: int) -> bytes:
    out, at, first = [], 0, True
    while at < len(data):
        if len(data) - at < 4:
            raise Refused("Truncated", "chunk header")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        if first and (kind != 255 or body != b"sNaPpY"):
            raise Refused("InvalidStream", "stream identifier")
        first = False
        if len(body) < size:
            raise Refused("Truncated", "chunk")
        if kind in (0, 1):
            block = _unsnappy(body[4:], 65536) if kind == 0 else body[4:]
            if _mask(crc_bytes(block, CRC32C)) != int.from_bytes(body[:4], "little"):
                raise Refused("ChecksumMismatch", "chunk checksum")
            out.append(block)
            limit -= len(block)
            if limit < 0:
                raise Refused("OutputTooSmall", "max_output")
        elif 2 <= kind < 128:
            raise Refused("Unsupported", "unskippable chunk")
        at += 4 + size
    return b"".join(out)


def _stream(data: bytes, make: Callable, errors: tuple, members: str, limit: int, padded: bool = False) -> tuple[bytes, int]:
    """Standard library decompressors that stop at a stream's end; ``padded``: zeros by fours may stand behind it."""
    out, at = [], 0
    while at < len(data):
        z = make()
        try:
            piece = z.decompress(data[at:], limit + 1)
        except errors as e:
            raise Refused("InvalidStream", str(e)) from None
        limit -= len(piece)
        if limit < 0:
            raise Refused("OutputTooSmall", "max_output")
        out.append(piece)
        if not z.eof:
            raise Refused("Truncated", "unexpected end")
        at = len(data) - len(z.unused_data)
        if members == "one":
            break
        while padded and data[at : at + 4] == bytes(4):
            at += 4
    if not out:
        raise Refused("Truncated", "empty")
    return b"".join(out), at


def decompress_bytes(data: bytes, codec: str, members: str = "all", dictionary: bytes | None = None, limit: int = MAX_OUTPUT, size: int | None = None) -> tuple[bytes, int]:
    """Decoded bytes and how many were read."""
    if codec in ("zlib_or_raw", "gzip_or_zlib"):
        codec = detect(codec, data[:2])
    if codec in _WBITS:
        return _inflate(data, codec, members, dictionary, limit)[:2]
    if codec == "bzip2":
        return _stream(data, bz2.BZ2Decompressor, (OSError, EOFError), members, limit)
    if codec == "xz":
        return _stream(data, lzma.LZMADecompressor, (lzma.LZMAError, EOFError), members, limit, True)
    if codec == "lzma":
        return _stream(data, lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE), (lzma.LZMAError, EOFError), "one", limit)
    if codec == "snappy":
        import pyarrow as pa

        try:
            return _unsnappy(data, limit), len(data)
        except (pa.ArrowException, OSError) as e:
            raise Refused("InvalidStream", str(e)) from None
    if codec == "snappy_stream":
        return _unsnappy_stream(data, limit), len(data)
    if codec == "deflate64":
        return deflate.inflate(data, limit=limit, wide=True)
    if codec == "lzw":
        return lzw.decode(data, limit=limit)
    if codec == "zstd":
        import zstandard as z

        if members == "one":
            d = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(dictionary) if dictionary else None).decompressobj()
            try:
                out = d.decompress(data)
            except z.ZstdError as e:
                raise Refused("InvalidStream", str(e)) from None
            if not d.eof:
                raise Refused("Truncated", "unexpected end")
            return out, len(data) - len(d.unused_data)
        from bytewright.operators.framing import Bad, zstd_frames

        try:
            for _ in zstd_frames(data):
                pass
        except Bad as e:
            raise Refused("Truncated" if e.reason == "Truncated" else "InvalidStream", e.reason) from None
        try:
            with z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(dictionary) if dictionary else None).stream_reader(data, read_across_frames=True) as r:
                out = r.read(limit + 1)
        except z.ZstdError as e:
            raise Refused("ChecksumMismatch" if "checksum" in str(e).lower() else "InvalidStream", str(e)) from None
        if len(out) > limit:
            raise Refused("OutputTooSmall", "max_output")
        return out, len(data)
    if codec in ("lz4", "brotli", "lz4_block"):
        import pyarrow as pa

        try:
            if codec == "lz4_block":
                return pa.decompress(data, decompressed_size=limit if size is None else size, codec="lz4_raw", asbytes=True), len(data)
            out = pa.CompressedInputStream(pa.BufferReader(data), codec).read(limit + 1)
        except (pa.ArrowException, OSError) as e:
            raise Refused("InvalidStream", str(e)) from None
        if len(out) > limit:
            raise Refused("OutputTooSmall", "max_output")
        return out, len(data)
    raise ValueError(f"no decoder for {codec}")


def compress(data: Column, codec: str, level: int | None = None, strategy: str = "default", dictionary: bytes | None = None, **options) -> Column:
    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else compress_bytes(bytes(v), codec, level, strategy, dictionary, **options))

    return run(data)


def decompress(data: Column, codec: str, members: str = "all", dictionary: bytes | None = None, max_output: int = MAX_OUTPUT) -> Column:
    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else decompress_bytes(bytes(v), codec, members, dictionary, max_output)[0])

    return run(data)


def try_decompress(data: Column, codec: str, members: str = "all", dictionary: bytes | None = None, max_output: int = MAX_OUTPUT) -> Column:
    def one(v: bytes | None) -> tuple:
        if v is None:
            return (None,) * 6
        try:
            out, used = decompress_bytes(bytes(v), codec, members, dictionary, max_output)
            return out, used, len(out), True, None, None
        except Refused as e:
            return None, None, None, False, e.error, e.reason

    @pandas_udf(TRIED)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=[x.split()[0] for x in TRIED.split(", ")])

    return run(data)


def decompress_prefix(data: Column, codec: str, n: int) -> Column:
    """The first ``n`` decoded bytes of a deflate stream, without decoding more."""

    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else zlib.decompressobj(_WBITS[codec]).decompress(bytes(v), n) if n else b"")

    return run(data)


def concat_blocks(blocks: Column) -> Column:
    """An array of Snappy blocks as one block."""

    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else snappy_concat([bytes(b) for b in v]))

    return run(blocks)


def bound(n: Column, codec: str) -> Column:
    """The most bytes that encoding ``n`` bytes can give."""
    div = lambda a, b: F.floor(a / b)
    if codec in _WBITS:
        return n + 5 * (div(n, 5000) + div(n, 65535) + 2) + 8 + {"raw": 0, "zlib": 6, "gzip": 18}[codec]
    if codec == "lz4_block":
        return n + div(n, 255) + 16
    if codec == "lz4":
        return 19 + n + F.ceil(n / 4194304) * 4 + 8
    if codec == "zstd":
        return n + F.shiftright(n, 8) + F.when(n < 131072, F.shiftright(131072 - n, 11)).otherwise(0)
    if codec == "snappy":
        return 32 + n + div(n, 6)
    if codec == "brotli":
        return F.when(n == 0, F.lit(2)).otherwise(n + 2 + 4 * F.shiftright(n, 14) + 4)
    raise ValueError(f"no bound for {codec}")
