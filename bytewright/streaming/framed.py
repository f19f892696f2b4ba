"""Streams of zstd, LZ4, Snappy, bzip2 and xz in Structured Streaming, beside gzip's in ``resumable``.

Encoding needs no state: each piece becomes frames, streams or chunks of its own, and joined in order they are one valid object.
Decoding keeps a restart point for each object: the unread bytes of the frame, stream or chunk that is not complete yet. Decoded
bytes of zstd, LZ4 and Snappy leave by whole frames and chunks, those of bzip2 and xz as they come; the latter decode their
current stream anew for each piece, so long streams belong in ``operators.parallel``. A refused object answers every later piece
with the same error. Empty pieces change nothing; null pieces count as empty."""

from __future__ import annotations

import bz2
import lzma
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewright.functions import codecs
from bytewright.operators import framing

CODECS = ("zstd", "lz4", "snappy_stream", "bzip2", "xz")
OUT = "path string, data binary, out_offset long, units long, error string"
STATE = "tail binary, given long, total long, units long, error string"
START = (b"", 0, 0, 0, None)
_SNAPPY_ID = b"\xff\x06\0\0sNaPpY"
_Decoded = tuple[list[bytes], bytes, int, int]  # what came out, unread bytes, how much of their output is out, units


def _by_frames(walk: Callable) -> Callable[[bytes, int, int], _Decoded]:
    def run(data: bytes, given: int, units: int, codec: str) -> _Decoded:
        out, end = [], 0
        try:
            for kind, at, n, *_ in walk(data):
                if kind == "frame":
                    out.append(codecs.decompress_bytes(data[at : at + n], codec)[0])
                units += kind == "frame"
                end = at + n
        except framing.Bad as e:
            if e.reason != "Truncated":
                raise codecs.Refused("InvalidStream", e.reason) from None
        return out, data[end:], 0, units

    return run


def _snappy(data: bytes, given: int, units: int, codec: str) -> _Decoded:
    if not units and not _SNAPPY_ID.startswith(data[:10]):
        raise codecs.Refused("InvalidStream", "stream identifier")
    end, found = 0, 0
    while end + 4 <= len(data) and (n := 4 + int.from_bytes(data[end + 1 : end + 4], "little")) <= len(data) - end:
        end, found = end + n, found + 1
    if end + 4 <= len(data) and data[end] < 2 and n > 8 + 76490:  # no chunk of 65,536 bytes is longer
        raise codecs.Refused("InvalidStream", "chunk length")
    if not found:
        return [], data, 0, units
    return [codecs.decompress_bytes((_SNAPPY_ID if units else b"") + data[:end], codec)[0]], data[end:], 0, units + found


def _by_streams(make: Callable) -> Callable[[bytes, int, int], _Decoded]:
    def run(data: bytes, given: int, units: int, codec: str) -> _Decoded:
        out = []
        while data:
            if codec == "xz" and units and not any(data[:4]):  # padding behind a stream
                if len(data) < 4:
                    break
                data = data[4:]
                continue
            z = make()
            try:
                text = z.decompress(data)
            except (OSError, EOFError, lzma.LZMAError) as e:
                raise codecs.Refused("InvalidStream", str(e)) from None
            out.append(text[given:])
            if not z.eof:
                given = len(text)
                break
            data, given, units = z.unused_data, 0, units + 1
        return out, data, given, units

    return run


_DECODERS = {
    "zstd": _by_frames(framing.zstd_frames),
    "lz4": _by_frames(lambda data: framing.lz4_blocks(data, True)),
    "snappy_stream": _snappy,
    "bzip2": _by_streams(bz2.BZ2Decompressor),
    "xz": _by_streams(lzma.LZMADecompressor),
}


def step(state: tuple, piece: bytes, codec: str) -> tuple[tuple, bytes]:
    """The next state of an object, and the bytes that ``piece`` lets out."""
    tail, given, total, units, error = state
    if error is not None or not piece:
        return state, b""
    try:
        out, tail, given, units = _DECODERS[codec](tail + piece, given, units, codec)
    except codecs.Refused as e:
        return (b"", 0, total, units, e.error), b""
    new = b"".join(out)
    return (tail, given, total + len(new), units, None), new


def decode_stream(pieces: DataFrame, codec: str) -> DataFrame:
    """``pieces``, a stream of (path, seq, piece), to a stream by ``OUT``. ``codec`` is one of ``CODECS``."""
    if codec not in CODECS:
        raise ValueError(f"no stream decoder for {codec}")

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else START
        state = (bytes(state[0]), *state[1:])
        for piece in pd.concat(list(batches)).sort_values("seq")["piece"]:
            before = state[2]
            state, new = step(state, b"" if piece is None else bytes(piece), codec)
            yield pd.DataFrame({"path": [key[0]], "data": [new], "out_offset": [before], "units": [state[3]], "error": [state[4]]})
        held.update(state)

    return pieces.groupBy("path").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")


def encode_stream(pieces: DataFrame, codec: str, level: int | None = None) -> DataFrame:
    """A stream of (path, seq, piece) to (path, seq, data); joined in order, one object of ``codec``. Rows stay where they are."""
    if codec not in CODECS:
        raise ValueError(f"no stream encoder for {codec}")
    piece = F.coalesce("piece", F.lit(b""))
    return pieces.select("path", "seq", codecs.compress(piece, codec, level).alias("data"))
