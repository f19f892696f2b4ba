"""Resumable decoding as Structured Streaming: pieces of objects arrive in any batches, decoded bytes leave as they come.

The state of an object is a restart point, not a decompressor: the unread bytes from the last member or frame on, how
much of it has been given out, and the running totals. A refused object answers every later piece with the same error."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "path string, data binary, out_offset long, members long, crc32 long, error string"
STATE = "tail binary, given long, total long, members long, crc long, error string"


def step(state: tuple, piece: bytes) -> tuple[tuple, bytes]:
    """The next state of a gzip stream, and the bytes that ``piece`` lets out."""
    tail, given, total, members, crc, error = state
    if error is not None:
        return state, b""
    data, out = tail + piece, []
    while data:
        z = zlib.decompressobj(31)
        try:
            text = z.decompress(data)
        except zlib.error as e:
            return (b"", 0, total, members, crc, str(e).split(": ")[-1]), b"".join(out)
        out.append(text[given:])
        if not z.eof:
            given = len(text)
            break
        data, given, members = z.unused_data, 0, members + 1
    new = b"".join(out)
    return (data, given, total + len(new), members, zlib.crc32(new, crc), None), new


def decode_stream(pieces: DataFrame) -> DataFrame:
    """``pieces``, a stream of (path, seq, piece), to a stream by ``OUT``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else (b"", 0, 0, 0, 0, None)
        state = (bytes(state[0]), *state[1:])
        rows = pd.concat(list(batches)).sort_values("seq")
        for piece in rows["piece"]:
            before = state[2]
            state, new = step(state, bytes(piece))
            yield pd.DataFrame({"path": [key[0]], "data": [new], "out_offset": [before], "members": [state[3]], "crc32": [state[4]], "error": [state[5]]})
        held.update(state)

    return pieces.groupBy("path").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")


def encode_step(before: bytes, piece: bytes, level: int = 6) -> tuple[bytes, bytes]:
    """A piece as sync-flushed raw DEFLATE that may refer to the 32 KiB before; and what the next one may refer to."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15, 8, 0, *([before] if before else []))
    return z.compress(piece) + z.flush(zlib.Z_SYNC_FLUSH), (before + piece)[-32768:]


def encode_stream(pieces: DataFrame, level: int = 6) -> DataFrame:
    """A stream of (path, seq, piece) to (path, seq, data): joined in order and ended by 0x0300, one raw DEFLATE stream."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        before = bytes(held.get[0]) if held.exists else b""
        for seq, piece in pd.concat(list(batches)).sort_values("seq")[["seq", "piece"]].itertuples(index=False):
            data, before = encode_step(before, bytes(piece), level)
            yield pd.DataFrame({"path": [key[0]], "seq": [seq], "data": [data]})
        held.update((before,))

    return pieces.groupBy("path").applyInPandasWithState(run, "path string, seq long, data binary", "before binary", "append", "NoTimeout")
