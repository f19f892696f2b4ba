"""Reversible filters of executables: Delta and branch converters for fixed-width instruction sets."""

from __future__ import annotations

import lzma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def delta(data: bytes, distance: int, encode: bool) -> bytes:
    a = np.frombuffer(data, np.uint8)
    if encode:
        out = a.copy()
        out[distance:] -= a[:-distance] if len(a) > distance else a[:0]
        return out.tobytes()
    padded = np.zeros(-(-len(a) // distance) * distance, np.uint8)
    padded[: len(a)] = a
    return np.cumsum(padded.reshape(-1, distance), axis=0, dtype=np.uint8).ravel()[: len(a)].tobytes()


def branch(data: bytes, kind: str, encode: bool, start: int = 0) -> bytes:
    """Relative branch targets to absolute ones and back; of ``arm``, ``powerpc``, ``sparc``, ``arm64``."""
    n = len(data) // 4 * 4
    words = np.frombuffer(data[:n], ">u4" if kind in ("powerpc", "sparc") else "<u4").astype(np.int64)
    at = start + 4 * np.arange(len(words), dtype=np.int64)
    sign = 1 if encode else -1
    if kind == "arm":
        hit = words >> 24 == 0xEB
        new = 0xEB000000 | ((words << 2) + sign * (at + 8) >> 2 & 0xFFFFFF)
    elif kind == "powerpc":
        hit = (words >> 26 == 0x12) & (words & 3 == 1)
        new = 0x48000001 | ((words & 0x03FFFFFC) + sign * at & 0x03FFFFFC)
    elif kind == "sparc":
        hit = (words >> 22 == 0x100) | (words >> 22 == 0x1FF)
        moved = (words << 2) + sign * at >> 2
        new = ((0 - (moved >> 22 & 1)) << 22 & 0x3FFFFFFF) | moved & 0x3FFFFF | 0x40000000
    elif kind == "arm64":
        hit = words >> 26 == 0x25
        page = (words & 0x9F000000) == 0x90000000
        new = 0x94000000 | (words + sign * (at >> 2) & 0x03FFFFFF)
        value = (words >> 29 & 3) | (words >> 3 & 0x1FFFFC)
        near = page & ((value + 0x020000 & 0x1C0000) == 0)
        moved = value + sign * (at >> 12)
        paged = (words & 0x9000001F) | (moved & 3) << 29 | (moved & 0x3FFFC) << 3 | ((0 - (moved & 0x20000)) & 0xE00000)
        words = np.where(near, paged, words)
        hit &= ~near
    else:
        raise ValueError(f"no filter {kind}")
    out = np.where(hit, new, words) & 0xFFFFFFFF
    return out.astype(">u4" if kind in ("powerpc", "sparc") else "<u4").tobytes() + data[n:]


def branch_by_library(data: bytes, kind: str, encode: bool) -> bytes:
    """``x86``, ``ia64`` and ``armthumb`` by liblzma: through LZMA2 with the filter on one side only."""
    own = {"x86": lzma.FILTER_X86, "ia64": lzma.FILTER_IA64, "armthumb": lzma.FILTER_ARMTHUMB}[kind]
    plain, both = [{"id": lzma.FILTER_LZMA2, "preset": 0}], [{"id": own}, {"id": lzma.FILTER_LZMA2, "preset": 0}]
    first, second = (both, plain) if encode else (plain, both)
    return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=first), lzma.FORMAT_RAW, filters=second)


def filtered(data: Column, kind: str, encode: bool, distance: int = 1) -> Column:
    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        def one(v: bytes) -> bytes:
            if kind == "delta":
                return delta(v, distance, encode)
            return (branch_by_library if kind in ("x86", "ia64", "armthumb") else branch)(v, kind, encode)

        return values.map(lambda v: None if v is None else one(bytes(v)))

    return run(data)
