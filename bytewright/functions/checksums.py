"""Checksums of binary columns, and the algebra that merges those of pieces.

CRC-32 is Spark's own. The others run over Arrow batches, with the standard library or NumPy. All results are
non-negative BIGINT, 64-bit ones 16 hexadecimal digits. A null value has a null checksum."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from bytewright.plans.scratch import materialize

ADLER = 65521
CRC32, CRC32C, CRC64_XZ = 0xEDB88320, 0x82F63B78, 0xC96C5795D7870F42


@functools.cache
def crc_table(poly: int) -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (poly if i & 1 else 0)
        out.append(i)
    return out


@functools.cache
def _slices(poly: int) -> list[np.ndarray]:
    """Tables for eight bytes at a time."""
    rows = [np.array(crc_table(poly), np.uint64)]
    for _ in range(7):
        rows.append((rows[-1] >> np.uint64(8)) ^ rows[0][(rows[-1] & np.uint64(255)).astype(int)])
    return rows


def crc_bytes(data: bytes, poly: int, bits: int = 32) -> int:
    table, crc = crc_table(poly), (1 << bits) - 1
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    return crc ^ (1 << bits) - 1


def _times(a: int, b: int, poly: int, bits: int) -> int:
    """Product of two reflected polynomials modulo the CRC's."""
    out, top = 0, 1 << bits - 1
    while a:
        if a & top:
            out ^= b
        a = a << 1 & (1 << bits) - 1
        b = b >> 1 ^ (poly if b & 1 else 0)
    return out


@functools.cache
def _x_power(n: int, poly: int, bits: int) -> int:
    """x to the power n modulo the polynomial."""
    out, base = 1 << bits - 1, 1 << bits - 2
    while n:
        if n & 1:
            out = _times(out, base, poly, bits)
        base, n = _times(base, base, poly, bits), n >> 1
    return out


def combine_crc(a: int, b: int, len_b: int, poly: int = CRC32, bits: int = 32) -> int:
    return _times(_x_power(8 * len_b, poly, bits), a, poly, bits) ^ b


def crc_operator(len_b: int, poly: int = CRC32, bits: int = 32) -> int:
    """What ``crc_apply`` takes for appending ``len_b`` bytes: made once for pieces of one size."""
    return _x_power(8 * len_b, poly, bits)


def crc_apply(a: int, b: int, operator: int, poly: int = CRC32, bits: int = 32) -> int:
    return _times(operator, a, poly, bits) ^ b


def combine_adler(a: int, b: int, len_b: int) -> int:
    s1 = (a % 65536 + b % 65536 - 1) % ADLER
    s2 = (a // 65536 + b // 65536 + len_b % ADLER * (a % 65536 - 1)) % ADLER
    return s2 << 16 | s1


def crc_batch(values: list[bytes], poly: int, bits: int = 32) -> np.ndarray:
    """Of many values at once: all are walked byte by byte together, longest first."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in order])
    data = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    full = np.uint64((1 << bits) - 1)
    crc = np.full(len(order), full)
    table = _slices(poly)[0]
    live = len(order)
    for at in range(int(sizes[0]) if len(order) else 0):
        while live and sizes[live - 1] <= at:
            live -= 1
        if live < 8:  # few long ones: one after another
            for i in range(live):
                c, t = int(crc[i]), crc_table(poly)
                for b in values[order[i]][at:]:
                    c = c >> 8 ^ t[(c ^ b) & 255]
                crc[i] = c
            break
        c = crc[:live]
        crc[:live] = (c >> np.uint64(8)) ^ table[((c ^ data[starts[:live] + at]) & np.uint64(255)).astype(np.int64)]
    out = np.empty(len(order), np.uint64)
    out[order] = crc ^ full
    return out


def _over(values: pd.Series, f) -> pd.Series:
    held = values.notna()
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    if held.any():
        out[held] = list(f([bytes(v) for v in values[held]]))
    return out


@pandas_udf(T.LongType())
def adler32(v: pd.Series) -> pd.Series:
    return _over(v, lambda x: [zlib.adler32(b) for b in x])


@pandas_udf(T.LongType())
def crc32c(v: pd.Series) -> pd.Series:
    return _over(v, lambda x: crc_batch(x, CRC32C).astype(np.int64).tolist())


@pandas_udf(T.LongType())
def crc32_bzip2(v: pd.Series) -> pd.Series:
    """Most significant bit first, as in bzip2."""
    flip = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)
    back = lambda c: int(f"{c:032b}"[::-1], 2)
    return _over(v, lambda x: [back(int(c)) for c in crc_batch([flip[np.frombuffer(b, np.uint8)].tobytes() for b in x], CRC32)])


@pandas_udf(T.StringType())
def crc64_xz(v: pd.Series) -> pd.Series:
    return _over(v, lambda x: [f"{int(c):016x}" for c in crc_batch(x, CRC64_XZ, 64)])


@pandas_udf(T.LongType())
def xxh32(v: pd.Series) -> pd.Series:
    import xxhash

    return _over(v, lambda x: [xxhash.xxh32_intdigest(b) for b in x])


@pandas_udf(T.StringType())
def xxh64(v: pd.Series) -> pd.Series:
    import xxhash

    return _over(v, lambda x: [xxhash.xxh64_hexdigest(b) for b in x])


def crc32(v: Column) -> Column:
    return F.crc32(v)


def masked(crc: Column) -> Column:
    """Rotated right by 15 bits and offset, as Snappy stores CRC-32C."""
    turned = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(0xFFFFFFFF)
    return (turned + 0xA282EAD8) % (1 << 32)


def adler32_combine(a: Column, b: Column, len_b: Column) -> Column:
    """Of the concatenation of two pieces, from theirs."""
    low = lambda c: c.bitwiseAND(65535)
    s1 = F.pmod(low(a) + low(b) - 1, F.lit(ADLER))
    s2 = F.pmod(F.shiftright(a, 16) + F.shiftright(b, 16) + (len_b % ADLER) * (low(a) - 1), F.lit(ADLER))
    return F.shiftleft(s2, 16).bitwiseOR(s1)


def _combiner(poly: int):
    @pandas_udf(T.LongType())
    def combine(a: pd.Series, b: pd.Series, len_b: pd.Series) -> pd.Series:
        return pd.Series([combine_crc(int(x), int(y), int(n), poly) for x, y, n in zip(a, b, len_b, strict=True)])

    return combine


crc32_combine, crc32c_combine = _combiner(CRC32), _combiner(CRC32C)


def crc32_combine_gen(len_b: int, poly: int = CRC32) -> list[int]:
    """What combining with a second piece of ``len_b`` bytes does to each bit of the first piece's checksum."""
    operator = crc_operator(len_b, poly)
    return [crc_apply(1 << i, 0, operator, poly) for i in range(32)]


def crc32_combine_op(a: Column, b: Column, op: list[int]) -> Column:
    """Of the concatenation of two pieces, by ``crc32_combine_gen`` of the second one's length: bit operations only."""
    bits = (F.shiftright(a, i).bitwiseAND(1) * F.lit(moved).cast("long") for i, moved in enumerate(op))
    return functools.reduce(Column.bitwiseXOR, bits, b.cast("long"))


def _behind(rows: DataFrame, group: list[str], order: str, length: str) -> DataFrame:
    """``rows`` with ``_behind``, the sum of ``length`` over a group's rows later in order. Rows are cut into ranges by group and
    order, whatever the groups' sizes; sums of ranges are added up, and rows just within their range."""
    dealt = rows.repartitionByRange(*group, order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "merge-ranges")
    later = Window.partitionBy(*group).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "_range").agg(F.sum(length).alias("_sum")).withColumn("_later", F.coalesce(F.sum("_sum").over(later), F.lit(0)))
    sums = sums.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_range").alias("_r"), "_later")
    same = F.col("_range") == F.col("_r")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = Window.partitionBy(*group, "_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_inside", F.coalesce(F.sum(length).over(inside), F.lit(0))).join(sums, same)
    return placed.withColumn("_behind", F.col("_inside") + F.col("_later")).select(*rows.columns, "_behind")


def adler32_merge(rows: DataFrame, group: list[str], order: str, value: str, length: str) -> DataFrame:
    """Adler-32 of each group's pieces joined in order, as sums: s1 adds up; a piece's s1 counts once more for every byte
    behind it."""
    parts = _behind(rows.select(*group, order, value, length), group, order, length)
    parts = parts.withColumn("_a", F.col(value).bitwiseAND(65535) - 1).withColumn("_b", F.shiftright(value, 16) - F.col(length) % ADLER)
    sums = parts.groupBy(*group).agg(F.sum("_a").alias("_a"), F.sum((F.col("_b") + F.col("_a") * (F.col("_behind") % ADLER)) % ADLER).alias("_b"), F.sum(length).alias("_n"))
    s1, s2 = F.pmod(F.col("_a") + 1, F.lit(ADLER)), F.pmod(F.col("_b") + F.col("_n") % ADLER, F.lit(ADLER))
    return sums.select(*group, F.shiftleft(s2, 16).bitwiseOR(s1).alias(value), F.col("_n").alias(length))


def crc32_merge(rows: DataFrame, group: list[str], order: str, value: str, length: str, poly: int = CRC32) -> DataFrame:
    """CRC of each group's pieces joined in order: crc * x^(8 * bytes behind), summed modulo 2. Each piece is shifted on
    its own, so a group of any size is an ordinary aggregate."""
    shift = _combiner(poly)
    parts = _behind(rows.select(*group, order, value, length), group, order, length).withColumn("_c", shift(F.col(value), F.lit(0).cast("long"), F.col("_behind")))
    return parts.groupBy(*group).agg(F.bit_xor("_c").alias(value), F.sum(length).alias(length))
