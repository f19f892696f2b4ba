"""Headers as column arithmetic: fields of a few bytes, read without Python. Null or short input gives null fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formats: bytes of a tile, id of the tile stream, first four bytes of a formatted zstd dictionary.
TILE, TILE_ID, DICTIONARY_MAGIC = 65536, 4, "37A430EC"


def little(data: Column, at: int, width: int) -> Column:
    """The unsigned number of ``width`` bytes, at most seven, from byte ``at`` on, the lowest byte first."""
    byte = lambda i: F.conv(F.hex(F.substring(data, at + i + 1, 1)), 16, 10).cast("long")
    value = reduce(lambda a, b: a + b, (F.shiftleft(byte(i), 8 * i) for i in range(width)))
    return F.when(F.octet_length(data) >= at + width, value)


def put_little(value: Column, width: int) -> Column:
    """The bytes that ``little`` reads."""
    pair = lambda i: F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(255)), 2, "0")
    return F.unhex(F.concat(*(pair(i) for i in range(width))))


def lzma_properties(byte: Column) -> Column:
    """Struct lc, lp, pb of an LZMA properties byte; null above 224 and where lc + lp is above 4."""
    lc, lp, pb = byte % 9, F.floor(byte / 9) % 5, F.floor(byte / 45)
    return F.when((byte <= 224) & (lc + lp <= 4), F.struct(lc.cast("int").alias("lc"), lp.cast("int").alias("lp"), pb.cast("int").alias("pb")))


def lzma_dictionary(declared: Column) -> Column:
    """Bytes of history held for a declared dictionary: 4 KiB at least, in steps of 16."""
    return (F.floor((F.greatest(declared.cast("long"), F.lit(4096)) + 15) / 16) * 16).cast("long")


def lzma2_dictionary(byte: Column) -> Column:
    """The dictionary that an LZMA2 properties byte names: 2 or 3 times a power of two, 4 GiB less one for 40, null above."""
    size = F.expr("1L") * (2 + byte % 2) * F.pow(F.lit(2.0), F.floor(byte / 2) + 11).cast("long")
    return F.when(byte == 40, F.lit(4294967295)).when(byte < 40, size).cast("long")


def brotli_window_bits(byte: Column) -> Column:
    """Window bits by a Brotli stream's first byte: 10 to 24, null for the reserved pattern (large windows)."""
    high, low = F.shiftright(byte, 4).bitwiseAND(7), F.shiftright(byte, 1).bitwiseAND(7)
    short = F.when(high == 0, 17).when(high > 1, high + 8)
    return F.when(byte % 2 == 0, 16).when(low > 0, low + 17).otherwise(short).cast("int")


def brotli_window(bits: Column) -> Column:
    """How far back a stream of these window bits reaches."""
    return (F.pow(F.lit(2.0), bits) - 16).cast("long")


def gdeflate_header(n: Column) -> Column:
    """The first eight bytes of a tile stream that decodes to ``n`` bytes."""
    tiles, last = F.ceil(n / TILE), n % TILE
    return F.concat(F.unhex(F.lit(f"{TILE_ID:02X}{TILE_ID ^ 255:02X}")), put_little(tiles, 2), put_little(last * 4 + 1, 4))


def gdeflate_inspect(data: Column) -> Column:
    """Struct tiles, size, last_tile, error: ``Truncated`` below eight bytes, ``InvalidStream`` for another id or tile size."""
    tiles, word = little(data, 2, 2), little(data, 4, 4)
    last = F.shiftright(word, 2).bitwiseAND((1 << 18) - 1)
    known = (little(data, 0, 2) == (TILE_ID | (TILE_ID ^ 255) << 8)) & (word.bitwiseAND(3) == 1) & (last < TILE)
    last = F.when(tiles == 0, 0).when(last == 0, TILE).otherwise(last)
    size = F.when(tiles == 0, 0).otherwise((tiles - 1) * TILE + last)
    error = F.when(F.octet_length(data) < 8, "Truncated").when(~known, "InvalidStream")
    held = lambda c: F.when(error.isNull() & data.isNotNull(), c).cast("long")
    return F.struct(held(tiles).alias("tiles"), held(size).alias("size"), held(last).alias("last_tile"), error.alias("error"))


def gdeflate_tiles(data: Column) -> Column:
    """Array of structs tile, in_offset (after the table), in_len: the table's first entry is the last tile's length, the
    others say where the tiles from the second on begin. Null where the table is cut off or the header is refused."""
    info = gdeflate_inspect(data)
    entry = lambda i: sum((F.shiftleft(F.conv(F.hex(F.substring(data, 9 + 4 * i + k, F.lit(1))), 16, 10).cast("long"), 8 * k) for k in range(1, 4)), F.conv(F.hex(F.substring(data, 9 + 4 * i, F.lit(1))), 16, 10).cast("long"))
    n = info["tiles"].cast("int")
    start = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(entry(i))
    length = lambda i: F.when(i == n - 1, entry(F.lit(0))).otherwise(entry(i + 1) - start(i))
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("tile"), start(i).alias("in_offset"), length(i).alias("in_len")))
    return F.when((n > 0) & (F.octet_length(data) >= 8 + 4 * n), rows)


def zstd_dictionary(data: Column) -> Column:
    """Struct formatted, id: of a trained dictionary its id; anything else is raw content, of id 0."""
    formatted = (F.octet_length(data) >= 8) & (F.hex(F.substring(data, 1, 4)) == DICTIONARY_MAGIC)
    return F.when(data.isNotNull(), F.struct(formatted.alias("formatted"), F.when(formatted, little(data, 4, 4)).otherwise(0).cast("long").alias("id")))


def skippable_frame(data: Column, variant: int = 0) -> Column:
    """A frame that zstd and LZ4 decoders skip."""
    return F.concat(put_little(F.lit(0x184D2A50 + variant), 4), put_little(F.octet_length(data), 4), data)


def skippable_chunk(data: Column, kind: int = 0x80) -> Column:
    """A chunk that Snappy decoders skip: of type 0x80 to 0xfd."""
    return F.concat(put_little(F.lit(kind), 1), put_little(F.octet_length(data), 3), data)
