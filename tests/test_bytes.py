"""Codecs, checksums, framing and filters, against independent libraries and definitions."""

import bz2
import gzip
import lzma
import random
import zlib

import pytest
from pyspark.sql import functions as F

from bytewright.functions import checksums, codecs, deflate, filters, lzw
from bytewright.operators import analysis, chunked, framing
from bytewright.sources import datasources
from bytewright.streaming import resumable

RNG = random.Random(5)
SAMPLES = [b"", b"a", b"abc" * 4000, RNG.randbytes(5000), "Überraschung – ünï ".encode() * 300, bytes(70000)]


@pytest.mark.parametrize("codec", ["gzip", "zlib", "raw", "zstd", "lz4", "snappy", "snappy_stream", "brotli", "bzip2", "xz", "lzma"])
@pytest.mark.parametrize("data", SAMPLES, ids=range(len(SAMPLES)))
def test_round_trip(codec, data):
    assert codecs.decompress_bytes(codecs.compress_bytes(data, codec), codec)[0] == data


@pytest.mark.parametrize("codec", ["gzip", "zlib", "raw", "zstd", "snappy", "snappy_stream", "bzip2", "xz", "lzma"])
def test_truncated_streams_are_refused(codec):
    packed = codecs.compress_bytes(SAMPLES[4], codec)
    with pytest.raises(codecs.Refused):
        codecs.decompress_bytes(packed[: len(packed) // 2], codec)


def test_members():
    two = codecs.compress_bytes(b"one", "gzip") + gzip.compress(b"two")
    assert codecs.decompress_bytes(two, "gzip")[0] == b"onetwo"
    assert codecs.decompress_bytes(two, "gzip", "one")[0] == b"one"
    assert codecs.decompress_bytes(bz2.compress(b"x") + bz2.compress(b"y"), "bzip2") [0] == b"xy"


def test_output_limit():
    with pytest.raises(codecs.Refused, match="OutputTooSmall"):
        codecs.decompress_bytes(zlib.compress(bytes(10**6)), "zlib", limit=1000)


@pytest.mark.parametrize("strategy", [0, 2, 3, 4])
def test_own_inflate(strategy):
    for data in SAMPLES:
        z = zlib.compressobj(6, 8, -15, 9, strategy)
        packed = z.compress(data) + z.flush()
        assert deflate.inflate(packed) == (data, len(packed))


def test_inflate_from_block_boundary():
    data = bytes(RNG.choice(b"abcdef ") for _ in range(200_000))
    z = zlib.compressobj(6, 8, -15)
    packed, blocks = z.compress(data) + z.flush(), []
    deflate.inflate(packed, blocks=blocks)
    point = blocks[len(blocks) // 2]
    assert point.out > 32768
    assert deflate.inflate(packed, bit=point.bit, history=data[point.out - 32768 : point.out])[0] == data[point.out :]


def test_lzw():
    # clear, 65, 66, 258 (AB), 260 (ABA: not yet known), end, nine bits each
    codes, bits, n = [256, 65, 66, 258, 260, 257], 0, 0
    for c in codes:
        bits |= c << n
        n += 9
    assert lzw.decode(bits.to_bytes((n + 7) // 8, "little"))[0] == b"ABABABA"


def test_checksum_vectors():
    v = b"123456789"
    assert checksums.crc_bytes(v, checksums.CRC32C) == 0xE3069283
    assert checksums.crc_bytes(v, checksums.CRC64_XZ, 64) == 0x995DC9BBDF1939FA
    assert checksums.crc_batch([v, b"", v * 50], checksums.CRC32).tolist() == [zlib.crc32(x) for x in (v, b"", v * 50)]


@pytest.mark.parametrize("cut", [0, 1, 77, 5000])
def test_combine(cut):
    a, b = SAMPLES[3][:cut], SAMPLES[3][cut:]
    assert checksums.combine_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert checksums.combine_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_merge_by_group(spark):
    pieces = [("g", i, SAMPLES[i % 5]) for i in range(7)] + [("h", 0, b"")]
    df = spark.createDataFrame(pieces, "k string, seq int, b binary").withColumn("n", F.octet_length("b").cast("long"))
    whole = b"".join(p[2] for p in pieces[:7])
    got = {r.k: r.c for r in checksums.crc32_merge(df.withColumn("c", F.crc32("b")), ["k"], "seq", "c", "n").collect()}
    assert got == {"g": zlib.crc32(whole), "h": 0}
    got = {r.k: r.c for r in checksums.adler32_merge(df.withColumn("c", checksums.adler32("b")), ["k"], "seq", "c", "n").collect()}
    assert got == {"g": zlib.adler32(whole), "h": 1}


@pytest.mark.parametrize("kind,id_", [("arm", lzma.FILTER_ARM), ("powerpc", lzma.FILTER_POWERPC), ("sparc", lzma.FILTER_SPARC)])
def test_branch_filters(kind, id_):
    head = {"arm": lambda w: w[:3] + b"\xeb", "powerpc": lambda w: bytes([0x48 | w[0] & 3]) + w[1:3] + bytes([w[3] & 0xFC | 1]), "sparc": lambda w: b"\x40" + bytes([w[0] & 63]) + w[1:3]}[kind]
    data = b"".join(head(RNG.randbytes(4)) if i % 3 else RNG.randbytes(4) for i in range(4000)) + b"xy"
    packed = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": id_}, {"id": lzma.FILTER_LZMA2}])
    encoded = lzma.decompress(packed, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2}])
    assert filters.branch(data, kind, True) == encoded
    assert filters.branch(encoded, kind, False) == data


@pytest.mark.parametrize("distance", [1, 3, 256])
def test_delta(distance):
    data = RNG.randbytes(3001)
    packed = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_DELTA, "dist": distance}, {"id": lzma.FILTER_LZMA2}])
    encoded = lzma.decompress(packed, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2}])
    assert filters.delta(data, distance, True) == encoded and filters.delta(encoded, distance, False) == data


@pytest.mark.parametrize("format,codec", [("gzip", "gzip"), ("zstd", "zstd"), ("lz4", "lz4"), ("snappy", "snappy_stream"), ("xz", "xz"), ("bzip2", "bzip2")])
def test_units_cover_the_object(spark, format, codec):
    packed = codecs.compress_bytes(SAMPLES[4], codec)
    rows = framing.units(spark.createDataFrame([("p", packed), ("bad", packed[:9]), ("none", None)], "path string, content binary"), format).orderBy("path", "seq").collect()
    good = [r for r in rows if r.path == "p"]
    assert all(r.kind != "refused" for r in good)
    if format in ("gzip", "zstd", "lz4", "snappy"):
        assert sum(r.in_len for r in good) == len(packed)
    if format in ("gzip", "snappy", "xz"):
        assert sum(r.out_len for r in good) == len(SAMPLES[4])
    assert any(r.kind == "refused" for r in rows if r.path == "bad") or format == "bzip2"


def test_parallel_gzip_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("a", SAMPLES[2] * 30), ("b", b""), ("c", SAMPLES[3])], "path string, content binary")
    one = {r.path: bytes(r.content) for r in chunked.parallel_gzip(df.coalesce(1), size=30_000).collect()}
    many = {r.path: bytes(r.content) for r in chunked.parallel_gzip(df.repartition(3), size=30_000).collect()}
    assert one == many
    assert gzip.decompress(one["a"]) == SAMPLES[2] * 30 and gzip.decompress(one["b"]) == b""


def test_bgzf_offsets(spark):
    data = RNG.randbytes(200_000)
    rows = chunked.bgzf(spark.createDataFrame([("a", data)], "path string, content binary")).orderBy("seq").collect()
    joined = b"".join(bytes(r.block) for r in rows) + chunked.BGZF_END
    assert gzip.decompress(joined) == data
    for r in rows:
        assert joined[r.voffset >> 16 :].startswith(bytes(r.block))


def test_seekable_ranges(spark):
    data = SAMPLES[4] * 20
    packed = bytes(chunked.zstd_seekable(spark.createDataFrame([("a", data)], "path string, content binary"), frame=1000).first().content)
    assert codecs.decompress_bytes(packed, "zstd")[0] == data
    for at, n in ((0, 10), (995, 10), (5000, 4000), (len(data) - 3, 50)):
        assert chunked.read_range(packed, at, n) == data[at : at + n]


def test_find(spark):
    points = spark.createDataFrame([("a", 0, 1), ("a", 100, 2), ("b", 50, 3)], "path string, out_offset long, n int")
    asked = spark.createDataFrame([("a", 99), ("a", 100), ("b", 10)], "path string, offset long")
    assert {(r.path, r.offset): r.n for r in chunked.find(points, asked).collect()} == {("a", 99): 1, ("a", 100): 2, ("b", 10): None}


def test_try_decompress_says_why(spark):
    df = spark.createDataFrame([(gzip.compress(b"x"),), (b"junk",), (None,)], "c binary")
    rows = df.select(codecs.try_decompress(F.col("c"), "gzip").alias("t")).select("t.*").collect()
    assert [r.error for r in rows] == [None, "InvalidStream", None] and bytes(rows[0].data) == b"x"


def test_generated_prefixes():
    for kind in datasources.KINDS:
        assert datasources.generated(kind, 3, 5000).startswith(datasources.generated(kind, 3, 100))


def test_generated_source_and_sink(spark, tmp_path):
    datasources.register(spark)
    df = spark.read.format("generated").option("spec", "runs 1 500 + zeros 2 9").load()
    assert [r.len for r in df.orderBy("len").collect()] == [9, 500]
    df.selectExpr("kind as path", "content").write.format("objects").option("path", str(tmp_path / "o")).option("suffix", ".bin").mode("append").save()
    assert (tmp_path / "o/zeros.bin").read_bytes() == bytes(9)


def test_resumable_steps_do_not_depend_on_cuts():
    data = gzip.compress(SAMPLES[4]) + gzip.compress(b"tail")
    for cut in (1, 7, 100, 10**6):
        state, out = (b"", 0, 0, 0, 0, None), b""
        for at in range(0, len(data), cut):
            state, new = resumable.step(state, data[at : at + cut])
            out += new
        assert out == SAMPLES[4] + b"tail" and state[3] == 2 and state[4] == zlib.crc32(out)
    state, _ = resumable.step((b"", 0, 0, 0, 0, None), b"not gzip at all")
    assert state[5] and resumable.step(state, data) == (state, b"")


def test_encoded_pieces_are_one_stream():
    before, out = b"", b""
    for piece in (SAMPLES[2], SAMPLES[4], b"", SAMPLES[2]):
        data, before = resumable.encode_step(before, piece)
        out += data
    assert zlib.decompress(out + b"\x03\0", -15) == SAMPLES[2] + SAMPLES[4] + SAMPLES[2]


def test_decode_as_a_stream(spark, tmp_path):
    data = gzip.compress(SAMPLES[4])
    schema = "path string, seq long, piece binary"
    spark.createDataFrame([("a", i, data[i * 50 : i * 50 + 50]) for i in range(len(data) // 50 + 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = resumable.decode_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    rows = spark.table("decoded").orderBy("out_offset").collect()
    assert b"".join(bytes(r.data) for r in rows) == SAMPLES[4]


def test_runs_and_histogram(spark):
    df = spark.createDataFrame([(1, b"aaab"), (2, b""), (3, None)], "k long, v binary")
    assert [(r.start, r.length, r.byte) for r in analysis.runs(df, "v", "k").collect()] == [(0, 3, 97)]
    assert {(r.byte, r.n) for r in analysis.byte_histogram(df, "v").collect()} == {(97, 3), (98, 1)}


@pytest.mark.parametrize("codec", ["zlib", "raw", "zstd"])
def test_dictionaries_come_back(codec):
    d, v = b"the quick brown fox jumps over " * 20, b"quick brown fox jumps over the lazy dog"
    packed = codecs.compress_bytes(v, codec, dictionary=d)
    assert codecs.decompress_bytes(packed, codec, dictionary=d)[0] == v
    if codec == "zlib":
        with pytest.raises(codecs.Refused):
            codecs.decompress_bytes(packed, codec)


def test_merges_of_groups_in_many_ranges(spark):
    """Groups of any size, null ones too, against the whole."""
    rows = [(None if i % 7 == 0 else f"g{i % 3 // 2}", i, bytes([i % 251]) * (i % 40)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o long, v binary").select("g", "o", checksums.crc32("v").alias("c"), checksums.adler32("v").alias("a"), F.octet_length("v").cast("long").alias("n"))
    for merge, column, plain in ((checksums.crc32_merge, "c", zlib.crc32), (checksums.adler32_merge, "a", zlib.adler32)):
        got = {r["g"]: r[column] for r in merge(df, ["g"], "o", column, "n").collect()}
        assert got == {g: plain(b"".join(v for h, _, v in rows if h == g)) for g in {g for g, _, _ in rows}}
