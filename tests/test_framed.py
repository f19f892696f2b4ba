"""Streams by frames, combining by operators, and content-defined cuts."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from bytewright.functions import checksums, codecs, headers
from bytewright.operators import analysis
from bytewright.streaming import framed

RNG = random.Random(8)
PARTS = [b"abc" * 4000, RNG.randbytes(5000), b"x", "Überraschung ".encode() * 300]


@pytest.mark.parametrize("codec", framed.CODECS)
@pytest.mark.parametrize("cut", [1, 7, 1000, 10**6])
def test_steps_do_not_depend_on_cuts(codec, cut):
    data = b"".join(codecs.compress_bytes(p, codec) for p in PARTS)
    state, out = framed.START, b""
    for at in range(0, len(data), cut):
        state, new = framed.step(state, data[at : at + cut], codec)
        assert state[2] == len(out) + len(new)
        out += new
    assert out == b"".join(PARTS) and state[0] == b"" and state[4] is None


@pytest.mark.parametrize("codec", framed.CODECS)
def test_refusal_sticks(codec):
    state, out = framed.step(framed.START, b"this is not such a stream at all, whatever it may be", codec)
    assert state[4] and not out
    assert framed.step(state, codecs.compress_bytes(b"a", codec), codec) == (state, b"")


def test_padding_between_xz_streams():
    data = codecs.compress_bytes(b"one", "xz") + bytes(8) + codecs.compress_bytes(b"two", "xz")
    for cut in (1, 3, 500):
        state, out = framed.START, b""
        for at in range(0, len(data), cut):
            state, new = framed.step(state, data[at : at + cut], "xz")
            out += new
        assert out == b"onetwo" and state[3] == 2


@pytest.mark.parametrize("codec", ["zstd", "snappy_stream", "bzip2"])
def test_encode_and_decode_as_streams(spark, tmp_path, codec):
    schema = "path string, seq long, piece binary"
    rows = [(p, i, piece) for p in "ab" for i, piece in enumerate([*PARTS, b"", None])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    encoded = framed.encode_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), codec)
    decoded = framed.decode_stream(encoded.withColumnRenamed("data", "piece"), codec)
    name = f"framed_{codec}"
    decoded.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    for path in "ab":
        found = spark.table(name).where(F.col("path") == path).orderBy("out_offset", F.octet_length("data")).collect()
        assert b"".join(bytes(r.data) for r in found) == b"".join(PARTS)
        assert all(r.error is None for r in found)


def test_combining_by_operator(spark):
    rows = [(a, b) for a in PARTS for b in (b"12345678", b"\0" * 8)]
    df = spark.createDataFrame(rows, "a binary, b binary")
    op = checksums.crc32_combine_gen(8)
    found = df.select("a", "b", checksums.crc32_combine_op(F.crc32("a"), F.crc32("b"), op).alias("c")).collect()
    assert all(r.c == zlib.crc32(bytes(r.a) + bytes(r.b)) for r in found)


def test_cuts_follow_content(spark):
    data = RNG.randbytes(20000)
    moved = b"new beginning" + data
    df = spark.createDataFrame([(0, data), (1, moved), (2, b"short"), (3, b""), (4, None)], "k long, v binary")
    found = {r.k: r.c for r in df.select("k", analysis.cut_points(F.col("v"), 8).alias("c")).collect()}
    assert 40 < len(found[0]) < 130
    assert {c + 13 for c in found[0]} == {c for c in found[1] if c >= 13 + 8}
    assert found[2] == found[3] == [] and found[4] is None
