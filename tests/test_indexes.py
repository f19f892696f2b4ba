"""Seek indexes, library filters and dictionaries."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from bytewright.functions import codecs, filters
from bytewright.operators import indexes

RNG = random.Random(3)


def test_ranges_by_index(spark):
    data = b"".join(RNG.choice([b"alpha ", b"beta ", b"gamma\n", RNG.randbytes(5)]) for _ in range(9000))
    objects = spark.createDataFrame([("a", gzip.compress(data)), ("b", gzip.compress(b"short")), ("c", None)], "path string, content binary")
    index = indexes.build_index(objects, 4096)
    points = index.where("path = 'a'").orderBy("point").collect()
    assert points[0].out_offset == 0 and all(b.out_offset - a.out_offset >= 4096 for a, b in zip(points, points[1:]))
    asked = spark.createDataFrame([("a", 0, 10), ("a", 20_000, 500), ("a", len(data) - 5, 50), ("b", 2, 2)], "path string, offset long, length int")
    got = {(r.path, r.offset): bytes(r.data) for r in indexes.read_ranges(objects, index, asked).collect()}
    assert got == {("a", 0): data[:10], ("a", 20_000): data[20_000:20_500], ("a", len(data) - 5): data[-5:], ("b", 2): b"or"}


def test_points_of_members():
    data = gzip.compress(b"one" * 100) + gzip.compress(b"two" * 100)
    points = list(indexes.points_of(data, 1 << 20))
    assert [p[1] for p in points] == [0, 300] and indexes.read_from(data, *points[1], 303, 6) == b"twotwo"


@pytest.mark.parametrize("kind", ["x86", "ia64", "armthumb"])
def test_library_filters(kind):
    data = b"".join(b"\xe8" + RNG.randbytes(3) + RNG.choice([b"\0", b"\xff", b"q"]) for _ in range(900))
    there = filters.branch_by_library(data, kind, True)
    assert len(there) == len(data) and filters.branch_by_library(there, kind, False) == data
    assert kind != "x86" or there != data


def test_dictionary(spark):
    texts = [f'{{"id": {i}, "name": "user {i * 7 % 91}", "address": "street {i % 13}, city {i % 5}"}}'.encode() for i in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "c binary")
    d = indexes.train_dictionary(df, "c", 2048)
    gain = indexes.dictionary_gain(df, F.col("c"), d).first()
    assert gain.primed < gain.plain
    assert codecs.decompress_bytes(codecs.compress_bytes(texts[0], "zstd", dictionary=d), "zstd", dictionary=d)[0] == texts[0]
