"""Part-wise codecs, stored indexes, headers and prefix codes against libraries and brute force."""

import bz2
import gzip
import heapq
import lzma
import random

import pytest
from pyspark.sql import functions as F

from bytewright.functions import codecs, headers
from bytewright.functions.checksums import combine_crc, crc_apply, crc_operator
from bytewright.operators import chunked, framing, indexes, parallel, prefix_codes, stream_index


def blob(n, seed=1):
    r = random.Random(seed)
    words = [bytes(r.randrange(97, 123) for _ in range(r.randrange(2, 9))) for _ in range(300)]
    out = b""
    while len(out) < n:
        out += r.choice(words) + b" "
    return out[:n]


DATA = blob(250_000)


@pytest.mark.parametrize("codec", ["xz", "bzip2", "snappy_stream", "zstd"])
def test_parts_there_and_back(spark, codec):
    rows = [("a", DATA), ("b", b""), ("c", b"x"), ("n", None), ("same", DATA[:70000]), ("same", b"other")]
    made = parallel.encode(spark.createDataFrame([r for r in rows if r[0] in "abc"], "path string, content binary"), codec, 65536)
    packed = {r.path: bytes(r.content) for r in made.collect()}
    for path, data in rows[:3]:
        assert codecs.decompress_bytes(packed[path], codec)[0] == data
    # a frame with a bit changed, one cut off, one with rubbish behind it, null, and two objects of one path
    bad = bytearray(packed["a"])
    bad[len(bad) // 2] ^= 16
    given = [*packed.items(), ("bad", bytes(bad)), ("cut", packed["a"][:-3]), ("more", packed["a"] + b"rubbish"), ("n", None)]
    given += [("same", codecs.compress_bytes(d, codec)) for p, d in rows if p == "same"]
    found = {}
    for r in parallel.decode(spark.createDataFrame(given, "path string, content binary"), codec).collect():
        found.setdefault(r.path, []).append(r)
    assert found["a"][0].how == "blocks" and bytes(found["a"][0].data) == DATA
    assert bytes(found["b"][0].data) == b"" and bytes(found["c"][0].data) == b"x"
    assert found["n"][0].data is None and found["n"][0].error is None
    assert {bytes(r.data) for r in found["same"]} == {DATA[:70000], b"other"}
    for path, content in given:
        if path in ("bad", "cut", "more"):
            try:
                want = codecs.decompress_bytes(content, codec)[0]
            except codecs.Refused as e:
                assert found[path][0].error == e.error and found[path][0].data is None
            else:
                assert bytes(found[path][0].data) == want


def test_foreign_objects(spark):
    xz = lzma.compress(DATA, check=lzma.CHECK_SHA256) + bytes(8) + lzma.compress(b"second", check=lzma.CHECK_CRC32) + bytes(4)
    objects = {"xz": xz, "bzip2": bz2.compress(DATA, 1) + bz2.compress(b"") + bz2.compress(DATA[:1000], 9)}
    for codec, content in objects.items():
        want = DATA + (b"second" if codec == "xz" else DATA[:1000])
        (row,) = parallel.decode(spark.createDataFrame([("p", content)], "path string, content binary"), codec).collect()
        assert row.how == "blocks" and bytes(row.data) == want
        assert codecs.decompress_bytes(content, codec)[0] == want
    assert len(list(framing.xz_blocks(xz))) == 2
    # a block's magic number inside a block is no cut: the serial decoder answers
    false = bz2.compress(random.Random(3).randbytes(50_000) + b"1AY&SY")
    (row,) = parallel.decode(spark.createDataFrame([("p", false)], "path string, content binary"), "bzip2").collect()
    assert bytes(row.data) == bz2.decompress(false)
    (row,) = parallel.decode(spark.createDataFrame([("p", objects["bzip2"])], "path string, content binary"), "bzip2", max_output=1000).collect()
    assert row.error == "OutputTooSmall"
    assert parallel.decode(spark.createDataFrame([], "path string, content binary"), "xz").count() == 0


def test_blocks_and_skip(spark):
    packed = spark.createDataFrame([("p", codecs.compress_bytes(DATA, "snappy_stream"))], "path string, content binary")
    rows = parallel.decode_blocks(packed, "snappy_stream", skip=70_000).orderBy("seq").collect()
    assert [r.out_offset for r in rows] == [65536, 131072, 196608] and b"".join(bytes(r.data) for r in rows) == DATA[65536:]


def test_bgzf(spark):
    objects = spark.createDataFrame([("p", DATA), ("e", b"")], "path string, content binary")
    made = {r.path: bytes(r.content) for r in chunked.bgzf_objects(objects).collect()}
    assert gzip.decompress(made["p"]) == DATA and made["e"] == chunked.BGZF_END and made["p"].endswith(chunked.BGZF_END)


def test_stream_index():
    stream = codecs.compress_bytes(DATA, "snappy_stream")
    entries, out = stream_index.entries_of(stream)
    assert out == len(DATA)
    for kept, block in ((entries, 65536), (entries, 7), ([(3, 0), (9, 5), (400, 90_000)], 65536), ([], 0)):
        chunk = stream_index.dump(kept, out, len(stream), block)
        assert stream_index.load_from_end(stream + chunk) == (kept, out, len(stream), block)
        assert codecs.decompress_bytes(stream + chunk, "snappy_stream")[0] == DATA
        for at in range(len(chunk)):
            with pytest.raises(stream_index.InvalidIndex):
                stream_index.load(chunk[:at])
    assert stream_index.find(entries, out, 70_000) == entries[1] == stream_index.find(entries, out, 70_000 - out)
    with pytest.raises(stream_index.InvalidIndex):
        stream_index.find(entries, out, out + 1)
    assert [e[1] for e in stream_index.thinned([(i, 10 * i) for i in range(100)], 25, 10)] == [0, 120, 240, 360, 480, 600, 720, 840, 960]


def test_points_file():
    data = gzip.compress(DATA) + gzip.compress(DATA[::-1])
    file = stream_index.dump_points(data, 50_000)
    points, fields = stream_index.load_points(file)
    assert fields == {"in_len": len(data), "out_len": 2 * len(DATA), "accept": "gzip"} and len(points) > 3
    assert points == [p for p in indexes.points_of(data, 50_000) if p[1]]
    for bit, out, history in points:
        assert indexes.read_from(data, bit, out, history, out + 5, 300) == (DATA + DATA[::-1])[out + 5 : out + 305]
    for bad in (file[:-1], file + b"x", b"WIDX\x02" + file[5:], file[:32] + b"\x09" + file[33:]):
        with pytest.raises(stream_index.InvalidIndex):
            stream_index.load_points(bad)


def _cost(counts):
    heap, total = [n for n in counts if n], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def test_prefix_codes():
    r = random.Random(5)
    for _ in range(200):
        counts = [r.choice([0, 1, 2, 5, 100, r.randrange(1, 10_000)]) for _ in range(r.randrange(2, 60))]
        lengths = prefix_codes.code_lengths(counts)
        used = [n for n in lengths if n]
        if len(used) > 1:
            assert sum(2 ** (15 - n) for n in used) == 1 << 15 and max(used) <= 15
        if len(used) > 1 and max(used) < 15:
            assert sum(n * k for n, k in zip(counts, lengths)) == _cost(counts)
        words = [format(c, f"0{n}b") for c, n in zip(prefix_codes.canonical_codes(lengths), lengths) if n]
        assert not any(a != b and b.startswith(a) for a in words for b in words)
    steep = [2**i for i in range(25)]
    assert max(prefix_codes.code_lengths(steep)) == 15 and sum(2 ** (15 - n) for n in prefix_codes.code_lengths(steep)) == 1 << 15
    assert prefix_codes.code_lengths([0, 4, 0]) == [0, 1, 0] and prefix_codes.code_lengths([]) == []
    with pytest.raises(ValueError):
        prefix_codes.code_lengths([1] * 5, 2)


def test_options():
    raw = codecs.compress_bytes(DATA, "gzip", name=b"n", comment=b"c", extra=b"ab\x01\0z", header_crc=True)
    assert gzip.decompress(raw) == DATA
    assert next(framing.gzip_members(raw))[5]["name"] == "n"
    damaged = bytearray(raw)
    damaged[4] ^= 1
    with pytest.raises(framing.Bad):
        list(framing.gzip_members(bytes(damaged)))
    xz = codecs.compress_bytes(DATA, "xz", check="sha256", filters=[{"id": lzma.FILTER_DELTA, "dist": 4}, {"id": lzma.FILTER_LZMA2, "preset": 1}])
    assert lzma.decompress(xz) == DATA and next(framing.xz_blocks(xz))[5]["check"] == "10"
    flags = next(framing.zstd_frames(codecs.compress_bytes(DATA, "zstd", checksum=False, content_size=False)))
    assert flags[3] is None and flags[4] is None
    with pytest.raises(ValueError):
        codecs.compress_bytes(DATA, "brotli", check="crc32")


def test_headers(spark):
    import zstandard

    trained = zstandard.train_dictionary(2000, [blob(200, i) for i in range(500)]).as_bytes()
    tile = bytes([4, 251]) + (3).to_bytes(2, "little") + (100 << 2 | 1).to_bytes(4, "little") + b"".join(x.to_bytes(4, "little") for x in (70, 1000, 1900))
    rows = spark.createDataFrame([("t", tile), ("d", trained), ("short", b"\x04"), ("bad", bytes(12)), ("null", None)], "name string, b binary")
    got = {r.name: r for r in rows.select("name", headers.gdeflate_inspect(F.col("b")).alias("i"), headers.gdeflate_tiles(F.col("b")).alias("tiles"), headers.zstd_dictionary(F.col("b")).alias("d")).collect()}
    assert got["t"].i.asDict() == {"tiles": 3, "size": 2 * 65536 + 100, "last_tile": 100, "error": None}
    assert [tuple(x) for x in got["t"].tiles] == [(0, 0, 1000), (1, 1000, 900), (2, 1900, 70)]
    assert got["short"].i.error == "Truncated" and got["bad"].i.error == "InvalidStream" and got["bad"].tiles is None
    assert got["d"].d.formatted and got["d"].d.id == zstandard.ZstdCompressionDict(trained).dict_id()
    assert not got["bad"].d.formatted and got["null"].d is None


def test_crc_operator():
    import zlib

    op = crc_operator(len(DATA) - 1000)
    assert crc_apply(zlib.crc32(DATA[:1000]), zlib.crc32(DATA[1000:]), op) == zlib.crc32(DATA) == combine_crc(zlib.crc32(DATA[:1000]), zlib.crc32(DATA[1000:]), len(DATA) - 1000)
