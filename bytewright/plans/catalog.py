"""Named queries of the byte-stream engine, each with SQL for comparison where SQL can express it.

Codecs are beyond SQL, but decode(encode(x)) = x is not: round trips are compared by the MD5 of the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright.functions import checksums as C
from bytewright.functions import codecs, filters, headers
from bytewright.operators import analysis, chunked, framing, parallel, prefix_codes, stream_index
from bytewright.plans.columns import pick
from bytewright.sources.tables import table

CODECS = ("gzip", "zlib", "raw", "zstd", "lz4", "snappy", "snappy_stream", "brotli", "bzip2", "xz", "lzma")
BOUNDS = ("gzip", "zlib", "raw", "lz4", "lz4_block", "zstd", "snappy", "brotli")
_Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    return docs.withColumn("content", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))


def _checksum(column: Callable, name: str) -> _Query:
    return lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", column(F.col("content")).alias(name))


def _merged(merge: Callable, column: Callable, group: str, name: str) -> _Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pieces = _docs(spark, sf_dir).select(group, "doc_id", column(F.col("content")).alias(name), F.octet_length("content").cast("long").alias("n_bytes"))
        return merge(pieces, [group], "doc_id", name, "n_bytes")

    return run


def _roundtrip(codec: str) -> _Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = _docs(spark, sf_dir).select("doc_id", codecs.compress(F.col("content"), codec).alias("packed"))
        return packed.select("doc_id", codecs.decompress(F.col("packed"), codec).alias("b")).select("doc_id", F.octet_length("b").cast("long").alias("n_bytes"), F.md5("b").alias("md5"))

    return run


def _units(codec: str, format: str) -> _Query:
    """Objects of one codec, walked: the number of data units and the decoded bytes they declare."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), codecs.compress(F.col("content"), codec).alias("content"))
        data = framing.units(packed, format).where("kind not in ('identifier', 'skippable', 'padding')")
        return data.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_units"), F.sum(F.coalesce("out_len", F.lit(0))).alias("n_bytes"))

    return run


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).select("doc_id", F.octet_length("content").cast("long").alias("n"))
    return n.select("doc_id", *(codecs.bound(F.col("n"), c).cast("long").alias(c) for c in BOUNDS))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.byte_histogram(_docs(spark, sf_dir), "content")


def byte_entropy_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.entropy(analysis.byte_histogram(_docs(spark, sf_dir), "content", "lang"), "lang")
    return found.select("lang", "n_bytes", F.round("bits", 6).alias("bits"))


def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.runs(_docs(spark, sf_dir), "content", "doc_id")


def block_split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.block_distances(_docs(spark, sf_dir), "content", "doc_id").where("split").select("doc_id", "block", "distance")


def stored_vs_fixed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.deflate_costs(analysis.byte_histogram(_docs(spark, sf_dir), "content", "doc_id"), "doc_id")


def dmer_coverage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent strings of eight bytes."""
    return analysis.dmers(_docs(spark, sf_dir), "content").orderBy(F.desc("n"), "dmer").limit(100)


def delta_filter_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = _docs(spark, sf_dir).select("doc_id", filters.filtered(F.col("content"), "delta", True, 4).alias("b"))
    return there.select("doc_id", F.md5(filters.filtered(F.col("b"), "delta", False, 4)).alias("md5"))


def zlib_header_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts would pass for zlib by their first two bytes."""
    head = F.conv(F.hex(F.substring("content", 1, 2)), 16, 10).cast("long")
    docs = _docs(spark, sf_dir).withColumn("head", head).where(F.octet_length("content") >= 2)
    cmf = F.shiftright("head", 8)
    return docs.select("doc_id", "head", ((F.col("head") % 31 == 0) & (cmf.bitwiseAND(15) == 8) & (F.shiftright(cmf, 4) <= 7)).alias("is_zlib"))


def bgzf_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 65,280 bytes over each source's texts joined in order of doc_id: where each begins."""
    joined = _docs(spark, sf_dir).groupBy("source").agg(F.sum(F.octet_length("content")).alias("n"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunked.BGZF_INPUT))).alias("seq")
    rows = joined.where("n > 0").select("source", "n", at)
    return rows.select("source", "seq", (F.col("seq") * chunked.BGZF_INPUT).alias("out_offset"), F.least(F.col("n") - F.col("seq") * chunked.BGZF_INPUT, F.lit(chunked.BGZF_INPUT)).alias("n_bytes"))


def seek_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For offsets of orders into a stream of line items, the line item's unit that holds each."""
    points = pick(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey").select(F.col("l_suppkey").cast("string").alias("path"), (F.col("l_orderkey") * 100).cast("long").alias("out_offset")).distinct()
    asked = pick(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey").select((F.col("o_custkey") % 100).cast("string").alias("path"), (F.col("o_orderkey") * 100 + 50).cast("long").alias("offset"))
    return chunked.find(points, asked).where("out_offset is not null").select("path", "offset", "out_offset")


def parallel_gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = chunked.parallel_gzip(analysis.objects(table(spark, sf_dir, "documents")), size=4096)
    return packed.select(F.col("path").cast("long").alias("doc_id"), F.md5(codecs.decompress(F.col("content"), "gzip")).alias("md5"))


def zstd_seekable_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = chunked.zstd_seekable(analysis.objects(table(spark, sf_dir, "documents")), frame=4096)
    return packed.select(F.col("path").cast("long").alias("doc_id"), F.md5(codecs.decompress(F.col("content"), "zstd")).alias("md5"))


def size_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _docs(spark, sf_dir).select("lang", "source", F.octet_length("content").alias("n_in"), F.octet_length(codecs.compress(F.col("content"), "gzip")).alias("n_out"))
    return analysis.size_report(sizes, "lang", "source")


def match_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.match_distances(_docs(spark, sf_dir), "content", "doc_id").withColumn("mean_distance", F.round("mean_distance", 6))


def _parallel(codec: str, size: int) -> _Query:
    """Texts encoded by parts and decoded by parts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = parallel.encode(analysis.objects(table(spark, sf_dir, "documents")), codec, size)
        return parallel.decode(packed, codec).select(F.col("path").cast("long").alias("doc_id"), "how", F.md5("data").alias("md5"))

    return run


def parallel_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of which every third lacks its last byte: those are refused by the serial decoder, the others joined from blocks."""
    packed = parallel.encode(analysis.objects(table(spark, sf_dir, "documents")), "bzip2", 16384)
    cut = F.expr("if(cast(path as bigint) % 3 = 0, substring(content, 1, octet_length(content) - 1), content)")
    found = parallel.decode(packed.select("path", cut.alias("content")), "bzip2")
    return found.select(F.col("path").cast("long").alias("doc_id"), "how", "error", F.md5("data").alias("md5"))


def bgzf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as BGZF objects with the end block, decoded by their members."""
    packed = chunked.bgzf_objects(analysis.objects(table(spark, sf_dir, "documents")))
    return parallel.decode(packed, "bgzf").select(F.col("path").cast("long").alias("doc_id"), "how", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("md5"))


def snappy_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of Snappy streams from decoded byte 10,000 on, without those before."""
    packed = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), codecs.compress(F.col("content"), "snappy_stream").alias("content"))
    rows = parallel.decode_blocks(packed, "snappy_stream", skip=10000)
    return rows.select(F.col("path").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "out_offset", F.md5("data").alias("md5"))


def snappy_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks of each document, its text and its source, joined without decoding."""
    packed = lambda c: codecs.compress(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), "snappy")
    docs = _docs(spark, sf_dir).select("doc_id", F.array(packed("text"), packed("source")).alias("blocks"))
    return docs.select("doc_id", F.md5(codecs.decompress(codecs.concat_blocks(F.col("blocks")), "snappy")).alias("md5"))


def snappy_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the indexes behind Snappy streams, one for each chunk."""
    packed = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), stream_index.indexed(codecs.compress(F.col("content"), "snappy_stream"), 65536).alias("content"))
    return stream_index.stored_entries(packed).select(F.col("path").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "out_offset")


def skippable_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and chunks that decoders skip, before and behind zstd frames and Snappy chunks."""
    docs = _docs(spark, sf_dir)
    note = F.encode(F.col("doc_id").cast("string"), "UTF-8")
    zstd = F.concat(headers.skippable_frame(note, 3), codecs.compress(F.col("content"), "zstd"), headers.skippable_frame(note))
    snappy = F.concat(codecs.compress(F.col("content"), "snappy_stream"), headers.skippable_chunk(note))
    return docs.select("doc_id", zstd.alias("z"), snappy.alias("s")).select("doc_id", F.md5(codecs.decompress(F.col("z"), "zstd")).alias("zstd"), F.md5(codecs.decompress(F.col("s"), "snappy_stream")).alias("snappy"))


def crc32_combine_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of each text with its length's last four digits behind it, from both pieces' checksums and one operator."""
    end = F.encode(F.lpad((F.octet_length("content") % 10000).cast("string"), 4, "0"), "UTF-8")
    return _docs(spark, sf_dir).select("doc_id", C.crc32_combine_op(F.crc32("content"), F.crc32(end), C.crc32_combine_gen(4)).alias("crc32"))


def content_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where content-defined chunks of each text begin."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(analysis.cut_points(F.col("content"), 8)).alias("start"))


def sniffed_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in a container that doc_id chooses, decoded by what the first bytes say."""
    docs = _docs(spark, sf_dir)
    either = lambda a, b: F.when(F.col("doc_id") % 2 == 0, codecs.compress(F.col("content"), a)).otherwise(codecs.compress(F.col("content"), b))
    packed = docs.select("doc_id", either("gzip", "zlib").alias("g"), either("zlib", "raw").alias("z"))
    return packed.select("doc_id", F.md5(codecs.decompress(F.col("g"), "gzip_or_zlib")).alias("gzip_or_zlib"), F.md5(codecs.decompress(F.col("z"), "zlib_or_raw")).alias("zlib_or_raw"))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What first bytes say, of a byte that doc_id gives."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id").withColumn("byte", F.col("doc_id") % 256)
    lzma, bits = headers.lzma_properties(F.col("byte")), headers.brotli_window_bits(F.col("byte"))
    return docs.select("doc_id", "byte", lzma["lc"].alias("lc"), lzma["lp"].alias("lp"), lzma["pb"].alias("pb"), headers.lzma_dictionary(F.col("doc_id") * 7).alias("lzma_dictionary"), headers.lzma2_dictionary(F.col("doc_id") % 43).alias("lzma2_dictionary"), bits.alias("window_bits"), headers.brotli_window(bits).alias("window"))


def gdeflate_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile stream headers of as many bytes as texts have, times 50, read again."""
    docs = _docs(spark, sf_dir).select("doc_id", (F.octet_length("content") * 50).cast("long").alias("n"))
    return docs.select("doc_id", headers.gdeflate_inspect(headers.gdeflate_header(F.col("n"))).alias("i")).select("doc_id", "i.tiles", "i.size", "i.last_tile", "i.error")


def prefix_codes_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal codes of each language's bytes: they fill the code space, and cost less than a bit a byte above the entropy."""
    codes = prefix_codes.prefix_codes(analysis.byte_histogram(_docs(spark, sf_dir), "content", "lang"), "lang")
    total, n = F.sum(F.col("n") * F.col("length")), F.sum("n")
    entropy = n * F.log2(n) - F.sum(F.col("n") * F.log2("n"))
    space = F.sum(F.pow(F.lit(2.0), 15 - F.col("length"))).cast("long")
    return codes.groupBy("lang").agg(F.count(F.lit(1)).alias("n_symbols"), space.alias("space"), ((total >= entropy - 1) & (total < entropy + n)).alias("near_entropy"))


def queries() -> dict[str, _Query]:
    found: dict[str, _Query] = {
        "crc32_documents": _checksum(C.crc32, "crc32"),
        "adler32_documents": _checksum(C.adler32, "adler32"),
        "crc32c_documents": _checksum(C.crc32c, "crc32c"),
        "masked_crc32c_documents": _checksum(lambda c: C.masked(C.crc32c(c)), "masked"),
        "crc32_bzip2_documents": _checksum(C.crc32_bzip2, "crc32_bzip2"),
        "crc64_xz_documents": _checksum(C.crc64_xz, "crc64_xz"),
        "xxh32_documents": _checksum(C.xxh32, "xxh32"),
        "xxh64_documents": _checksum(C.xxh64, "xxh64"),
        "sha256_documents": _checksum(lambda c: F.sha2(c, 256), "sha256"),
        "adler32_combine_by_lang": _merged(C.adler32_merge, C.adler32, "lang", "adler32"),
        "crc32_combine_by_source": _merged(C.crc32_merge, C.crc32, "source", "crc32"),
    }
    found |= {f"roundtrip_{c}": _roundtrip(c) for c in CODECS}
    found |= {f"units_{c}": _units(c, c) for c in ("gzip", "zstd", "xz")} | {"units_snappy": _units("snappy_stream", "snappy"), "units_lz4": _units("lz4", "lz4")}
    for f in (bounds, byte_histogram, byte_entropy_by_lang, run_lengths, block_split_points, stored_vs_fixed_cost, dmer_coverage_top, delta_filter_roundtrip, zlib_header_classify, bgzf_layout, seek_find, parallel_gzip_roundtrip, zstd_seekable_roundtrip, size_report_rollup, match_distances):
        found[f.__name__] = f
    found |= {f"parallel_{c}": _parallel(c, size) for c, size in (("xz", 16384), ("bzip2", 16384), ("snappy_stream", 65536), ("zstd", 16384))}
    for f in (parallel_fallback, bgzf_roundtrip, snappy_skip, snappy_concat, snappy_index, skippable_roundtrip, sniffed_containers, header_fields, gdeflate_inspect, prefix_codes_by_lang, crc32_combine_fixed, content_cuts):
        found[f.__name__] = f
    return found


_BYTES = "b AS (SELECT doc_id, lang, source, encode(coalesce(text, '')) AS v, octet_length(encode(coalesce(text, ''))) AS n FROM documents), x AS (SELECT doc_id, lang, source, n, hex(v) AS h FROM b), e AS (SELECT doc_id, lang, source, n, unnest(range(n)) AS pos, unnest(regexp_extract_all(h, '..')) AS pair FROM x), y AS (SELECT doc_id, lang, source, n, pos, ('0x' || pair)::INTEGER AS byte FROM e)"


def _crc_sql(poly: int, name: str, outer: str = "{}") -> str:
    listed = ", ".join(map(str, C.crc_table(poly)))
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda i: ('0x' || i)::BIGINT)), lambda c, d: xor(c >> 8, ([{listed}])[1 + (xor(c, d) & 255)]::BIGINT))"
    return f"WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents), r AS (SELECT doc_id, xor({fold}, 4294967295) AS c FROM x) SELECT doc_id, {outer.format('c')} AS {name} FROM r"


def _crc32_bzip2_sql() -> str:
    """The same from the top bit down."""
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c >> 31 else 0)) & 0xFFFFFFFF
        table.append(c)
    fold = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda i: ('0x' || i)::BIGINT)), lambda c, d: xor((c & 16777215) << 8, ([{', '.join(map(str, table))}])[1 + xor(c >> 24, d)]::BIGINT))"
    return f"WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents) SELECT doc_id, xor({fold}, 4294967295) AS crc32_bzip2 FROM x"


def _crc64_xz_sql() -> str:
    table = ", ".join(map(str, C.crc_table(C.CRC64_XZ)))
    full = "18446744073709551615::UBIGINT"
    fold = f"list_reduce(list_prepend({full}, list_transform(regexp_extract_all(h, '..'), lambda i: ('0x' || i)::UBIGINT)), lambda c, d: xor(c >> 8, ([{table}]::UBIGINT[])[1 + (xor(c, d) & 255)::BIGINT]))"
    return f"WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents) SELECT doc_id, lpad(lower(to_hex(xor({fold}, {full}))), 16, '0') AS crc64_xz FROM x"


def oracle_sql() -> dict[str, str]:
    md5 = "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents"
    one_unit = "SELECT doc_id, 1::BIGINT AS n_units, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents"
    n = "octet_length(encode(coalesce(text, '')))::BIGINT"
    deflate = "n + 5 * (n // 5000 + n // 65535 + 2) + 8"
    whole = _crc_sql(C.CRC32, "crc32").replace("SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents", "SELECT source, hex(encode(string_agg(coalesce(text, ''), '' ORDER BY doc_id))) AS h, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS n FROM documents GROUP BY source").replace("SELECT doc_id, xor(", "SELECT source, n, xor(").replace("SELECT doc_id, c AS crc32", "SELECT source, n AS n_bytes, c AS crc32")
    found = {
        "crc32_combine_by_source": whole,
        "crc32_bzip2_documents": _crc32_bzip2_sql(),
        "crc64_xz_documents": _crc64_xz_sql(),
        "units_lz4": f"SELECT doc_id, CAST(({n} + 4194303) // 4194304 AS BIGINT) AS n_units, 0::BIGINT AS n_bytes FROM documents WHERE {n} > 0",  # its blocks declare no decoded size
        "adler32_documents": f"WITH {_BYTES}, s AS (SELECT doc_id, (1 + sum(byte)) % 65521 AS a, (any_value(n) + sum((n - pos) * byte)) % 65521 AS b FROM y GROUP BY doc_id) SELECT b.doc_id, CAST(coalesce(s.b * 65536 + s.a, 1) AS BIGINT) AS adler32 FROM b LEFT JOIN s USING (doc_id)",
        "crc32c_documents": _crc_sql(C.CRC32C, "crc32c"),
        "crc32_documents": _crc_sql(C.CRC32, "crc32"),
        "masked_crc32c_documents": _crc_sql(C.CRC32C, "masked", "(((({0} >> 15) | ({0} << 17)) & 4294967295) + 2726488792) % 4294967296"),
        "sha256_documents": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
        "adler32_combine_by_lang": "WITH d AS (SELECT doc_id, lang, encode(coalesce(text, '')) AS v, octet_length(encode(coalesce(text, ''))) AS n FROM documents), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS behind, hex(v) AS h FROM d), e AS (SELECT lang, n, behind, unnest(regexp_extract_all(h, '..')) AS pair, unnest(range(n)) AS pos FROM o), y AS (SELECT lang, ('0x' || pair)::INTEGER AS byte, n - pos + behind AS weight FROM e), t AS (SELECT lang, sum(n) AS n FROM d GROUP BY lang), s AS (SELECT lang, sum(byte) AS a, sum(byte * weight) AS b FROM y GROUP BY lang) SELECT lang, CAST((t.n + s.b) % 65521 * 65536 + (1 + s.a) % 65521 AS BIGINT) AS adler32, CAST(t.n AS BIGINT) AS n_bytes FROM t JOIN s USING (lang)",
        "bounds": f"WITH d AS (SELECT doc_id, {n} AS n FROM documents) SELECT doc_id, {deflate} + 18 AS gzip, {deflate} + 6 AS zlib, {deflate} AS raw, 19 + n + (n + 4194303) // 4194304 * 4 + 8 AS lz4, n + n // 255 + 16 AS lz4_block, n + (n >> 8) + CASE WHEN n < 131072 THEN (131072 - n) >> 11 ELSE 0 END AS zstd, 32 + n + n // 6 AS snappy, CASE WHEN n = 0 THEN 2 ELSE n + 2 + 4 * (n >> 14) + 4 END AS brotli FROM d",
        "byte_histogram": f"WITH {_BYTES} SELECT byte::BIGINT AS byte, count(*) AS n FROM y GROUP BY byte",
        "byte_entropy_by_lang": f"WITH {_BYTES}, c AS (SELECT lang, byte, count(*) AS n FROM y GROUP BY lang, byte) SELECT lang, CAST(sum(n) AS BIGINT) AS n_bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM c GROUP BY lang",
        "run_lengths": f"WITH {_BYTES}, i AS (SELECT doc_id, pos, byte, pos - row_number() OVER (PARTITION BY doc_id, byte ORDER BY pos) AS island FROM y) SELECT doc_id, min(pos) AS start, count(*) AS length, byte::BIGINT AS byte FROM i GROUP BY doc_id, byte, island HAVING count(*) >= 3",
        "block_split_points": f"WITH {_BYTES}, c AS (SELECT doc_id, pos // 512 AS block, byte, count(*) AS n FROM y GROUP BY ALL), l AS (SELECT doc_id, max(block) AS last FROM c GROUP BY doc_id), u AS (SELECT doc_id, block, byte, n FROM c UNION ALL SELECT doc_id, block + 1, byte, -n FROM c), d AS (SELECT doc_id, block, byte, sum(n) AS d FROM u GROUP BY ALL) SELECT doc_id, block, CAST(sum(abs(d)) AS BIGINT) AS distance FROM d JOIN l USING (doc_id) WHERE block BETWEEN 1 AND last GROUP BY doc_id, block HAVING 512 * sum(abs(d)) >= 200 * 512",
        "stored_vs_fixed_cost": f"WITH {_BYTES}, c AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN byte < 144 THEN 8 ELSE 9 END) AS bits FROM y GROUP BY doc_id), k AS (SELECT doc_id, CAST((n + 65534) // 65535 * 40 + 8 * n AS BIGINT) AS stored_bits, CAST(10 + bits AS BIGINT) AS fixed_bits FROM c) SELECT *, CASE WHEN stored_bits < fixed_bits THEN 'stored' ELSE 'fixed' END AS kind FROM k",
        "dmer_coverage_top": "WITH x AS (SELECT hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents), p AS (SELECT h, unnest(range(n - 7)) AS i FROM x WHERE n >= 8) SELECT substr(h, 2 * i + 1, 16) AS dmer, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, dmer LIMIT 100",
        "delta_filter_roundtrip": md5,
        "parallel_gzip_roundtrip": md5,
        "zstd_seekable_roundtrip": md5,
        "zlib_header_classify": "WITH h AS (SELECT doc_id, ('0x' || substr(hex(encode(text)), 1, 4))::BIGINT AS head FROM documents WHERE octet_length(encode(text)) >= 2) SELECT doc_id, head, head % 31 = 0 AND (head >> 8) & 15 = 8 AND (head >> 12) <= 7 AS is_zlib FROM h",
        "bgzf_layout": f"WITH s AS (SELECT source, sum({n})::BIGINT AS n FROM documents GROUP BY source), q AS (SELECT source, n, unnest(range((n - 1) // 65280 + 1)) AS seq FROM s WHERE n > 0) SELECT source, seq, seq * 65280 AS out_offset, least(n - seq * 65280, 65280) AS n_bytes FROM q",
        "seek_find": "WITH p AS (SELECT DISTINCT l_suppkey::VARCHAR AS path, (l_orderkey * 100)::BIGINT AS out_offset FROM lineitem), a AS (SELECT (o_custkey % 100)::VARCHAR AS path, (o_orderkey * 100 + 50)::BIGINT AS q FROM orders) SELECT a.path, a.q AS \"offset\", p.out_offset FROM a ASOF JOIN p ON a.path = p.path AND a.q >= p.out_offset",
        "units_gzip": one_unit,
        "units_snappy": f"SELECT doc_id, CAST(({n} + 65535) // 65536 AS BIGINT) AS n_units, {n} AS n_bytes FROM documents WHERE {n} > 0",
        "units_zstd": one_unit,
        "units_xz": f"{one_unit} WHERE {n} > 0",
        "match_distances": f"WITH {_BYTES}, g AS (SELECT doc_id, pos, byte + lead(byte, 1) OVER w * 256 + lead(byte, 2) OVER w * 65536 + (lead(byte, 3) OVER w)::BIGINT * 16777216 AS gram FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), k AS (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id, gram ORDER BY pos) AS gap FROM g WHERE gram IS NOT NULL) SELECT doc_id, count(*) AS n_positions, count(*) FILTER (gap <= 32768) AS n_matched, round(avg(gap) FILTER (gap <= 32768), 6) AS mean_distance FROM k GROUP BY doc_id",
    }
    text = "coalesce(text, '')"
    # an empty text has no blocks, so the serial decoder answers; of zstd and bzip2 an empty frame or stream is still one
    for c, first in (("xz", "serial"), ("bzip2", "serial"), ("snappy_stream", "serial"), ("zstd", "blocks")):
        found[f"parallel_{c}"] = f"SELECT doc_id, CASE WHEN {n} = 0 THEN '{first}' ELSE 'blocks' END AS how, md5({text}) AS md5 FROM documents"
    found |= {
        "parallel_fallback": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR {n} = 0 THEN 'serial' ELSE 'blocks' END AS how, CASE WHEN doc_id % 3 = 0 THEN 'Truncated' END AS error, CASE WHEN doc_id % 3 <> 0 THEN md5({text}) END AS md5 FROM documents",
        "bgzf_roundtrip": f"SELECT doc_id, 'blocks' AS how, {n} AS n_bytes, md5({text}) AS md5 FROM documents",
        "snappy_skip": f"WITH c AS (SELECT doc_id, hex(encode({text})) AS h, {n} AS n, unnest(range(({n} + 65535) // 65536)) AS seq FROM documents) SELECT doc_id, seq, seq * 65536 AS out_offset, md5(unhex(substr(h, seq * 131072 + 1, 131072))) AS md5 FROM c WHERE least((seq + 1) * 65536, n) > 10000",
        "snappy_concat": f"SELECT doc_id, md5({text} || coalesce(source, '')) AS md5 FROM documents",
        "snappy_index": f"SELECT doc_id, seq, seq * 65536 AS out_offset FROM (SELECT doc_id, unnest(range(({n} + 65535) // 65536)) AS seq FROM documents)",
        "skippable_roundtrip": f"SELECT doc_id, md5({text}) AS zstd, md5({text}) AS snappy FROM documents",
        "sniffed_containers": f"SELECT doc_id, md5({text}) AS gzip_or_zlib, md5({text}) AS zlib_or_raw FROM documents",
        "header_fields": "WITH b AS (SELECT doc_id, doc_id % 256 AS byte, doc_id % 43 AS l FROM documents), c AS (SELECT *, byte <= 224 AND byte % 9 + byte // 9 % 5 <= 4 AS ok, CASE WHEN byte % 2 = 0 THEN 16 WHEN (byte >> 1) & 7 > 0 THEN 17 + ((byte >> 1) & 7) WHEN (byte >> 4) & 7 = 0 THEN 17 WHEN (byte >> 4) & 7 > 1 THEN 8 + ((byte >> 4) & 7) END AS w FROM b) SELECT doc_id, byte, CASE WHEN ok THEN byte % 9 END::INTEGER AS lc, CASE WHEN ok THEN byte // 9 % 5 END::INTEGER AS lp, CASE WHEN ok THEN byte // 45 END::INTEGER AS pb, (greatest(doc_id * 7, 4096) + 15) // 16 * 16 AS lzma_dictionary, CASE WHEN l = 40 THEN 4294967295 WHEN l < 40 THEN (2 + l % 2) << (l // 2 + 11) END::BIGINT AS lzma2_dictionary, w::INTEGER AS window_bits, ((1::BIGINT << w) - 16)::BIGINT AS \"window\" FROM c",
        "gdeflate_inspect": f"WITH d AS (SELECT doc_id, {n} * 50 AS n FROM documents) SELECT doc_id, ((n + 65535) // 65536)::BIGINT AS tiles, n AS size, CASE WHEN n = 0 THEN 0 WHEN n % 65536 = 0 THEN 65536 ELSE n % 65536 END::BIGINT AS last_tile, NULL::VARCHAR AS error FROM d",
        "crc32_combine_fixed": _crc_sql(C.CRC32, "crc32").replace("hex(encode(coalesce(text, '')))", f"hex(encode(coalesce(text, '') || lpad(({n} % 10000)::VARCHAR, 4, '0')))"),
        "content_cuts": f"WITH {_BYTES}, g AS (SELECT doc_id, pos, n, byte + lead(byte, 1) OVER w * 256 + lead(byte, 2) OVER w * 65536 + (lead(byte, 3) OVER w)::HUGEINT * 16777216 AS gram FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), k AS (SELECT doc_id, pos, n, (gram * 2654435761 + lead(gram, 4) OVER (PARTITION BY doc_id ORDER BY pos) * 2246822519) % 4294967296 AS h FROM g) SELECT doc_id, pos + 8 AS start FROM k WHERE h < 16777216 AND pos + 8 < n",
        "prefix_codes_by_lang": f"WITH {_BYTES} SELECT lang, count(DISTINCT byte) AS n_symbols, 32768::BIGINT AS space, true AS near_entropy FROM y GROUP BY lang",
    }
    for c in CODECS:
        found[f"roundtrip_{c}"] = f"SELECT doc_id, {n} AS n_bytes, md5(coalesce(text, '')) AS md5 FROM documents"
    return found
