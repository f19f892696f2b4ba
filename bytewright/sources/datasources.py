"""Python data sources: generated inputs and corpus files; and a writer of one object per row.

``spark.dataSource.register`` each class, then ``spark.read.format("generated").option("spec", "text 1 65536")`` and so on."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_MASK = (1 << 64) - 1
KINDS = ("text", "binary", "noise", "runs", "zeros", "png", "periodic", "json")


class SplitMix:
    def __init__(self, state: int):
        self.state = state & _MASK

    def next(self) -> int:
        self.state = self.state + 0x9E3779B97F4A7C15 & _MASK
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
        return z ^ z >> 31

    def below(self, n: int) -> int:
        return self.next() * n >> 64


def generated(kind: str, seed: int, length: int) -> bytes:
    """Seeded bytes of a kind; a shorter input is a prefix of a longer one."""
    rng, out = SplitMix(seed ^ KINDS.index(kind) << 56), bytearray()
    pattern = bytes(rng.below(256) for _ in range(1 + rng.below(300))) if kind == "periodic" else b""
    syllables = [f"{a}{b}" for a in "bcdfglmnprst" for b in "aeiou"]
    while len(out) < length:
        if kind == "zeros":
            out += bytes(length - len(out))
        elif kind == "periodic":
            out += pattern
        elif kind == "runs":
            out += bytes([rng.below(256)]) * (1 + rng.below(300))
        elif kind == "text":
            word = "".join(syllables[min(rng.below(60), rng.below(60))] for _ in range(1 + rng.below(4)))
            out += word.encode() + (b".\n" if rng.below(16) == 0 else b" ")
        elif kind == "json":
            out += (",".join(f'"{syllables[rng.below(10)]}":{rng.below(10000)}' for _ in range(2 + rng.below(6)))).join(("{", "}\n")).encode()
        elif kind == "binary":
            out += struct.pack("<IIHBQ", rng.below(1000), len(out), rng.below(65536), rng.below(256), rng.next() & 0xFFFF)
        elif kind == "png":
            base = rng.below(256)
            out += bytes([rng.below(5)]) + bytes((base + rng.below(4)) & 255 for _ in range(96))
        else:
            out += rng.next().to_bytes(8, "little")
    return bytes(out[:length])


class _Part(InputPartition):
    def __init__(self, value):
        self.value = value


class GeneratedSource(DataSource):
    """Rows (spec, kind, seed, len, content), one for each term of ``spec``; terms are joined by " + "."""

    @classmethod
    def name(cls) -> str:
        return "generated"

    def schema(self) -> str:
        return "spec string, kind string, seed long, len int, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _GeneratedReader(self.options["spec"])


class _GeneratedReader(DataSourceReader):
    def __init__(self, spec: str):
        self.terms = spec.split(" + ")

    def partitions(self) -> list[InputPartition]:
        return [_Part(t) for t in self.terms]

    def read(self, partition) -> Iterator[tuple]:
        kind, seed, n = partition.value.split(" ")
        yield partition.value, kind, int(seed), int(n), generated(kind, int(seed), int(n))


def corpus_records(data: bytes) -> Iterator[list[bytes]]:
    """Of a corpus file: a text header that ends with an empty line and names the fields, then records of fields, each
    with its length in four bytes before it."""
    header, _, body = data.partition(b"\n\n")
    fields = next(line for line in header.decode().split("\n") if line.startswith("fields:")).split()[1:]
    at = 0
    while at < len(body):
        record = []
        for _ in fields:
            n = struct.unpack_from("<I", body, at)[0]
            record.append(body[at + 4 : at + 4 + n])
            at += 4 + n
        yield record


def read_corpus(spark: SparkSession, path: str):
    """(file, record, fields) of corpus files that Spark can read."""
    from pyspark.sql import functions as F

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(corpus_records(content))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.binary()))], ["file", "record", "fields"])

    return spark.read.format("binaryFile").load(path).select(F.col("path"), "content").mapInArrow(parse, "file string, record int, fields array<binary>")


class ObjectSink(DataSource):
    """Writes the rows (path, content) as one file each under ``path``, with ``suffix`` behind its name."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ObjectWriter(self.options["path"], self.options.get("suffix", ""))


class _ObjectWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def write(self, iterator) -> WriterCommitMessage:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        store.create_dir(root)
        for row in iterator:
            with store.open_output_stream(f"{root}/{row.path.replace('/', '_')}{self.suffix}") as out:
                out.write(bytes(row.content))
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    for source in (GeneratedSource, ObjectSink):
        spark.dataSource.register(source)
