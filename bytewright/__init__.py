"""Byte-stream analytics on Spark: checksums, codecs, framing, indexes and streams as DataFrames."""

__version__ = "0.1.0"
