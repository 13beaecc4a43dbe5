"""Hashes of the first bytes of files, unpacked as they are read: of a packed file only so much is read and unpacked as the
hash needs. Files are opened in the tasks through Arrow's file systems, by the paths that Spark's listing gives."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlens.operators.extract import DUMP_ENDS
from cinderlens.sources.files import listing
from cinderlens.sources.tables import load

#: Bytes that are hashed; fixed value.
HEAD = 65_536
#: Bytes that are read at once.
PIECE = 8_192


def is_packed(name: Column) -> Column:
    """Whether a name is that of a packed dump, whose hash is that of what is in it."""
    low = F.lower(name)
    dump = F.lit(False)
    for end in DUMP_ENDS:
        dump = dump | low.endswith(end)
    return dump & low.endswith(".gz")


def head_digest(stream: BinaryIO, packed: bool, most: int = HEAD) -> tuple[str | None, int]:
    """The hash of the first ``most`` bytes, and how many were read for it. A packed file that is broken before that has
    none; one that ends is hashed as far as it goes."""
    digest, left, read = hashlib.sha256(), most, 0
    unpack = zlib.decompressobj(31) if packed else None
    while left > 0:
        piece = stream.read(PIECE if packed else min(PIECE, left))
        read += len(piece)
        if not piece:
            return (digest.hexdigest() if unpack is None or unpack.eof else None), read
        while piece and left > 0:
            try:
                part = unpack.decompress(piece, left) if unpack else piece
            except zlib.error:
                return None, read
            digest.update(part[:left])
            left -= len(part)
            if unpack is None:
                break
            # another member may follow the one that is over
            piece = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if unpack.eof and piece and left > 0:
                unpack = zlib.decompressobj(31)
    return digest.hexdigest(), read


def file_hashes(spark: SparkSession, folder: str, most: int = HEAD) -> DataFrame:
    """``name, path, size, hash, bytes_read`` of the files in a folder."""
    schema = "name string, path string, size long, hash string, bytes_read long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, packed in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                files, place = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                with files.open_input_file(place) as stream:
                    found.append(head_digest(stream, packed, most))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([h for h, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["name", "path", "size", "hash", "bytes_read"])

    rows = listing(spark, folder).select("name", "path", "size", is_packed(F.col("name")).alias("packed"))
    # listings are short rows; the work is in the files
    return rows.repartition("path").mapInArrow(run, schema)


def content_hashes(rows: DataFrame, most: int = HEAD) -> DataFrame:
    """``id, hash`` from ``id, content, packed``, of files that are held as binary values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [head_digest(io.BytesIO(c or b""), bool(p), most)[0] for c, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["id", "hash"])

    return rows.select("id", "content", "packed").mapInArrow(run, "id long, hash string")


def packed(rows: DataFrame) -> DataFrame:
    """``id, content, packed``: the rows with their contents packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([gzip.compress(c or b"", mtime=0) for c in batch.column(1).to_pylist()], pa.binary()), pa.array([True] * batch.num_rows)], ["id", "content", "packed"])

    return rows.select("id", "content").mapInArrow(run, "id long, content binary, packed boolean")


def packed_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of every page's packed and plain copy: four copies of it in a row, so that most are cut."""
    plain = load(spark, d, "pages").select(F.col("page_id").alias("id"), F.repeat("html", F.lit(4)).cast("binary").alias("content"))
    both = content_hashes(plain.withColumn("packed", F.lit(False))).withColumnRenamed("hash", "plain").join(content_hashes(packed(plain)), "id")
    return both.select(F.col("id").alias("page_id"), "plain", F.col("hash").alias("packed"))


_HEAD_SQL = f"sha256(CASE WHEN strlen(repeat(html, 4)) <= {HEAD} THEN encode(repeat(html, 4)) ELSE array_slice(encode(repeat(html, 4)), 1, {HEAD}) END)"
QUERIES = {"partial_hash_packed": (packed_hashes, f"SELECT page_id, {_HEAD_SQL} AS plain, {_HEAD_SQL} AS packed FROM pages")}
