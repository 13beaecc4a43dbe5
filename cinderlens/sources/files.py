"""Files on shared storage: listings, report archives and their pages, and lines around a place in a source file. Spark's
readers find and open the files, so any file system that they know will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.operators.extract import DUMP_ENDS

#: Words in the names of report archives, by kind; fixed values.
ARCHIVE_WORDS = {"overview": ("system_overview", "overview"), "suspects": ("leak_suspects", "suspects"), "components": ("top_components", "components")}


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, size, modified`` of the files in a folder that are not empty; their content is not read."""
    rows = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.withColumn("name", F.substring_index("path", "/", -1))


def dump_files(files: DataFrame, any_ending: bool = False) -> DataFrame:
    """Dumps of a listing: no hidden files, known endings unless ``any_ending``; a packed file is shown by its plain name,
    and of two with one name the plain one counts. ``place`` orders them by time, newest first."""
    low = F.lower("name")
    known = F.lit(any_ending)
    for end in DUMP_ENDS:
        known = known | low.endswith(end)
    rows = files.where(~F.col("name").startswith(".") & known)
    packed = low.endswith(".gz")
    shown = F.when(packed, F.regexp_replace("name", r"(?i)\.gz$", "")).otherwise(F.col("name"))
    rows = rows.select(shown.alias("shown"), packed.alias("packed"), "size", "modified", "path")
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shown").orderBy("packed", "path"))).where("nth = 1").drop("nth")
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("modified"), "shown")))


def archives(files: DataFrame, kinds: dict[str, tuple[str, ...]] = ARCHIVE_WORDS) -> DataFrame:
    """``base, kind, path``: the archive of each dump and kind, whose name holds the dump's name and one of the kind's
    words; ``files`` has ``base`` too. A word alone does not do."""
    low = F.lower("name")
    words = [F.when(low.contains(F.lower("base")) & F.greatest(*(F.instr(low, w) for w in own), F.lit(0)).cast("boolean"), F.lit(kind)) for kind, own in kinds.items()]
    rows = files.where(low.endswith(".zip")).select("base", "path", "name", F.explode(F.array_compact(F.array(*words))).alias("kind"))
    return rows.groupBy("base", "kind").agg(F.min_by("path", "name").alias("path"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """``path, entry, pos, size, html`` of the HTML entries of the archives in a folder; an archive that cannot be read has
    no entries."""
    schema = "path string, entry string, pos int, size long, html string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for pos, info in enumerate(archive.infolist()):
                    if info.filename.lower().endswith((".html", ".htm")):
                        row = {"path": path, "entry": info.filename, "pos": pos, "size": info.file_size, "html": archive.read(info).decode("utf-8", "replace")}
                        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("entry", pa.string()), ("pos", pa.int32()), ("size", pa.int64()), ("html", pa.string())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")
    return files.mapInArrow(run, schema)


def main_page(entries: DataFrame) -> DataFrame:
    """The page that stands for an archive: its index, else the largest page of top consumers, else the largest one."""
    low = F.lower("entry")
    rank = F.when(low.endswith("index.html"), 0).when(low.contains("top_consumer"), 1).otherwise(2)
    return entries.groupBy("path").agg(F.min_by(F.struct("entry", "html"), F.struct(rank.alias("r"), (-F.col("size")).alias("s"), "pos")).alias("p")).select("path", "p.entry", "p.html")


def named_page(entries: DataFrame, word: str) -> DataFrame:
    """The first page of each archive whose name holds the word, one in the folder ``pages`` before others."""
    rows = entries.where(F.lower("entry").contains(word.lower()))
    return rows.groupBy("path").agg(F.min_by(F.struct("entry", "html"), F.struct((~F.col("entry").contains("pages/")).alias("o"), "pos")).alias("p")).select("path", "p.entry", "p.html")


def first_page(entries: DataFrame) -> DataFrame:
    return entries.groupBy("path").agg(F.min_by(F.struct("entry", "html"), "pos").alias("p")).select("path", "p.entry", "p.html")


def context_lines(lines: DataFrame, places: DataFrame, around: int = 5) -> DataFrame:
    """Numbered lines near places. ``lines``: ``file, number, line``; ``places``: ``id, file, number``."""
    wanted = places.select("id", "file", F.col("number").alias("at"), F.explode(F.sequence(F.greatest(F.col("number") - around, F.lit(1)), F.col("number") + around)).alias("number"))
    return wanted.join(lines, ["file", "number"]).select("id", "file", "number", "line", (F.col("number") == F.col("at")).alias("marked"))


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``file, number, line`` of the text files in a folder; a file is read whole by one task."""
    rows = spark.read.text(folder, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), "value")
    return rows.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).select("file", (F.col("at") + 1).alias("number"), "line")
