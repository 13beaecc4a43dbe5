"""Polling of servers as a streaming source.

A server has its own interval and is due once in each: its turns begin at the multiples of the interval. The source's offset
holds the turn of each server, which follows from the clock alone, so that nothing has to be remembered besides the offsets
in the checkpoint: after a restart the same servers are listed again for a batch that had begun, and none whose turn is
done. Servers and listings are Parquet tables on any file system that Arrow knows; each due server is one partition, and its
task reads that server's files only.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "server_id long, turn long, name string, size long, path string"
#: Seconds between two listings of a server that states no interval; fixed value.
INTERVAL = 60


class Due(InputPartition):
    """One server that is to be listed."""

    def __init__(self, server: str, at: int):
        self.server, self.at = server, at


def turns(servers: list[dict], now: int) -> dict[str, int]:
    """When the turn began that each server is in at ``now`` (seconds): of enabled ones that are polled on their own."""
    every = lambda s: s.get("interval") or INTERVAL
    return {str(s["server_id"]): now - now % every(s) for s in servers if s.get("enabled") and s.get("auto_detect")}


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.servers, self.listing, self.clock = options["servers"], options["listing"], options.get("clock")

    def _now(self) -> int:
        if self.clock is None:
            return int(time.time())
        # a stated time, for tests
        return ds.dataset(self.clock, format="parquet").to_table()["now"][0].as_py()

    def initialOffset(self) -> dict:
        return {"turns": "{}"}

    def latestOffset(self) -> dict:
        rows = ds.dataset(self.servers, format="parquet").to_table().to_pylist()
        return {"turns": json.dumps(turns(rows, self._now()), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Due]:
        old, new = json.loads(start["turns"]), json.loads(end["turns"])
        return [Due(s, at) for s, at in sorted(new.items()) if at > old.get(s, -1)]

    def read(self, partition: Due) -> Iterator[pa.RecordBatch]:
        files = ds.dataset(self.listing, format="parquet", partitioning=ds.partitioning(pa.schema([("server_id", pa.int64())]), flavor="hive"))
        rows = files.scanner(filter=ds.field("server_id") == int(partition.server), columns=["name", "size", "path"])
        for batch in rows.to_batches():
            n = batch.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([int(partition.server)] * n, pa.int64()), pa.array([partition.at] * n, pa.int64()), batch.column(0), batch.column(1), batch.column(2)], ["server_id", "turn", "name", "size", "path"])


class PollSource(DataSource):
    """``spark.readStream.format("poll")`` with ``servers`` (``server_id, interval, enabled, auto_detect``) and ``listing``
    (``server_id, name, size, path``, best as a folder for each server)."""

    @classmethod
    def name(cls) -> str:
        return "poll"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> PollReader:
        return PollReader(self.options)


def polled(spark: SparkSession, servers: str, listing: str, **options: str) -> DataFrame:
    """The files that are found at each listing of a server."""
    spark.dataSource.register(PollSource)
    return spark.readStream.format("poll").option("servers", servers).option("listing", listing).options(**options).load()


def fresh(found: DataFrame, transfers: DataFrame) -> DataFrame:
    """The found files that no transfer has brought: by server, name and size."""
    done = transfers.where(F.col("state") == "SUCCESS").select("server_id", "name", "size").distinct()
    return found.join(done, ["server_id", "name", "size"], "left_anti")
