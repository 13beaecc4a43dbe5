"""WARC archives: records written as text files by Spark, read back, and assembled into captures.

Each page gives three records that share one exchange: a ``request``, a ``response`` (or a ``revisit`` of an equal
payload that another record holds) and a ``metadata`` record. The request and the metadata name the response in
``WARC-Concurrent-To``; assembly joins on that identifier and emits one nested row per capture. A revisit is resolved
through ``WARC-Refers-To``.

Archives are gzip files of plain WARC/1.1 records, written with Spark's text writer (records are UTF-8, separated by
two line ends) and read with its text reader, which cuts a file at what looks like the start of a record; pieces are put
together again until a record has the length that it states. A task thus holds one record at a time, whatever the size of
its file, and any file system works.

Record ids hold a random part, so that repeated and null page ids do not meet in one capture; only a response that others
refer to has an id made of its page id and digest.

Defined results: a null page is an empty payload; payloads below ``min_revisit_bytes`` are never revisits; among equal
payloads the largest id is the response, and a payload that only rows without an id hold is stored by each; null ids are
kept, as a capture without an id, and sort before all others; repeated ids give one capture each; an empty table gives no
records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlens.llm.scratch import durable, new_path

#: Payloads below this size are stored again rather than referred to.
MIN_REVISIT_BYTES = 1000
#: Records of one archive file.
RECORDS_PER_FILE = 3000
RECORD_SCHEMA = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_digest string, payload_bytes long, body binary"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, holder, key``: who holds each payload. The holder is found from ids and digests
    alone; the aggregate combines before its shuffle, and the join back is one that Spark splits at skewed digests."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    held = rows.where(F.col("bytes") >= min_revisit_bytes).groupBy(F.col("digest").alias("held_digest")).agg(F.max("page_id").alias("holder"), F.count("*").alias("copies")).where("copies > 1").select("held_digest", "holder")
    return rows.join(held, (F.col("digest") == F.col("held_digest")) & (F.col("bytes") >= min_revisit_bytes), "left").drop("held_digest", "bytes")


def _record(kind: Column | str, record_id: Column, page_id: Column, url: Column, body: Column, extra: list[tuple[str, Column]]) -> Column:
    """One record: headers, an empty line, the body. A null extra header is left out."""
    one_line = F.regexp_replace(url, r"[\r\n]", " ")
    heads = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit("1970-01-01T00:00:00Z")), ("WARC-Target-URI", one_line), ("X-Page-ID", page_id.cast("string")), *extra, ("Content-Length", F.octet_length(body).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in heads]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"), body)


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, **columns) -> None:
    """Write the three records of every page to gzip archives at ``path``."""
    # the random part is made once per row
    rows = plan_records(pages, **columns).withColumn("part", F.expr("uuid()"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    rid = lambda kind, which: F.concat(F.lit(f"<urn:page:{kind}:"), which, F.lit(">"))
    held = lambda page: F.concat(page, F.lit(":"), F.col("digest"))
    name = F.concat(name, F.lit(":"), F.col("part"))
    holder = rid("response", held(F.col("holder").cast("string")))
    own = F.when(F.col("holder") == F.col("page_id"), holder).otherwise(rid("response", name))
    again = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))
    empty = F.lit("")
    to = [("WARC-Concurrent-To", own)]
    head = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", F.when(again, holder))]
    records = F.array(
        _record("request", rid("request", name), F.col("page_id"), F.col("url"), F.concat(F.lit("GET "), F.regexp_replace("url", r"[\r\n]", " "), F.lit(" HTTP/1.1\r\n\r\n")), to),
        _record(F.when(again, "revisit").otherwise("response"), own, F.col("page_id"), F.col("url"), F.when(again, empty).otherwise(F.col("payload")), head),
        _record("metadata", rid("metadata", name), F.col("page_id"), F.col("url"), F.concat(F.lit("length: "), F.octet_length("payload").cast("string"), F.lit("\r\n")), to),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


#: What separates records, and what stands between two of them.
_START = b"WARC/1.1\r\n"
_BETWEEN = b"\r\n\r\n" + _START


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record, from the parts that archives fall into when cut between records. A body that holds
    such a place is in several pieces."""
    held = None
    for piece in pieces:
        if held is None:
            content = piece.removeprefix(_START)
        else:
            content = held + _BETWEEN + piece
        end = content.index(b"\r\n\r\n")
        heads = dict(line.split(": ", 1) for line in content[:end].decode().split("\r\n"))
        size = int(heads["Content-Length"])
        body = content[end + 4 : end + 4 + size]
        if len(body) < size:
            held = content
            continue
        held = None
        yield heads, body


def read_records(spark: SparkSession, path: str, with_body: bool = True) -> DataFrame:
    """One row per record of the archives at ``path``; digests and sizes are those of the bodies read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("body", pa.binary())])
        pieces = (x for batch in batches for x in batch.column(0).cast(pa.binary()).to_pylist())
        rows, held = [], 0
        for h, body in parse_records(pieces):
            kind = h["WARC-Type"]
            digest = hashlib.sha1(body).hexdigest() if kind == "response" else h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
            page = h.get("X-Page-ID")
            rows.append({"record_id": h["WARC-Record-ID"], "type": kind, "concurrent_to": h.get("WARC-Concurrent-To"), "refers_to": h.get("WARC-Refers-To"), "target_uri": h["WARC-Target-URI"], "page_id": int(page) if page else None, "payload_digest": digest, "payload_bytes": len(body), "body": body if with_body or kind != "response" else None})
            held += len(body)
            if len(rows) >= 3000 or held > 1 << 24:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.option("lineSep", _BETWEEN.decode()).schema("value string").text(path).mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, response, requests, metadata``. Records meet at the identifier that they
    are concurrent to. Records without a response stay, as a capture with a null response."""
    fields = [c for c in records.columns if c != "concurrent_to"]
    keyed = records.withColumn("capture", F.coalesce("concurrent_to", "record_id"))
    of = lambda *kinds: F.collect_list(F.when(F.col("type").isin(*kinds), F.struct(*fields)))
    grouped = keyed.groupBy("capture").agg(of("response", "revisit").alias("answers"), of("request").alias("requests"), of("metadata").alias("metadata"))
    answers = F.when(F.size("answers") > 0, F.col("answers"))
    return grouped.select(F.col("capture").alias("record_id"), F.explode_outer(answers).alias("response"), "requests", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """Captures with the payload size of the response that a revisit refers to, and that response's page. Only revisits
    are joined; both sides are written first, so that Spark can split a response that many revisits name."""
    captures = durable(captures, "captures")
    refers_to = F.col("response.refers_to")
    held = captures.where(F.col("response.type") == "response").select(F.col("record_id").alias("held_id"), F.col("response.payload_bytes").alias("held_bytes"), F.col("response.page_id").alias("held_page"))
    held = durable(held.dropDuplicates(["held_id"]), "held")
    revisits = captures.where(refers_to.isNotNull()).join(held, refers_to == F.col("held_id"), "left").drop("held_id")
    return revisits.unionByName(captures.where(refers_to.isNull()), allowMissingColumns=True)


def capture_digest(pages: DataFrame) -> DataFrame:
    """Write, read back and assemble all pages: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    r = F.col("response")
    captures = resolve(assemble(read_records(pages.sparkSession, path, with_body=False)))
    return captures.select(
        r["page_id"].alias("page_id"),
        F.coalesce("held_bytes", r["payload_bytes"]).alias("payload_bytes"),
        r["payload_digest"].alias("payload_digest"),
        r["type"].alias("record_type"),
        F.col("held_page").alias("refers_to"),
        F.size("requests").alias("n_requests"),
        F.element_at("metadata", 1)["target_uri"].alias("target_uri"),
    )


#: The contract's columns over ``pages``, without the two further ones.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, url FROM pages),
h AS (SELECT payload_digest AS d, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to, 1 AS n_requests, regexp_replace(coalesce(url, ''), '[\\r\\n]', ' ', 'g') AS target_uri
FROM p LEFT JOIN h ON d = payload_digest AND payload_bytes >= 1000
"""
