"""Merkle manifest of a dataset: a content-addressed DAG, and proofs by descending it.

Every row is a leaf; per group (source) the leaves are in order of id, each run of three nodes becomes one, until one is
left, the subroot; the subroots, in order of the group, become the root in the same way. What is stored is records of
digest to children. Records are kept in pages: a page holds all records of a subtree of ``DIGITS`` levels under the digest
of its top, so a page is found by its digest and equal subtrees are stored once. With pages the number of shuffles is the
number of levels over ``DIGITS`` (five for 10**14 rows), and no page holds more than ``3 ** DIGITS`` nodes of its lowest level.

A request for a leaf descends from the root by the base-3 digits of its rank: at each record the digit picks the child, and
the children that it does not pick are collected as one segment of the path. Requests for all leaves go down together: a
page is read once, and what its requests have in common, the path down to it, is one row. At the lowest page the path's
segments are put in reverse, which gives the siblings from the leaf up, and the digest is folded from them.

Ranks come from a sort by ranges of (group, id) and counts by range and group, so a group of any size is spread over many
tasks, and no task ever holds more than a page of it.

Defined results: a null field is hashed as ``-``; null ids come first; rows of one id are in order of their digests, so
repeated rows are leaves of their own; the crc32 of a null id is that of the empty text; a null group is one group, before
all others; other columns are not part of a leaf; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlens.llm.scratch import durable, release

#: Children of a record, levels of a page, nodes of a page's lowest level.
ARITY, DIGITS = 3, 6
PAGE = ARITY**DIGITS
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PAGE_SCHEMA = pa.schema([("grp", pa.string()), ("page", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("records", pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])))])
_PAGE_DDL = "grp string, page long, n long, digest string, records array<struct<digest:string,children:array<string>>>"


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: of each field its length in bytes, a colon and its value, or ``-``."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts)), 256)


def group_key(group: Column) -> Column:
    """A text that is never null and sorts as the group does, null first."""
    return F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group.cast("string")))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0 within the group, and ``n``, the group's rows."""
    by = [group, *order]
    placed = durable(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    # a row per range and per group in it, so that of a large group too
    spans = placed.groupBy(F.col(group).alias("__g"), part.alias("__part")).agg(F.count("*").alias("__c"), F.min("__at").alias("__first"))
    own = Window.partitionBy("__g")
    spans = spans.withColumn("n", F.sum("__c").over(own)).withColumn("__upto", F.sum("__c").over(own.orderBy("__part")))
    spans = durable(spans, "spans")
    found = placed.withColumn("__part", part).join(spans.hint("merge"), (F.col(group) == F.col("__g")) & (spans["__part"] == F.shiftright("__at", 33)))
    return found.select(*rows.columns, (F.col("__upto") - F.col("__c") + F.col("__at") - F.col("__first")).alias("rank"), "n")


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def page_levels(n: int) -> int:
    """Pages that a path down to one of ``n`` nodes goes through."""
    return -(-levels_of(n) // DIGITS)


def _height(n: int) -> int:
    """Levels of a page over nodes of a level with ``n``."""
    return DIGITS if n > PAGE else levels_of(n)


def _paged(nodes: DataFrame) -> DataFrame:
    """A row per page from ``grp, page, n, digests``: its digest and its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                level, records = row["digests"], {}
                for _ in range(_height(row["n"])):
                    runs = [level[k : k + ARITY] for k in range(0, len(level), ARITY)]
                    level = [digest_of(x) for x in runs]
                    records.update(zip(level, runs, strict=True))
                out.append({"grp": row["grp"], "page": row["page"], "n": row["n"], "digest": level[0], "records": [{"digest": d, "children": c} for d, c in records.items()]})
            yield pa.RecordBatch.from_pylist(out, _PAGE_SCHEMA)

    return nodes.select("grp", "page", "n", "digests").mapInArrow(run, _PAGE_DDL)


def _blocks(rows: DataFrame, *more: str) -> DataFrame:
    """``grp, page, n, digests`` and arrays of more columns from ``grp, rank, n, digest``."""
    sets = rows.groupBy("grp", F.floor(F.col("rank") / PAGE).alias("page")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "digest", *more))).alias("x"))
    return sets.select("grp", "page", "n", *(F.col(f"x.{c}").alias(f"{c}s") for c in ("digest", *more)))


def build(blocks: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """Pages (``digest, records``, one row per digest) over the lowest level's blocks, and ``grp, n, digest``: the top of
    each group, whose largest one has ``largest`` leaves."""
    tops, pages, level = [], [], blocks
    for k in range(max(1, page_levels(largest))):
        made = durable(_paged(level), "pages")
        pages.append(made.where("n > 1").select("digest", "records"))
        tops.append(made.where(F.col("n") <= PAGE).select("grp", F.lit(k).alias("k"), "digest"))
        nodes = made.where(F.col("n") > PAGE).select("grp", F.col("page").alias("rank"), F.ceil(F.col("n") / PAGE).alias("n"), "digest")
        level = _blocks(nodes)
    every, found = pages[0], tops[0]
    for p, t in zip(pages[1:], tops[1:], strict=True):
        every, found = every.unionByName(p), found.unionByName(t)
    return every.groupBy("digest").agg(F.first("records").alias("records")), found


def _step(records: dict[str, list[str]], digest: str, at: int, height: int) -> tuple[str, str]:
    """The node that the digits of ``at`` lead to, and the path's segments: each is the digit, the number of children and
    the children that are not on the way."""
    path = []
    for k in range(height - 1, -1, -1):
        children = records[digest]
        d = at // ARITY**k % ARITY
        path.append(f"{d}{len(children)}" + "".join(children[:d] + children[d + 1 :]))
        digest = children[d]
    return digest, "".join(path)


def _segments(path: str) -> list[tuple[int, list[str]]]:
    """Digit and siblings by level, from the root down."""
    out, at = [], 0
    while at < len(path):
        d, n = int(path[at]), int(path[at + 1])
        out.append((d, [path[at + 2 + 64 * j : at + 66 + 64 * j] for j in range(n - 1)]))
        at += 2 + 64 * (n - 1)
    return out


def _records(row: dict) -> dict[str, list[str]]:
    return {x["digest"]: x["children"] for x in row["records"] or ()}


def _expand(front: DataFrame, pages: DataFrame) -> DataFrame:
    """The next pages of all rows of ``grp, digest, at, n, left, path``: ``at`` is the page's place in its level, ``n`` the
    group's leaves and ``left`` the number of pages on the way down, this one among them."""
    columns = ["grp", "digest", "at", "n", "left", "path"]
    schema = pa.schema([("grp", pa.string()), ("digest", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("left", pa.int32()), ("path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                records, out = _records(row), []
                nodes = -(-row["n"] // PAGE ** (row["left"] - 1))
                for k in range(min(PAGE, nodes - PAGE * row["at"])):
                    digest, path = _step(records, row["digest"], k, _height(nodes))
                    out.append({"grp": row["grp"], "digest": digest, "at": PAGE * row["at"] + k, "n": row["n"], "left": row["left"] - 1, "path": row["path"] + path})
                yield pa.RecordBatch.from_pylist(out, schema)

    return front.join(pages.hint("merge"), "digest").select(*columns, "records").mapInArrow(run, "grp string, digest string, at long, n long, left int, path string")


def descend(front: DataFrame, pages: DataFrame, largest: int, until: int) -> DataFrame:
    """Go down from ``front`` until ``until`` pages are left (1: to the lowest pages, 0: to the nodes below them)."""
    done = None
    for _ in range(max(0, page_levels(largest) - until)):
        front = durable(front, "front")
        low = front.where(F.col("left") <= until)
        done = low if done is None else done.unionByName(low)
        front = _expand(front.where(F.col("left") > until), pages)
    return front if done is None else done.unionByName(front)


def _levels(n: str) -> Column:
    """``page_levels`` of a column, for up to 10**18 nodes."""
    out = F.lit(0)
    for k in range(7):
        out = F.when(F.col(n) > PAGE**k, k + 1).otherwise(out)
    return out


def prove(blocks: DataFrame, front: DataFrame, pages: DataFrame, root: str) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of the requests in ``blocks`` (``grp, page, ids,
    tampereds``) from the rows of ``front`` that lead to their lowest pages."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                records, above = _records(row), _segments(row["path"])
                out = []
                for k, (doc_id, tampered) in enumerate(zip(row["doc_ids"], row["tampereds"], strict=True)):
                    own, path = _step(records, row["digest"], k, _height(row["n"]))
                    way = (above + _segments(path))[::-1]
                    node = tampered or own
                    for d, siblings in way:
                        node = digest_of([*siblings[:d], node, *siblings[d:]])
                    out.append((doc_id, own, row["subroot"], root, digest_of([s for _, x in way for s in x]), node, node == root))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.string()] * 5, pa.bool_()], strict=True)], names)

    at = blocks.select(F.col("grp"), F.col("page").alias("at"), "doc_ids", "tampereds")
    both = front.join(pages.hint("merge"), "digest", "left").join(at.hint("merge"), ["grp", "at"])
    return both.select("digest", "n", "path", "subroot", "records", "doc_ids", "tampereds").mapInArrow(run, ddl)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """A proof for every row: its leaf, the subroot and root above it, the hash of its proof, and the root that is folded
    from the leaf (with the line ends of the text deleted where 2 divides the crc32 of the id) and the proof."""
    spark = docs.sparkSession
    own = {c: F.col(c) for c in fields}
    odd = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 2
    tampered = F.when(odd == 0, leaf(own | {text: F.replace(F.col(text), F.lit("\n"), F.lit(""))}))
    rows = docs.select(group_key(F.col(group)).alias("grp"), F.col(id_col).cast("long").alias("doc_id"), leaf(own).alias("digest"), tampered.alias("tampered"))
    blocks = durable(_blocks(ranked(rows, "grp", ["doc_id", "digest"]), "doc_id", "tampered"), "blocks")
    largest = blocks.agg(F.max("n")).first()[0] or 0
    pages, tops = build(blocks, largest)
    pages = durable(pages, "store")

    # the groups in order are the leaves of the upper tree
    sizes = blocks.groupBy("grp").agg(F.first("n").alias("leaves"))
    subroots = tops.join(sizes.hint("merge"), "grp").select(F.lit("").alias("top"), "grp", "leaves", "digest")
    order = durable(ranked(subroots, "top", ["grp"]), "order")
    groups = order.count()
    upper, root = build(_blocks(order.select(F.col("top").alias("grp"), "rank", "n", "digest")), groups)
    upper = durable(upper, "store")
    start = root.select("grp", "digest", F.lit(0).cast("long").alias("at"), F.lit(groups).cast("long").alias("n"), F.lit(page_levels(groups)).alias("left"), F.lit("").alias("path"))
    first = root.select("digest").first()
    reached = descend(start, upper, groups, 0).select("at", F.col("digest").alias("subroot"), "path")
    below = reached.join(order.select(F.col("rank").alias("at"), "grp", F.col("leaves").alias("n")).hint("merge"), "at")
    front = below.select("grp", F.col("subroot").alias("digest"), F.lit(0).cast("long").alias("at"), "n", _levels("n").alias("left"), "path")
    low = durable(descend(front, pages, largest, 1), "low")
    low = low.join(tops.select("grp", F.col("digest").alias("subroot")).hint("merge"), "grp").select("grp", "at", "digest", "subroot", "path", F.col("n"))
    return prove(blocks, low, pages, first[0] if first else "")


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
#: One step of crc32 by bits, for a polynomial in reversed form.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
ORACLE_SQL = f"""WITH RECURSIVE d AS (
  SELECT coalesce('=' || source, '-') AS g, doc_id, {_LEAF("text")} AS leaf, CASE WHEN xor({_CRC.format("coalesce(CAST(doc_id AS VARCHAR), '')")}, 4294967295) % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} END AS tampered FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
 low(g, lv, pos, h, n) AS (SELECT g, 0, pos, leaf, n FROM r UNION ALL SELECT g, lv + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY g, lv, pos // 3, n),
 s AS (SELECT g, h, lv AS height, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
 top(lv, pos, h, n) AS (SELECT 0, pos, h, n FROM s UNION ALL SELECT lv + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lv, pos // 3, n),
 steps AS (SELECT r.g, r.pos, l.lv, l.pos AS place, CAST(floor(r.pos / pow(3, l.lv)) AS BIGINT) AS mine, l.h FROM r JOIN low l ON l.g = r.g AND l.n > 1 AND l.pos // 3 = CAST(floor(r.pos / pow(3, l.lv + 1)) AS BIGINT)
  UNION ALL SELECT r.g, r.pos, s.height + t.lv, t.pos, CAST(floor(s.pos / pow(3, t.lv)) AS BIGINT), t.h FROM r JOIN s ON s.g = r.g JOIN top t ON t.n > 1 AND t.pos // 3 = CAST(floor(s.pos / pow(3, t.lv + 1)) AS BIGINT)),
 way AS (SELECT g, pos, lv, coalesce(string_agg(h, '' ORDER BY place) FILTER (place < mine), '') AS a, coalesce(string_agg(h, '' ORDER BY place) FILTER (place > mine), '') AS b FROM steps GROUP BY g, pos, lv),
 proof AS (SELECT g, pos, sha256(string_agg(a || b, '' ORDER BY lv)) AS p, max(lv) AS last FROM way GROUP BY g, pos),
 fold(g, pos, lv, h) AS (SELECT g, pos, 0, coalesce(tampered, leaf) FROM r UNION ALL SELECT f.g, f.pos, f.lv + 1, sha256(w.a || f.h || w.b) FROM fold f JOIN way w ON w.g = f.g AND w.pos = f.pos AND w.lv = f.lv)
 SELECT r.doc_id, r.leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(p, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM top WHERE n = 1) AS verified
 FROM r JOIN s ON s.g = r.g LEFT JOIN proof q ON q.g = r.g AND q.pos = r.pos JOIN fold f ON f.g = r.g AND f.pos = r.pos AND f.lv = coalesce(q.last + 1, 0)"""
