"""Text retrieval: chunks, contexts of searches under a budget, and the text field of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.operators.search import SCORES_SQL, search_keyword
from cinderlens.sources.tables import load

#: Characters of a chunk, overlap, chunks of a document, characters of a context, hits; fixed values.
CHUNK, OVERLAP, PER_DOC, BUDGET, HITS = 800, 120, 3, 6000, 3
#: What pieces are trimmed of: all characters up to the space; fixed value.
TRIMMED = "".join(map(chr, range(33)))


# ---- chunks


def fixed_chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Pieces of ``size`` characters that overlap; the last one ends with the text."""
    size = size if size > 0 else CHUNK
    overlap = size // 2 if overlap >= size else max(overlap, 0)
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def _folded(pieces: Column, add, size: int, overlap: int, cut_at: float, cut) -> Column:
    """Chunks from pieces in order: ``add`` puts a piece to the open chunk. A chunk is closed when the next piece does not
    fit; its last ``overlap`` characters start the next one. A chunk longer than ``cut_at`` is cut by ``cut``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit("").alias("tail"))

    def step(acc, p):
        open_, tail = acc["open"], acc["tail"]
        fits = (open_ == "") | (F.length(add(open_, p)) <= size)
        closed = F.when(F.length(open_) > overlap, F.substring(open_, -overlap, overlap)).otherwise("") if overlap else F.lit("")
        before = F.when(open_ == "", tail).when(fits, open_).otherwise(closed)
        joined = F.when(open_ != "", F.when(fits, add(open_, p)).otherwise(F.when(before == "", p).otherwise(F.concat(before, F.lit(" "), p)))).otherwise(F.when(before == "", p).otherwise(F.concat(before, F.lit(" "), p)))
        done = F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(open_)))
        long = F.length(joined) > cut_at
        return F.struct(F.when(long, F.concat(done, cut(joined))).otherwise(done).alias("done"), F.when(long, "").otherwise(joined).alias("open"), F.when(long | fits, F.when(long, "").otherwise(tail)).otherwise(closed).alias("tail"))

    return F.aggregate(F.filter(F.transform(pieces, lambda x: F.trim(x, F.lit(TRIMMED))), lambda x: x != ""), start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def paragraph_chunks(text: Column, size: int = CHUNK) -> Column:
    """Paragraphs (parted by empty lines) merged with an empty line between up to the size; longer ones are cut."""
    return _folded(F.split(text, r"\n{2,}"), lambda a, p: F.concat(a, F.lit("\n\n"), p), size, 0, size, lambda c: fixed_chunks(c, size, 0))


def sentence_chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Sentences merged up to the size, each chunk starting with the end of the one before; beyond 1.5 times the size a
    chunk is cut."""
    return _folded(F.split(text, r"(?<=[\.!?。？！])\s+"), lambda a, s: F.concat(a, F.lit(" "), s), size, overlap, size * 1.5, lambda c: fixed_chunks(c, size, overlap))


STRATEGIES = {"fixed": fixed_chunks, "paragraph": lambda t, size, overlap: paragraph_chunks(t, size), "sentence": sentence_chunks}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def chunks(text: Column, strategy: str = "fixed", size: int = CHUNK, overlap: int = OVERLAP, most: int | None = None) -> Column:
    """Chunks of a text by a strategy (any other name is the fixed one); with ``most`` only so many."""
    return chunks_of(trimmed(text), strategy, size, overlap, most)


def chunks_of(clean: Column, strategy: str = "fixed", size: int = CHUNK, overlap: int = OVERLAP, most: int | None = None) -> Column:
    """``chunks`` of a text that is trimmed already. The text is read once for each chunk, so it should be a column."""
    out = F.when(F.coalesce(clean, F.lit("")) == "", F.array().cast("array<string>")).otherwise(STRATEGIES.get(strategy.lower(), fixed_chunks)(clean, size, overlap))
    return F.slice(out, 1, most) if most else out


def chunk_query(strategy: str, most: int | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        # trimmed once, as a column of its own
        rows = load(spark, d, "documents").select("doc_id", trimmed(F.col("text")).alias("clean"))
        rows = rows.select("doc_id", F.posexplode(chunks_of(F.col("clean"), strategy, most=most)).alias("chunk", "text"))
        return rows.select("doc_id", "chunk", F.length("text").alias("chars"), F.md5("text").alias("md5"))

    return run


# ---- context


def context_pack(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """What is put into a query's context: chunks of its hits in order, each with a header line and an empty line after,
    until one does not fit; a first one that does not fit is cut. ``hits``: ``query, hit, chunk, of, text``. A query has
    at most ``MOST_HITS`` hits, so its window is short."""
    rows = hits.withColumn("header", F.concat(F.lit("--- Source "), F.col("hit").cast("string"), F.when(F.col("of") > 1, F.concat(F.lit("."), (F.col("chunk") + 1).cast("string"))).otherwise(""), F.lit(" ---\n")))
    rows = rows.withColumn("needs", F.length("header") + F.length("text") + 2)
    w = Window.partitionBy("query").orderBy("hit", "chunk")
    rows = rows.withColumn("upto", F.sum("needs").over(w)).withColumn("at", F.row_number().over(w))
    rows = rows.where((F.col("upto") <= budget) | (F.col("at") == 1))
    room = F.greatest(F.lit(budget) - F.length("header") - 4, F.lit(0))
    shown = F.when(F.col("upto") <= budget, F.concat("header", "text", F.lit("\n\n"))).otherwise(F.concat("header", F.substring(F.col("text"), F.lit(1), room), F.lit("...\n\n")))
    return rows.select("query", "hit", "chunk", F.length(shown).alias("chars"))


def context_query(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of all benchmark items from the best documents for their words."""
    docs = load(spark, d, "documents").select("doc_id", trimmed(F.col("text")).alias("clean"))
    found = search_keyword(spark, d, HITS).select("query", F.col("rank").alias("hit"), "doc_id").join(docs, "doc_id")
    pieces = chunks_of(F.col("clean"), most=PER_DOC)
    rows = found.select("query", "hit", F.size(pieces).alias("of"), F.posexplode(pieces).alias("chunk", "text"))
    return context_pack(rows.where("text <> ''"))


# ---- fields


def content_of(source: Column, preferred: str | None = None) -> Column:
    """The text field of a JSON document: the preferred one, else content, body, text or message, else the document."""
    fields = ([preferred] if preferred else []) + ["content", "body", "text", "message"]
    return F.coalesce(*(F.get_json_object(source, f"$.{f}") for f in fields), source)


def content_query(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("event_id") % 4, F.col("event_id").cast("string")
    source = F.when(k == 0, F.concat(F.lit('{"message": "m'), e, F.lit('", "body": "b'), e, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"text": "t'), e, F.lit('"}'))).when(k == 2, F.concat(F.lit('{"title": "own", "content": "c"}'))).otherwise(F.concat(F.lit('{"n":'), e, F.lit("}")))
    return load(spark, d, "events").select("event_id", content_of(source, "title").alias("content"))


_PIECES = f"""whole AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
 cut AS (SELECT doc_id, unnest(range(0, CAST(greatest(ceil((length(t) - {CHUNK}) / {CHUNK - OVERLAP}), 0) AS BIGINT) + 1)) AS chunk, t FROM whole WHERE t <> ''),
 pieces AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, substring(t, chunk * {CHUNK - OVERLAP} + 1, {CHUNK}) AS text FROM cut)"""
QUERIES = {
    "chunk_fixed": (chunk_query("fixed"), f"WITH {_PIECES} SELECT doc_id, chunk, CAST(length(text) AS INTEGER) AS chars, md5(text) AS md5 FROM pieces"),
    "chunk_capped": (chunk_query("other", PER_DOC), f"WITH {_PIECES} SELECT doc_id, chunk, CAST(length(text) AS INTEGER) AS chars, md5(text) AS md5 FROM pieces WHERE chunk < {PER_DOC}"),
    "chunk_paragraph": (chunk_query("paragraph"), None),
    "chunk_sentence": (chunk_query("sentence"), None),
    "context_pack": (
        context_query,
        f"""WITH {_PIECES}, {SCORES_SQL}, r AS (SELECT query, doc_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS hit FROM s QUALIFY hit <= {HITS}),
 h AS (SELECT query, hit, chunk, text, count(*) OVER (PARTITION BY query, hit) AS n FROM r JOIN pieces USING (doc_id) WHERE chunk < {PER_DOC}),
 q AS (SELECT *, length('--- Source ' || hit || CASE WHEN n > 1 THEN '.' || chunk + 1 ELSE '' END || ' ---') + 1 AS head FROM h),
 u AS (SELECT *, sum(head + length(text) + 2) OVER w AS upto, row_number() OVER w AS rn FROM q WINDOW w AS (PARTITION BY query ORDER BY hit, chunk))
 SELECT query, hit, chunk, CAST(CASE WHEN upto <= {BUDGET} THEN head + length(text) + 2 ELSE head + least(length(text), {BUDGET} - head - 4) + 5 END AS INTEGER) AS chars FROM u WHERE upto <= {BUDGET} OR rn = 1""",
    ),
    "content_fallback": (content_query, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'b' || event_id WHEN 1 THEN 't' || event_id WHEN 2 THEN 'own' ELSE '{\"n\":' || event_id || '}' END AS content FROM events"),
}
