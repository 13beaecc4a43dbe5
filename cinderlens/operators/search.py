"""Search over stored indexes: words by BM25, and nearest vectors among candidates.

The index of words is a table of cells: a cell holds the documents of one block that have one word, with counts, lengths and
the largest part that any of them can add to a score. Blocks are some ``DOCS`` documents by a hash, so a word that stands in
every document is spread over all of them. Cells are dealt to folders by a hash of the word, sorted by word, so that a search
reads the folders and row groups of its own words. For each query a block's bound is the sum of its cells' bounds; the blocks
with the highest bounds are scored first, and then those whose bound reaches the score that the last hit has so far. All
words of a query count and no document that could be a hit is left out. Each cell is moved once, to the others of its block,
where it meets the queries that ask for the block; a document is in one block, so its score is summed there.

The index of vectors has lists around centroids, which are fitted on at most ``SAMPLE`` vectors and hold every vector; a long
list is cut into parts. A search looks at the nearest lists until they hold the candidates wanted, and ranks all their
vectors exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlens.sources.stored import new_folder, stored
from cinderlens.sources.tables import load

#: Hits of a search, at least one and at most so many; fixed value.
MOST_HITS = 20
TOP = 10
K1, B = 1.2, 0.75
#: Documents of a block, folders of words, blocks of each query that are scored first.
DOCS, FOLDERS, FIRST = 4096, 16, 2
#: Queries and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 256, 4096
#: Vectors that centroids are fitted on, most lists, and passes.
SAMPLE, LISTS, PASSES = 20_000, 1024, 8
#: Share of the nearest neighbours that the lists looked at should hold, and vectors that it is measured with.
RECALL, MEASURED = 0.97, 256
#: Score that rounding may take from a sum of bounds.
SLACK = 1e-6


def clamp_hits(k: int) -> int:
    return min(max(k, 1), MOST_HITS)


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


# ---- words


@dataclass(frozen=True)
class WordIndex:
    """``cells``: ``word, block, docs, counts, lens, top``; ``frequencies``: ``word, df``; documents and their mean length."""

    cells: DataFrame
    frequencies: DataFrame
    docs: int
    mean_len: float


def _part(tf: Column, length: Column, mean: float) -> Column:
    """What a word adds to a score, but for its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def word_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", per_block: int = DOCS) -> WordIndex:
    """Write the index of ``docs`` under ``folder``. Null texts have no words."""
    held = lambda c: F.coalesce(words(c), F.array().cast("array<string>")).alias("w")
    total = docs.select(held(F.col(text_col))).agg(F.count("*").alias("docs"), F.avg(F.size("w")).alias("mean")).first()
    n, mean = total["docs"], total["mean"] or 1.0
    blocks = max(1, -(-n // per_block))
    # the texts move to their block, where all counts are made
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block")).repartition("block").select("doc_id", "block", held(F.col("text")))
    counts = rows.select("doc_id", "block", F.size("w").alias("len"), F.explode("w").alias("word")).groupBy("word", "block", "doc_id", "len").agg(F.count("*").cast("int").alias("tf"))
    cells = counts.groupBy("word", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf", "len"))).alias("d"), F.max(_part(F.col("tf"), F.col("len"), mean)).alias("top"))
    cells = cells.select(F.pmod(F.hash("word"), F.lit(FOLDERS)).alias("folder"), "word", "block", F.col("d.doc_id").alias("docs"), F.col("d.tf").alias("counts"), F.col("d.len").alias("lens"), "top")
    kept = stored(cells.repartition("folder", "word", "block").sortWithinPartitions("folder", "word", "block"), f"{folder}/cells", ("folder",))
    df = stored(kept.groupBy("word").agg(F.sum(F.size("docs")).alias("df")), f"{folder}/words")
    return WordIndex(kept, df, n, mean)


def keyword_hits(index: WordIndex, queries: DataFrame, k: int = TOP, least: float = 0.0) -> DataFrame:
    """``query, doc_id, rank, score``: the best documents for the distinct words of each ``query, text``, at most
    ``MOST_HITS``; with ``least`` only those of at least this score."""
    k = clamp_hits(k)
    asked = queries.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).withColumn("folder", F.pmod(F.hash("word"), F.lit(FOLDERS)))
    df = F.col("df")
    asked = asked.join(index.frequencies, "word").withColumn("weight", F.log(1 + (index.docs - df + 0.5) / (df + 0.5)))
    asked = stored(asked, new_folder(asked.sparkSession, "asked"))
    bounds = index.cells.join(asked, ["folder", "word"]).groupBy("query", "block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    bounds = stored(bounds, new_folder(asked.sparkSession, "bounds"))
    highest = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("nth", F.row_number().over(highest)).where(F.col("nth") <= FIRST).select("query", "block")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")

    def scored(pairs: DataFrame) -> DataFrame:
        """The best documents of blocks for the queries that they are paired with."""
        own = pairs.groupBy("block").agg(F.collect_set("query").alias("queries"))
        cells = index.cells.join(asked.select("folder", "word").distinct(), ["folder", "word"], "left_semi").repartition("block")
        cells = cells.join(own.hint("shuffle_hash"), "block").join(asked, ["folder", "word"]).where(F.array_contains("queries", F.col("query")))
        found = cells.select("query", "block", "weight", F.explode(F.arrays_zip("docs", "counts", "lens")).alias("d"))
        part = F.col("weight") * _part(F.col("d.counts"), F.col("d.lens"), index.mean_len)
        sums = found.groupBy("query", "block", F.col("d.docs").alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score")).drop("block")
        return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    hits = stored(scored(first), new_folder(asked.sparkSession, "hits"))
    # the score that a document must reach now, where there are enough hits
    bar = hits.where(F.col("rank") == k).select("query", F.col("score").alias("bar"))
    rest = bounds.join(first, ["query", "block"], "left_anti").join(bar, "query", "left").where(F.col("bar").isNull() | (F.col("bound") + SLACK >= F.col("bar"))).select("query", "block")
    every = hits.drop("rank").unionByName(scored(rest).drop("rank"))
    every = every.where(F.col("score") >= least) if least > 0 else every
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "doc_id", "rank", "score")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")


def search_keyword(spark: SparkSession, d: str, k: int = TOP, least: float = 0.0) -> DataFrame:
    """The best documents for all words of every benchmark item."""
    return keyword_hits(word_index(load(spark, d, "documents"), new_folder(spark, "words")), _items(spark, d), k, least)


# ---- vectors


def _units(v: np.ndarray, n: int) -> np.ndarray:
    v = v.reshape(n, -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def _packed(rows: DataFrame, size: int, ids: str, values: str, *by: str) -> DataFrame:
    """Blocks of about ``size`` vectors of each ``by``: their ids and their numbers one behind the other."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = (rows.join(counts, list(by)) if by else rows.crossJoin(F.broadcast(counts))).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return dealt.groupBy(*by, "block").agg(F.collect_list("vec_id").alias(ids), F.flatten(F.collect_list("v")).alias(values)).drop("block")


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """``query, vec_id, rank, score`` from pairs of blocks ``qs, qv, ids, values``: each pair sends the best of the block for
    each query, by cosine in double precision, a query itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qs, qv, ids, values = (batch.column(c)[i].values.to_numpy() for c in range(4))
                score = np.round(_units(qv, len(qs)) @ _units(values, len(ids)).T, 6)
                score[qs[:, None] == ids[None, :]] = -np.inf
                # with the ties of the last place, which the ids settle later
                least = np.partition(score, -min(k, len(ids)), axis=1)[:, -min(k, len(ids)), None]
                q, at = np.nonzero((score >= least) & np.isfinite(score))
                yield pa.RecordBatch.from_arrays([pa.array(qs[q]), pa.array(ids[at]), pa.array(score[q, at])], ["query", "vec_id", "score"])

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = pairs.select("qs", "qv", "ids", "values").mapInArrow(run, "query long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "vec_id", "rank", "score")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def search_knn(spark: SparkSession, d: str, k: int = TOP) -> DataFrame:
    """The nearest vectors for each vector of an id divisible by 100: blocks of queries meet all blocks of vectors."""
    rows = _vectors(spark, d)
    pairs = _packed(rows.where("vec_id % 100 = 0"), QUERY_BLOCK, "qs", "qv").crossJoin(_packed(rows, VECTOR_BLOCK, "ids", "values"))
    return _nearest(pairs, clamp_hits(k))


@dataclass(frozen=True)
class VectorIndex:
    """``lists``: ``list, ids, values``, some ``VECTOR_BLOCK`` vectors a row; the centroids, how many each list holds, and how
    many lists a search looks at."""

    lists: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    probes: int


def fit_centroids(sample: np.ndarray, lists: int, passes: int = PASSES, seed: int = 3) -> np.ndarray:
    """Centroids of unit vectors by k-means on the sphere; one without members takes a vector that is far from its own."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(passes):
        near = sample @ centres.T
        of = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        empty = np.flatnonzero(np.bincount(of, minlength=lists) == 0)
        sums[empty] = sample[near.max(1).argsort()[: len(empty)]]
        centres = _units(sums, lists)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int = TOP, recall: float = RECALL, measured: int = MEASURED) -> int:
    """The number of nearest lists in which this share of the nearest neighbours in the sample lie."""
    asked = sample[:measured]
    score = asked @ sample.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argpartition(-score, min(k, len(sample) - 1), axis=1)[:, : min(k, len(sample) - 1)]
    of = (sample @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    needed = np.take_along_axis(place, of[near], axis=1)
    return int(np.quantile(needed, recall, method="higher")) + 1 if needed.size else 1


def vector_index(rows: DataFrame, folder: str, sample: int = SAMPLE, most: int = LISTS) -> VectorIndex:
    """Write lists of all ``vec_id, v`` under ``folder``. The sample are the first vectors in order of a hash of the id."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    n = drawn.num_rows
    if not n:
        return VectorIndex(rows.sparkSession.createDataFrame([], "list int, ids array<long>, values array<double>"), np.zeros((0, 1)), np.zeros(0, int), 1)
    vectors = _units(drawn["v"].combine_chunks().flatten().to_numpy(), n)
    lists = int(max(1, min(most, round(np.sqrt(n)))))
    centres = fit_centroids(vectors, lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of = (_units(batch.column(1).flatten().to_numpy(), batch.num_rows) @ centres.T).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), batch.column(0), batch.column(1)], ["list", "vec_id", "v"])

    dealt = rows.select("vec_id", "v").mapInArrow(assign, "list int, vec_id long, v array<double>")
    kept = stored(_packed(stored(dealt, f"{folder}/dealt"), VECTOR_BLOCK, "ids", "values", "list"), f"{folder}/lists")
    sizes = np.zeros(lists, int)
    # a row per list
    for r in kept.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():
        sizes[r["list"]] = r["n"]
    return VectorIndex(kept, centres, sizes, probes_for(vectors, centres))


def vector_hits(index: VectorIndex, queries: DataFrame, k: int = TOP, candidates: int = 0, probes: int = 0) -> DataFrame:
    """``query, vec_id, rank, score`` of ``vec_id, v``: the best of the vectors in the nearest lists that hold at least
    ``candidates`` vectors (ten times the hits unless given), and at least ``probes`` lists (the index's unless given)."""
    k = clamp_hits(k)
    wanted = candidates if candidates > 0 else max(10, 10 * k)
    centres, sizes, probes = index.centroids, index.sizes, probes or index.probes

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(centres):
                order = np.argsort(-(_units(batch.column(1).flatten().to_numpy(), batch.num_rows) @ centres.T), axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                row, place = np.nonzero((before < wanted) | (np.arange(order.shape[1]) < probes))
                yield pa.RecordBatch.from_arrays([pa.array(order[row, place].astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["list", "vec_id", "v"])

    asked = queries.select("vec_id", "v").mapInArrow(probe, "list int, vec_id long, v array<double>")
    asked = stored(asked, new_folder(queries.sparkSession, "probes"))
    return _nearest(_packed(asked, QUERY_BLOCK, "qs", "qv", "list").join(index.lists, "list"), k)


def search_knn_candidates(spark: SparkSession, d: str, k: int = TOP, candidates: int = 0) -> DataFrame:
    """Like ``search_knn``, among candidates of an index."""
    rows = _vectors(spark, d)
    return vector_hits(vector_index(rows, new_folder(spark, "vectors")), rows.where("vec_id % 100 = 0"), k, candidates)


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
#: ``s``: query, doc_id, score of all documents that hold a word of the query.
SCORES_SQL = f"""i AS (SELECT item_id AS query, unnest(list_distinct({_WORDS})) AS word FROM benchmark), w AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT count(*) AS docs, avg(len(w)) AS avg_len FROM w),
 c AS (SELECT doc_id, len, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM w) WHERE word IN (SELECT word FROM i) GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM c GROUP BY 1),
 s AS (SELECT query, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * len / avg_len))), 6) AS score FROM c JOIN f USING (word) JOIN i USING (word), t GROUP BY 1, 2)"""
_RANKED = "SELECT query, doc_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank, score FROM s"
LEAST = 12.0
QUERIES = {
    "search_keyword": (search_keyword, f"WITH {SCORES_SQL} {_RANKED} QUALIFY rank <= {TOP}"),
    "search_keyword_least": (lambda s, d: search_keyword(s, d, MOST_HITS + 5, LEAST), f"WITH {SCORES_SQL} {_RANKED} WHERE score >= {LEAST} QUALIFY rank <= {MOST_HITS}"),
    "search_knn": (search_knn, f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e JOIN e q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) SELECT query, vec_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, score FROM s QUALIFY rank <= {TOP}"),
    "search_knn_candidates": (search_knn_candidates, None),
}
