"""Ranked retrieval: by words, by vectors, and both fused."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require

RRF_K = 60
K1, B = 1.2, 0.75
QUERY_BLOCK = 4096  # query vectors per pass over the vectors


def candidate_limit(limit: int) -> int:
    """Candidates each ranked input hands to the fusion."""
    return max(4 * limit, 20)


def store_limit(skip: int, limit: int) -> int:
    """Hits fetched for a page: twice what it needs, since a filter follows, and at most 500."""
    return min((skip + limit) * 2, 500)


def words(text: Column) -> Column:
    """Words of a text: runs of letters and digits, small."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def top_k(hits: DataFrame, k: int, query: str = "query_id", score: str = "score", item: str = "item_id") -> DataFrame:
    """The k best items of each query with their rank; equal scores by item.  row_number() <= k lets Spark keep k rows per
    query in each partition before it shuffles.
    """
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), item)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_search(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """BM25: query_id, item_id, score, rank.  ``texts``: item_id, text.  ``queries``: query_id, text (a stated query set).

    Only words that occur in a query leave the scan.  Null and empty texts count in the statistics and match nothing;
    a query word counts once however often it is repeated.
    """
    require(texts, "item_id", "text")
    require(queries, "query_id", "text")
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    split = texts.select("item_id", words(F.col("text")).alias("_w")).withColumn("length", F.size("_w"))
    stats = split.agg(F.count("*").alias("n_items"), F.avg("length").alias("mean_length"))
    postings = split.select("item_id", "length", F.explode("_w").alias("word")).join(asked.select("word").distinct(), "word", "left_semi").groupBy("word", "item_id", "length").agg(F.count("*").alias("tf"))
    frequency = postings.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n_items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    weighted = postings.join(frequency, "word").crossJoin(F.broadcast(stats)).select("word", "item_id", weight.alias("w"))  # one row of statistics
    scores = asked.join(weighted, "word").groupBy("query_id", "item_id").agg(F.round(F.sum("w"), 9).alias("score"))
    return top_k(scores, k)


_HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _nearest(ids: list[int], block: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, v in enumerate(batch.column(1).to_pylist()) if v and len(v) == block.shape[1] and None not in v]
            if not keep:
                continue
            items = batch.column(0).take(pa.array(keep)).to_numpy()
            m = np.array(batch.column(1).take(pa.array(keep)).to_pylist(), dtype=np.float64)
            norms = np.linalg.norm(m, axis=1)
            scores = np.round((block @ m.T) / np.where(norms == 0, np.inf, norms), 9)
            order = np.lexsort((np.broadcast_to(items, scores.shape), -scores), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(ids)), order.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[rows]), pa.array(items[order.ravel()]), pa.array(scores[rows, order.ravel()])], names=["query_id", "item_id", "score"])

    return run


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, dimension: int) -> DataFrame:
    """Exact cosine neighbours: query_id, item_id, score, rank.  ``vectors``: item_id, embedding; ``queries`` likewise.

    The query set is stated and goes over all vectors in blocks; each batch of vectors keeps only its k best per query.
    Vectors that are null, of another dimension, or hold nulls are no candidates; a zero vector scores 0.
    """
    require(vectors, "item_id", "embedding")
    pairs = vectors.select(F.col("item_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") == dimension)
    found, ids, rows = None, [], []

    def sweep() -> DataFrame:
        block = np.array(rows, dtype=np.float64).reshape(len(ids), dimension)
        norms = np.linalg.norm(block, axis=1, keepdims=True)
        return pairs.mapInArrow(_nearest(list(ids), block / np.where(norms == 0, np.inf, norms), k), _HITS)

    for r in asked.orderBy("item_id").toLocalIterator():
        ids.append(r.item_id)
        rows.append(r.embedding)
        if len(ids) == QUERY_BLOCK:
            found = sweep() if found is None else found.unionByName(sweep())
            ids, rows = [], []
    if ids or found is None:
        found = sweep() if found is None else found.unionByName(sweep())
    return top_k(found, k)


def fuse_ranks(lexical: DataFrame, vector: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists per query: query_id, item_id, score, lexical_rank, vector_rank, rank.

    A full join: an item that only one list holds has a null rank in the other and no score from it.
    """
    a = lexical.select("query_id", "item_id", F.col("rank").alias("lexical_rank"))
    b = vector.select("query_id", "item_id", F.col("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    fused = a.join(b, ["query_id", "item_id"], "full_outer").withColumn("score", F.round(part("lexical_rank") + part("vector_rank"), 9))
    return top_k(fused, limit)
