"""Keyword, dense and fused retrieval over tables: an inverted index, BM25, exact dot products, reciprocal rank fusion, top-k per query or group.

Index statistics (number of documents, document frequencies, mean length) are taken over all documents, whatever a later filter keeps.
Postings are reduced to the queries' tokens before they are counted, partial sums are combined before each shuffle, and ranking is by
row_number with a limit, which Spark prunes within each partition before it shuffles. Scores are rounded to six places and ties go to
the smaller id, so ranks do not depend on the order of addition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import BROADCAST_BYTES, is_small, plan_bytes, written

K1, B, RRF_K, CANDIDATES, TOP = 1.2, 0.75, 60, 50, 10


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast only if the plan's estimated size allows it."""
    return F.broadcast(df) if is_small(df) else df


def bm25(docs: DataFrame, id_col: str, tokens: Column, queries: DataFrame, query_id: str, query_tokens: Column, k1: float = K1, b: float = B, keep: Column | None = None) -> DataFrame:
    """(query_id, id, score) of every document with a positive score. A repeated query token counts once.

    keep limits which documents are scored, not what the statistics are taken over.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(query_tokens)).alias("token"))
    wanted = asked.select("token").distinct()
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    lengths = docs.select(F.col(id_col).alias("d"), tokens.alias("tokens"), kept.alias("kept"))
    # one pass over the texts: beside its tokens each document has a row without a token, which the statistics are counted from
    every = lengths.select("d", "kept", F.size("tokens").alias("len"), F.explode(F.array_append("tokens", F.lit(None).cast("string"))).alias("token"))
    told = every.join(maybe_broadcast(wanted.withColumn("asked", F.lit(True))), "token", "left").where("asked or token is null")
    tf = written(told.groupBy("token", "d", "kept", "len").agg(F.count(F.lit(1)).alias("tf")), "postings")
    sizes = tf.where("token is null").agg(F.sum("tf").alias("n"), F.sum(F.col("tf") * F.col("len")).alias("total")).first()
    n_docs, total = sizes["n"] or 0, sizes["total"] or 0
    avg_len = total / n_docs if total else 1.0
    tf = tf.where("token is not null")
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, "token").select("q", "token", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg_len))
    scored = tf.where("kept").join(maybe_broadcast(weights), "token").groupBy("q", "d").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.where("score > 0").select(F.col("q").alias(query_id), F.col("d").alias(id_col), "score")


def ranked(scores: DataFrame, by: list[str], id_col: str, most: int | None = TOP, score: str = "score", name: str = "rank") -> DataFrame:
    """Rank from 1 by falling score, then id, within the columns by; at most `most` each."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_col).asc())
    out = scores.withColumn(name, F.row_number().over(w))
    return out if most is None else out.where(F.col(name) <= most)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bad_vectors(vectors: DataFrame, column: str, dimension: int, tolerance: float = 0.025) -> Column:
    """Whether a vector has another dimension, a value that is no number, or another norm than 1."""
    v = F.col(column)
    norm = F.sqrt(dot(v, v))
    return v.isNull() | (F.size(v) != dimension) | F.exists(v, lambda x: F.isnan(x) | x.isNull()) | (F.abs(norm - 1) > tolerance)


def dense(vectors: DataFrame, id_col: str, column: str, queries: DataFrame, query_id: str, query_column: str) -> DataFrame:
    """(query_id, id, score) of all vectors against a stated set of queries, which goes to them in blocks below the broadcast bound."""
    asked = written(queries.select(F.col(query_id).alias("q"), F.col(query_column).alias("qv")), "queries")
    blocks = 1 + plan_bytes(asked) // BROADCAST_BYTES
    mine = vectors.select(F.col(id_col).alias("d"), F.col(column).alias("v"))
    parts = [mine.crossJoin(F.broadcast(asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b))) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts).select(F.col("q").alias(query_id), F.col("d").alias(id_col), F.round(dot(F.col("v"), F.col("qv")), 6).alias("score"))


def rrf(first: DataFrame, second: DataFrame, query_id: str, id_col: str, k: int = RRF_K, candidates: int = CANDIDATES, most: int = TOP) -> DataFrame:
    """Reciprocal rank fusion of two scored lists: each list's first `candidates` ranks give 1 / (k + rank)."""
    a = ranked(first, [query_id], id_col, candidates, name="rank_a").withColumnRenamed("score", "score_a")
    b = ranked(second, [query_id], id_col, candidates, name="rank_b").withColumnRenamed("score", "score_b")
    both = a.join(b, [query_id, id_col], "full")
    gain = F.coalesce(1 / (k + F.col("rank_a")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("rank_b")), F.lit(0.0))
    return ranked(both.withColumn("score", F.round(gain, 9)), [query_id], id_col, most, name="hybrid_rank")


def with_all_groups(hits: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Groups without a hit stay, with nulls."""
    return groups.join(hits, on, "left")


def reciprocal_ranks(hits: DataFrame, gold: DataFrame, query_id: str, id_col: str) -> DataFrame:
    """Per query with gold documents: share of gold among its hits, reciprocal of the first gold rank."""
    found = gold.join(hits.select(query_id, id_col, "rank"), [query_id, id_col], "left")
    per = found.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_gold"), F.count("rank").alias("n_found"), F.min("rank").alias("first_rank"))
    return per.select(query_id, "n_gold", "n_found", F.round(F.col("n_found") / F.col("n_gold"), 6).alias("recall"), F.coalesce(F.round(1 / F.col("first_rank"), 6), F.lit(0.0)).alias("reciprocal_rank"))


def votes(neighbours: DataFrame, query_id: str, label: str, most: int, decay: float) -> DataFrame:
    """The label with the largest sum of score^2 / (1 + decay * rank) over the first `most` neighbours (rank from 1 here)."""
    near = neighbours.where(F.col("rank") <= most)
    sums = near.groupBy(query_id, label).agg(F.round(F.sum(F.col("score") * F.col("score") / (1 + decay * (F.col("rank") - 1))), 6).alias("weight"), F.min("rank").alias("first_rank"))
    w = Window.partitionBy(query_id).orderBy(F.col("weight").desc(), F.col("first_rank").asc())
    return sums.withColumn("place", F.row_number().over(w)).where("place = 1").select(query_id, F.col(label).alias("voted"), "weight")
