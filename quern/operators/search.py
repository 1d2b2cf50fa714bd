"""The front end of retrieval: checked arguments, scope, mode, hits with all their scores and ranks, and answers made of hits.

What a caller asks wrongly is refused before anything runs; a mode whose index is missing is an error, never another mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import retrieval as R

MODES = ("bm25", "dense", "hybrid")
MOST_QUERY, MOST_HITS = 3000, 100


class DenseNotReady(RuntimeError):
    """A dense or hybrid search was asked for where there are no vectors."""


def check_query(text: str) -> str:
    if not isinstance(text, str) or not text.strip() or len(text) > MOST_QUERY:
        raise ValueError(f"a query has 1 to {MOST_QUERY} characters")
    return text


def clamped(top: int | None) -> int:
    """A number of hits between 1 and MOST_HITS; ten without one."""
    return max(1, min(MOST_HITS, top or R.TOP))


def check_mode(mode: str, has_vectors: bool) -> str:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode != "bm25" and not has_vectors:
        raise DenseNotReady(mode)
    return mode


def eligible(companies: list[str], company: Column, code: Column) -> Column:
    """Whether a chunk is in scope: its company's name or code is asked for; all are, where none is."""
    return F.lit(True) if not companies else F.coalesce(company.isin(*companies), F.lit(False)) | F.coalesce(code.isin(*companies), F.lit(False))


def unique_ids(chunks: DataFrame, id_col: str) -> DataFrame:
    """The chunks' ids that an index refuses: missing, empty, or given more than once."""
    return chunks.groupBy(F.col(id_col).cast("string").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or chunk_id is null or trim(chunk_id) = ''")


def hits(words: DataFrame, dense: DataFrame | None, query_id: str, id_col: str, mode: str = "hybrid", top: int | None = None) -> DataFrame:
    """Hits of scored lists with every score and rank: (query, id, score, bm25_score, bm25_rank, dense_score, dense_rank, hybrid_rank, rank).

    Without vectors the dense and hybrid columns are null. words and dense hold (query_id, id_col, score).
    """
    check_mode(mode, dense is not None)
    a = R.ranked(words, [query_id], id_col, None, name="bm25_rank").withColumnRenamed("score", "bm25_score")
    if dense is None:
        both = a.withColumns({"dense_score": F.lit(None).cast("double"), "dense_rank": F.lit(None).cast("int"), "hybrid_score": F.lit(None).cast("double"), "hybrid_rank": F.lit(None).cast("int")})
    else:
        b = R.ranked(dense, [query_id], id_col, None, name="dense_rank").withColumnRenamed("score", "dense_score")
        both = a.join(b, [query_id, id_col], "full")
        near = [F.when(F.col(r) <= R.CANDIDATES, 1 / (R.RRF_K + F.col(r))) for r in ("bm25_rank", "dense_rank")]
        gain = F.when(near[0].isNotNull() | near[1].isNotNull(), F.round(F.coalesce(near[0], F.lit(0.0)) + F.coalesce(near[1], F.lit(0.0)), 9))
        both = both.withColumn("hybrid_score", gain)
        order = Window.partitionBy(query_id).orderBy(F.col("hybrid_score").desc_nulls_last(), id_col)
        both = both.withColumn("hybrid_rank", F.when(F.col("hybrid_score").isNotNull(), F.row_number().over(order)))
    chosen = F.col(f"{mode}_rank")
    out = both.where(chosen <= clamped(top)).withColumns({"rank": chosen, "score": F.col(f"{mode}_score")})
    return out.select(query_id, id_col, "score", "bm25_score", "bm25_rank", "dense_score", "dense_rank", "hybrid_rank", "rank")


#: Fixed value: what a header cell says of the unit of its table.
UNIT_HEADER = r"单位(?:说明)?\s*[:：]|(?:人民币|金额单位).{0,16}(?:元|%)|(?:百万元|千元).{0,12}(?:人民币|单位)"


def context_lines(kind: Column, unit_context: Column, headers: Column) -> Column:
    """What is told of a table as a whole: its unit note and the header cells that name a unit. Text chunks have none."""
    lines = F.array_union(F.array(F.coalesce(unit_context, F.lit(""))), F.filter(F.coalesce(headers, F.array().cast("array<string>")), lambda h: F.coalesce(F.regexp_like(h, F.lit(UNIT_HEADER)), F.lit(False))))
    clean = F.array_distinct(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))
    return F.when(kind == "table", clean).otherwise(F.array().cast("array<string>"))


def evidence(found: DataFrame, query_id: str, id_col: str, text: str) -> DataFrame:
    """Hits with their citation numbers: blank ones left out, the first of each id, numbered by rank within the query."""
    first = Window.partitionBy(query_id, id_col).orderBy("rank")
    one = found.where(F.trim(F.coalesce(text, F.lit(""))) != "").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return one.withColumn("citation", F.row_number().over(Window.partitionBy(query_id).orderBy("rank", id_col)))


def answer_groups(cited: DataFrame, queries: DataFrame, companies: DataFrame, query_id: str) -> DataFrame:
    """(query, code, found, n_hits, citations) for every query and company, those without a hit included; companies are a dimension of checked size."""
    every = queries.select(query_id).distinct().crossJoin(R.maybe_broadcast(companies.select("code").distinct()))
    per = cited.groupBy(query_id, "code").agg(F.count(F.lit(1)).alias("n_hits"), F.sort_array(F.collect_list("citation")).alias("citations"))  # at most the hits of a query
    joined = every.join(per, [query_id, "code"], "left")
    return joined.select(query_id, "code", F.col("n_hits").isNotNull().alias("found"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.array_join(F.coalesce("citations", F.array().cast("array<int>")), ",").alias("citations"))


def set_votes(neighbours: DataFrame, query_id: str, labels: str, most: int = 8, decay: float = 0.15, keep: int = 5) -> DataFrame:
    """(query, label, weight, place) voted by the labels that neighbours bear: each of the first `most` gives its labels its score over
    1 + decay * rank. Labels that two neighbours bear are kept, at most `keep`; if there are none, the best one."""
    near = neighbours.where(F.col("rank") <= most).select(query_id, "score", "rank", F.explode(labels).alias("label"))
    gain = F.greatest(F.col("score"), F.lit(0.001)) / (1 + decay * (F.col("rank") - 1))
    sums = near.groupBy(query_id, "label").agg(F.round(F.sum(gain), 6).alias("weight"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(query_id).orderBy((F.col("n") >= 2).desc(), F.col("weight").desc(), "label")
    placed = sums.withColumn("place", F.row_number().over(order))
    return placed.where((F.col("place") == 1) | ((F.col("n") >= 2) & (F.col("place") <= keep))).select(query_id, "label", "weight", "place")
