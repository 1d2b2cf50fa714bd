"""Queries of the retrieval operators: documents, pages and vectors against the test items and stated query vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import retrieval as R
from quern.operators.dedup import holders
from quern.plans.base import Registry
from quern.plans.texts import sql_char_bigrams, sql_norm, sql_tokens
from quern.session import spread_table, table

query = Registry()


def _sql_bm25(docs: str, queries: str, doc_tokens: str, query_tokens: str, k1: float, b: float, keep: str = "true") -> str:
    return f"""
        d AS (SELECT id, kept, t, len(t) AS len FROM (SELECT *, {doc_tokens} AS t FROM ({docs}))),
        s AS (SELECT count(*) AS n, sum(len) / count(*) AS av FROM d),
        q AS (SELECT DISTINCT q, unnest(t) AS token FROM (SELECT *, {query_tokens} AS t FROM ({queries}))),
        tf AS (SELECT id, kept, len, token, count(*) AS tf FROM (SELECT id, kept, len, unnest(t) AS token FROM d) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
        df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
        bm AS (SELECT q, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * len / av))), 6) AS score FROM tf JOIN df USING (token) JOIN q USING (token), s WHERE kept GROUP BY q, id)
    """


_DOCS = "SELECT doc_id AS id, source, text, true AS kept FROM documents"
_ITEMS = "SELECT item_id AS q, text FROM eval_items"
_TOP = "SELECT q AS item_id, id AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0) WHERE rank <= 10"


def _scores(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    docs, items = spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return R.bm25(docs, "doc_id", T.tokenize(F.col("text")), items, "item_id", T.tokenize(F.col("text")), **more)


@query("WITH " + _sql_bm25(_DOCS, _ITEMS, sql_tokens("text"), sql_tokens("text"), 1.2, 0.75) + _TOP)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All test items as queries against all documents, ten hits each."""
    return R.ranked(_scores(spark, sf_dir), ["item_id"], "doc_id")


@query("WITH " + _sql_bm25("SELECT doc_id AS id, text, coalesce(doc_kind IN ('judgment'), false) AS kept FROM documents", _ITEMS, sql_tokens("text"), sql_tokens("text"), 1.2, 0.75) + _TOP)
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only judgments are scored; statistics stay those of all documents."""
    return R.ranked(_scores(spark, sf_dir, keep=F.col("doc_kind").isin("judgment")), ["item_id"], "doc_id")


@query(
    "WITH " + _sql_bm25(_DOCS, _ITEMS, sql_tokens("text"), sql_tokens("text"), 1.2, 0.75) + """
    , g AS (SELECT q, source, id, score, row_number() OVER (PARTITION BY q, source ORDER BY score DESC, id) AS rank FROM bm JOIN d USING (id) JOIN (SELECT doc_id AS id, source FROM documents) USING (id) WHERE score > 0),
    every AS (SELECT DISTINCT item_id, source FROM eval_items, (SELECT DISTINCT source FROM documents))
    SELECT item_id, every.source, id AS doc_id, score, rank FROM every LEFT JOIN (SELECT * FROM g WHERE rank <= 2) g ON g.q = item_id AND g.source IS NOT DISTINCT FROM every.source
    """.replace("JOIN d USING (id) ", "")
)
def bm25_panoramic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hits per query and source; sources without a hit stay. Ranks are within each source."""
    docs, items = spread_table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "eval_items").select("item_id")
    hits = R.ranked(_scores(spark, sf_dir).join(docs, "doc_id"), ["item_id", "source"], "doc_id", 2)
    groups = items.distinct().crossJoin(F.broadcast(docs.select("source").distinct()))
    return R.with_all_groups(hits, groups, ["item_id", "source"]).select("item_id", "source", "doc_id", "score", "rank")


@query("WITH " + _sql_bm25("SELECT doc_id AS id, text, true AS kept FROM documents", "SELECT record_id AS q, company AS text FROM (SELECT row_number() OVER (ORDER BY company) AS record_id, company FROM (SELECT DISTINCT company FROM report_manifest))", sql_char_bigrams("coalesce(text, '')"), sql_char_bigrams("text"), 1.5, 0.75) + "SELECT q AS company_no, count(*) AS n_hits, max(score) AS best FROM bm WHERE score > 0 GROUP BY q")
def bm25_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character bigrams with k1 = 1.5: company names against documents."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "report_manifest").select("company").distinct()
    companies = names.withColumn("company_no", F.row_number().over(Window.orderBy("company")))
    docs = spread_table(spark, sf_dir, "documents")
    scores = R.bm25(docs, "doc_id", T.char_bigrams(F.coalesce("text", F.lit(""))), companies, "company_no", T.char_bigrams(F.col("company")), k1=1.5)
    return scores.groupBy("company_no").agg(F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("best"))


_SQL_DOT = "list_sum(list_transform(list_zip(e.embedding, o.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_SQL_DENSE = f"dn AS (SELECT o.vec_id AS q, e.vec_id AS id, e.label, round({_SQL_DOT}, 6) AS score FROM embeddings e, embeddings o WHERE o.vec_id % 50 = 0)"


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.dense(e, "vec_id", "embedding", asked, "query_id", "query_vector")


@query(f"WITH {_SQL_DENSE} SELECT q AS query_id, id AS vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM dn) WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 as a query against all vectors."""
    return R.ranked(_dense(spark, sf_dir), ["query_id"], "vec_id")


@query("SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64 OR abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.025) AS n_bad FROM embeddings")
def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(R.bad_vectors(e, "embedding", 64)).alias("n_bad"))


@query(
    "WITH " + _sql_bm25(_DOCS, "SELECT vec_id AS q, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0", sql_tokens("text"), sql_tokens("text"), 1.2, 0.75)
    + f""", {_SQL_DENSE},
    a AS (SELECT * FROM (SELECT q, id, score AS score_a, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank_a FROM bm WHERE score > 0) WHERE rank_a <= 50),
    b AS (SELECT * FROM (SELECT q, id, score AS score_b, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank_b FROM dn) WHERE rank_b <= 50),
    f AS (SELECT *, round(coalesce(1 / (60 + rank_a), 0) + coalesce(1 / (60 + rank_b), 0), 9) AS score FROM a FULL JOIN b USING (q, id))
    SELECT q AS query_id, id AS doc_id, score_a, rank_a, score_b, rank_b, score, hybrid_rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS hybrid_rank FROM f) WHERE hybrid_rank <= 10
    """
)
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents and all vectors, fused; a document without a vector can be a hit by its words alone, and the other way round."""
    e, docs = table(spark, sf_dir, "embeddings"), spread_table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 50 = 0").join(e.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "text")
    words = R.bm25(docs, "doc_id", T.tokenize(F.col("text")), asked, "query_id", T.tokenize(F.col("text")))
    return R.rrf(words, _dense(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), "query_id", "doc_id")


@query(
    "WITH " + _sql_bm25(_DOCS, _ITEMS, sql_tokens("text"), sql_tokens("text"), 1.2, 0.75)
    + f""", hits AS ({_TOP}),
    gold AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, {sql_norm('text')} AS k FROM eval_items WHERE {sql_norm('text')} <> ''), (SELECT doc_id, {sql_norm('text')} AS n FROM documents WHERE text IS NOT NULL) WHERE contains(n, k)),
    f AS (SELECT gold.item_id, count(*) AS n_gold, count(rank) AS n_found, min(rank) AS first_rank FROM gold LEFT JOIN hits USING (item_id, doc_id) GROUP BY gold.item_id)
    SELECT item_id, n_gold, n_found, round(n_found / n_gold, 6) AS recall, coalesce(round(1 / first_rank, 6), 0) AS reciprocal_rank FROM f
    """
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold documents hold an item's whole normal form."""
    docs, items = spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    gold = holders(docs, "doc_id", T.normal_form(F.col("text")), items, "item_id", T.normal_form(F.col("text")))
    return R.reciprocal_ranks(R.ranked(_scores(spark, sf_dir), ["item_id"], "doc_id"), gold, "item_id", "doc_id")


_SQL_NEAR = f"WITH {_SQL_DENSE}, nb AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM dn WHERE id <> q AND score > 0)"


def _neighbours(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = _dense(spark, sf_dir).where("vec_id <> query_id and score > 0")
    return R.ranked(near, ["query_id"], "vec_id", most).join(e, "vec_id")


def _sql_vote(most: int, decay: float) -> str:
    return f"""{_SQL_NEAR}, v AS (SELECT q, label, round(sum(score * score / (1 + {decay} * (rank - 1))), 6) AS weight, min(rank) AS first_rank FROM nb WHERE rank <= {most} GROUP BY q, label)
        SELECT q AS query_id, label AS voted, weight FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY weight DESC, first_rank) AS place FROM v) WHERE place = 1"""


@query(_sql_vote(12, 0.12))
def label_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve neighbours, weights falling by 0.12 a rank."""
    return R.votes(_neighbours(spark, sf_dir, 12), "query_id", "label", 12, 0.12)


@query(_sql_vote(9, 0.2))
def direction_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine neighbours, weights falling by 0.2 a rank."""
    return R.votes(_neighbours(spark, sf_dir, 9), "query_id", "label", 9, 0.2)


@query(f"""
    WITH p AS (SELECT DISTINCT code, company FROM report_manifest)
    SELECT item_id, code FROM (SELECT item_id, text FROM eval_items), p WHERE contains(text, company) OR list_contains(regexp_split_to_array(text, '[^0-9A-Za-z]+'), code)
""")
def inferred_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that a question names, by name or code; the companies are one broadcast array (a dimension of bounded size)."""
    names = table(spark, sf_dir, "report_manifest").select("code", "company").distinct().agg(F.collect_list(F.struct("code", "company")).alias("names"))
    items = table(spark, sf_dir, "eval_items").crossJoin(F.broadcast(names))
    words = F.split("text", "[^0-9A-Za-z]+")
    hit = F.filter("names", lambda x: F.contains(F.col("text"), x["company"]) | F.array_contains(words, x["code"]))
    return items.select("item_id", F.explode(hit).alias("m")).select("item_id", F.col("m.code").alias("code"))


QUERIES, SQL = query.queries, query.sql
