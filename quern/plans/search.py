"""Queries of the search front end: scoped hits over pages and tables, answers, character TF-IDF neighbours and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.functions.fold import judged
from quern.operators import dedup
from quern.operators import retrieval as R
from quern.operators import search as S
from quern.operators import vectors as V
from quern.plans.base import Registry
from quern.plans.retrieval import _sql_bm25
from quern.plans.texts import CITATION, _citations, sql_near, sql_norm, sql_shingles, sql_tokens
from quern.session import spread_table, table, written

query = Registry()

# Chunks: distinct pages as texts, distinct tables with their cells as text.
_SQL_CHUNKS = """
    SELECT DISTINCT page_id AS id, 'text' AS kind, code, pdf_page, text, NULL::VARCHAR AS unit_context, NULL::VARCHAR[] AS headers, source_url FROM report_pages
    UNION ALL
    SELECT DISTINCT table_id, 'table', code, pdf_page, array_to_string(headers, ' ') || ' ' || array_to_string(list_transform(table_rows, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' ')), ' '), unit_context, headers, NULL FROM report_tables
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["id", "kind", "code", "pdf_page", "text", "unit_context", "headers", "source_url"]
    pages = spread_table(spark, sf_dir, "report_pages").select(F.col("page_id").alias("id"), F.lit("text").alias("kind"), "code", "pdf_page", "text", F.lit(None).cast("string").alias("unit_context"), F.lit(None).cast("array<string>").alias("headers"), "source_url")
    cells = F.array_join(F.transform("table_rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " ")), " ")
    tables = spread_table(spark, sf_dir, "report_tables").select(F.col("table_id").alias("id"), F.lit("table").alias("kind"), "code", "pdf_page", F.concat(F.array_join("headers", " "), F.lit(" "), cells).alias("text"), "unit_context", "headers", F.lit(None).cast("string").alias("source_url"))
    return pages.unionByName(tables).select(*columns).dropDuplicates(["id"])


#: The questions of these queries: what each company reported, by the labels of its facts.
_SQL_QUESTIONS = "SELECT row_number() OVER (ORDER BY company)::BIGINT AS q, company || ' 净利润 不良贷款率 2024年' AS text FROM (SELECT DISTINCT company FROM report_manifest)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "report_manifest").select("company").distinct()
    return names.selectExpr("cast(row_number() over (order by company) as long) as question_id", "company || ' 净利润 不良贷款率 2024年' as text")


def _hits(spark: SparkSession, sf_dir: str, companies: list[str], top: int | None) -> tuple[DataFrame, DataFrame]:
    every = written(chunks(spark, sf_dir), "chunks")
    keep = S.eligible(companies, F.lit(None).cast("string"), F.col("code"))
    words = R.bm25(every, "id", T.tokenize(F.col("text")), questions(spark, sf_dir), "question_id", T.tokenize(F.col("text")), keep=keep)
    return S.hits(words, None, "question_id", "id", "bm25", top), every


def _sql_hits(keep: str, top: int) -> str:
    return "WITH chunks AS (" + _SQL_CHUNKS + "), " + _sql_bm25(f"SELECT id, kind, code, text, {keep} AS kept FROM chunks", _SQL_QUESTIONS, sql_tokens("text"), sql_tokens("text"), 1.2, 0.75) + f", hits AS (SELECT * FROM (SELECT q AS question_id, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0) WHERE rank <= {top})"


@query(_sql_hits("coalesce(code IN ('E10001', 'E10186'), false)", 5) + " SELECT question_id, id, score, rank FROM hits")
def scoped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hits a question among the chunks of two companies asked for by code; statistics are those of all chunks."""
    found, _ = _hits(spark, sf_dir, ["E10001", "E10186"], 5)
    return found.select("question_id", "id", "score", "rank")


_SQL_CITED = _sql_hits("true", 10) + """,
    cited AS (SELECT question_id, id, kind, code, rank, unit_context, headers, source_url, pdf_page, row_number() OVER (PARTITION BY question_id ORDER BY rank, id) AS citation
              FROM hits JOIN chunks USING (id) WHERE trim(coalesce(text, '')) <> '')"""
_SQL_TRIM = "regexp_replace(regexp_replace(x, '^[ \\t\\n\\x0b\\f\\r]+', ''), '[ \\t\\n\\x0b\\f\\r]+$', '')"


@query(
    _SQL_CITED + f"""
    SELECT question_id, citation, id, code, CASE WHEN kind = 'table' THEN (SELECT coalesce(string_agg(x, '|' ORDER BY first), '') FROM (SELECT x, min(i) AS first FROM (
        SELECT {_SQL_TRIM} AS x, i FROM (SELECT unnest([coalesce(unit_context, '')] || list_filter(coalesce(headers, []), lambda h: coalesce(regexp_matches(h, '{S.UNIT_HEADER}'), false))) AS x, generate_subscripts([coalesce(unit_context, '')] || list_filter(coalesce(headers, []), lambda h: coalesce(regexp_matches(h, '{S.UNIT_HEADER}'), false)), 1) AS i)) WHERE x <> '' GROUP BY x)) ELSE '' END AS context,
        CASE WHEN regexp_matches(regexp_replace(trim(source_url), '#.*$', ''), '(?i)^https?://[^/?#\\s@]+([/?]\\S*)?$') THEN regexp_replace(trim(source_url), '#.*$', '') || '#page=' || pdf_page END AS citation_url
    FROM cited"""
)
def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered evidence: what a table's own unit note and headers say of its unit (never the text), and a link to the page."""
    found, every = _hits(spark, sf_dir, [], 10)
    cited = S.evidence(found.join(every, "id"), "question_id", "id", "text")
    context = F.array_join(S.context_lines(F.col("kind"), F.col("unit_context"), F.col("headers")), "|")
    return cited.select("question_id", "citation", "id", "code", context.alias("context"), U.citation_href(F.col("source_url"), F.col("pdf_page")).alias("citation_url"))


@query(
    _SQL_CITED + """
    SELECT e.question_id, e.code, count(c.id) > 0 AS found, count(c.id) AS n_hits, coalesce(string_agg(c.citation::VARCHAR, ',' ORDER BY c.citation), '') AS citations
    FROM (SELECT q AS question_id, code FROM q0, (SELECT DISTINCT code FROM report_manifest)) e LEFT JOIN cited c ON c.question_id = e.question_id AND c.code = e.code GROUP BY ALL
    """.replace("FROM q0,", f"FROM ({_SQL_QUESTIONS}),")
)
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by question and company with their citations; companies without evidence stay."""
    found, every = _hits(spark, sf_dir, [], 10)
    cited = S.evidence(found.join(every, "id"), "question_id", "id", "text")
    return S.answer_groups(cited, questions(spark, sf_dir), table(spark, sf_dir, "report_manifest"), "question_id")


@query("SELECT page_id AS chunk_id, count(*) AS n FROM report_pages GROUP BY page_id HAVING count(*) > 1 OR page_id IS NULL OR trim(page_id) = ''")
def refused_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids an index would refuse."""
    return S.unique_ids(table(spark, sf_dir, "report_pages"), "page_id")


# Character TF-IDF over the judged part of documents' texts.
_SQL_FEATURES = """f AS (SELECT doc_id, regexp_replace(lower(CASE WHEN length(t) > 7500 THEN left(t, 2500) || right(t, 5000) ELSE t END), '\\s\\s+', ' ', 'g') AS f
      FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_split_to_array(text, '本院认为|本庭认为|判决如下|裁定如下')[1], '^[ \\t\\n\\x0b\\f\\r]+', ''), '[ \\t\\n\\x0b\\f\\r]+$', '') AS t FROM documents))"""
_SQL_TFIDF = f"""
    {_SQL_FEATURES},
    g AS (SELECT doc_id, g AS gram, count(*) AS tf FROM (SELECT doc_id, unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, length(f) - n + 2), lambda k: f[k:k + n - 1])))) AS g FROM f) GROUP BY ALL),
    v AS (SELECT gram, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT gram, count(*) AS df, sum(tf) AS total FROM g GROUP BY gram HAVING count(*) >= 2 ORDER BY total DESC, gram LIMIT 65000), (SELECT count(*) AS n FROM documents)),
    w AS (SELECT doc_id, gram, (1 + ln(tf)) * idf AS w FROM g JOIN v USING (gram)),
    x AS (SELECT doc_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents").select("doc_id", "doc_kind", "text")


@query(f"WITH {_SQL_TFIDF} SELECT gram, df, round(idf, 6) AS idf FROM v")
def tfidf_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features: grams of two to four characters that two documents hold, the 65,000 most frequent ones."""
    docs = _documents(spark, sf_dir)
    return V.vocabulary(V.gram_totals(docs, "doc_id", F.col("text"), judged), docs.agg(F.count(F.lit(1)).alias("n_docs"))).select("gram", "df", F.round("idf", 6).alias("idf"))


_SQL_COSINES = f"{_SQL_TFIDF}, c AS (SELECT * FROM (SELECT a.doc_id AS query_id, b.doc_id, round(sum(a.weight * b.weight), 6) AS score FROM x a JOIN x b USING (gram) WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL) WHERE score > 0)"


@query(f"WITH {_SQL_COSINES} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c) WHERE rank <= 10")
def tfidf_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest documents by cosine."""
    docs = _documents(spark, sf_dir)
    words = V.feature_words(docs, "doc_id", F.col("text"), part=judged)
    near = V.nearest(docs, "doc_id", F.col("text"), docs.where("doc_id % 50 = 0"), "query_id", words, R.TOP, part=judged)
    return R.ranked(near, ["query_id"], "doc_id")


_SQL_FORMS = f"forms AS (SELECT doc_id, {sql_norm('f')} AS n, {sql_shingles('f')} AS s FROM (SELECT doc_id, CASE WHEN length(t) > 7500 THEN left(t, 2500) || right(t, 5000) ELSE t END AS f FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_split_to_array(text, '本院认为|本庭认为|判决如下|裁定如下')[1], '^[ \\t\\n\\x0b\\f\\r]+', ''), '[ \\t\\n\\x0b\\f\\r]+$', '') AS t FROM documents WHERE text IS NOT NULL)))"
_SQL_GUARDED = f"""{_SQL_COSINES}, {_SQL_FORMS},
    same AS (SELECT a.doc_id AS query_id, b.doc_id FROM forms a, forms b WHERE a.doc_id % 50 = 0 AND {sql_near('a', 'b')}),
    gn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE NOT EXISTS (SELECT 1 FROM same WHERE same.query_id = c.query_id AND same.doc_id = c.doc_id))"""


#: Neighbours taken beyond those asked for, as near-duplicates of the query will be among them.
_SPARE = 20


def guarded(spark: SparkSession, sf_dir: str, most: int, kept: Column | None = None) -> DataFrame:
    """The nearest documents (of those kept) that are no near-duplicates of the query: these are left out before ranks are given.

    Some more neighbours are taken than asked for and compared with their query; queries that too few are left of are asked again for more."""
    docs = _documents(spark, sf_dir)
    words = V.feature_words(docs, "doc_id", F.col("text"), part=judged)
    among = docs if kept is None else docs.where(kept)
    queries, taken, found = docs.where("doc_id % 50 = 0"), most + _SPARE, []
    while True:
        pairs = spark.range(0).select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"), F.lit(0.0).alias("score"))  # its size counts as 0
        for near, sent in V.nearest_blocks(among, "doc_id", F.col("text"), queries, "query_id", words, taken, part=judged):
            near = R.ranked(near, ["query_id"], "doc_id", taken).select("query_id", "doc_id", "score")
            pairs = pairs.unionByName(written(near, "pairs"))
            sent.destroy()  # else the vectors of all blocks and rounds stay on the disks of the driver and the executors
        marked = written(dedup.near_marked(pairs, "query_id", "doc_id", docs, "text", judged), "marked")
        short = marked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("same")).alias("free")).where((F.col("n") >= taken) & (F.col("free") < most))
        short = written(short.select("query_id"), "short")
        found.append(marked.where("not same").join(R.maybe_broadcast(short), "query_id", "left_anti"))
        if short.isEmpty():
            return R.ranked(reduce(DataFrame.unionByName, found).drop("same"), ["query_id"], "doc_id", most)
        queries = docs.join(R.maybe_broadcast(short.withColumnRenamed("query_id", "doc_id")), "doc_id", "left_semi")
        taken *= 4


@query(f"WITH {_SQL_GUARDED} SELECT query_id, doc_id, score, rank FROM gn WHERE rank <= 60")
def guarded_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty neighbours with a positive score, near-duplicates of the query skipped."""
    return guarded(spark, sf_dir, 60)


@query(f"""WITH {_SQL_GUARDED}, k AS (SELECT gn.query_id, d.doc_kind AS label, round(sum(score * score / (1 + 0.12 * (rank - 1))), 6) AS weight, min(rank) AS first_rank FROM gn JOIN documents d USING (doc_id) WHERE rank <= 12 GROUP BY ALL)
    SELECT query_id, label AS voted, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, first_rank) AS place FROM k) WHERE place = 1""")
def kind_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of document that twelve guarded neighbours vote for."""
    near = guarded(spark, sf_dir, 12).join(table(spark, sf_dir, "documents").select("doc_id", "doc_kind"), "doc_id")
    return R.votes(near, "query_id", "doc_kind", 12, 0.12)


_SQL_LAWS = "laws AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_zip(regexp_extract_all(text, '《([^《》\\n]+)》第([零〇一二两三四五六七八九十百千万]+)条', 1), regexp_extract_all(text, '《([^《》\\n]+)》第([零〇一二两三四五六七八九十百千万]+)条', 2)), lambda m: m[1] || '第' || m[2] || '条'))) AS laws FROM documents)"
_SQL_LAW_VOTES = f"""{_SQL_GUARDED}, {_SQL_LAWS},
    ln AS (SELECT query_id, score, laws, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM gn JOIN laws USING (doc_id) WHERE len(laws) > 0),
    lv AS (SELECT query_id, label, round(sum(greatest(score, 0.001) / (1 + 0.15 * (rank - 1))), 6) AS weight, count(*) AS n FROM (SELECT query_id, score, rank, unnest(laws) AS label FROM ln WHERE rank <= 8) GROUP BY ALL),
    chosen AS (SELECT query_id, label, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n >= 2 DESC, weight DESC, label) AS place FROM lv) WHERE place = 1 OR (n >= 2 AND place <= 5))"""


def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _citations(spark, sf_dir).select("doc_id", F.concat("title", F.lit("第"), "article", F.lit("条")).alias("law"))
    return cited.groupBy("doc_id").agg(F.sort_array(F.collect_set("law")).alias("laws"))  # of one document


def _law_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = guarded(spark, sf_dir, 8, F.col("text").rlike(CITATION))
    return S.set_votes(near.join(_laws(spark, sf_dir), "doc_id"), "query_id", "laws")


@query(f"WITH {_SQL_LAW_VOTES} SELECT query_id, label, weight, place FROM chosen")
def law_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that the eight nearest citing documents vote for."""
    return _law_votes(spark, sf_dir)


@query(f"""WITH {_SQL_LAW_VOTES}, p AS (SELECT query_id, list(label) AS predicted FROM chosen GROUP BY query_id)
    SELECT count(*) AS n, round(avg(len(list_intersect(predicted, laws)) / len(predicted)), 6) AS law_precision, round(avg(len(list_intersect(predicted, laws)) / len(laws)), 6) AS law_recall FROM p JOIN laws ON doc_id = query_id WHERE len(laws) > 0""")
def held_out_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of voted articles against those the query documents cite, averaged over them."""
    voted = _law_votes(spark, sf_dir).groupBy("query_id").agg(F.collect_set("label").alias("predicted"))
    both = voted.join(_laws(spark, sf_dir).withColumnRenamed("doc_id", "query_id"), "query_id")
    common = F.size(F.array_intersect("predicted", "laws"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(common / F.size("predicted")), 6).alias("law_precision"), F.round(F.avg(common / F.size("laws")), 6).alias("law_recall"))


QUERIES, SQL = query.queries, query.sql
