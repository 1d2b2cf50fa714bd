"""Queries of duplicates and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import dedup, feeds
from quern.plans.base import Registry
from quern.plans.texts import _sql_url, sql_fold, sql_near, sql_norm, sql_shingles
from quern.session import spread_table, table

query = Registry()


@query(f"SELECT min(doc_id) AS class_id, count(*) AS n FROM (SELECT doc_id, {sql_norm('text')} AS f FROM documents) WHERE f <> '' GROUP BY f")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_classes(spread_table(spark, sf_dir, "documents"), "doc_id", T.normal_form(F.col("text"))).select("class_id", "n")


_SQL_FORMS = f"forms AS (SELECT doc_id, lang, n, s FROM (SELECT doc_id, lang, {sql_norm('text')} AS n, {sql_shingles('text')} AS s FROM documents WHERE text IS NOT NULL) WHERE n <> '')"
_SQL_LINKS = f"cls AS (SELECT n, any_value(s) AS s, min(doc_id) AS class_id FROM forms GROUP BY n), links AS (SELECT a.class_id AS a, b.class_id AS b FROM cls a, cls b WHERE a.class_id <> b.class_id AND {sql_near('a', 'b')})"


@query(f"WITH {_SQL_FORMS}, {_SQL_LINKS}, deg AS (SELECT a AS class_id, count(*) AS n_links FROM links GROUP BY a) SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM forms JOIN cls USING (n) LEFT JOIN deg USING (class_id)")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicate_summary(spread_table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE length(text) >= 80) WHERE r = 1")
def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of eighty characters or more, the first of equal ones."""
    d = spread_table(spark, sf_dir, "documents").where(F.length("text") >= 80)
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"""
    WITH {_SQL_FORMS}, {_SQL_LINKS}, held AS (SELECT DISTINCT class_id FROM forms JOIN cls USING (n) WHERE doc_id % 7 = 0), near AS (SELECT class_id FROM held UNION SELECT b FROM links JOIN held ON a = class_id)
    SELECT count(*) AS n FROM documents d WHERE text IS NOT NULL AND lang IS NOT NULL AND doc_id % 7 <> 0 AND doc_id NOT IN (SELECT doc_id FROM forms JOIN cls USING (n) WHERE class_id IN (SELECT class_id FROM near))
""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows outside the hold-out (ids divisible by seven) whose text is no near-duplicate of one in it: its class holds no
    held-out text and is linked to no class that does."""
    d = spread_table(spark, sf_dir, "documents").where("text is not null").withColumn("f", T.normal_form(F.col("text")))
    classes, links = dedup.near_duplicates(d, "doc_id", "text")
    held = d.where("doc_id % 7 = 0").select(F.col("f").alias("form")).join(classes, "form").select("class_id").distinct()
    beside = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(held.withColumnRenamed("class_id", "a"), "a").select(F.col("b").alias("class_id"))
    near = classes.join(held.unionByName(beside).distinct(), "class_id").select(F.col("form").alias("f"))
    return d.where("lang is not null and doc_id % 7 <> 0").join(near, "f", "left_anti").agg(F.count(F.lit(1)).alias("n"))


_HOST = "lower(regexp_extract(url, '(?i)^\\s*https?://([^/?#:\\s@]+)', 1))"
_TRUSTED = f"""t AS (SELECT e.*, coalesce(({_sql_url('feed')}) IS NOT NULL AND ({_HOST} = feed_host OR ends_with({_HOST}, '.' || feed_host)), false) AS trusted
    FROM feed_entries e LEFT JOIN (SELECT source_id, regexp_replace(lower(regexp_extract(feed_url, '(?i)^\\s*https?://([^/?#:\\s@]+)', 1)), '^feeds?\\.', '') AS feed_host FROM feed_sources) USING (source_id))"""
_NOW = "n AS (SELECT max(fetched_at) - INTERVAL 20 DAY AS now FROM feed_entries)"


@query(f"""
    WITH {_TRUSTED}, {_NOW}, r AS (SELECT source_id, CASE WHEN coalesce(trim(title), '') = '' THEN 'invalid' WHEN NOT trusted THEN 'invalid' WHEN fetched_at IS NULL THEN 'undated' WHEN fetched_at > now THEN 'future' WHEN fetched_at < now - INTERVAL 72 HOUR THEN 'older' ELSE 'eligible' END AS reason FROM t, n)
    SELECT source_id, reason, count(*) AS n FROM r GROUP BY ALL
""")
def admission_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by source and first reason; the clock stands twenty days before the last fetch."""
    return _admitted(spark, sf_dir).groupBy("source_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "feed_entries")
    clock = entries.agg((F.max("fetched_at") - F.expr("interval 20 days")).alias("now"))
    marked = feeds.trusted(entries, table(spark, sf_dir, "feed_sources")).crossJoin(F.broadcast(clock))
    return marked.withColumn("reason", feeds.admission(F.col("title"), F.col("trusted"), F.col("fetched_at"), F.col("now")))


@query(f"""
    WITH {_TRUSTED}, {_NOW}, f AS (SELECT source_id, CASE WHEN fetched_at IS NULL THEN 'undated' WHEN fetched_at > now THEN 'future' WHEN fetched_at >= now - INTERVAL 72 HOUR THEN 'recent' ELSE 'stale' END AS freshness, trusted FROM t, n)
    SELECT source_id, count(*) AS n_seen, count(*) FILTER (trusted) AS n_trusted, count(*) FILTER (freshness = 'recent') AS n_recent, CASE WHEN bool_and(trusted) THEN 'ok' WHEN bool_or(trusted) THEN 'partial' ELSE 'failed' END AS status FROM f GROUP BY source_id
""")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _admitted(spark, sf_dir).withColumn("freshness", feeds.freshness(F.col("fetched_at"), F.col("now")))
    return a.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_seen"), F.count_if("trusted").alias("n_trusted"), F.count_if(F.col("freshness") == "recent").alias("n_recent"),
        F.when(F.every("trusted"), "ok").when(F.some("trusted"), "partial").otherwise("failed").alias("status"),
    )


@query("SELECT source_id, entry_id, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC NULLS LAST, entry_id) AS source_rank FROM feed_entries) WHERE source_rank <= 20")
def newest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.newest_per_source(table(spark, sf_dir, "feed_entries")).select("source_id", "entry_id", "source_rank")


@query(f"""
    WITH RECURSIVE e AS (SELECT entry_id, coalesce(source_id, '') AS s, list_filter(['u' || ({_sql_url('key')}), 't' || lower(title)], lambda x: x IS NOT NULL) AS ks, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC NULLS FIRST, entry_id) AS rn FROM feed_entries),
    g AS (
        SELECT entry_id, s, rn, true AS kept, ks AS seen FROM e WHERE rn = 1
        UNION ALL
        SELECT e.entry_id, e.s, e.rn, NOT list_has_any(g.seen, e.ks), CASE WHEN list_has_any(g.seen, e.ks) THEN g.seen ELSE g.seen || e.ks END FROM g JOIN e ON e.s = g.s AND e.rn = g.rn + 1
    )
    SELECT entry_id FROM g WHERE kept
""")
def greedy_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries kept per source, newest first, by address or title."""
    return feeds.deduplicated(table(spark, sf_dir, "feed_entries"), -F.unix_micros("fetched_at"))


@query()
def balanced_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "feed_sources").selectExpr("source_id", "row_number() over (order by source_id) as source_no")
    return feeds.balanced(table(spark, sf_dir, "feed_entries"), order)


@query(f"""
    SELECT entry_id FROM (SELECT entry_id, lower({sql_fold("concat_ws(' ', title, summary)")}) AS t FROM feed_entries)
    WHERE regexp_matches(t, '(^|[^a-z0-9_])(ai|artificial intelligence|chip|chips|semiconductor|semiconductors)($|[^a-z0-9_])') OR contains(t, '人工智能') OR contains(t, '芯片')
""")
def keyword_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feed_entries").where(feeds.keyword_match(F.concat_ws(" ", "title", "summary"), "AI，芯片")).select("entry_id")


_PRINTS = f"list_filter([sha256('url:' || ({_sql_url('ledger')})), sha256('title:' || regexp_replace(lower({sql_fold('title')}), '[^\\p{{L}}\\p{{N}}]', '', 'g'))], lambda x: x IS NOT NULL)"


@query(f"""
    WITH p AS (SELECT entry_id, batch_no, unnest({_PRINTS}) AS print FROM feed_entries)
    SELECT entry_id FROM feed_entries WHERE batch_no > 0 AND entry_id NOT IN (SELECT entry_id FROM p WHERE batch_no > 0 AND print IN (SELECT print FROM p WHERE batch_no = 0))
""")
def undelivered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of later batches none of whose fingerprints the history holds."""
    entries = table(spark, sf_dir, "feed_entries")
    history = entries.where("batch_no = 0").select(F.explode(U.fingerprints(F.col("url"), F.col("title"))).alias("print"))
    return feeds.undelivered(entries.where("batch_no > 0"), history).select("entry_id")


@query(f"""
    WITH k AS (SELECT entry_id, batch_no, {_sql_url('key')} AS k FROM feed_entries)
    SELECT a.entry_id, b.first_id FROM (SELECT * FROM k WHERE batch_no > 0) a LEFT JOIN (SELECT k, min(entry_id) AS first_id FROM k WHERE batch_no = 0 GROUP BY k) b ON a.k = b.k
""")
def backfilled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later entries with the first historic entry of the same canonical address, null where there is none."""
    keyed = table(spark, sf_dir, "feed_entries").select("entry_id", "batch_no", U.key_url(F.col("url")).alias("k"))
    history = keyed.where("batch_no = 0 and k is not null").groupBy("k").agg(F.min("entry_id").alias("first_id"))
    return keyed.where("batch_no > 0").join(history, "k", "left").select("entry_id", "first_id")


@query(f"""
    WITH w AS (SELECT entry_id, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM (SELECT entry_id, regexp_extract_all(lower(concat_ws(' ', title, summary)), '[a-z][a-z0-9_-]{{2,31}}') AS l FROM feed_entries)),
         c AS (SELECT word, count(*) AS n, min((entry_id, p)) AS first FROM w WHERE word NOT IN {tuple(feeds.STOP_WORDS)} GROUP BY word)
    SELECT word, n, row_number() OVER (ORDER BY n DESC, first) AS place FROM c ORDER BY n DESC, first LIMIT 64
""")
def frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.frequent_words(table(spark, sf_dir, "feed_entries"), "entry_id", ["title", "summary"])


QUERIES, SQL = query.queries, query.sql
