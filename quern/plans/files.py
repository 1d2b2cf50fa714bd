"""Queries of readers and writers: test tables written as files of the shared folder and read back by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.base import Registry
from quern.session import scratch_path, table
from quern.sources import readers, writers

query = Registry()


@query("SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines appended in two goes and read with a strict schema and unique ids."""
    path = scratch_path(spark, "lines")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    for part in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0")):
        writers.append_events(part, path)
    return readers.read_json_lines(spark, path, "doc_id long, text string, lang string, n_chars long", "doc_id").select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


@query("SELECT code, report_year, title, count(*) OVER (PARTITION BY code) AS n_in_file FROM report_manifest")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with an array for each company, with the digest of its content."""
    path = scratch_path(spark, "arrays")
    arrays = table(spark, sf_dir, "report_manifest").groupBy("code").agg(F.to_json(F.collect_list(F.struct("code", "report_year", "title"))).alias("value"))
    arrays.write.partitionBy("code").text(path)
    rows = readers.read_json_array(spark, f"{path}/*/*.txt", "code string, report_year int, title string")
    n = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_in_file"))
    return rows.join(n, "sha256").select("code", "report_year", "title", "n_in_file")


def _xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


@query("""
    SELECT n_nationkey AS feed, c_name AS title, 'https://feeds.example/' || c_custkey || '?a=1&b=2' AS url, '2024-01-0' || (1 + c_custkey % 9)::VARCHAR || 'T00:00:00Z' AS published, NULL::VARCHAR AS error FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 0
    UNION ALL SELECT n_nationkey, NULL, NULL, NULL, 'document type or NUL' FROM nation WHERE n_nationkey % 5 = 0
""")
def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each nation: RSS or Atom; those with a document type are refused with a status row."""
    path = scratch_path(spark, "feeds")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    link, day = F.concat(F.lit("https://feeds.example/"), "c_custkey", F.lit("?a=1&b=2")), F.concat(F.lit("2024-01-0"), 1 + F.col("c_custkey") % 9, F.lit("T00:00:00Z"))
    rss = F.concat(F.lit("<item><title>"), _xml(F.col("c_name")), F.lit("</title><link>"), _xml(link), F.lit("</link><pubDate>"), day, F.lit("</pubDate></item>"))
    atom = F.concat(F.lit('<entry><title>'), _xml(F.col("c_name")), F.lit('</title><link rel="alternate" href="'), _xml(link), F.lit('"/><published>'), day, F.lit("</published></entry>"))
    per = rows.groupBy("n_nationkey", "n_name").agg(F.array_join(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, rss).otherwise(atom)), "").alias("body"))
    every = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(per.select("n_nationkey", "body"), "n_nationkey", "left").withColumn("body", F.coalesce("body", F.lit("")))
    refused = F.when(F.col("n_nationkey") % 5 == 0, "<!DOCTYPE rss>").otherwise("")
    whole = F.when(F.col("n_nationkey") % 2 == 0, F.concat(refused, F.lit("<rss><channel>"), "body", F.lit("</channel></rss>"))).otherwise(F.concat(refused, F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "body", F.lit("</feed>")))
    every.select(F.col("n_nationkey").alias("feed"), whole.alias("value")).write.partitionBy("feed").text(path)
    found = readers.read_feeds(spark, f"{path}/*/*.txt")
    return found.select(F.regexp_extract("path", r"feed=([^/]+)/", 1).cast("long").alias("feed"), "title", "url", "published", F.regexp_replace("error", "^ValueError: ", "").alias("error"))


@query("SELECT 200 + event_id % 3 AS status, count(*) AS n, round(sum(value), 4) AS total_ms, count(value) AS n_timed FROM events WHERE event_type <> 'error' GROUP BY ALL")
def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of calls by status; other lines are skipped."""
    path = scratch_path(spark, "log")
    e = table(spark, sf_dir, "events")
    told = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" POST /judge status="), (200 + F.col("event_id") % 3).cast("string"), F.coalesce(F.concat(F.lit(" duration_ms="), F.col("value").cast("string")), F.lit("")))
    e.select(F.when(F.col("event_type") != "error", told).otherwise("started without a call").alias("value")).write.text(path)
    log = readers.read_call_log(spark, path)
    return log.groupBy(F.col("status").cast("long").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_ms"), 4).alias("total_ms"), F.count("duration_ms").alias("n_timed"))


@query("SELECT event_type AS phase, count(*) AS n, max(event_id::VARCHAR) AS last FROM events WHERE event_type IN ('view', 'purchase') GROUP BY event_type")
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines of known phases."""
    path = scratch_path(spark, "events")
    e = table(spark, sf_dir, "events")
    writers.append_events(e.select(F.col("ts").cast("string").alias("time"), F.col("event_type").alias("phase"), F.col("event_id").cast("string").alias("message")), path)
    return readers.read_run_events(spark, path, ("view", "purchase")).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.max("message").alias("last"))


@query("SELECT n_name AS id, 'sent' AS status FROM nation WHERE n_nationkey % 4 <> 0 ORDER BY n_name DESC LIMIT 10")
def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten status files by name; damaged ones are skipped."""
    path = scratch_path(spark, "statuses")
    n = table(spark, sf_dir, "nation")
    good = F.to_json(F.struct(F.col("n_name").alias("id"), F.lit("sent").alias("status")))
    n.select(F.replace("n_name", F.lit(" "), F.lit("_")).alias("run"), F.when(F.col("n_nationkey") % 4 == 0, F.lit('{"id": "x')).otherwise(good).alias("value")).write.partitionBy("run").text(path)
    return readers.read_run_statuses(spark, f"{path}/*/*.txt", 10).select("id", "status")


@query("SELECT r_name, length('%PDF-1.7 ' || r_name) + 1 AS length FROM region WHERE r_regionkey % 2 = 0")
def files_with_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that begin as documents of one format do."""
    path = scratch_path(spark, "magic")
    r = table(spark, sf_dir, "region")
    r.select("r_name", F.concat(F.when(F.col("r_regionkey") % 2 == 0, "%PDF-1.7 ").otherwise("<html>"), "r_name").alias("value")).write.partitionBy("r_name").text(path)
    found = readers.read_with_magic(spark, f"{path}/*/*.txt", b"%PDF")
    return found.select(F.replace(F.regexp_extract("path", r"r_name=([^/]+)/", 1), F.lit("%20"), F.lit(" ")).alias("r_name"), "length")


@query("SELECT vec_id AS id, len(embedding) AS dimension, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, (SELECT count(*) FROM embeddings) AS n FROM embeddings")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the number that the table beside them tells."""
    path = scratch_path(spark, "vectors")
    writers.write_vectors(table(spark, sf_dir, "embeddings"), path, "vec_id", "embedding")
    meta = spark.read.schema("n long, dimension int").json(f"{path}/meta")
    rows = spark.read.parquet(f"{path}/vectors").crossJoin(F.broadcast(meta.select("n")))
    return rows.select("id", F.size("vector").cast("long").alias("dimension"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), "n")


@query("SELECT 'failed' AS status, count(*) AS n FROM orders")
def status_of_failed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed run replaces the old status and leaves the old rows."""
    path = scratch_path(spark, "run")
    rows, status = table(spark, sf_dir, "orders").select("o_orderkey"), spark.range(1)
    writers.write_status_then(path, status.select(F.lit("ok").alias("status")), rows, False)
    try:
        writers.write_status_then(path, status.select(F.lit("failed").alias("status")), rows.limit(0), True)
    except RuntimeError:
        pass
    n = spark.read.parquet(f"{path}/rows").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.schema("status string").json(f"{path}/status").crossJoin(F.broadcast(n))


@query("""
    SELECT n_regionkey AS region, '<ul>' || string_agg(CASE WHEN n_nationkey % 3 = 0 THEN '<li>' || t || '</li>' ELSE '<li><a href="https://n.example/' || n_nationkey || '?a&amp;b">' || t || '</a></li>' END, '' ORDER BY n_nationkey) || '</ul>' AS html
    FROM (SELECT *, replace(n_name, 'A', '&lt;A&gt;') AS t FROM nation) GROUP BY n_regionkey
""")
def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An escaped list for each region; only safe addresses are linked."""
    n = table(spark, sf_dir, "nation")
    url = F.when(F.col("n_nationkey") % 3 == 0, "http://n.example/").otherwise(F.concat(F.lit("https://n.example/"), "n_nationkey", F.lit("?a&b")))
    items = n.select(F.col("n_regionkey").alias("region"), F.replace("n_name", F.lit("A"), F.lit("<A>")).alias("title"), url.alias("url"), "n_nationkey")
    return writers.brief_html(items, "region", "n_nationkey")


QUERIES, SQL = query.queries, query.sql
