"""Queries of small column functions: instants and keys as text, titles, preferences, counts with fixed keys, retention, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import small as H
from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import dedup, state
from quern.plans.base import Registry
from quern.plans.retrieval import retrieval_metrics
from quern.plans.texts import _sql_url, sql_fold
from quern.session import table

query = Registry()


@query("SELECT doc_id, CASE WHEN epoch_us(fetched_at) % 1000000 = 0 THEN strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') END AS iso FROM documents WHERE fetched_at IS NOT NULL")
def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("fetched_at is not null").select("doc_id", H.iso_instant(F.col("fetched_at")).alias("iso"))


@query("SELECT c_custkey, sha256(lower(trim(c_name)) || '@mail.example') AS recipient_key, left(sha256(lower(trim(c_name)) || '@mail.example'), 32) AS digest FROM customer")
def recipient_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of mailboxes made of customers' names: the digest of the normal mailbox, and its short form."""
    box = F.concat(F.trim(F.regexp_replace("c_name", "#", "#")), F.lit("@Mail.example"))
    return table(spark, sf_dir, "customer").select("c_custkey", H.recipient_key(box).alias("recipient_key"), H.short_digest(H.normal_mailbox(box)).alias("digest"))


@query("""
    SELECT entry_id, CASE WHEN n BETWEEN 5 AND 20 THEN n ELSE 12 END AS item_count, left(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')), 200) AS keywords FROM (SELECT entry_id, title, entry_id % 30 AS n FROM feed_entries)
""")
def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of items and keywords, with their defaults where they are out of bounds or missing."""
    return table(spark, sf_dir, "feed_entries").select("entry_id", H.item_count(F.col("entry_id") % 30).alias("item_count"), H.keywords(F.col("title")).alias("keywords"))


@query("""
    SELECT page_id, md5(left(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> '')[1:3], ' '), 180)) AS heading FROM (SELECT DISTINCT page_id, text FROM report_pages WHERE text IS NOT NULL)
""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of a page's heading: its first three lines that are not blank, 180 characters at most."""
    pages = table(spark, sf_dir, "report_pages").where("text is not null").select("page_id", "text").distinct()
    return pages.select("page_id", F.md5(H.heading(F.col("text"))).alias("heading"))


@query("SELECT table_id, array_to_string(list_transform(range(1, len(headers) + 1), lambda i: CASE WHEN trim(coalesce(headers[i], '')) = '' THEN '列 ' || i::VARCHAR ELSE headers[i] END), '|') AS headers, regexp_replace(unit_context, '^\\s*单位(说明)?\\s*[:：]\\s*', '') AS unit FROM (SELECT DISTINCT table_id, headers, unit_context FROM report_tables)")
def shown_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as shown (empty ones numbered) and unit notes without their prefix."""
    t = table(spark, sf_dir, "report_tables").select("table_id", "headers", "unit_context").distinct()
    return t.select("table_id", F.array_join(H.shown_headers(F.col("headers")), "|").alias("headers"), H.unit_text(F.col("unit_context")).alias("unit"))


@query("SELECT item_id, replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(10), ' ') AS cell FROM eval_items")
def escaped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", H.markdown_cell(F.col("text")).alias("cell"))


_STATUS = "CASE WHEN coalesce(trim(text), '') = '' THEN 'missing' WHEN lang IS NULL THEN 'partial' ELSE 'complete' END"


@query(f"SELECT doc_kind, count(*) FILTER (s = 'complete') AS complete, count(*) FILTER (s = 'partial') AS partial, count(*) FILTER (s = 'missing') AS missing, count(*) FILTER (s = 'complete')::VARCHAR || '/' || count(*) FILTER (s = 'partial')::VARCHAR || '/' || count(*) FILTER (s = 'missing')::VARCHAR AS shown FROM (SELECT doc_kind, {_STATUS} AS s FROM documents) GROUP BY doc_kind")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of three states with fixed keys, zero where there is none, and as one string."""
    s = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "missing").when(F.col("lang").isNull(), "partial").otherwise("complete")
    counted = H.fixed_counts(table(spark, sf_dir, "documents").select("doc_kind", s.alias("s")), ["doc_kind"], "s", ["complete", "partial", "missing"])
    return counted.withColumn("shown", F.concat_ws("/", "complete", "partial", "missing"))


@query("""
    WITH c AS (SELECT max(epoch_us(ts)) AS now FROM events), r AS (SELECT event_id, event_type, epoch_us(ts) AS at, row_number() OVER (PARTITION BY event_type = 'purchase' ORDER BY ts DESC, event_id DESC) AS nth FROM events, c WHERE epoch_us(ts) > now - 86400000000)
    SELECT event_id FROM r WHERE event_type = 'purchase' OR nth <= 200
""")
def retained_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the last day: all of one kind (purchases), of the others the newest 200."""
    return H.retained(table(spark, sf_dir, "events"), F.col("event_type") == "purchase").select("event_id")


@query("""
    SELECT event_id, CASE WHEN event_id = first_id THEN 'new' WHEN event_type = first_type THEN 'same' ELSE 'conflict' END AS outcome
    FROM (SELECT *, first_value(event_id) OVER w AS first_id, first_value(event_type) OVER w AS first_type FROM events WINDOW w AS (PARTITION BY user_id, props ORDER BY epoch_us(ts), event_id))
""")
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by key: the first is new, a later one with the same content is the same, with another a conflict."""
    return H.outcomes(table(spark, sf_dir, "events"), ["user_id", "props"], "event_type").select("event_id", "outcome")


@query("SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS latest, bool_or(event_type = 'purchase') AS ever FROM events GROUP BY user_id")
def sticky_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each key, with a flag that stays once it was set."""
    last = state.last_state(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", F.col("event_type").alias("latest"))
    ever = table(spark, sf_dir, "events").groupBy("user_id").agg(F.some(F.col("event_type") == "purchase").alias("ever"))
    return last.join(ever, "user_id")


@query("SELECT source_id, count(*) AS n, coalesce(max(region_hint), '?') AS region, CASE WHEN count(DISTINCT u) >= 10 THEN 'enough' ELSE 'too few' END AS gate FROM (SELECT source_id, url AS u FROM feed_entries) JOIN feed_sources USING (source_id) GROUP BY source_id")
def candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by source, its region, and whether it has ten distinct addresses."""
    joined = table(spark, sf_dir, "feed_entries").join(F.broadcast(table(spark, sf_dir, "feed_sources").select("source_id", "region_hint")), "source_id")
    return joined.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("region_hint"), F.lit("?")).alias("region"), F.when(F.countDistinct("url") >= 10, "enough").otherwise("too few").alias("gate"))


@query("""
    WITH l AS (SELECT entry_id, url, batch_no FROM feed_entries WHERE batch_no = 10), h AS (SELECT DISTINCT url FROM feed_entries WHERE batch_no < 10)
    SELECT entry_id, h.url IS NOT NULL AS is_known FROM l LEFT JOIN h USING (url)
""")
def referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each entry of the last batch whether an earlier one has its address."""
    entries = table(spark, sf_dir, "feed_entries")
    return H.referenced(entries.where("batch_no = 10").select("entry_id", "url"), entries.where("batch_no < 10"), "url").select("entry_id", "is_known")


@query("SELECT code, coalesce(max(m.chunk_count), sum(p.n))::BIGINT AS total FROM (SELECT code, sum(chunk_count)::BIGINT AS chunk_count FROM report_manifest GROUP BY code) m FULL JOIN (SELECT code, count(DISTINCT page_id) AS n FROM report_pages GROUP BY code) p USING (code) GROUP BY code")
def totals_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest tells, or else what is counted."""
    told = table(spark, sf_dir, "report_manifest").groupBy("code").agg(F.sum("chunk_count").alias("told"))
    counted = table(spark, sf_dir, "report_pages").groupBy("code").agg(F.countDistinct("page_id").alias("counted"))
    return told.join(counted, "code", "full").select("code", F.coalesce("told", "counted").alias("total"))


@query(None)
def metric_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The macro average of the retrieval metrics, as numbers and as shown."""
    m = retrieval_metrics(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("reciprocal_rank"))
    return m.withColumns({"recall_shown": H.shown_share(F.col("recall")), "reciprocal_shown": H.shown_rank(F.col("reciprocal_rank"))})


query.sql["metric_averages"] = f"""
    SELECT n, recall, reciprocal_rank, format('{{:.1f}}%', recall * 100) AS recall_shown, format('{{:.3f}}', reciprocal_rank) AS reciprocal_shown
    FROM (SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM ({__import__('quern.plans.retrieval', fromlist=['SQL']).SQL['retrieval_metrics']}))
"""


@query("SELECT entry_id, CASE WHEN regexp_matches(published, '^\\s*[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]+)?)?\\s*(Z|[+-][0-9]{2}:?[0-9]{2})\\s*$') THEN epoch_us(try_cast(regexp_replace(regexp_replace(trim(published), '\\s+([Z+-])', '\\1'), '([+-][0-9]{2})([0-9]{2})$', '\\1:\\2') AS TIMESTAMPTZ)) END AS at_us FROM feed_entries")
def strict_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of ISO texts that name their zone; null for others."""
    return table(spark, sf_dir, "feed_entries").select("entry_id", F.unix_micros(H.strict_instant(F.col("published"))).alias("at_us"))


@query(f"""
    SELECT entry_id, CASE WHEN regexp_matches(lower(title), '{T.PRIVATE}') OR t = '' THEN 'Entry ' || entry_id ELSE t END AS shown
    FROM (SELECT entry_id, title, left(trim(regexp_replace(coalesce(title, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')), 200) AS t FROM feed_entries)
""".replace("OR t = ''", "IS TRUE OR t = ''").replace("WHEN regexp", "WHEN (regexp").replace("IS TRUE", ") IS TRUE"))
def safe_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feed_entries").select("entry_id", H.safe_title(F.col("title"), F.concat(F.lit("Entry "), "entry_id"), T.is_private(F.col("title"))).alias("shown"))


@query("SELECT code, '## ' || code || chr(10) || chr(10) || string_agg('- ' || report_year || ' ' || replace(replace(title, '\\', '\\\\'), '|', '\\|'), chr(10) ORDER BY report_year) AS record FROM report_manifest GROUP BY code")
def markdown_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown section for each company with its reports."""
    return H.markdown_record(table(spark, sf_dir, "report_manifest"), "code", "report_year", F.concat(F.col("report_year").cast("string"), F.lit(" "), H.markdown_cell(F.col("title"))))


@query("""
    WITH x AS (SELECT label, (1 + vec_id % 3) * unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), s AS (SELECT label, p, sum(x) AS x FROM x GROUP BY ALL), n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS norm FROM s)
    SELECT label, array_to_string(list(format('{:.5f}', x / norm + 0.0) ORDER BY p), ' ') AS vector FROM n GROUP BY label
""")
def mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted mean vector of each label, as text with five places."""
    means = H.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding", 1 + F.col("vec_id") % 3)
    return means.select("label", F.array_join(F.transform("vector", lambda x: F.format_string("%.5f", x)), " ").alias("vector"))


@query("SELECT (SELECT count(*) FROM report_manifest) AS n_a, (SELECT count(*) FROM report_manifest WHERE report_year > 2022) AS n_b, (SELECT count(*) FROM report_manifest WHERE report_year <= 2022) AS only_a, 0::BIGINT AS only_b")
def rebuilt_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against a part of it: what each has that the other has not, repetitions counted."""
    m = table(spark, sf_dir, "report_manifest").select("code", "report_year", "title", "source_url")
    return H.differences(m, m.where("report_year > 2022"))


_BATCH_PRINTS = f"list_filter([sha256('url:' || ({_sql_url('ledger')})), sha256('title:' || regexp_replace(lower({sql_fold('title')}), '[^\\p{{L}}\\p{{N}}]', '', 'g'))], lambda x: x IS NOT NULL)"


@query(f"""
    WITH RECURSIVE e AS (SELECT entry_id, batch_no AS s, {_BATCH_PRINTS} AS ks, row_number() OVER (PARTITION BY batch_no ORDER BY entry_id) AS rn FROM feed_entries),
    g AS (
        SELECT entry_id, s, rn, true AS kept, ks AS seen FROM e WHERE rn = 1
        UNION ALL
        SELECT e.entry_id, e.s, e.rn, NOT list_has_any(g.seen, e.ks), CASE WHEN list_has_any(g.seen, e.ks) THEN g.seen ELSE g.seen || e.ks END FROM g JOIN e ON e.s = g.s AND e.rn = g.rn + 1
    )
    SELECT entry_id FROM g WHERE kept
""")
def first_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries kept batch by batch in order, each without a fingerprint that one kept before it has."""
    entries = table(spark, sf_dir, "feed_entries")
    keys = F.transform(U.fingerprints(F.col("url"), F.col("title")), lambda p: F.concat(F.col("batch_no").cast("string"), F.lit(":"), p))
    return dedup.greedy_first(entries, "entry_id", F.col("batch_no"), keys)


QUERIES, SQL = query.queries, query.sql
