"""Queries of joins, aggregates, event state and the platform's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import state as S
from quern.operators import tables as B
from quern.plans.base import Registry
from quern.session import table

query = Registry()

_STARTS = "st AS (SELECT code, report_year, section, min(pdf_page) AS start_page FROM report_pages WHERE section IS NOT NULL GROUP BY ALL)"
_RANGES = f"""{_STARTS}, rg AS (SELECT st.*, coalesce(lead(start_page) OVER (PARTITION BY st.code, st.report_year ORDER BY start_page, section) - 1, page_count) AS end_page
    FROM st LEFT JOIN (SELECT code, report_year, max(page_count) AS page_count FROM report_manifest GROUP BY ALL) m USING (code, report_year))"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, manifest = table(spark, sf_dir, "report_pages"), table(spark, sf_dir, "report_manifest")
    starts = pages.where("section is not null").groupBy("code", "report_year", "section").agg(F.min("pdf_page").alias("start_page"))
    return B.section_ranges(starts, manifest.groupBy("code", "report_year").agg(F.max("page_count").alias("page_count")), ["code", "report_year"])


@query(f"WITH {_RANGES} SELECT code, report_year, section, start_page, end_page FROM rg")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).select("code", "report_year", "section", "start_page", "end_page")


@query(f"""
    WITH {_RANGES} SELECT DISTINCT page_id, coalesce(chapter, '') AS chapter FROM (SELECT page_id, rg.section AS chapter FROM report_pages p LEFT JOIN rg ON p.code = rg.code AND p.report_year = rg.report_year AND pdf_page BETWEEN start_page AND end_page)
""")
def section_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the section in force on it."""
    pages = table(spark, sf_dir, "report_pages").select("page_id", "code", "report_year", "pdf_page")
    return B.as_of_section(pages, _ranges(spark, sf_dir), ["code", "report_year"]).select("page_id", "chapter").distinct()


@query("""
    SELECT fact_id, count(DISTINCT page_id) AS n_pages, count(DISTINCT CASE WHEN contains(text, label) THEN page_id END) AS n_with_label
    FROM fact_checks f JOIN report_pages p ON f.code = p.code AND f.report_year = p.report_year AND f.pdf_page = p.pdf_page GROUP BY fact_id
""")
def facts_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts joined to the pages they are cited from, and whether those name them."""
    f, p = table(spark, sf_dir, "fact_checks").select("fact_id", "label", "code", "report_year", "pdf_page"), table(spark, sf_dir, "report_pages").select("page_id", "text", "code", "report_year", "pdf_page")
    both = f.join(p, ["code", "report_year", "pdf_page"])
    return both.groupBy("fact_id").agg(F.countDistinct("page_id").alias("n_pages"), F.countDistinct(F.when(F.contains("text", "label"), F.col("page_id"))).alias("n_with_label"))


@query("""
    SELECT doc_kind, count(*) AS n, count(text) AS n_text, count(lang) AS n_lang, count(DISTINCT text) AS n_distinct, round(count(lang) / count(*), 6) AS lang_rate, min(n_chars) AS least, median(n_chars) AS middle, max(n_chars) AS most FROM documents GROUP BY doc_kind
""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("doc_kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("text").alias("n_text"), F.count("lang").alias("n_lang"), F.countDistinct("text").alias("n_distinct"), F.round(F.count("lang") / F.count(F.lit(1)), 6).alias("lang_rate"),
        F.min("n_chars").alias("least"), F.median("n_chars").alias("middle"), F.max("n_chars").alias("most"),
    )


_STATUS = "CASE WHEN coalesce(trim(text), '') = '' THEN 'missing' WHEN lang IS NULL THEN 'partial' ELSE 'complete' END"


@query(f"""
    SELECT source, count(*) FILTER (s = 'complete') AS complete, count(*) FILTER (s = 'partial') AS partial, count(*) FILTER (s = 'missing') AS missing, CASE WHEN bool_and(s = 'complete') THEN 'complete' WHEN bool_and(s = 'missing') THEN 'missing' ELSE 'partial' END AS status
    FROM (SELECT source, {_STATUS} AS s FROM documents) GROUP BY source
""")
def review_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued roll-up of document states by source, with zero-filled counts."""
    s = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "missing").when(F.col("lang").isNull(), "partial").otherwise("complete")
    d = table(spark, sf_dir, "documents").select("source", s.alias("s"))
    return d.groupBy("source").agg(*(F.count_if(F.col("s") == v).alias(v) for v in ("complete", "partial", "missing")), B.roll_up(F.col("s")).alias("status"))


@query("SELECT count(*) AS n_reports, sum(page_count)::BIGINT AS pages, sum(chunk_count)::BIGINT AS chunks, sum(table_count)::BIGINT AS tables FROM report_manifest")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "report_manifest").agg(F.count(F.lit(1)).alias("n_reports"), F.sum("page_count").alias("pages"), F.sum("chunk_count").alias("chunks"), F.sum("table_count").alias("tables"))


@query("SELECT e.key AS method, sum(e.value)::BIGINT AS total FROM (SELECT unnest(map_entries(table_methods)) AS e FROM report_manifest) GROUP BY e.key")
def method_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.summed_map(table(spark, sf_dir, "report_manifest"), "table_methods").withColumnRenamed("key", "method")


@query("SELECT code, report_year, source_url FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY coalesce(publication_date, DATE '0001-01-01') DESC, source_url DESC) AS r FROM report_manifest) WHERE r = 1")
def latest_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.latest_edition(table(spark, sf_dir, "report_manifest"), "code", "publication_date", "source_url").select("code", "report_year", "source_url")


@query("SELECT m.code, count(DISTINCT page_id) AS n_pages, count(page_id) > 0 AS covered FROM (SELECT DISTINCT code FROM report_manifest) m LEFT JOIN report_pages p ON m.code = p.code AND p.text LIKE '%不良贷款率%' GROUP BY m.code")
def covered_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with the pages that mention a term; those without one stay."""
    codes = table(spark, sf_dir, "report_manifest").select("code").distinct()
    hits = table(spark, sf_dir, "report_pages").where(F.contains("text", F.lit("不良贷款率"))).select("code", "page_id").distinct()
    return codes.join(hits, "code", "left").groupBy("code").agg(F.count("page_id").alias("n_pages"), (F.count("page_id") > 0).alias("covered"))


@query("SELECT code, company FROM (SELECT code, company, row_number() OVER (PARTITION BY company ORDER BY report_year, code) AS r FROM report_manifest) WHERE r = 1")
def first_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "report_manifest")
    return m.groupBy("company").agg(F.min_by("code", F.struct("report_year", "code")).alias("code")).select("code", "company")


@query("""
    SELECT a.code, a.report_year, round(len(list_intersect(a.k, b.k)) / len(list_distinct(a.k || b.k)), 6) AS similarity FROM (SELECT code, report_year, map_keys(table_methods) AS k FROM report_manifest) a JOIN (SELECT code, report_year + 1 AS report_year, map_keys(table_methods) AS k FROM report_manifest) b USING (code, report_year)
""")
def method_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of a report's methods with those of the year before."""
    m = table(spark, sf_dir, "report_manifest").select("code", "report_year", F.map_keys("table_methods").alias("k"))
    before = m.select("code", (F.col("report_year") + 1).alias("report_year"), F.col("k").alias("k0"))
    return m.join(before, ["code", "report_year"]).select("code", "report_year", F.round(B.jaccard(F.col("k"), F.col("k0")), 6).alias("similarity"))


@query("SELECT code FROM report_manifest EXCEPT SELECT code FROM fact_checks")
def companies_without_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "report_manifest").select("code").distinct().join(table(spark, sf_dir, "fact_checks").select("code").distinct(), "code", "left_anti")


# Events: user_id is the key, ts the clock, ties by event_id.
@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS per_user FROM events WHERE event_type = 'signup'")
def rolling_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    signups = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return S.rolling_counts(signups, ["user_id"]).select("event_id", F.col("n_in_span").alias("per_user"))


#: Windows by going through each key's events in time order.
SQL_WINDOWS = """
    WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    w AS (
        SELECT event_id, user_id, t AS start, rn, 1::BIGINT AS nth FROM e WHERE rn = 1
        UNION ALL
        SELECT e.event_id, e.user_id, CASE WHEN e.t - w.start >= 900000000 THEN e.t ELSE w.start END, e.rn, CASE WHEN e.t - w.start >= 900000000 THEN 1 ELSE w.nth + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1
    )
    SELECT event_id, user_id, start AS window_start_us, nth, nth <= 5 AS allowed FROM w
"""


@query(SQL_WINDOWS)
def fixed_window_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fixed_windows(table(spark, sf_dir, "events"))


@query("SELECT user_id, max(epoch_us(ts)) AS last_seen_us, (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) <= 90000000 AS online FROM events WHERE event_type = 'view' GROUP BY user_id")
def workers_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.online(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "view")


@query("SELECT user_id, props, arg_min(event_id, (epoch_us(ts), event_id)) AS event_id, count(*) AS n_requests FROM events GROUP BY user_id, props")
def first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_of_request(table(spark, sf_dir, "events"), ["user_id", "props"])


@query("SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type, max(epoch_us(ts)) AS at_us FROM events GROUP BY user_id")
def last_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_state(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""
    WITH n AS (SELECT *, min(CASE WHEN event_type = 'view' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM events)
    SELECT event_id, user_id, epoch_us(ts) AS at_us FROM n WHERE event_type = 'signup' AND (nx IS NULL OR nx - epoch_us(ts) > 900000000)
""")
def expired_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.expired(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "signup", F.col("event_type") == "view")


@query("SELECT user_id, event_id, r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r <= 20")
def history_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest entries of each key."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.row_number().over(w).alias("r")).where("r <= 20")


@query("SELECT event_type, count(*) AS n, max(epoch_us(ts)) AS latest_us, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(S.micros()).alias("latest_us"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT event_id, epoch_us(date_trunc('day', ts + INTERVAL 8 HOUR) + CASE WHEN ts + INTERVAL 8 HOUR >= date_trunc('day', ts + INTERVAL 8 HOUR) + INTERVAL 9 HOUR THEN INTERVAL 33 HOUR ELSE INTERVAL 9 HOUR END - INTERVAL 8 HOUR) AS next_run_us FROM events")
def next_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 09:00 at UTC+8 strictly after each event."""
    local = F.col("ts") + F.expr("interval 8 hours")
    day = F.date_trunc("day", local.cast("timestamp"))
    at = F.when(local.cast("timestamp") >= day + F.expr("interval 9 hours"), day + F.expr("interval 33 hours")).otherwise(day + F.expr("interval 9 hours"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(at - F.expr("interval 8 hours")).alias("next_run_us"))


@query("SELECT strftime(fetched_at AT TIME ZONE 'UTC' + INTERVAL 8 HOUR, '%Y-%m-%d') AS day_key, count(*) AS n FROM feed_entries GROUP BY ALL")
def daily_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by calendar day at UTC+8."""
    day = F.date_format(F.from_utc_timestamp("fetched_at", "+08:00"), "yyyy-MM-dd")
    return table(spark, sf_dir, "feed_entries").groupBy(day.alias("day_key")).agg(F.count(F.lit(1)).alias("n"))


# What the platform brings by itself, on the star schema.
@query("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""
    SELECT n_name, r_name, round(sum(o_totalprice), 2) AS total, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
""")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed by customer before the joins, so only one row a customer is shuffled."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"), F.count(F.lit(1)).alias("k"))
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == r["r_regionkey"])
    return joined.groupBy("n_name", "r_name").agg(F.round(F.sum("t"), 2).alias("total"), F.sum("k").alias("n_orders"))


@query("SELECT c_mktsegment, o_orderstatus, count(*) AS n, grouping(c_mktsegment) AS all_segments, grouping(o_orderstatus) AS all_states FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def order_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).rollup("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("c_mktsegment").cast("long").alias("all_segments"), F.grouping("o_orderstatus").cast("long").alias("all_states"))


@query("SELECT event_id, lag(event_type) OVER w AS before, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"))


QUERIES, SQL = query.queries, query.sql
