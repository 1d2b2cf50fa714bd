"""Queries of chunking, packing, excerpts, geometry, learning and streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.arrow import map_columns
from quern.operators import chunks as C
from quern.operators import learning as L
from quern.operators import retrieval as R
from quern.plans.base import Registry
from quern.plans.tables import SQL_WINDOWS
from quern.session import spread_table, table
from quern.streaming import jobs

query = Registry()


_TRIM = "regexp_replace(regexp_replace({}, '^[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}]+', ''), '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}]+$', '')"


@query(f"""
    WITH RECURSIVE p AS (SELECT page_id, any_value(text) AS t, length(any_value(text)) AS n FROM report_pages WHERE text IS NOT NULL GROUP BY page_id),
    c AS (
        SELECT page_id, t, n, 0::BIGINT AS low, CASE WHEN n <= 340 THEN n ELSE CASE WHEN regexp_matches(substr(t, 171, 170), '[。；\n]') THEN 170 + length(regexp_extract(substr(t, 171, 170), '^((?s:.*)[。；\n])', 1)) ELSE 340 END END AS high FROM p WHERE n > 0
        UNION ALL
        SELECT page_id, t, n, l, CASE WHEN n <= l + 340 THEN n ELSE CASE WHEN regexp_matches(substr(t, l + 171, 170), '[。；\n]') THEN l + 170 + length(regexp_extract(substr(t, l + 171, 170), '^((?s:.*)[。；\n])', 1)) ELSE l + 340 END END
        FROM (SELECT page_id, t, n, greatest(high - 35, low + 1) AS l FROM c WHERE high < n)
    )
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY low) - 1 AS no, low AS start_at, high AS end_at, part FROM (SELECT *, {_TRIM.format('substr(t, low + 1, high - low)')} AS part FROM c) WHERE part <> ''
""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of distinct pages, with offsets."""
    pages = spread_table(spark, sf_dir, "report_pages").select("page_id", "text").dropDuplicates(["page_id"])
    return C.explode_text(pages, "page_id", "text", C.overlapping())


@query()
def document_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.explode_text(spread_table(spark, sf_dir, "documents"), "doc_id", "text", C.windows())


@query()
def encoder_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lossless spans of documents of at most 480 counted units: ideographs one each, other characters a quarter."""

    def count(text: str) -> int:
        wide = sum("㐀" <= c <= "鿿" for c in text)
        return wide + -(-(len(text) - wide) // 4)

    return C.explode_text(spread_table(spark, sf_dir, "documents"), "doc_id", "text", C.lossless(count, 480))


@query("""
    WITH RECURSIVE t AS (SELECT table_id, any_value(table_rows) AS g, any_value(CASE WHEN coalesce(unit_context, '') <> '' THEN '单位说明：' || unit_context || chr(10) ELSE '' END || '表头：' || array_to_string(list_transform(coalesce(headers, []), lambda h: coalesce(h, '')), ' | ') || chr(10)) AS head FROM report_tables GROUP BY table_id),
    r AS (SELECT table_id, head, rn, array_to_string(list_transform(coalesce(l, []), lambda c: coalesce(c, '')), ' | ') AS line, coalesce(list_sum(list_transform(l, lambda c: length(coalesce(c, '')) + 3)), 0)::BIGINT AS cost FROM (SELECT table_id, head, unnest(g) AS l, generate_subscripts(g, 1) AS rn FROM t)),
    f AS (
        SELECT table_id, head, rn, line, rn AS first, length(head) + cost AS size FROM r WHERE rn = 1
        UNION ALL
        SELECT r.table_id, r.head, r.rn, r.line, CASE WHEN f.size + r.cost > 340 THEN r.rn ELSE f.first END, CASE WHEN f.size + r.cost > 340 THEN length(r.head) + r.cost ELSE f.size + r.cost END FROM f JOIN r ON r.table_id = f.table_id AND r.rn = f.rn + 1
    )
    SELECT table_id, first AS row_start, max(rn) AS row_end, any_value(head) || string_agg(line, chr(10) ORDER BY rn) AS chunk FROM f GROUP BY table_id, first
""")
def packed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = table(spark, sf_dir, "report_tables").select("table_id", "headers", "table_rows", "unit_context").dropDuplicates(["table_id"])
    return C.table_chunks(tables)


@query()
def hit_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each item with an excerpt for it."""
    docs, items = spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    hits = R.ranked(R.bm25(docs, "doc_id", T.tokenize(F.col("text")), items, "item_id", T.tokenize(F.col("text"))), ["item_id"], "doc_id")
    asked = items.select("item_id", T.query_terms(F.col("text")).alias("terms"))
    joined = hits.join(docs.select("doc_id", "text", "source_url" if "source_url" in docs.columns else F.lit(None).cast("string").alias("source_url")), "doc_id").join(asked, "item_id")

    def make():
        def step(batch: dict[str, pa.Array]) -> dict[str, list | pa.Array]:
            cut = [C.excerpt(t or "", terms) for t, terms in zip(batch["text"].to_pylist(), batch["terms"].to_pylist())]
            return {"item_id": batch["item_id"], "doc_id": batch["doc_id"], "rank": batch["rank"], "excerpt": cut}

        return step

    return map_columns(joined.select("item_id", "doc_id", "rank", "text", "terms"), make, "item_id long, doc_id long, rank int, excerpt string")


@query()
def kept_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of each page whose box is not held by a larger one; a page has few tables, so its list is small."""
    per = table(spark, sf_dir, "report_tables").select("page_id", "table_id", "bbox").dropDuplicates(["table_id"])
    pages = per.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("table_id", "bbox"))).alias("boxes"))

    def make():
        def step(batch: dict[str, pa.Array]) -> dict[str, list]:
            out = [(p, boxes[i]["table_id"]) for p, boxes in zip(batch["page_id"].to_pylist(), batch["boxes"].to_pylist()) for i in C.unsuppressed([tuple(b["bbox"] or (0, 0, 0, 0)) for b in boxes])]
            return {"page_id": [p for p, _ in out], "table_id": [t for _, t in out]}

        return step

    return map_columns(pages, make, "page_id string, table_id string")


@query()
def classified_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear classifier applied to all vectors, also those without a label."""
    return classified(table(spark, sf_dir, "embeddings"))


def classified(e: DataFrame) -> DataFrame:
    """(vec_id, label, predicted, held_out) of every vector. Labelled vectors whose id is divisible by five are held out of the fit."""
    fitted = F.col("label").isNotNull() & (F.col("vec_id") % 5 != 0)
    model = L.fit_linear(e.where(fitted), "embedding", "label", "vec_id")
    held_out = F.coalesce(F.col("label").isNotNull() & (F.col("vec_id") % 5 == 0), F.lit(False)).alias("held_out")
    return L.predicted(model, e, "embedding").select("vec_id", "label", F.col("prediction").cast("int").alias("predicted"), held_out)


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a stream with a watermark, run over all that is there."""
    return jobs.hourly_counts(spark, sf_dir)


@query("SELECT user_id, props, arg_min(event_id, (epoch_us(ts), event_id)) AS event_id FROM events GROUP BY user_id, props")
def stream_first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First requests by key, as a streaming aggregate."""
    return jobs.first_requests(spark, sf_dir)


@query("SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type FROM events GROUP BY user_id")
def stream_last_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.last_phases(spark, sf_dir)


@query(SQL_WINDOWS)
def stream_window_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-window limits as a stateful stream."""
    return jobs.window_limits(spark, sf_dir)


QUERIES, SQL = query.queries, query.sql
