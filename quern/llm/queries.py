"""Queries of the problems with text, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import characters, copies, leakage, mojibake, pieces, stories, tokens
from quern.session import spread_table, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = characters.flagged(spread_table(spark, sf_dir, "report_pages"), "page_id", "text")
    entries = characters.flagged(spread_table(spark, sf_dir, "feed_entries"), "entry_id", "title")
    return pages.select(F.lit("page").alias("record_kind"), "record_id").unionByName(entries.select(F.lit("entry").alias("record_kind"), "record_id"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = characters.clean_texts(spread_table(spark, sf_dir, "report_pages"), "page_id", "text")
    entries = characters.clean_texts(spread_table(spark, sf_dir, "feed_entries"), "entry_id", "title")
    return pages.withColumn("record_kind", F.lit("page")).unionByName(entries.withColumn("record_kind", F.lit("entry")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized(spread_table(spark, sf_dir, "report_pages"), spread_table(spark, sf_dir, "report_tables"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread_table(spark, sf_dir, "report_pages").select("page_id", "text").dropDuplicates(["page_id"])
    grids = spread_table(spark, sf_dir, "report_tables").select("table_id", "table_rows").dropDuplicates(["table_id"])
    return pieces.pieces(pages, grids)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.further_copies(spread_table(spark, sf_dir, "feed_entries"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_counts(spread_table(spark, sf_dir, "feed_entries"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.p7_pairs(spread_table(spark, sf_dir, "feed_entries"))


def p7_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, each later batch taken in by itself."""
    return stories.p7_pairs(spread_table(spark, sf_dir, "feed_entries"), one_by_one=True)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(spread_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their leaked passages."""
    return leakage.cleaned(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(spread_table(spark, sf_dir, "documents"))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore(spread_table(spark, sf_dir, "documents")).where("spans > 0")


QUERIES = {f.__name__: f for f in (p2_found, p2_clean, p3_found, p3_pieces, p5_found, p5_counts, p7_found, p7_batches, p8_ids, p9_found, p9_clean, p10_found, p10_restored)}

_PAGE_STRETCH = "list_max(list_transform(regexp_split_to_array(text, '[。；！？\\r\\n]'), lambda x: length(x)))"
_GRID = "list_transform(table_rows, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | '))"

SQL: dict[str, str] = {
    "p3_found": f"""
        SELECT 'page' AS item_kind, page_id AS item_id, max(CASE WHEN {_PAGE_STRETCH} > 340 THEN 1 ELSE 0 END)::BIGINT AS hard_cut
        FROM report_pages WHERE length(text) > 340 GROUP BY page_id
        UNION ALL
        SELECT 'table', table_id, max(CASE WHEN list_max(list_transform(g, lambda x: length(x))) > 340 THEN 1 ELSE 0 END)::BIGINT
        FROM (SELECT table_id, {_GRID} AS g FROM report_tables) WHERE length(array_to_string(g, chr(10))) > 340 GROUP BY table_id
    """,
    "p9_found": """
        WITH items AS (SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM eval_items),
             grams AS (SELECT DISTINCT item_id, substr(t, k, 50) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 48)) AS k FROM items)),
             docs AS (SELECT doc_id, regexp_replace(lower(translate(text, '０１２３４５６７８９', '0123456789')), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
             windows AS (SELECT doc_id, substr(t, k, 50) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 48)) AS k FROM docs))
        SELECT DISTINCT doc_id, item_id FROM windows JOIN grams USING (g)
    """,
}
