"""Queries of the general problems 1, 4 and 6, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import nested, timestamps, units
from quern.session import spread_table, table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.declared(table(spark, sf_dir, "fact_checks"), spread_table(spark, sf_dir, "report_tables")).drop("declared")


def p1_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures without a printed unit beside figures that have one, in the unit the series' level speaks for."""
    found = units.figures(table(spark, sf_dir, "fact_checks"), spread_table(spark, sf_dir, "report_tables"))
    return found.where("not declared").drop("declared")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalised(table(spark, sf_dir, "feed_entries"), table(spark, sf_dir, "feed_sources"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.wanted_leaves(spread_table(spark, sf_dir, "json_records"))


def p6_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.merged_schema(spread_table(spark, sf_dir, "json_records"))


def p6_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flat tables in one: a row per element, with its parent's key, ordinal and number of columns."""
    rows = nested.exploded(spread_table(spark, sf_dir, "json_records"))
    return rows.select("record_id", "table_path", "row_key", "parent_key", "ordinal", F.size("columns").alias("n_columns"))


def p6_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables the merged schema asks for, with the table each hangs on."""
    return nested.table_levels(written(nested.merged_schema(spread_table(spark, sf_dir, "json_records")), "schema"))


def p6_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed companies with their status, linked to their question and record."""
    return companies(spread_table(spark, sf_dir, "json_records"))


def companies(records: DataFrame) -> DataFrame:
    """statuses holds every status of the element by its path within it, also those that have no column of their own; elements of
    arrays or maps further down that hold one are rows too, found by their table_path."""
    rows = nested.exploded(records, wanted={"manual-review": r"/companies/(?:\[\]|\*)/(?:(?:company|code|reason)$|(?:.*/)?status$)"})
    places = rows.where(F.col("table_path").rlike(r"/companies/(\[\]|\*)(/|$)"))
    columns = {"company": "/company", "code": "/code", "status": "/status", "reason": "/reason", "retrieval_status": "/retrieval/status", "answer_status": "/answer/status"}
    statuses = F.map_filter("columns", lambda k, _: k.endswith("/status")).alias("statuses")
    return places.select("record_id", "table_path", "row_key", "parent_key", "ordinal", *(F.col("columns").getItem(path).alias(c) for c, path in columns.items()), statuses)


def _levels(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The tables of one kind of record, exploded once and stored by level."""
    return written(nested.exploded(spread_table(spark, sf_dir, "json_records").where(F.col("record_kind") == kind)), "levels")


def _ending(name: str) -> Column:
    """The first column of a row whose path ends with the name."""
    found = F.map_filter("columns", lambda k, _: k.endswith(f"/{name}"))
    return F.get(F.map_values(found), F.lit(0)).alias(name)


def p6_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold evidence (a table of its own) with its code, page and unit, joined to the question it belongs to (the table above)."""
    rows = _levels(spark, sf_dir, "questions")
    evidence = rows.where(F.col("table_path").rlike(r"/goldEvidence/(\[\]|\*)$"))
    above = rows.select(F.col("row_key").alias("parent_key"), F.col("table_path").alias("parent_table"), F.col("columns").getItem("/id").alias("question_id"))
    told = evidence.select("record_id", "row_key", "parent_key", "ordinal", *map(_ending, ("code", "pdfPage", "unit")))
    return told.join(above, "parent_key").select("record_id", "row_key", "parent_key", "parent_table", "ordinal", "question_id", "code", "pdfPage", "unit")


def p6_evidence_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of gold evidence, each joined to its evidence by the parent's key."""
    rows = _levels(spark, sf_dir, "questions")
    values = rows.where(F.col("table_path").rlike(r"/goldEvidence/.*values/\[\]$")).select("record_id", "row_key", "parent_key", "ordinal", F.explode("columns").alias("column", "value"))
    above = rows.select(F.col("row_key").alias("parent_key"), F.col("table_path").alias("parent_table"), F.col("ordinal").alias("evidence_no"))
    return values.join(above, "parent_key").select("record_id", "row_key", "parent_key", "parent_table", "evidence_no", "ordinal", "column", "value")


def p6_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with their table-method counts, one row a method, under the key of the report's row."""
    rows = nested.exploded(spread_table(spark, sf_dir, "json_records"), wanted={"manifest": nested.WANTED["manifest"]})
    return rows.select("record_id", "table_path", "row_key", "parent_key", "ordinal", F.explode("columns").alias("column", "n_tables"))


QUERIES = {f.__name__: f for f in (p1_found, p1_inferred, p4_found, p6_found, p6_schema, p6_levels, p6_tables, p6_companies, p6_evidence, p6_evidence_values, p6_methods)}
SQL: dict[str, str] = {
    "p6_found": """
        WITH RECURSIVE enc AS (
          SELECT record_id, record_kind, ltrim(body, chr(65279)) AS b FROM json_records WHERE body IS NOT NULL
          UNION ALL
          SELECT record_id, record_kind, ltrim(CAST(b AS JSON) ->> '$', chr(65279)) FROM enc WHERE json_valid(b) AND json_type(b) = 'VARCHAR'
        ),
        t AS (
          SELECT record_id, record_kind, '' AS p, CAST(b AS JSON) AS j FROM enc WHERE json_valid(b) AND json_type(b) IN ('OBJECT', 'ARRAY')
          UNION ALL
          SELECT record_id, record_kind, p || '/' || replace(replace(e.key, '~', '~0'), '/', '~1'), e.value FROM t, json_each(t.j) AS e WHERE json_type(t.j) IN ('OBJECT', 'ARRAY')
        )
        SELECT record_id, p AS leaf_path, CASE WHEN json_type(j) = 'VARCHAR' THEN j ->> '$' ELSE j::VARCHAR END AS leaf_value FROM t
        WHERE json_type(j) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND CASE record_kind
          WHEN 'manual-review' THEN regexp_matches(p, '/companies/(.*/)?status$')
          WHEN 'questions' THEN regexp_matches(p, '/goldEvidence/(.*/)?values(/|$)')
          WHEN 'manifest' THEN regexp_matches(p, '/tableMethods(/|$)') ELSE false END
    """
}
