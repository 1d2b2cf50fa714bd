"""Joins and aggregates over report tables: sections by page, totals, roll-ups, editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import is_small


def section_ranges(starts: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section, start_page, end_page): a section ends before the next one starts, the last with the report."""
    w = Window.partitionBy(*keys).orderBy("start_page", "section")
    nxt = F.lead("start_page").over(w) - 1
    ranged = starts.join(counts, keys, "left").withColumn("end_page", F.coalesce(nxt, F.col("page_count")))
    return ranged.select(*keys, "section", "start_page", "end_page")


def as_of_section(pages: DataFrame, ranges: DataFrame, keys: list[str], page: str = "pdf_page", sentinel: str = "") -> DataFrame:
    """Pages with the section of the greatest start at or before them, sentinel where none: an equi-join with a range condition.

    Ranges are few per key, so each page meets only its report's ranges; the ranges are broadcast while they are small.
    """
    r = ranges.select(*keys, F.col("section").alias("chapter"), "start_page", "end_page")
    r = F.broadcast(r) if is_small(r) else r
    hit = pages.join(r, [*(pages[k] == r[k] for k in keys), pages[page] >= r["start_page"], pages[page] <= r["end_page"]], "left")
    return hit.select(*(pages[c] for c in pages.columns), F.coalesce("chapter", F.lit(sentinel)).alias("chapter"))


def roll_up(status: Column) -> Column:
    """All complete: complete; all missing: missing; else partial."""
    return F.when(F.every(status == "complete"), "complete").when(F.every(status == "missing"), "missing").otherwise("partial")


def latest_edition(manifest: DataFrame, key: str, date: str, url: str) -> DataFrame:
    """Per key the row with the greatest (date, url); a row without date counts as the oldest."""
    order = F.struct(F.coalesce(date, F.lit("0001-01-01").cast("date")).alias("d"), F.col(url).alias("u"))
    return manifest.groupBy(key).agg(F.max_by(F.struct(*manifest.columns), order).alias("r")).select("r.*")


def summed_map(rows: DataFrame, column: str) -> DataFrame:
    """(key, total) over a map column."""
    return rows.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
