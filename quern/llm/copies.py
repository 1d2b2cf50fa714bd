"""Problem 5: feed entries that differ only in the formatting of title and url collapse into one record each, with its exact number of copies.

Method: canonical records are range-partitioned and externally sorted; adjacent runs are scanned, comparing full keys, and give one
representative (the smallest entry_id) and the exact copy count. See runs.py for runs that cross partitions.

Defined cases: an entry whose title or url is null, empty or without a letter or digit, or whose url is not https, is no copy of
anything and has no record; a repeated row with the same id counts as one more copy in the counts but never as a copy of itself in
the pairs; null ids are left out; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.keys import canonical_entries
from quern.llm.runs import first_of_runs
from quern.session import written


def representatives(entries: DataFrame) -> DataFrame:
    """(entry_id, keep_id) of every entry that has both keys."""
    records = written(canonical_entries(entries).dropna(subset=["title_key", "url_key"]).select("entry_id", "title_key", "url_key"), "canonical")
    return first_of_runs(records, ["title_key", "url_key"])


def further_copies(entries: DataFrame) -> DataFrame:
    """(keep_id, entry_id) of each further copy."""
    return representatives(entries).where("keep_id < entry_id").select("keep_id", "entry_id")


def copy_counts(entries: DataFrame) -> DataFrame:
    """(keep_id, copies) of each record, copies counting the representative itself."""
    return representatives(entries).groupBy("keep_id").agg(F.count(F.lit(1)).alias("copies"))
