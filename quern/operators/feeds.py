"""Feed entries: admission, keyword filter, newest per source, interleaving, ledger anti-join, frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import urls as U
from quern.operators.dedup import greedy_first
from quern.session import is_small

RECENT_HOURS, PER_SOURCE, BALANCED = 72, 20, 80

# Words that say nothing about news, and groups of keywords that mean the same.
STOP_WORDS = (
    "the and for with from that this are was were has have had its into will can not but our you your their than how why what "
    "new said says more about through which over after before com https http www news blog"
).split()
ALIASES = (("ai", "人工智能", "artificial intelligence"), ("芯片", "chip", "chips", "semiconductor", "semiconductors"))


def trusted(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries with a column trusted: whether the address is https and its host that of the entry's feed, or below it."""
    hosts = sources.select("source_id", F.regexp_replace(U.host_of(F.col("feed_url")), r"^feeds?\.", "").alias("feed_host"))
    joined = entries.join(F.broadcast(hosts) if is_small(hosts) else hosts, "source_id", "left")
    host = U.host_of(F.col("url"))
    same = (host == F.col("feed_host")) | F.endswith(host, F.concat(F.lit("."), "feed_host"))
    return joined.withColumn("trusted", F.coalesce(U.feed_url(F.col("url")).isNotNull() & same, F.lit(False))).drop("feed_host")


def admission(title: Column, trusted_url: Column, at: Column, now: Column, hours: int = RECENT_HOURS) -> Column:
    """The first reason against an entry, or eligible; exactly `hours` old and exactly now are eligible."""
    age = now.cast("double") - at.cast("double")
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", "invalid").when(~trusted_url, "invalid").when(at.isNull(), "undated").when(age < 0, "future").when(age > hours * 3600, "older").otherwise("eligible")


def freshness(at: Column, now: Column, hours: int = RECENT_HOURS) -> Column:
    age = now.cast("double") - at.cast("double")
    return F.when(at.isNull(), "undated").when(age < 0, "future").when(age <= hours * 3600, "recent").otherwise("stale")


def keyword_match(text: Column, keywords: str) -> Column:
    """Whether a text holds any keyword or one that means the same: ASCII words whole, others anywhere; no keywords match all."""
    terms = [t for t in keywords.lower().replace("，", ",").replace(",", " ").split() if t]
    wanted = dict.fromkeys([*terms, *(a for group in ALIASES for a in group if any(t in group for t in terms))])
    folded = F.lower(T.fold_width(text))
    hit = F.lit(not terms)
    for term in wanted:
        if term.isascii():
            hit = hit | F.regexp_like(folded, F.lit(rf"(^|[^a-z0-9_]){term}($|[^a-z0-9_])"))
        else:
            hit = hit | F.contains(folded, F.lit(term))
    return hit


def newest_per_source(entries: DataFrame, at: str = "fetched_at", most: int = PER_SOURCE) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(F.col(at).desc(), F.col("entry_id").asc())
    return entries.withColumn("source_rank", F.row_number().over(w)).where(F.col("source_rank") <= most)


def deduplicated(entries: DataFrame, order: Column) -> DataFrame:
    """Per source the entries kept by going through them in order: none whose address or title a kept one has."""
    keys = F.array(F.concat_ws("|", F.lit("u"), "source_id", U.key_url(F.col("url"))), F.concat_ws("|", F.lit("t"), "source_id", F.lower("title")))
    keyed = F.array(F.when(U.key_url(F.col("url")).isNotNull(), keys[0]), F.when(F.col("title").isNotNull(), keys[1]))
    return greedy_first(entries, "entry_id", order, keyed)


def balanced(entries: DataFrame, source_order: DataFrame, most: int = BALANCED) -> DataFrame:
    """Round-robin over sources (newest first within each), duplicates by address or title across sources dropped, at most `most`; newest first."""
    ranked = newest_per_source(entries).join(F.broadcast(source_order) if is_small(source_order) else source_order, "source_id")
    keys = F.array(F.concat(F.lit("u"), U.key_url(F.col("url"))), F.concat(F.lit("t"), F.lower("title")))
    kept = greedy_first(ranked, "entry_id", F.struct("source_rank", "source_no"), keys)
    chosen = ranked.join(kept, "entry_id").withColumn("place", F.row_number().over(Window.orderBy("source_rank", "source_no"))).where(F.col("place") <= most)
    return chosen.select("entry_id", "source_id", "source_rank", "place", F.row_number().over(Window.orderBy(F.col("fetched_at").desc(), "entry_id")).alias("final_rank"))


def undelivered(items: DataFrame, delivered: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """Items none of whose fingerprints was delivered; delivered has a column print."""
    prints = items.select(id_col, F.explode(U.fingerprints(F.col("url"), F.col("title"))).alias("print"))
    blocked = prints.join(delivered.select("print").distinct(), "print", "left_semi").select(id_col).distinct()
    return items.join(blocked, id_col, "left_anti")


def frequent_words(items: DataFrame, id_col: str, texts: list[str], most: int = 64) -> DataFrame:
    """(word, n, place): the most frequent words of three letters or more, without stop words; ties to the word seen first."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit(r"[a-z][a-z0-9_-]{2,31}"), F.lit(0))
    seen = items.select(F.col(id_col).alias("i"), F.posexplode(words).alias("p", "word")).where(~F.col("word").isin(*STOP_WORDS))
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("i", "p")).alias("first"))
    top = counts.orderBy(F.col("n").desc(), "first").limit(most)
    return top.select("word", "n", F.row_number().over(Window.orderBy(F.col("n").desc(), "first")).alias("place"))
