"""Small column functions and table forms: instants and digests as text, mailboxes, preferences, titles, headers, counts, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ITEMS, MOST_ITEMS, DEFAULT_ITEMS, MOST_KEYWORDS, MOST_HEADING = 5, 20, 12, 200, 180
DAY_US = 86_400_000_000


def iso_instant(at: Column) -> Column:
    """An instant in UTC with Z; microseconds only where there are some."""
    utc = F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone())
    whole = F.unix_micros(at.cast("timestamp")) % 1_000_000 == 0
    return F.when(whole, F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def strict_instant(text: Column) -> Column:
    """The instant of an ISO text that names its zone; null for any other text."""
    return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})\s*$"), F.try_to_timestamp(F.trim(text)))


def normal_mailbox(text: Column) -> Column:
    """A mailbox without outer blanks in lower case; null if it is none."""
    box = F.lower(F.trim(text))
    return F.when((F.length(box) <= 254) & box.rlike(r"^[^\s@<>(),;:\"\\\[\]]{1,64}@[a-z0-9-]+(\.[a-z0-9-]+)+$"), box)


def recipient_key(mailbox: Column) -> Column:
    return F.sha2(normal_mailbox(mailbox), 256)


def short_digest(text: Column) -> Column:
    """The first half of a digest."""
    return F.left(F.sha2(text, 256), F.lit(32))


def item_count(n: Column) -> Column:
    return F.when(n.between(LEAST_ITEMS, MOST_ITEMS), n).otherwise(F.lit(DEFAULT_ITEMS))


def keywords(text: Column) -> Column:
    """White space collapsed, cut at MOST_KEYWORDS; empty without any."""
    return F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit(MOST_KEYWORDS))


def heading(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != "")
    return F.left(F.array_join(F.slice(lines, 1, 3), " "), F.lit(MOST_HEADING))


def shown_headers(headers: Column) -> Column:
    return F.transform(headers, lambda h, i: F.when(F.trim(F.coalesce(h, F.lit(""))) == "", F.concat(F.lit("列 "), (i + 1).cast("string"))).otherwise(h))


def unit_text(note: Column) -> Column:
    return F.regexp_replace(note, r"^\s*单位(说明)?\s*[:：]\s*", "")


def markdown_cell(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.replace(escaped, F.lit("\n"), F.lit(" "))


def shown_share(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 1), F.lit("%"))


def shown_rank(x: Column) -> Column:
    return F.format_number(x, 3)


def fixed_counts(rows: DataFrame, by: list[str], status: str, keys: list[str]) -> DataFrame:
    """A column of counts for each key, zero where there is none."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(status) == k).alias(k) for k in keys))


def retained(events: DataFrame, always: Column, span_us: int = DAY_US, newest: int = 200) -> DataFrame:
    """Events less than a span before the last one: all for which `always` holds, of the others the newest. The rank is limited within
    each partition before it is taken over all."""
    at = events.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("always", F.coalesce(always, F.lit(False)))
    clock = at.agg(F.max("at_us").alias("now_us"))
    recent = at.crossJoin(F.broadcast(clock)).where(F.col("at_us") > F.col("now_us") - span_us)
    rest = recent.where(~F.col("always")).orderBy(F.col("at_us").desc(), F.col("event_id").desc()).limit(newest)
    return recent.where("always").unionByName(rest)


def outcomes(events: DataFrame, key: list[str], content: str) -> DataFrame:
    """What becomes of each request: new, the same as its key's first one, or in conflict with it. The first ones are combined before the shuffle."""
    order = F.struct(F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"))
    first = events.groupBy(*key).agg(F.min(F.struct(order.alias("o"), F.col("event_id").alias("first_id"), F.col(content).alias("first_content"))).alias("f")).select(*key, "f.first_id", "f.first_content")
    return events.join(first, key).withColumn("outcome", F.when(F.col("event_id") == F.col("first_id"), "new").when(F.col(content).eqNullSafe(F.col("first_content")), "same").otherwise("conflict"))


def referenced(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """rows with is_known: whether targets hold the key."""
    known = targets.select(key).where(F.col(key).isNotNull()).distinct().withColumn("is_known", F.lit(True))
    return rows.join(known, key, "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def required(column: Column, label: str) -> Column:
    """The trimmed text; a blank one fails the job."""
    text = F.trim(column)
    return F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit(f"{label} is missing")).cast("string")).otherwise(text)


def required_recent(at: Column, now: Column, hours: int = 72) -> Column:
    """Whether an instant is at most so many hours old and not in the future; any other fails the job."""
    age = F.unix_micros(now) - F.unix_micros(at)
    return F.when(age.between(0, hours * 3_600_000_000), F.lit(True)).otherwise(F.raise_error(F.lit("not recent")).cast("boolean"))


def safe_title(title: Column, label: Column, private: Column) -> Column:
    """White space collapsed, 200 characters at most; the generic label where the title is blank or holds personal data."""
    short = F.left(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " ")), F.lit(200))
    return F.when(F.coalesce(private, F.lit(False)) | (short == ""), label).otherwise(short)


def markdown_record(rows: DataFrame, by: str, order: str, line: Column) -> DataFrame:
    """(by, record): a Markdown heading and a list item a row, in order; groups are sections of a report, so of its size."""
    lines = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("ls"))
    items = F.array_join(F.transform("ls", lambda x: F.concat(F.lit("- "), x["l"])), "\n")
    return lines.select(by, F.concat(F.lit("## "), F.col(by).cast("string"), F.lit("\n\n"), items).alias("record"))


def mean_vectors(rows: DataFrame, by: str, vector: str, weight: Column) -> DataFrame:
    """(by, vector): the weighted mean of each group's vectors, scaled to norm 1. Summed by position before the shuffle, so a group may be of any size."""
    at = rows.select(by, weight.cast("double").alias("w"), F.posexplode(vector).alias("p", "x"))
    sums = at.groupBy(by, "p").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x"))
    whole = sums.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("xs"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return whole.select(by, F.transform("xs", lambda e: e["x"] / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("vector"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_a, n_b, only_a, only_b): how many rows two tables have, and how many of them, repetitions counted, the other has not."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("s"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*columns, F.lit(-1).alias("s"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = both.groupBy(*columns).agg(F.sum("s").alias("s"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    zero = F.lit(0).cast("long")
    return per.agg(F.coalesce(F.sum("x"), zero).alias("n_a"), F.coalesce(F.sum("y"), zero).alias("n_b"), F.coalesce(F.sum(F.greatest("s", F.lit(0))), zero).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("s"), F.lit(0))), zero).alias("only_b"))
