"""Problem 4: timestamps in mixed notations and zones normalised to microseconds since 1970-01-01 UTC.

Method: the raw strings are deduplicated, with the zone and the day/month order that apply to them, into a dictionary of distinct
values. Each value is parsed once, exhaustively, and the dictionary is kept in the shared folder; later runs parse only values it
does not hold yet. The instants are then joined back to the rows. Values that occur very often in the rows at hand are joined by
broadcast (there are at most 1 / HOT_SHARE of them, whatever the data), all others by a shuffled join, so a value that a third of the
rows hold makes no hot task.

Defined cases: null, blank and unreadable values, impossible dates and local times that a zone skipped name no moment and give no
row; of a repeated local hour the earlier is meant; digits finer than a microsecond are cut off; 24:00 is the next midnight; a feed
without zone counts as UTC; entries of an unknown feed count as feeds without zone and locale; repeated rows give repeated results,
as every row is answered for itself; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.arrow import map_columns
from quern.functions.fold import nfkc
from quern.session import shared_dir, written

FIELDS = ("pub_date", "published", "updated")
#: A value held by more than this share of all rows is joined by broadcast; so there are at most 1 / HOT_SHARE such values.
HOT_SHARE = 1e-3

#: Part of the dictionary's name: to be raised when a value is to be read otherwise than before.
DICTIONARY_VERSION = 1

# Month names (English, German, French), by prefix or whole word.
_MONTH_WORDS = {
    1: "jan january januar jänner janvier janv", 2: "feb february februar février fevrier févr fév", 3: "mar march märz maerz mrz mär mars",
    4: "apr april avril avr", 5: "may mai", 6: "jun june juni juin", 7: "jul july juli juillet juil", 8: "aug august août aout",
    9: "sep sept september septembre", 10: "oct october oktober okt octobre", 11: "nov november novembre", 12: "dec december dezember dez décembre decembre déc",
}
_MONTHS = {w: m for m, words in _MONTH_WORDS.items() for w in words.split()}
_UTC_WORDS = {"z", "utc", "ut", "gmt", "zulu"}
_BEIJING = {"北京时间", "中国标准时间"}
_DAY_PARTS = {"上午": 0, "凌晨": 0, "早上": 0, "清晨": 0, "早晨": 0, "中午": 11, "下午": 12, "傍晚": 12, "晚上": 12, "晚间": 12, "夜间": 12, "am": 0, "pm": 12, "a.m.": 0, "p.m.": 12}

_TIME = r"(?P<h>\d{1,2})(?::(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<frac>\d+))?)?|h(?P<mih>\d{2})?|时(?:(?P<mic>\d{1,2})分(?:(?P<sc>\d{1,2})秒)?)?)"
_ZONE = r"(?P<zone>z|[+-]\d{2}(?::?\d{2})?|(?:utc|gmt)[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,5})?(?:\s*\((?P<note>[a-z +:0-9-]*)\))?"
_PART = "|".join(k for k in _DAY_PARTS if not k.isascii())
_PATTERNS = [
    re.compile(p, re.VERBOSE)
    for p in (
        # 2026-05-01T12:00:00.123+08:00, 2026/5/1 12:00, 2026-05-01
        rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:(?:t|\s+|,\s*)(?:(?P<part>{_PART})\s*)?{_TIME}\s*(?P<ap>[ap]m|[ap]\.m\.)?\s*{_ZONE})?",
        # 20260501T120000Z, 20260501120000, 20260501
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:t?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:[.,](?P<frac>\d+))?\s*{_ZONE})?",
        # Fri, 01 May 2026 12:00:00 +0800 (CST); 1 May 2026, 12:00 BST; 1. Mai 2026 12:00; 1 mai 2026 à 12h00
        rf"(?:[^\W\d_]+\.?,?\s+)?(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th)?[\s-]+(?P<mon>[^\W\d_]+)\.?,?[\s-]+(?P<y>\d{{4}}|\d{{2}})(?:(?:,|\s+à|\s+um|\s+at)?\s+{_TIME}(?:\s*uhr)?\s*(?P<ap>[ap]m|[ap]\.m\.)?\s*{_ZONE})?",
        # May 1, 2026 3:37 PM CDT
        rf"(?:[^\W\d_]+\.?,\s+)?(?P<mon>[^\W\d_]+)\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:(?:,|\s+at)?\s+{_TIME}\s*(?P<ap>[ap]m|[ap]\.m\.)?\s*{_ZONE})?",
        # Fri May  1 12:00:00 CST 2026
        rf"[^\W\d_]+\.?,?\s+(?P<mon>[^\W\d_]+)\s+(?P<d>\d{{1,2}})\s+{_TIME}\s+(?:{_ZONE}\s+)?(?P<y>\d{{4}})",
        # 05/01/2026 3:37 PM, 01.05.2026, 12:00 Uhr: the order of day and month is the feed's
        rf"(?P<o1>\d{{1,2}})(?P<sep>[-/.])(?P<o2>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}})(?:(?:,|\s+à|\s+um|\s+at)?\s+{_TIME}(?:\s*uhr)?\s*(?P<ap>[ap]m|[ap]\.m\.)?\s*{_ZONE})?",
        # 北京时间2026年5月1日 下午3:37:01
        rf"(?P<clock>北京时间|中国标准时间)?\s*(?P<y>\d{{4}}|\d{{2}})年(?P<m>\d{{1,2}})月(?P<d>\d{{1,2}})[日号](?:\s*(?:星期.|周.))?(?:\s*(?P<part>{_PART})?\s*{_TIME}\s*{_ZONE})?",
    )
]
_EPOCH = re.compile(r"(\d{9,10})(?:\.(\d+))?|(\d{12,13})|(\d{15,16})|(\d{18,19})")
_ZERO = dt.datetime(1970, 1, 1)
_US = dt.timedelta(microseconds=1)


@lru_cache(1000)
def _zone(name: str | None) -> dt.tzinfo:
    if not name:
        return dt.timezone.utc
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return dt.timezone.utc


@lru_cache(20_000)
def _abbreviation(word: str, zone_name: str | None, year: int) -> dt.timedelta | None:
    """The offset that an abbreviation stands for in a zone, in or near a year; None if the zone never uses it."""
    zone = _zone(zone_name)
    if zone is dt.timezone.utc:
        return None
    for y in (year, year - 1, year + 1, *range(2030, 1969, -1)):
        for month in range(1, 13):
            at = dt.datetime(y, month, 15, tzinfo=zone)
            if (at.tzname() or "").lower() == word:
                return at.utcoffset()
    return None


# Abbreviations read by themselves where the feed's own zone does not use them (minutes east of UTC).
_ELSEWHERE = {"est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "bst": 60, "ist": 330, "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "aest": 600, "aedt": 660, "acst": 570, "awst": 480, "nzst": 720, "nzdt": 780}


def parse_moment(raw: str | None, zone_name: str | None, month_first: bool) -> int | None:
    """Microseconds since 1970-01-01 UTC, or None if the value names no moment."""
    if not raw:
        return None
    text = nfkc(raw).strip().lower()
    if not text or not any(c.isdigit() for c in text):
        return None
    if m := _EPOCH.fullmatch(text):
        seconds, frac, ms, us, ns = m.groups()
        if seconds:
            return int(seconds) * 1_000_000 + int(((frac or "") + "000000")[:6])
        return int(ms) * 1000 if ms else int(us) if us else int(ns) // 1000
    for pattern in _PATTERNS:
        if m := pattern.fullmatch(text):
            moment = _from_match(m.groupdict(), zone_name, month_first)
            if moment is not None:
                return moment
    return None


def _from_match(g: dict[str, str | None], zone_name: str | None, month_first: bool) -> int | None:
    year = int(g["y"])
    if len(g["y"]) == 2:
        year += 2000
    if g.get("mon"):
        month = _MONTHS.get(g["mon"], 0)
        day = int(g["d"])
    elif g.get("o1"):
        first, second = int(g["o1"]), int(g["o2"])
        month, day = (first, second) if month_first else (second, first)
    else:
        month, day = int(g["m"]), int(g["d"])
    hour = int(g.get("h") or 0)
    minute = int(g.get("mi") or g.get("mih") or g.get("mic") or 0)
    second = int(g.get("s") or g.get("sc") or 0)
    micro = int(((g.get("frac") or "") + "000000")[:6])
    part = g.get("part") or g.get("ap")
    if part:
        shift = _DAY_PARTS[part]
        if hour > 12 and part.isascii() or hour > 24:
            return None
        if shift == 11:  # noon: 11 to 2
            hour += 12 * (hour < 3)
        elif shift:
            hour += 12 * (hour < 12) - 24 * (hour == 12 and part in ("晚上", "夜间"))
            if hour < 0:
                hour, extra = 0, 1
                return _instant(year, month, day, hour, minute, second, micro, extra, g, zone_name)
        elif hour == 12:
            hour = 0 if part in ("am", "a.m.", "凌晨", "上午") else 12
    extra = 0
    if hour == 24 and not (minute or second or micro):
        hour, extra = 0, 1
    return _instant(year, month, day, hour, minute, second, micro, extra, g, zone_name)


def _instant(year, month, day, hour, minute, second, micro, extra, g, zone_name) -> int | None:
    try:
        local = dt.datetime(year, month, day, hour, minute, second, micro) + dt.timedelta(days=extra)
    except (ValueError, OverflowError):
        return None
    word = g.get("zone")
    if g.get("clock") and not word:
        zone_name, word = "Asia/Shanghai", None
    offset: dt.timedelta | None = None
    if word:
        if word in _UTC_WORDS:
            offset = dt.timedelta(0)
        elif m := re.fullmatch(r"(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?", word):
            hours, minutes = int(m[2]), int(m[3] or 0)
            if hours > 18 or minutes > 59:
                return None
            offset = dt.timedelta(hours=hours, minutes=minutes) * (-1 if m[1] == "-" else 1)
        else:
            offset = _abbreviation(word, zone_name, year)
            if offset is None and word in _ELSEWHERE:
                offset = dt.timedelta(minutes=_ELSEWHERE[word])
            if offset is None:
                return None
    if offset is None:
        zone = _zone(zone_name)
        aware = local.replace(tzinfo=zone, fold=0)
        offset = aware.utcoffset()
        if zone is not dt.timezone.utc and offset != local.replace(tzinfo=zone, fold=1).utcoffset():
            back = aware.astimezone(dt.timezone.utc).astimezone(zone).replace(tzinfo=None)
            if back != local:  # skipped when the clocks went forward
                return None
    return (local - offset - _ZERO) // _US


def raw_values(entries: DataFrame, sources: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per non-blank value: entry_id, field_name, raw, tz_name, month_first. sources is a dimension of bounded size."""
    feeds = sources.groupBy("source_id").agg(F.max("tz_name").alias("tz_name"), F.max(F.coalesce(F.col("feed_locale") == "en-US", F.lit(False))).alias("month_first"))
    stacked = entries.select(
        "entry_id", "source_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields))).alias("v")
    ).select("entry_id", "source_id", "v.field_name", "v.raw")
    stacked = stacked.where(F.trim("raw") != "")
    return stacked.join(feeds, "source_id", "left").select("entry_id", "field_name", "raw", "tz_name", F.coalesce("month_first", F.lit(False)).alias("month_first"))


def _parser():
    def step(batch: dict[str, pa.Array]) -> dict[str, list | pa.Array]:
        values = [parse_moment(r, z, m) for r, z, m in zip(*(batch[n].to_pylist() for n in ("raw", "tz_name", "month_first")))]
        return {"raw": batch["raw"], "tz_name": batch["tz_name"], "month_first": batch["month_first"], "epoch_us": values}

    return step


_KEYS = ("raw", "tz_name", "month_first")


def _same(a: DataFrame, b: DataFrame):
    return (a["raw"] == b["raw"]) & a["tz_name"].eqNullSafe(b["tz_name"]) & (a["month_first"] == b["month_first"])


_DICTIONARY = "raw string, tz_name string, month_first boolean, epoch_us long"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The distinct values parsed so far. Two runs that extend it at the same time may both hold a value, with the same result; it is given once."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _DICTIONARY)
    return spark.read.schema(_DICTIONARY).parquet(path).groupBy(*_KEYS).agg(F.first("epoch_us").alias("epoch_us"))


def extend_dictionary(counts: DataFrame, path: str) -> DataFrame:
    """Parse the distinct values that the dictionary at path does not hold yet, append them to it, and return the whole dictionary."""
    known = read_dictionary(counts.sparkSession, path)
    new = counts.join(known, _same(counts, known), "left_anti")
    map_columns(new.select(*_KEYS), _parser, _DICTIONARY).write.mode("append").parquet(path)
    return read_dictionary(counts.sparkSession, path)


def normalised(entries: DataFrame, sources: DataFrame, dictionary_path: str | None = None) -> DataFrame:
    """(entry_id, field_name, epoch_us) of every value that names a moment.

    The dictionary is that of the shared folder unless a path is given: what one run has parsed, no later one parses again. Values that
    more than HOT_SHARE of this run's rows hold (so at most 1 / HOT_SHARE of them) are joined by broadcast, the others by a shuffle.
    """
    spark = entries.sparkSession
    values = written(raw_values(entries, sources), "values")
    counts = written(values.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")), "counts")
    known = extend_dictionary(counts, dictionary_path or f"{shared_dir(spark)}/quern-moments-{DICTIONARY_VERSION}").where(F.col("epoch_us").isNotNull())
    limit = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) * HOT_SHARE).alias("hot_from"))
    often = counts.crossJoin(F.broadcast(limit)).where("n > hot_from").select(*_KEYS)
    columns = ["entry_id", "field_name", "epoch_us"]
    hot = F.broadcast(known.join(F.broadcast(often), _same(known, often), "left_semi"))
    rest = values.join(F.broadcast(often), _same(values, often), "left_anti")
    return values.join(hot, _same(values, hot)).select(*columns).unionByName(rest.join(known, _same(rest, known)).select(*columns))
