import datetime as dt

import pytest

from quern.operators import timestamps as ts
from quern.session import scratch_path


def us(*parts):
    return int((dt.datetime(*parts) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


@pytest.mark.parametrize(
    "raw, zone, month_first, want",
    [
        ("2026-05-01T12:00:00.1234569+08:00", None, False, us(2026, 5, 1, 4, 0, 0, 123456)),
        ("2026-05-01", "Asia/Shanghai", False, us(2026, 4, 30, 16)),
        ("20260501T120000Z", "Asia/Tokyo", False, us(2026, 5, 1, 12)),
        ("Fri, 01 May 26 12:00:00 EDT", "America/New_York", True, us(2026, 5, 1, 16)),
        ("Fri, 01 May 2026 12:00 CST", "Asia/Shanghai", False, us(2026, 5, 1, 4)),
        ("Fri, 01 May 2026 12:00 CST", "America/Chicago", False, us(2026, 5, 1, 18)),
        ("1 May 2026, 12:00 IST", "Asia/Kolkata", False, us(2026, 5, 1, 6, 30)),
        ("03/04/2026 3:07:01 PM", None, True, us(2026, 3, 4, 15, 7, 1)),
        ("03/04/2026 15h07", None, False, us(2026, 4, 3, 15, 7)),
        ("2026年5月1日 下午3:37:01", "Asia/Shanghai", False, us(2026, 5, 1, 7, 37, 1)),
        ("北京时间2026年5月1日9时5分", None, False, us(2026, 5, 1, 1, 5)),
        ("2026年5月1日 凌晨12:30:00", None, False, us(2026, 5, 1, 0, 30)),
        ("9. März 2026 07:24", "Europe/Berlin", False, us(2026, 3, 9, 6, 24)),
        ("2 août 2026 à 01h35", "Europe/Paris", False, us(2026, 8, 1, 23, 35)),
        ("November 2, 2025 1:46 AM CDT", "America/Chicago", True, us(2025, 11, 2, 6, 46)),
        ("2025-11-02 01:30", "America/New_York", True, us(2025, 11, 2, 5, 30)),
        ("2025-03-09 02:30", "America/New_York", True, None),
        ("1754264506138", None, False, 1754264506138000),
        ("1760034115.260859", None, False, 1760034115260859),
        ("２０２６-05-01 24:00", None, False, us(2026, 5, 2)),
        ("Sun, 05 Oct 2025 10:45:45 -0000", "Asia/Tokyo", False, us(2025, 10, 5, 10, 45, 45)),
        ("2025-13-45T99:00:00Z", None, False, None), ("0000-00-00 00:00:00", None, False, None), ("31/04/2026", None, False, None),
        ("yesterday", None, False, None), ("", None, False, None), (None, None, False, None), ("13/25/2026", None, True, None),
    ],
)
def test_notations(raw, zone, month_first, want):
    assert ts.parse_moment(raw, zone, month_first) == want


def test_dictionary_is_kept_and_hot_values_join(spark):
    sources = spark.createDataFrame([("a", "Asia/Shanghai", "zh-CN"), ("b", None, None)], "source_id string, tz_name string, feed_locale string")
    rows = [(i, "a" if i % 2 else "b", "2026-05-01 08:00", None if i % 3 else "x", f"2026-05-01 08:{i % 60:02d}", "clash") for i in range(600)]
    rows += [(600, None, " ", "2026-05-01", None, "clash"), (601, "z", "2026-05-01", None, None, "clash")]
    entries = spark.createDataFrame(rows, "entry_id long, source_id string, pub_date string, published string, updated string, raw string")
    path = scratch_path(spark, "moments")
    got = {(r.entry_id, r.field_name): r.epoch_us for r in ts.normalised(entries, sources, path).collect()}
    zone = {"a": "Asia/Shanghai"}
    want = {}
    for i, source, *values, _ in rows:
        for f, v in zip(ts.FIELDS, values):
            if (e := ts.parse_moment(v, zone.get(source), False)) is not None:
                want[i, f] = e
    assert got == want
    before = spark.read.parquet(path).count()
    assert {(r.entry_id, r.field_name): r.epoch_us for r in ts.normalised(entries, sources, path).collect()} == want
    assert spark.read.parquet(path).count() == before
    assert ts.normalised(entries.limit(0), sources).count() == 0
