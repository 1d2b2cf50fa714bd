import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.characters import Cleaner, clean_texts, flagged

CASES = {
    "Ｔｏｒ": "Tor", "１２％": "12%", "１．２．３": "1.2.3", "été": "été", "plan​es": "planes", "ﬃx": "ffix", "Ρrofіt": "Profit", "⻅附⼀": "见附一", "𝐌𝐚": "Ma", "a b": "a b",
    "ЕХQUA": "EXQUA", "x️": "x", "Leɑsing": "Leasing", "ｱｲ": "アイ", "\uf961": "率", "a　b": "a b", "﻿x": "x", "х́a": "x́a", "⻓⻛⻋": "长风车",
}
PLAIN = ["ab", "Север", "СЕВЕР", "α版体验", "β测试", "👩‍💻 ok", "❤️", "été Rûno", "中文，全角；（）：！？", "«“”’–…", "カタログ・안내", "m² ① Ⅲ", "می‌خو", "𠮷", "", None, "20 %", "α 1．2", "目录．．．．12"]


def test_cases_and_plain_texts():
    texts = [*CASES, *PLAIN]
    where, clean = Cleaner().changed(pa.array(texts, pa.string()))
    assert dict(zip((texts[k] for k in where), clean)) == CASES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aео рΆ​‍👩💻１％️é中", max_size=12), min_size=1, max_size=20))
def test_cleaning_twice_changes_nothing_more(texts):
    cleaner = Cleaner()
    once = cleaner.clean(pa.array(texts, pa.string()))
    assert cleaner.clean(pa.array(once, pa.string())) == once


def test_tables(spark):
    rows = [(1, "Ａ", "c"), (1, "Ａ", "c"), (2, "a", "c"), (3, None, "c"), (None, "Ａ", "c"), (4, "", "c"), (5, "x" * 200_000 + "​", "c")]
    df = spark.createDataFrame(rows, "page_id int, text string, record_id string")
    assert {r.record_id for r in flagged(df, "page_id", "text").collect()} == {"1", "5"}
    assert sorted(r.changed for r in clean_texts(df, "page_id", "text").collect()) == [False] * 3 + [True] * 4
    assert flagged(df.limit(0), "page_id", "text").count() == 0
