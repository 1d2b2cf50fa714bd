"""Amounts and numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chinese digits and powers of ten.
_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
_SMALL = {"十": 10, "百": 100, "千": 1000}
_LARGE = {"万": 10_000, "亿": 100_000_000}


def _value(c: Column, table: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c].cast("long")


def chinese_number(text: Column) -> Column:
    """The number a Chinese numeral names, as a fold over its characters: a digit waits for its power, 万 and 亿 close a group."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("digit"))

    def step(acc: Column, c: Column) -> Column:
        digit, small, large = _value(c, _DIGITS), _value(c, _SMALL), _value(c, _LARGE)
        group = F.when(small.isNotNull(), acc["group"] + F.when(acc["digit"] > 0, acc["digit"]).otherwise(1) * small).otherwise(acc["group"])
        whole = acc["group"] + acc["digit"]
        closes_all = c == "亿"
        total = F.when(closes_all, (acc["total"] + whole) * large).when(large.isNotNull(), acc["total"] + whole * large).otherwise(acc["total"])
        return F.struct(
            total.alias("total"),
            F.when(large.isNotNull(), F.lit(0).cast("long")).otherwise(group).alias("group"),
            F.when(digit.isNotNull(), digit).otherwise(F.lit(0).cast("long")).alias("digit"),
        )

    return F.when(F.regexp_like(text, F.lit("^[零〇一二两三四五六七八九十百千万亿]+$")), F.aggregate(F.split(text, ""), start, step, lambda a: a["total"] + a["group"] + a["digit"]))


#: Amounts in figures with their unit.
AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([亿万千]?元)"


def amount_yuan(figure: Column, unit: Column) -> Column:
    factor = F.when(unit == "千元", 1000).when(unit == "万元", 10_000).when(unit == "亿元", 100_000_000).otherwise(1)
    return (F.replace(figure, F.lit(","), F.lit("")).cast("decimal(24,4)") * factor).cast("decimal(38,4)")


def format_amount(x: Column) -> Column:
    """Thousands separated, closing zeros of the fraction dropped."""
    return F.regexp_replace(F.regexp_replace(F.format_number(x, 2), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
