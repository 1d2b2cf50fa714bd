import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import pieces as P


def check(text, tree, strings):
    spans, hard = P.cut(text, tree)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for k, (s, e) in enumerate(spans):
        assert 0 < e - s <= P.LIMIT
        if k:
            before = spans[k - 1]
            assert s == max(before[0], before[1] - P.OVERLAP) and e > before[1]
    assert hard == int(max(map(len, strings)) > P.LIMIT)
    return spans


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "第一章 ", "一、", "（一）", "1. ", "- ", "x，"]), st.integers(0, 400), st.sampled_from(["。", "；", "\n", "\r\n", "！？", "\n\n", ""])), min_size=1, max_size=30))
def test_pages(parts):
    text = "".join(a + "字" * n + b for a, n, b in parts)
    if len(text) > P.LIMIT:
        check(text, P.page_tree(text), re.split("[。；！？\r\n]", text))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.integers(0, 150).map("数".__mul__), st.just("a\nb")), max_size=5)), min_size=1, max_size=25))
def test_grids(rows):
    text, tree = P.grid_text(rows)
    joined = [" | ".join(c or "" for c in r or []) for r in rows]
    assert text == "\n".join(joined)
    if len(text) > P.LIMIT:
        check(text, tree, joined)


def test_natural_ends():
    text = ("句子" * 40 + "。") * 30
    spans = check(text, P.page_tree(text), text.split("。"))
    assert all(text[e - 1] == "。" for _, e in spans)
    long = "a" * 1_000_000
    check(long, P.page_tree(long), [long])


def test_tables(spark):
    page = "很" * 200 + "。" + "长" * 200
    pages = spark.createDataFrame([("p", page, "x"), ("p", page, "x"), ("q", "短", "x"), ("r", None, "x"), (None, page, "x"), ("s", "", "x"), ("t", "无" * 341, "x")], "page_id string, text string, piece string")
    grids = spark.createDataFrame([("p", [["a", None]] * 200), ("u", [["b" * 400]]), ("v", None), ("w", [None])], "table_id string, table_rows array<array<string>>")
    got = {(r.item_kind, r.item_id): r.hard_cut for r in P.oversized(pages, grids).collect()}
    assert got == {("page", "p"): 0, ("page", "t"): 1, ("table", "p"): 0, ("table", "u"): 1}
    for r in P.pieces(pages, grids).where("item_id = 't'").collect():
        assert r.piece == ("无" * 341)[r.start_at : r.end_at]
    assert P.oversized(pages.limit(0), grids.limit(0)).count() == 0
