import itertools
import math
import random
import re
import unicodedata

from pyspark.sql import functions as F

from quern.functions import numbers, text, urls
from quern.operators import chunks, dedup, feeds, learning, retrieval, state, tables


def one(spark, column, **values):
    fields = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], fields).select(column).first()[0]


def test_tokenize(spark):
    assert one(spark, text.tokenize(F.col("t")), t="净利润 ２０２５ 1.25% 好 A-b.c") == ["净利", "利润", "2025", "1.25%", "好", "a-b.c"]
    assert one(spark, text.query_terms(F.col("t")), t="净利润如何 ROE 5%") == sorted({"净利", "利润", "润如", "roe", "5%"} - {"如何"})
    assert one(spark, text.shingles(F.col("t")), t="abcd123efgh") == ["abcd0", "cd0ef", "0efgh"]
    assert one(spark, text.char_bigrams(F.col("t")), t="a，bb b") == ["ab", "bb", "bb"]
    assert one(spark, text.contains_value(F.col("t"), F.col("v")), t="共 12.5 元", v="2.5") is False
    assert one(spark, text.contains_value(F.col("t"), F.col("v")), t="共 １2.5 元", v="12.5") is True
    assert one(spark, text.before_reasoning(F.col("t")), t=" 事实 本院认为 理由") == "事实"
    assert text.plain("<p>a&amp;b<script>x</script> c</p>" + "d" * 700, 20) == "a&b c ddddddddddddd…"
    assert one(spark, text.nfkc(F.col("t")), t="ﬁ①") == unicodedata.normalize("NFKC", "ﬁ①") and one(spark, text.casefold(F.col("t")), t="Straße") == "strasse"
    assert one(spark, text.html_text(50)(F.col("t")), t="<b>x</b>y") == "x y"
    for private in ("mail a@b.cc", "tel 13812345678", "密码：abc", "C:\\x", "api_key = 1", "sk-abcdefghijklmnop"):
        assert one(spark, text.is_private(F.col("t")), t=private) is True
    assert one(spark, text.is_private(F.col("t")), t="合同金额 1234567 元") is False


def test_urls_and_numbers(spark):
    u = " HTTPS://www.A.example:443/p/?b=2&a=1&utm_x=1&ref=r#f "
    assert one(spark, urls.feed_url(F.col("u")), u=u) == "https://www.a.example:443/p/?b=2&a=1&ref=r"
    assert one(spark, urls.key_url(F.col("u")), u=u) == "https://www.a.example/p?a=1&b=2&ref=r"
    assert one(spark, urls.ledger_url(F.col("u")), u=u) == "https://a.example/p?a=1&b=2"
    for f in (urls.feed_url, urls.key_url, urls.ledger_url):
        once = one(spark, f(F.col("u")), u=u)
        assert one(spark, f(F.col("u")), u=once) == once
        assert one(spark, f(F.col("u")), u="https://u@x.example/") is None and one(spark, f(F.col("u")), u="http://x.example/") is None
    assert one(spark, urls.citation_href(F.col("u"), F.col("p")), u="https://x.example/a#z", p=3) == "https://x.example/a#page=3"
    assert one(spark, urls.has_secret_parameter(F.col("u")), u="https://x/?access_token=1") is True
    table = {"九十七": 97, "十": 10, "一百零三": 103, "两万三千": 23000, "一亿零五": 100_000_005, "十万": 100_000, "一万亿": 10**12, "x": None}
    for k, v in table.items():
        assert one(spark, numbers.chinese_number(F.col("t")), t=k) == v
    assert [r[0] for r in spark.createDataFrame([(1234.5,), (100.0,)], "x double").select(numbers.format_amount(F.col("x"))).collect()] == ["1,234.5", "100"]


def test_bm25_against_plain_python(spark):
    docs = [(1, "甲银行 净利润 增长"), (2, "乙银行 净利润 下降 净利润"), (3, "甲银行 贷款"), (4, ""), (5, None)]
    queries = [(1, "净利润 净利润"), (2, "甲银行")]
    tokens = {d: re.findall(r"\S+", t or "") for d, t in docs}
    d, q = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(queries, "q long, t string")
    split = F.filter(F.split(F.coalesce("t", F.lit("")), " "), lambda x: x != "")
    avg = sum(map(len, tokens.values())) / 5
    want = {}
    for (qi, qt), (di, ts) in itertools.product(queries, tokens.items()):
        s = 0.0
        for term in set(qt.split()):
            df = sum(term in x for x in tokens.values())
            tf = ts.count(term)
            if tf:
                s += math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        if s > 0:
            want[qi, di] = round(s, 6)
    got = {(r.q, r.d): r.score for r in retrieval.bm25(d, "d", split, q, "q", split).collect()}
    assert got == want
    scoped = {(r.q, r.d): r.score for r in retrieval.bm25(d, "d", split, q, "q", split, keep=F.col("d") == 1).collect()}
    assert scoped == {k: v for k, v in want.items() if k[1] == 1}


def test_ranking_ties_and_fusion(spark):
    a = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0), (1, 9, 2.0)], "q long, d long, score double")
    assert [(r.d, r["rank"]) for r in retrieval.ranked(a, ["q"], "d", 2).orderBy("rank").collect()] == [(9, 1), (3, 2)]
    b = spark.createDataFrame([(1, 5, 0.9), (1, 7, 0.1)], "q long, d long, score double")
    fused = {r.d: round(r.score, 6) for r in retrieval.rrf(a, b, "q", "d").collect()}
    assert fused == {5: round(1 / 63 + 1 / 61, 6), 9: round(1 / 61, 6), 3: round(1 / 62, 6), 7: round(1 / 62, 6)}
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])], "i long, v array<double>")
    assert [r.b for r in v.orderBy("i").select(retrieval.bad_vectors(v, "v", 2).alias("b")).collect()] == [False, False, True]
    n = spark.createDataFrame([(1, "x", 0.9, 1), (1, "y", 0.8, 2), (1, "y", 0.8, 3)], "q long, l string, score double, rank int")
    assert retrieval.votes(n, "q", "l", 3, 0.12).first().voted == "y" and retrieval.votes(n, "q", "l", 1, 0.12).first().voted == "x"


def near(x, y):
    def norm(t, digits=False):
        t = re.sub(r"[^㐀-鿿A-Za-z0-9]", "", t).lower()
        return re.sub(r"\d+", "0", t) if digits else t

    a, b = norm(x), norm(y)
    if not a or not b or a == b:
        return False
    low, high = sorted((len(a), len(b)))
    if low >= 100 and low * 10 >= high * 6 and (a in b or b in a):
        return True
    if low < 120 or low * 10 < high * 7:
        return False
    s, t = ({z[i : i + 5] for i in range(0, len(z) - 4, 2)} for z in (norm(x, True), norm(y, True)))
    return bool(s and t) and 100 * len(s & t) >= 88 * len(s | t)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh中文字词") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 90))) for _ in range(40)]
    for base in texts[:25]:
        ws = base.split()
        for _ in range(rng.randint(0, 3)):
            copy = list(ws)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        texts.append(base.upper() + "!")
        texts.append(base[3 : int(len(base) * 0.8)])
    texts += ["", None, "短"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    classes, links = dedup.near_duplicates(docs, "i", "t")
    ids = {r.class_id for r in classes.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(ids), 2) if near(texts[a], texts[b])}
    assert {(r.a, r.b) for r in links.collect()} == want and len(want) > 15
    summary = {r.i: (r.class_id, r.n_links) for r in dedup.near_duplicate_summary(docs, "i", "t").collect()}
    assert len(summary) == sum(1 for t in texts if t)


def test_greedy_first_against_a_loop(spark):
    rng = random.Random(4)
    for _ in range(4):
        items = [(i, rng.randint(0, 50), rng.choice([None, *"abcdefgh"]), rng.choice([None, *"uvwxyz"])) for i in range(60)]
        kept, seen = set(), set()
        for i, o, x, y in sorted(items, key=lambda r: (r[1], r[0])):
            keys = {("x", x), ("y", y)} - {("x", None), ("y", None)}
            if not keys & seen:
                kept.add(i)
                seen |= keys
        df = spark.createDataFrame(items, "i long, o long, x string, y string")
        keys = F.array(F.concat(F.lit("x"), "x"), F.concat(F.lit("y"), "y"))
        assert {r.i for r in dedup.greedy_first(df, "i", F.col("o"), keys).collect()} == kept


def test_feeds(spark):
    at = F.timestamp_seconds(F.col("s"))
    now = F.timestamp_seconds(F.lit(1_000_000))
    df = spark.createDataFrame([("t", 1_000_000), ("t", 1_000_001), ("t", 1_000_000 - 72 * 3600), ("t", 1_000_000 - 72 * 3600 - 1), (" ", 1), ("t", None)], "t string, s long")
    assert [r[0] for r in df.select(feeds.admission(F.col("t"), F.lit(True), at, now)).collect()] == ["eligible", "future", "eligible", "older", "invalid", "undated"]
    titles = spark.createDataFrame([("AI chips",), ("said",), ("人工智能",), ("芯片",), ("ＡＩ",)], "t string")
    assert [r.m for r in titles.select(feeds.keyword_match(F.col("t"), "AI").alias("m")).collect()] == [True, False, True, False, True]
    assert all(r.m for r in titles.select(feeds.keyword_match(F.col("t"), " ").alias("m")).collect())


def test_chunks():
    rng = random.Random(8)
    for _ in range(100):
        t = "".join(rng.choice("字a。；\n ") if rng.random() < 0.2 else "字" for _ in range(rng.randint(0, 2500)))
        for s, e, part in chunks.overlapping()(t):
            assert e - s <= 340 and t[s:e].strip() == part
        assert "".join("".join(p.split()) for *_, p in chunks.windows(200)(t)) == "".join(t.split())
        spans = list(chunks.lossless(lambda x: len(x) + 2, 30)(t))
        assert "".join(p for *_, p in spans) == t.strip() and all(len(p) + 2 <= 30 for *_, p in spans) and all(t[s:e] == p for s, e, p in spans)
    assert [r[:2] for r in chunks.packed_rows(["a"], [["x" * 200], ["y" * 200], ["z"]], "元")] == [(1, 1), (2, 3)]
    assert chunks.clusters([1, 2, 10, 2.5, 11]) == [(1 + 2 + 2.5) / 3, 10.5]
    assert chunks.unsuppressed([(0, 0, 10, 10), (1, 1, 9, 9), (20, 0, 30, 10)]) == [0, 2]
    assert chunks.excerpt("短。", ["x"]) == "短。"
    long = "甲" * 300 + "。" + "净利润为5亿元。" + "乙" * 400 + "。"
    assert chunks.excerpt(long, ["净利"]).startswith("…净利润为5亿元。")
    assert chunks.budgeted([(1, "a" * 100, 0), (2, "b" * 100, 2), (3, "c" * 5000, 1)]) == [(2, "b" * 100), (3, "c" * 4900)]
    assert chunks.mean_vector([[1.0, 0.0], [0.0, 1.0]], [3, 4]) == [0.6, 0.8]


def test_sections(spark):
    starts = spark.createDataFrame([("a", "x", 3), ("a", "y", 7)], "k string, section string, start_page int")
    counts = spark.createDataFrame([("a", 9)], "k string, page_count int")
    pages = spark.createDataFrame([("a", p) for p in (1, 3, 6, 7, 9, 10)] + [("b", 1)], "k string, pdf_page int")
    got = {(r.k, r.pdf_page): r.chapter for r in tables.as_of_section(pages, tables.section_ranges(starts, counts, ["k"]), ["k"], sentinel="?").collect()}
    assert got == {("a", 1): "?", ("a", 3): "x", ("a", 6): "x", ("a", 7): "y", ("a", 9): "y", ("a", 10): "?", ("b", 1): "?"}
    rows = spark.createDataFrame([("a", None, "u1"), ("a", "2024-01-01", "u2"), ("b", None, "u3")], "k string, d string, u string").withColumn("d", F.col("d").cast("date"))
    assert {r.k: r.u for r in tables.latest_edition(rows, "k", "d", "u").collect()} == {"a": "u2", "b": "u3"}


def test_fixed_windows_batch_equals_stream(spark, small):
    from quern.session import table
    from quern.streaming import jobs

    batch = {tuple(r) for r in state.fixed_windows(table(spark, small, "events")).collect()}
    assert batch == {tuple(r) for r in jobs.window_limits(spark, small).collect()} and batch


def test_fixed_windows_rule(spark):
    times = [0, 10, 20, 30, 40, 50, 899, 900, 2000]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r.nth, r.allowed) for r in state.fixed_windows(df).orderBy("event_id").collect()]
    assert got == [(1, True), (2, True), (3, True), (4, True), (5, True), (6, False), (7, False), (1, True), (1, True)]


def test_classifier_held_out(spark):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[k]], k) for i in range(300) for k in [0 if rng.random() < 0.6 else rng.choice([1, 2])]]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    model = learning.fit_linear(e.where("vec_id % 5 <> 0"), "embedding", "label", "vec_id")
    got = learning.predicted(model, e.where("vec_id % 5 = 0"), "embedding")
    assert got.where("prediction = label").count() / got.count() >= 0.95
    weights = {r.label: r.w for r in learning.balanced_weights(e, "label").groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert all(abs(w - 100) < 1e-6 for w in weights.values())


def test_classifier_predicts_after_observation_in_the_same_session(spark):
    from pyspark.sql import Observation

    e = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2], i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int")
    model = learning.fit_linear(e, "embedding", "label", "vec_id")
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 5
    again = learning.fit_linear(e, "embedding", "label", "vec_id")
    for m in (model, again):
        assert learning.predicted(m, e, "embedding").where("prediction = label").count() == 40
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.prediction for r in learning.predicted(model, odd, "embedding").orderBy("vec_id").collect()] == [None, None, 0.0]


def test_items_held_whole(spark):
    rng = random.Random(3)
    items = ["a" * 5, "b", "", "甲" * 30, "x" * 100, "".join(rng.choice("abc") for _ in range(16)), None]
    texts = [rng.choice(["", "zz"]) + (rng.choice(items) or "q") + "".join(rng.choice("abcx甲") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", None, "x" * 99]
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "d long, t string"), spark.createDataFrame(list(enumerate(items)), "i long, t string")
    got = {tuple(r) for r in dedup.holders(docs, "d", F.col("t"), asked, "i", F.col("t")).collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if t and x and x in t}
    assert dedup.holders(docs.limit(0), "d", F.col("t"), asked, "i", F.col("t")).count() == 0 == dedup.holders(docs, "d", F.col("t"), asked.limit(0), "i", F.col("t")).count()


def test_classifier_covers_every_vector(spark):
    from quern.plans.chunks import classified

    rng = random.Random(7)
    rows = [(i, [4.0 * k + rng.gauss(0, 0.3), 1.0 - k], None if i % 3 == 0 else k) for i in range(60) for k in [i % 2]]
    got = {r.vec_id: r for r in classified(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert set(got) == set(range(60)) and all(r.predicted == i % 2 for i, r in got.items())
    assert {i for i, r in got.items() if r.held_out} == {i for i in range(60) if i % 5 == 0 and i % 3}
