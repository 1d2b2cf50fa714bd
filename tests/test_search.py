import itertools
import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import functions as F

from quern import session
from quern.functions import fold, small, text
from quern.operators import citations, dedup, retrieval, search, vectors
from quern.plans import search as plans


def one(spark, column, **values):
    fields = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], fields).select(column).first()[0]


def test_what_is_asked_wrongly_is_refused():
    for bad in ("", "  ", "x" * 3001, None):
        with pytest.raises(ValueError):
            search.check_query(bad)
    assert search.check_query("x" * 3000)
    with pytest.raises(ValueError):
        search.check_mode("fuzzy", True)
    for mode in ("dense", "hybrid"):
        with pytest.raises(search.DenseNotReady):
            search.check_mode(mode, False)
    assert [search.clamped(n) for n in (None, 0, -3, 7, 1000)] == [10, 10, 1, 7, 100]


def test_hits_of_each_mode(spark):
    words = spark.createDataFrame([(1, 5, 2.0), (1, 3, 1.0), (1, 9, 1.0)], "q long, d long, score double")
    dense = spark.createDataFrame([(1, 3, 0.9), (1, 4, 0.8), (1, 5, -0.1)], "q long, d long, score double")
    plain = search.hits(words, None, "q", "d", "bm25", 2).orderBy("rank").collect()
    assert [(r.d, r.bm25_rank, r.dense_rank, r.hybrid_rank) for r in plain] == [(5, 1, None, None), (3, 2, None, None)]
    got = {r.d: r for r in search.hits(words, dense, "q", "d", "hybrid").collect()}
    assert got[3].hybrid_rank == 1 and math.isclose(got[3].score, 1 / 62 + 1 / 61, abs_tol=1e-8) and set(got) == {3, 4, 5, 9}
    assert [r.d for r in search.hits(words, dense, "q", "d", "dense").orderBy("rank").collect()] == [3, 4, 5]
    with pytest.raises(search.DenseNotReady):
        search.hits(words, None, "q", "d", "dense")


def test_scope_and_ids(spark):
    rows = spark.createDataFrame([("甲", "1"), ("乙", "2"), (None, "3"), ("丙", None)], "company string, code string")
    keep = lambda *c: [r.k for r in rows.select(search.eligible(list(c), F.col("company"), F.col("code")).alias("k")).collect()]
    assert keep() == [True] * 4 and keep("甲", "3") == [True, False, True, False]
    ids = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], "i string")
    assert {r.chunk_id for r in search.unique_ids(ids, "i").collect()} == {"a", "", None}


def test_evidence_and_answers(spark):
    found = spark.createDataFrame([(1, "x", 1, "t", "A"), (1, "x", 2, "t", "A"), (1, "y", 3, " ", "A"), (1, "z", 4, "u", "B")], "q long, id string, rank int, text string, code string")
    cited = search.evidence(found, "q", "id", "text")
    assert [(r.id, r.citation) for r in cited.orderBy("citation").collect()] == [("x", 1), ("z", 2)]
    companies = spark.createDataFrame([("A",), ("B",), ("C",)], "code string")
    groups = {r.code: (r.found, r.n_hits, r.citations) for r in search.answer_groups(cited, found.select("q"), companies, "q").collect()}
    assert groups == {"A": (True, 1, "1"), "B": (True, 1, "2"), "C": (False, 0, "")}
    tables = spark.createDataFrame([("table", " 单位：元 ", ["项目", "单位: 千元", "单位：元", None]), ("text", "单位：元", None), ("table", None, None)], "kind string, unit string, headers array<string>")
    assert [r.c for r in tables.select(search.context_lines(F.col("kind"), F.col("unit"), F.col("headers")).alias("c")).collect()] == [["单位：元", "单位: 千元"], [], []]


def test_tfidf_against_plain_python(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc 甲乙") for _ in range(rng.randint(0, 40))) for _ in range(40)] + [None, "", "A  B\n\nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    for features in (65_000, 50):
        found, words = vectors.tfidf(docs, "d", F.col("t"), features=features)
        import re

        grams = [Counter(x[k : k + n] for x in [re.sub(r"\s\s+", " ", (t or "").lower())] for n in (2, 3, 4) for k in range(len(x) - n + 1)) for t in texts]
        df, total = Counter(g for c in grams for g in c), Counter()
        for c in grams:
            total.update(c)
        kept = sorted((g for g in df if df[g] >= 2), key=lambda g: (-total[g], g.encode()))[:features]
        assert {r.gram for r in words.collect()} == set(kept)
        want = {}
        for d, c in enumerate(grams):
            w = {g: (1 + math.log(c[g])) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g in kept if g in c}
            norm = math.sqrt(sum(x * x for x in w.values()))
            want[d] = {g: x / norm for g, x in w.items()}
        got = {(r.d, r.gram): r.weight for r in found.collect()}
        assert set(got) == {(d, g) for d, w in want.items() for g in w} and all(math.isclose(got[d, g], want[d][g], rel_tol=1e-9) for d, g in got)
        scores = {(r.q, r.d): r.score for r in vectors.cosines(found, "d", found.where("d < 3"), "q").collect()}
        for q, d in itertools.product(range(3), range(len(texts))):
            dot = sum(want[q][g] * want[d].get(g, 0) for g in want[q])
            assert math.isclose(scores.get((q, d), 0.0), dot, abs_tol=1e-6)


def test_totals_of_pieces(monkeypatch):
    """Grams are counted whatever the pieces; none spans two texts; other planes and NUL are characters too."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab甲\0\U0001f600") for _ in range(rng.randint(0, 12))) for _ in range(50)]
    want_df, want = Counter(), Counter()
    for t in texts:
        own = Counter(t[k : k + n] for n in (2, 3, 4) for k in range(len(t) - n + 1))
        want.update(own)
        want_df.update(own.keys())
    for table, most in ((1 << 24, 10**6), (1, 10**6), (1 << 24, 30)):
        monkeypatch.setattr(vectors, "_TABLE", table)
        df, total = Counter(), Counter()
        for piece in vectors._pieces(texts, most):
            for grams, d, t in vectors.piece_totals(texts[piece]):
                df.update(dict(zip(grams, d.tolist())))
                total.update(dict(zip(grams, t.tolist())))
        assert (df, total) == (want_df, want)


def test_totals_give_few_rows(spark):
    """A gram that many texts hold is one row of their piece, not one a text."""
    docs = spark.createDataFrame([(i, "abcabcabc") for i in range(200)], "d long, t string").coalesce(1)
    rows = vectors.gram_totals(docs, "d", F.col("t")).collect()
    assert {(r.gram, r.df, r.total) for r in rows if len(r.gram) == 2} == {("ab", 200, 600), ("bc", 200, 600), ("ca", 200, 400)} and len(rows) == 9


def test_nearest_against_all_pairs(spark, monkeypatch):
    """The same neighbours as from the scores of all pairs, with ties, skipped pairs, and queries in more than one block and tile."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc 甲乙丙") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:20], None])), "d long, t string")
    skip = spark.createDataFrame([(0, 60), (0, 7), (4, 5)], "q long, d long")
    found, words = vectors.tfidf(docs, "d", F.col("t"))
    scores = vectors.cosines(found, "d", found.where("d % 4 = 0"), "q").where("q <> d and score > 0")
    for tile, nbytes, scatter, skipped in ((768, 64 << 20, 1000, None), (3, 4000, 0, skip), (5, 0, 10**9, skip)):
        for name, value in (("TILE", tile), ("QUERY_BYTES", nbytes), ("_SCATTER", scatter)):
            monkeypatch.setattr(vectors, name, value)
        left = scores if skipped is None else scores.join(skipped, ["q", "d"], "left_anti")
        want = [tuple(r) for r in retrieval.ranked(left, ["q"], "d", 5).select("q", "rank", "d", "score").orderBy("q", "rank").collect()]
        near = vectors.nearest(docs, "d", F.col("t"), docs.where("d % 4 = 0"), "q", words, 5, skipped)
        got = [tuple(r) for r in retrieval.ranked(near, ["q"], "d", 5).select("q", "rank", "d", "score").orderBy("q", "rank").collect()]
        assert got == want
    assert vectors.nearest(docs, "d", F.col("t"), docs.limit(0), "q", words, 5).count() == 0


@pytest.fixture
def stored(monkeypatch):
    """The names of the tables that queries write to the shared folder."""
    names = []
    for module in (vectors, dedup):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or session.written(df, name))
    monkeypatch.setattr(plans, "written", lambda df, name: names.append(name) or session.written(df, name))
    return names


def test_neighbours_store_no_pairs(spark, small, stored):
    assert plans.tfidf_neighbours(spark, small).count() and set(stored) == {"vocabulary"}


@pytest.mark.parametrize("name", ["guarded_neighbours", "law_votes", "held_out_laws", "kind_votes"])
def test_guarded_queries_store_no_table_of_the_corpus(spark, small, stored, name):
    assert getattr(plans, name)(spark, small).count() and set(stored) == {"vocabulary", "pairs", "marked", "asked", "short"}


@pytest.mark.parametrize("name", ["held_out_laws", "kind_votes", "law_votes"])
def test_guarded_queries_fold_texts_in_workers(spark, small, monkeypatch, name):
    """No stored table is made by regular expressions of the JVM over whole texts, which took most of these queries' time."""
    made = {}
    for module in (vectors, dedup, plans):
        monkeypatch.setattr(module, "written", lambda df, name: made.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or session.written(df, name))
    assert getattr(plans, name)(spark, small).count() and "vocabulary" in made
    assert [k for k, plan in made.items() if "regexp_replace" in plan or "split(" in plan] == []


@pytest.mark.parametrize("name", ["kind_votes", "law_votes"])
def test_query_vectors_are_destroyed_once_their_pairs_are_stored(spark, small, monkeypatch, name):
    """Whatever the blocks of queries, the same rows, and no block of vectors is left on the disks."""
    want = sorted(map(tuple, getattr(plans, name)(spark, small).collect()))
    sent, left = [], []
    blocks = vectors._query_blocks
    monkeypatch.setattr(vectors, "_query_blocks", lambda *a: (sent.append(b) or b for b in blocks(*a)))
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, own=Broadcast.destroy: left.append(len(sent)) or own(self, *a))
    monkeypatch.setattr(vectors, "TILE", 1)
    monkeypatch.setattr(vectors, "QUERY_BYTES", 0)
    assert sorted(map(tuple, getattr(plans, name)(spark, small).collect())) == want
    assert len(sent) > 1 and left == list(range(1, len(sent) + 1))


def test_few_bytes_of_query_vectors_are_sent(spark, small, monkeypatch):
    """A block of query vectors lies on the disks of the driver and of each executor, so it holds no weights (12 bytes a feature with its number)."""
    sent = []
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value, own=SparkContext.broadcast: sent.append(value) or own(self, value))
    assert plans.law_votes(spark, small).count()
    known = vectors.Encoder(*sent[0])
    features = sum(len(known.vectors([fold.spaced_lower(fold.judged(r.text))])[0]) for r in spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 50 = 0 and text is not null").collect())
    assert features > 100 and 0 < len(pickle.dumps(sent[1])) < 6 * features


def test_packed_vectors_are_the_vectors():
    rng = random.Random(7)
    grams = sorted({"".join(rng.choice("abc甲乙") for _ in range(rng.randint(2, 4))) for _ in range(300)})
    for known in (vectors.Encoder(grams, np.random.default_rng(1).random(len(grams)) + 1), vectors.Encoder([], np.zeros(0))):
        texts = ["", "x", "ab" * 70_000, *("".join(rng.choice("abc甲乙 ") for _ in range(rng.randint(0, 60))) for _ in range(50)), ""]
        of, feature, weight = known.vectors(texts)
        by = np.lexsort((feature, of))
        n, *packed = known.packed(texts)
        lengths, features, weights = known.unpacked(*packed)
        assert n == len(of) and lengths.tolist() == np.bincount(of, minlength=len(texts)).tolist()
        assert features.tolist() == feature[by].tolist() and weights.tolist() == weight[by].tolist()


def test_texts_are_folded_as_in_sql(spark):
    """Lower case by single characters: no final sigma, no dotted i of two characters."""
    docs = spark.createDataFrame([(1, "ΑΣ İ"), (2, None), (None, "xy")], "d long, t string")
    assert {r.gram for r in vectors.gram_totals(docs, "d", F.col("t")).collect()} == {"ασ", "σ ", " i", "ασ ", "σ i", "ασ i"}
    assert fold.spaced_lower("A \t\x0b\nB C\u2003\u2003D") == "a b c\u2003\u2003d"
    texts = [" \x0b事实 \n本庭认为理由，本院认为", "判决如下", "无", "", "长" * 7500, " " + "头" * 2500 + "中" * 2501 + "尾" * 2500 + " ", "事实\u3000裁定如下", "裁定 如下"]
    got = spark.createDataFrame(list(enumerate(texts)), "d long, t string").select("d", text.features(F.col("t")).alias("f"), text.normal_form(F.col("t")).alias("n")).orderBy("d").collect()
    assert [(r.f, r.n) for r in got] == [(fold.judged(t), fold.normal_form(t)) for t in texts]
    assert fold.normal_form("Ａb，C1一 ㏒") == "bc1一"


def test_queries_with_many_copies_are_asked_again(spark, small, monkeypatch):
    want = sorted(map(tuple, plans.guarded(spark, small, 3).collect()))
    monkeypatch.setattr(plans, "_SPARE", 0)
    assert sorted(map(tuple, plans.guarded(spark, small, 3).collect())) == want


def test_set_votes(spark):
    rows = [(1, 0.9, 1, ["a", "b"]), (1, 0.5, 2, ["b", "c"]), (2, 0.4, 1, ["x", "y"]), (3, 0.1, 9, ["z"])]
    got = [(r.q, r.label, r.place) for r in search.set_votes(spark.createDataFrame(rows, "q long, score double, rank int, labels array<string>"), "q", "labels").orderBy("q", "place").collect()]
    assert got == [(1, "b", 1), (2, "x", 1)]


def test_citations(spark):
    text = "依照《甲法》第五条、第六条之一第二款，《关于适用《乙法》若干问题的解释》 第十二条（试行）和第十三条的规定，《丙》无条文，《丁法》与第三条，》《戊法》第一条、第一条"
    assert list(citations.cited(text)) == [("甲法", "五", None), ("甲法", "六", "一"), ("关于适用《乙法》若干问题的解释", "十二", None), ("关于适用《乙法》若干问题的解释", "十三", None), ("丁法", "三", None), ("戊法", "一", None)][:4] + [("戊法", "一", None)]
    assert list(citations.cited("《" + "长" * 500 + "法》第2条")) == [("长" * 500 + "法", "2", None)] and list(citations.cited("《《甲》第一条")) == []
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "d long, t string")
    assert citations.cited_articles(docs, "d", "t").count() == 5 and citations.cited_articles(docs.limit(0), "d", "t").count() == 0


def test_small_functions(spark):
    assert one(spark, small.strict_instant(F.col("t")), t="2026-05-01T08:00:00+08:00").isoformat() == "2026-05-01T00:00:00"
    for naive in ("2026-05-01T08:00:00", "x", ""):
        assert one(spark, small.strict_instant(F.col("t")), t=naive) is None
    assert one(spark, small.normal_mailbox(F.col("t")), t=" A.b@X.example ") == "a.b@x.example"
    for bad in ("a@b", "a b@x.example", "@x.example", "a@x..example"):
        assert one(spark, small.recipient_key(F.col("t")), t=bad) is None
    assert one(spark, small.keywords(F.col("t")), t=" a \n b " + "c" * 300) == ("a b " + "c" * 300)[:200]
    assert [one(spark, small.item_count(F.col("n")), n=n) for n in (4, 5, 20, 21)] == [12, 5, 20, 12]
    assert one(spark, small.required(F.col("t"), "title"), t=" x ") == "x"
    with pytest.raises(Exception, match="title is missing"):
        one(spark, small.required(F.col("t"), "title"), t="  ")
    at = F.timestamp_seconds(F.col("n"))
    assert one(spark, small.required_recent(at, F.timestamp_seconds(F.lit(72 * 3600))), n=0) is True
    for n in (-1, 72 * 3600 + 1):
        with pytest.raises(Exception, match="not recent"):
            one(spark, small.required_recent(at, F.timestamp_seconds(F.lit(72 * 3600))), n=n)
