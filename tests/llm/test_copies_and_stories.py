import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import copies, graph, runs, stories
from quern.llm.keys import title_key, url_key, words

SCHEMA = "entry_id long, batch_no int, title string, url string, keep_id string"
U = "https://a.example/p/1?id=2&cat=x"


def test_url_keys(spark):
    same = [U, " HTTPS://www.A.example:443/p/1/?cat=x&id=2#top ", U + "&utm_source=r&UTM_Content=2&GCLID=1&from=q&spm=", U + "\n"]
    others = [U, "https://a.example/p/1?id=3&cat=x", "https://a.example:8443/p/1?id=2&cat=x", "https://a.example/P/1?id=2&cat=x", "https://m.a.example/p/1?id=2&cat=x"]
    none = [None, "", "http://a.example/", "a.example", "https://", "mailto:x"]
    keys = {r.u: r.k for r in spark.createDataFrame([(u,) for u in same + others + none], "u string").select("u", url_key(F.col("u")).alias("k")).collect()}
    assert len({keys[u] for u in same}) == 1 and len({keys[u] for u in others}) == 5 and {keys[u] for u in none} == {None}
    assert title_key("A-b, 9 É!") == "ab9é" and title_key("…") is None


def test_words():
    assert words("Update: Marsona ships the 4E-6E for 3789 homes") == (["3789", "4e", "6e"], ["for", "the"], ["the-", "for-"], ["homes", "marsona", "ships", "update"], [])
    assert words("The new Marsona GF-X chip")[4] == ["marsona"]


@pytest.fixture(scope="module")
def entries(spark):
    rows = [
        (1, 0, "Torsona ships 120 units of the chip GF-X2 this season", U), (2, 0, "TORSONA  ships 120 units of the chip GF X2, this season!", U.upper().replace("/P/1?ID=2&CAT=X", "/p/1?cat=x&id=2")),
        (3, 0, "Torsona ships 120 units of the chip GF-X3 this season", "https://a.example/p/3"), (4, 0, None, U), (5, 0, "No address here", None), (6, 0, "", ""), (7, 0, "Plain http", "http://a.example/"),
        (8, 1, "Update: Torsona delivers 120 units of the chip GF-X2 this season", "https://b.example/9"), (9, 1, "Torsona ships 121 units of the chip GF-X2 this season", "https://b.example/10"),
        (10, 2, "Something else altogether", "https://b.example/9/"), (11, 2, "something ELSE: altogether", "https://c.example/1"), (11, 2, "something ELSE: altogether", "https://c.example/1"),
        (12, 3, "no address here.", "http://x.example"), (None, 3, "Something else altogether", "https://c.example/1"), (13, None, "Something else altogether", U),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_copies(entries):
    assert {tuple(r) for r in copies.further_copies(entries).collect()} == {(1, 2)}
    counts = {r.keep_id: r.copies for r in copies.copy_counts(entries).collect()}
    assert counts[1] == 2 and counts[11] == 2 and counts[3] == 1
    assert copies.further_copies(entries.limit(0)).count() == 0


def test_stories(entries, spark):
    want = {(1, 8), (1, 10), (1, 11), (5, 12)}
    assert {tuple(r) for r in stories.p7_pairs(entries).collect()} == want
    index = stories.StoryIndex(spark)
    for batch in range(4):
        index.ingest(entries.where(f"batch_no = {batch}"))
    assert {tuple(r) for r in index.found().collect()} == want
    assert stories.p7_pairs(entries.limit(0)).count() == 0


def test_codes_are_told_by_their_title(spark):
    hard = {
        "Torsona dévoile le clé 3A-DE et promet 12 livraisons": ["12", "3a", "de"], "Torsona opens the chip 39\u2011UP for 12 homes": ["12", "39", "up"], "Norkor dévoile 3A DE et promet": ["3a", "de"],
        "norkor zeigt 3a-de von morgen": ["3a", "de"], "NORKOR ZEIGT 5R RL MIT KÜHLUNG": ["5r", "rl"], "NORKOR ZEIGT 4J-5H VON MORGEN": ["4j", "5h"], "The new Marsona GF-X chip": ["gf", "x"],
        "Norkor shows A chip for 12 of us": ["12"], "凌频云发布 39-ME芯片": ["39", "me"],
    }
    assert {t: words(t)[0] for t in hard} == hard
    # no code of the later batches is in the history, where the same pieces are common words
    rows = [(i, 0, f"Marsona {w} le du de up Nr {i}", None, None) for i, w in enumerate(("liefert", "ruft", "testet"), 1)]
    rows += [(10 + i, 1 + i % 2, f"Fenpelo dévoile le clé sécurisée 3A-{c} et promet 9496 livraisons avant l’été", None, None) for i, c in enumerate(("DE", "LE", "DU", "QX", "QY"))]
    rows.append((20, 3, "Update : Fenpelo dévoile le clé sécurisée 3A-DE et promet 9496 livraisons avant l’été", None, None))
    assert {tuple(r) for r in stories.p7_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == {(10, 20)}


def _by_hand(rows):
    """(accepted, entry) by comparing every two titles; rows are (entry_id, batch_no, title)."""
    told = {e: words(t) for e, _, t in rows}
    parent = {e: e for e, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (e, _, s), (f, _, t) in itertools.combinations(rows, 2):
        (h, short, _, soft, names), (k, other, _, words_f, names_f) = told[e], told[f]
        if title_key(s) == title_key(t) or stories.same_story(" ".join(h), {*short, *soft}, set(names), " ".join(k), {*other, *words_f}, set(names_f)):
            a, b = sorted((root(e), root(f)))
            parent[b] = a
    out = set()
    for e, batch, _ in rows:
        mine = [(f, b) for f, b, _ in rows if root(f) == root(e)]
        if min(b for _, b in mine) < batch and min(f for f, _ in mine) < e:
            out.add((min(f for f, _ in mine), e))
    return out


def _titles(rng, n, codes):
    vocabulary = [a + b for a in ("mer", "tal", "vor", "kin", "sul", "pra") for b in ("ta", "li", "mon", "den", "fix")]
    rows, bases = [], [[rng.choice(vocabulary) for _ in range(rng.randint(3, 8))] for _ in range(n // 4)]
    for e in range(1, n + 1):
        ws = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        rows.append((e, 3 * e // n, " ".join(ws) + (rng.choice([" 7", " 8", ""]) if codes else "")))
    return rows


@pytest.mark.parametrize("codes", [False, True])
def test_rewordings_without_rare_codes_against_all_pairs(spark, codes, monkeypatch):
    rows = _titles(random.Random(5), 240, codes)
    want = _by_hand(rows)
    frame = spark.createDataFrame([(e, b, t, None, None) for e, b, t in rows], SCHEMA)
    assert {tuple(r) for r in stories.p7_pairs(frame).collect()} == want and len(want) > 60
    monkeypatch.setattr(stories, "BLOCK", 5)  # every list of more than five titles is cut
    index = stories.StoryIndex(spark)
    for low, high in ((0, 1), (2, 3)):
        index.ingest(frame.where(f"batch_no between {low} and {high}"))
    assert {tuple(r) for r in index.found().collect()} == want


def test_any_division_into_batches_gives_the_same(spark):
    rows = [(e, 0 if e < 12 else 1 if e < 30 else b, t) for e, b, t in _titles(random.Random(9), 120, True)]
    frame = spark.createDataFrame([(e, b, t, None, None) for e, b, t in rows], SCHEMA)
    index = stories.StoryIndex(spark, parts=4)
    index.ingest(frame.limit(0), "nothing")
    for low, high in ((0, 0), (1, 1), (2, 3)):  # from next to nothing: the order is counted anew as the titles double
        assert index.ingest(frame.where(f"batch_no between {low} and {high}"), f"{low}")
    assert index.generation > 0
    assert {tuple(r) for r in index.found().collect()} == _by_hand(rows)


def test_batches_are_taken_in_once_and_whole(spark, entries):
    index = stories.StoryIndex(spark)
    assert index.ingest(entries.where("batch_no = 0"), "a") and not index.ingest(entries.where("batch_no = 0"), "a")
    again = stories.StoryIndex(spark, index.path)
    assert again.commits == index.commits
    again._write("marks", again.read("marks"), 0)  # an attempt that did not come to its commit
    assert again.ingest(entries.where("batch_no > 0"), "b")
    assert {tuple(r) for r in stories.StoryIndex(spark, index.path).found().collect()} == {(1, 8), (1, 10), (1, 11), (5, 12)}
    with pytest.raises(RuntimeError):
        index._commit(label="late", generation=0, titles=0, ranked_at=0, tables=[])


def test_a_small_batch_reads_little_of_the_history(spark):
    rows = _titles(random.Random(3), 400, False)
    history = spark.createDataFrame([(e, 0, f"{t} {1000 + e}", f"https://a.example/{e}", None) for e, _, t in rows], SCHEMA)
    index = stories.StoryIndex(spark, parts=64)
    index.ingest(history)
    for name, of in (("marks", spark.range(1).select(F.col("id").alias("a"))), ("postings", spark.range(1).select(F.lit("h1001").alias("token")))):
        assert index.read(name, of).count() < index.read(name).count() / 10
    assert index.ingest(spark.createDataFrame([(9001, 1, f"{rows[0][2]} 1001", None, None)], SCHEMA))
    assert [tuple(r) for r in index.found().collect()] == [(1, 9001)]


def test_batch_by_batch_equals_backlog(spark, small):
    from quern.session import table

    whole = table(spark, small, "feed_entries")
    index, backlog = stories.StoryIndex(spark), stories.StoryIndex(spark)
    for low, high in ((0, 0), (1, 3), (4, 10)):
        index.ingest(whole.where(f"batch_no between {low} and {high}"))
    backlog.ingest(whole)
    assert {tuple(r) for r in index.found().collect()} == {tuple(r) for r in backlog.found().collect()}


def test_runs_across_partitions(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", None if i % 50 == 0 else "u") for i in range(1, 4000)]
    got = {r.entry_id: r.keep_id for r in runs.first_of_runs(spark.createDataFrame(rows, "entry_id long, a string, b string"), ["a", "b"]).collect()}
    first = {}
    for i, *key in rows:
        if None not in key:
            first.setdefault(tuple(key), i)
    assert got == {i: first[tuple(k)] for i, *k in rows if None not in k}


def test_components(spark):
    import random

    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
