import random

from quern.llm import leakage as K


def brute(items, text, least):
    return {i for i, s in items.items() if any(s[k : k + least] in text for k in range(len(s) - least + 1))}


def test_against_substrings():
    rng = random.Random(5)
    for least in (3, 5, 8):
        for _ in range(60):
            items = {i: "".join(rng.choice("ab") for _ in range(rng.randint(0, 25))) for i in range(5)}
            matcher = K.Matcher(K.SuffixAutomaton(items, least))
            for _ in range(10):
                text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
                assert matcher.leaks(text) == brute(items, text, least)


def test_table(spark, monkeypatch):
    passage = "Der Wert betrug 1,234 Einheiten; danach folgte der zweite Abschnitt mit ÜBERSICHT"
    quoted = passage.upper().replace("1,234", "１ 234").replace(" ", " - ")
    items = spark.createDataFrame([(1, passage), (1, passage), (2, "kurz"), (3, None), (4, "vorne " + passage), (None, passage)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x " + quoted + " y", 0), (1, "x " + quoted + " y", 0), (2, passage[:40], 0), (3, None, 0), (4, "", 0), (None, passage, 0), (5, "z" * 300_000 + passage, 0)], "doc_id long, text string, item_id long"
    )
    want = {(1, 1), (1, 4), (5, 1), (5, 4)}
    assert {tuple(r) for r in K.leaked(docs, items).collect()} == want
    monkeypatch.setattr(K.item_parts, "__defaults__", (60, 50))
    assert {tuple(r) for r in K.leaked(docs, items).collect()} == want
    assert K.leaked(docs, items.limit(0)).count() == 0 == K.leaked(docs.limit(0), items).count()


def test_spans_against_substrings():
    rng = random.Random(6)
    for least in (3, 5):
        for _ in range(60):
            items = {i: "".join(rng.choice("ab") for _ in range(rng.randint(0, 25))) for i in range(4)}
            matcher = K.Matcher(K.SuffixAutomaton(items, least))
            text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
            held = [any(text[k : k + least] in s for s in items.values() for k in range(max(0, i - least + 1), i + 1) if k + least <= len(text)) for i in range(len(text))]
            got = [False] * len(text)
            for low, high in matcher.spans(text):
                got[low:high] = [True] * (high - low)
            assert got == held


def test_cleaned(spark, monkeypatch):
    passage = "Der Wert betrug 1,234 Einheiten; danach folgte der zweite Abschnitt mit U\u0308BERSICHT"
    items = spark.createDataFrame([(1, passage), (2, "Ein anderer langer Satz ohne jede Verbindung zu dem ersten, der auch im Text steht")], "item_id long, text string")
    rest = "eigener Text " * 20
    other = "Ein anderer langer Satz ohne jede Verbindung zu dem ersten, der auch im Text steht"
    docs = [(1, f"{rest}«{passage.upper()}»{rest}"), (2, f"{passage}!"), (3, rest), (4, None), (5, ""), (6, f"{rest}{passage} {rest}{other}{rest}"), (7, passage[:40]), (None, passage)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string")
    for most in (500_000, 70):  # in one part and in two
        monkeypatch.setattr(K.item_parts, "__defaults__", (most, 50))
        got = {r.doc_id: r for r in K.cleaned(frame, items).collect()}
        assert set(got) == {1, 2, 3, 4, 5, 6, 7}
        assert got[1].clean_text == f"{rest}«»{rest}" and not got[1].dropped and len(got[1].spans) == 1
        assert got[2].clean_text is None and got[2].dropped and got[2].covered == 1.0
        assert got[3].clean_text == rest and got[4].clean_text is None and not got[4].dropped and got[5].clean_text == "" and got[7].clean_text == passage[:40]
        assert got[6].clean_text == f"{rest} {rest}{rest}" and len(got[6].spans) == 2
    assert K.cleaned(frame.limit(0), items).count() == 0 and K.cleaned(frame, items.limit(0)).count() == 7
