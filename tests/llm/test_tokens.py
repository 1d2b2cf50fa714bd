import os
import random

import pytest

from quern.llm import tokens as T

tokenizers = pytest.importorskip("tokenizers")
LIBRARY = os.path.dirname(T.VOCABULARY) + "/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder()


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(LIBRARY)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_random_texts(encoder, library):
    rng = random.Random(3)
    alphabet = "ab'sdtmrevl  \n\t\r09.!中é　  👩‍💻́²Ⅲ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    texts += ["<|endoftext|>x", "it's we'll I'd'd ''s", " 's  's", "'", "''", "a'", "a're'r", "ab" * 3000, "中" * 3000, " " * 3000, "x" * 150]
    assert encoder.encode(texts) == library(texts)


def test_groups_do_not_matter(encoder, library, monkeypatch):
    texts = ["it's", None, "", " a", "b  ", "'s c", "中文。x"] * 7
    monkeypatch.setattr(T, "GROUP", 5)
    assert encoder.encode(texts) == [w if t else [] for t, w in zip(texts, library([t or "" for t in texts]))]


def test_round_trip_and_offsets(encoder):
    back = {v: k for k, v in encoder.ranks.items()}
    texts = ["Größe des Gerätes: 12.5 €!  \n", "报告期内，净利润增长。"]
    for text, (ids, offsets) in zip(texts, encoder.encode_with_offsets(texts)):
        assert b"".join(back[i] for i in ids).decode() == text
        assert offsets == sorted(offsets) and offsets[0] == 0 and len(offsets) == len(ids)


def test_table(spark, library):
    rows = [(1, "a b", 1), (2, None, 1), (3, "", 1), (1, "a b", 1), (4, "长" * 50_000, 1)]
    got = [(r.doc_id, r.ids) for r in T.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()]
    assert sorted(got) == sorted((d, library([t])[0] if t else []) for d, t, _ in rows)
    assert T.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
