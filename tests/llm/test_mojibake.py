import pytest

from quern.llm import mojibake as M

ZH = "报告期内，本行实现营业收入增长，董事会审议通过年度方案。"
DE = "Größere Änderungen über den Prüfstand für 48 € – „schön“"


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "mac_roman", "gb18030"])
def test_wrong_decodings_of_utf8_come_back(wrong):
    for text in (ZH, DE) if wrong != "gb18030" else (ZH,):
        raw = text.encode()
        bad = "".join(chr(b) if wrong == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(wrong) for b in raw) if wrong != "gb18030" else raw.decode(wrong, "replace")
        now, spans, garbled = M.restored("前文。" + bad + "后文。")
        assert garbled and spans
        if "�" not in bad:
            assert now == "前文。" + text + "后文。"


def test_twice_wrong_and_gb_read_as_latin():
    twice = DE.encode().decode("latin-1").encode().decode("latin-1")
    assert M.restored(twice)[0] == DE
    assert M.restored(ZH.encode("gb18030").decode("latin-1")) == (ZH, 1, True)


def test_lost_text_is_told():
    assert M.restored(ZH.encode("gb18030").decode("utf-8", "replace"))[2]
    assert M.restored("a � b") == ("a � b", 0, True)


def test_other_texts_are_left_alone():
    for text in (ZH, DE, "ÂME und SÃO", "PÂTISSERIE ET CHÂTEAU", "“CAFÉ»", "£4446 «É»", "Ä“ Ö“ „Spaß“", "créée, naïf", "カタログ・안내", "Север αβ", "𠮷野与㴪水 🚀", "１２３％ ⅶ ℃", "", None, "ÄÖÜ äöü ß"):
        assert M.restored(text) == (text, 0, False), text


def test_table(spark):
    bad = ZH.encode().decode("gb18030", "replace")
    df = spark.createDataFrame([(1, bad, 0), (1, bad, 0), (2, ZH, 0), (3, None, 0), (4, "", 0), (None, bad, 0), (5, "好" * 100_000 + bad, 0)], "doc_id long, text string, spans int")
    assert {r.doc_id for r in M.garbled(df).collect()} == {1, 5}
    assert M.restore(df).count() == 7 and M.garbled(df.limit(0)).count() == 0


def test_any_number_of_wrong_decodings():
    for times in (7, 12):
        for text in ("Größe für Übermut", "Bürgermeister"):
            bad = text
            for _ in range(times):
                bad = bad.encode("utf-8").decode("latin-1")
            assert M.restored(bad)[0] == text and M.restored(bad)[2]
