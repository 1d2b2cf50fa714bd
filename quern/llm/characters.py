"""Problem 2: text that looks alike but is spelled with other characters, brought to one spelling.

Method: DuckDB runs inside the Arrow partitions. Its embedded SQL applies nfc_normalize, translate and regular expressions: emoji
sequences are put under protection, invisible characters removed, compatibility forms and look-alike ideographs translated, accents
composed, and look-alike letters replaced in words that also hold Latin letters. A text is a case if any of these steps changes it.

Defined cases: null text stays null and is no case; empty text stays empty; words wholly of another alphabet, emoji sequences,
Chinese and typographic punctuation, precomposed accents, superscripts, circled and Roman numerals stay as they are; a zero-width
joiner or non-joiner within an alphabet that needs it (Arabic, Indic scripts) stays; ids delivered several times count once in
p2_found, and a null id is no case; texts of any length are handled whole; further columns are ignored.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrow import map_columns

# Look-alike letters of other alphabets (and Latin's own odd forms) and the Latin letters they look like.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "в": "ʙ", "к": "ĸ",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "ο": "o", "ν": "v", "α": "ɑ", "ι": "ı", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "κ": "ĸ", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g",
}
# Letters that only resemble a letter of another size or shape stand for the ordinary one.
LOOK_ALIKES |= {"в": "b", "к": "k", "κ": "k", "α": "a", "ι": "i"}

# Radicals of the CJK supplement, each followed by the ideograph it looks like.
_RADICALS = (
    "⺁厂 ⺂乛 ⺃乚 ⺄乙 ⺅亻 ⺆冂 ⺇几 ⺈刀 ⺉刂 ⺊卜 ⺋㔾 ⺌小 ⺍小 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺗㣺 ⺘扌 ⺙攵 ⺛旡 ⺜日"
    " ⺝月 ⺞歺 ⺟母 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺥爫 ⺦丬 ⺧牛 ⺨犭 ⺩王 ⺪疋 ⺫目 ⺬示 ⺭礻 ⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺶羊 ⺹耂 ⺺肀 ⺼月 ⺽臼"
    " ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页"
    " ⻛风 ⻜飞 ⻝食 ⻞飠 ⻟飠 ⻠饣 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀 ⻳龟"
)


def _single_forms() -> dict[str, str]:
    """Character by character: widths, mathematical letters, radicals, compatibility ideographs and spaces, by Unicode's own rules."""
    out = {}
    ranges = [(0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF05, 0xFF05), (0xFF65, 0xFFDC), (0x1D400, 0x1D7FF), (0x2F00, 0x2FD5), (0xF900, 0xFAD9), (0x2F800, 0x2FA1D), (0x2102, 0x2138), (0x1F100, 0x1F10A)]
    for low, high in ranges:
        for code in range(low, high + 1):
            c = chr(code)
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and len(plain) == 1 and unicodedata.category(plain)[0] in "LN" or code == 0xFF05:
                out[c] = plain
    out |= {pair[0]: pair[1] for pair in _RADICALS.split()}
    out |= {chr(c): " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    return {k: v for k, v in out.items() if k not in "ΩKÅ℃℉№™ℓ℮℗"}


_FORMS = _single_forms() | {"\u212a": "K", "\u212b": "\u00c5", "\u2126": "\u03a9"}
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

_EMOJI = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}\x{2190}-\x{21FF}\x{200D}\x{FE0F}©®0-9#*"
_ORDINARY_INVISIBLE = r"\x{AD}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}"
_JOINED = r"\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}\p{Mongolian}"
_PICTURE = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}\x{2190}-\x{21FF}"
#: Noncharacters stand for protected joiners and selectors while invisible characters are removed.
_ZWJ, _VS, _ZWNJ = "\\x{FDD0}", "\\x{FDD1}", "\\x{FDD2}"
_KEEP = {"‍": "﷐", "️": "﷑", "‌": "﷒"}

_LATIN = r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"
_WORD = r"\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Nd}\x{300}-\x{36F}"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


def _only(text: str, chars: str, step: str) -> str:
    """The step, taken only where the text has one of the characters (a class's inside); elsewhere it would change nothing."""
    return f"CASE WHEN regexp_matches({text}, '[{chars}]') THEN {step} ELSE {text} END"


def _sql() -> str:
    """The query over table batch(k, t): the clean text of each row, by steps."""
    like_from, like_to = "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values())
    like = _class(LOOK_ALIKES)
    mixed = f"[{_LATIN}][{_WORD}]*[{like}]|[{like}][{_WORD}]*[{_LATIN}]"
    odd = f"[{_ORDINARY_INVISIBLE}\\x{{200C}}\\x{{200D}}\\x{{300}}-\\x{{36F}}{_class(_FORMS)}{_class(_LIGATURES)}{like}]"
    protect = "t"
    for _ in range(2):  # twice, as neighbouring matches share a picture
        protect = f"regexp_replace({protect}, '([{_PICTURE}][\\x{{1F3FB}}-\\x{{1F3FF}}]?\\x{{FE0F}}?)\\x{{200D}}([{_PICTURE}])', '\\1﷐\\2', 'g')"
        protect = f"regexp_replace({protect}, '([{_JOINED}])\\x{{200C}}([{_JOINED}])', '\\1﷒\\2', 'g')"
        protect = f"regexp_replace({protect}, '([{_JOINED}])\\x{{200D}}([{_JOINED}])', '\\1﷐\\2', 'g')"
    protect = f"regexp_replace({protect}, '([{_PICTURE}©®0-9#*])\\x{{FE0F}}', '\\1﷑', 'g')"
    protect = _only("t", "\\x{200C}\\x{200D}\\x{FE0F}", protect)
    visible = f"regexp_replace(t, '[{_ORDINARY_INVISIBLE}\\x{{200C}}\\x{{200D}}]', '', 'g')"
    wide = r"([\x{FF10}-\x{FF19}])\x{FF0E}([\x{FF10}-\x{FF19}])"
    plain = f"regexp_replace(regexp_replace(t, '{wide}', '\\1.\\2', 'g'), '{wide}', '\\1.\\2', 'g')"  # twice, as neighbours share a digit
    plain = _only("t", r"\x{FF0E}", plain)
    # building a translation costs in proportion to its size, so it is built only for texts with one of its characters, and the common ones apart
    usual = {k: v for k, v in _FORMS.items() if "\u2000" <= k <= "\u3000" or k >= "\uff00" or k == "\xa0"}
    steps = [f"SELECT k, raw, {plain} AS t FROM s1"]
    for forms in (usual, {k: v for k, v in _FORMS.items() if k not in usual}):
        steps.append(_only("t", _class(forms), f"translate(t, {_quote(''.join(forms))}, {_quote(''.join(forms.values()))})"))
    ligatures = "t"
    for k, v in _LIGATURES.items():
        ligatures = f"replace({ligatures}, {_quote(k)}, {_quote(v)})"
    steps.append(_only("t", _class(_LIGATURES), ligatures))
    forms_sql = steps[0]
    for step in steps[1:]:
        forms_sql = f"SELECT k, raw, {step} AS t FROM ({forms_sql})"
    words = f"list_transform(regexp_extract_all(t, '[{_WORD}]+|[^{_WORD}]+'), lambda w: CASE WHEN regexp_matches(w, {_quote(mixed)}) THEN translate(w, {_quote(like_from)}, {_quote(like_to)}) ELSE w END)"
    return f"""
        WITH s0 AS (SELECT k, t AS raw, {protect} AS t FROM batch WHERE regexp_matches(t, {_quote(odd)})),
             s1 AS (SELECT k, raw, {visible} AS t FROM s0),
             s2 AS ({forms_sql}),
             s3 AS (SELECT k, raw, nfc_normalize({_only("t", like, f"array_to_string({words}, '')")}) AS t FROM s2)
        SELECT k, translate(t, '﷐﷑﷒', {_quote("".join(_KEEP))}) AS t FROM s3
        WHERE translate(t, '﷐﷑﷒', {_quote("".join(_KEEP))}) <> raw
    """


class Cleaner:
    """DuckDB in one Python worker; clean() takes a list or Arrow array of texts."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.sql = _sql()

    def changed(self, texts: pa.Array) -> tuple[list[int], list[str]]:
        """(positions, clean texts) of the texts that cleaning changes."""
        batch = pa.table({"k": pa.array(range(len(texts)), pa.int64()), "t": texts})
        self.db.register("batch", batch)
        out = self.db.sql(self.sql).to_arrow_table()
        self.db.unregister("batch")
        return out["k"].to_pylist(), out["t"].to_pylist()

    def clean(self, texts: pa.Array) -> list[str | None]:
        result = texts.to_pylist()
        for k, t in zip(*self.changed(texts)):
            result[k] = t
        return result


_cleaners: list[Cleaner] = []


def cleaner() -> Cleaner:
    """This worker process's cleaner, made for its first task and kept for the others."""
    if not _cleaners:
        _cleaners.append(Cleaner())
    return _cleaners[0]


def clean_texts(df: DataFrame, id_col: str, text_col: str, only_changed: bool = False) -> DataFrame:
    """(record_id, clean_text, changed) per row; with only_changed just the rows whose text is a case."""

    def make():
        tool = cleaner()

        def step(batch: dict[str, pa.Array]) -> dict[str, list]:
            where, texts = tool.changed(batch["t"])
            ids = batch["i"].to_pylist()
            if only_changed:
                return {"record_id": [ids[k] for k in where], "clean_text": texts, "changed": [True] * len(where)}
            result, changed = batch["t"].to_pylist(), [False] * len(ids)
            for k, t in zip(where, texts):
                result[k], changed[k] = t, True
            return {"record_id": ids, "clean_text": result, "changed": changed}

        return step

    slim = df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    return map_columns(slim, make, "record_id string, clean_text string, changed boolean")


def flagged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct non-null ids whose text is spelled with other characters."""
    return clean_texts(df.where(F.col(id_col).isNotNull()), id_col, text_col, only_changed=True).select("record_id").distinct()
