"""Problem 10: text that was once decoded in the wrong character encoding, found and restored where it is still determined.

Method: characters are mapped back to the bytes of a legacy encoding; a byte-structure automaton finds maximal well-formed multibyte
spans in them, and only those spans are decoded anew. Three ways of going wrong are undone, as often as they were stacked:
UTF-8 read as a single-byte encoding (Windows-1252 and Latin-1 together, or Mac Roman), UTF-8 read as GB18030, and GB18030 read as
Windows-1252 or Latin-1. The automata are byte regular expressions, which the standard library compiles to state machines.

A span counts only if its structure cannot well be chance: see the constants. Replacement characters (U+FFFD) and C1 control
characters mark text that is garbled beyond or beside restoration; what they replaced is not guessed at.

Defined cases: null and empty texts are not garbled and stay as they are; single accented capitals, foreign words, rare characters,
emoji and other scripts are not garbled; texts of any length are handled whole; a null doc_id is left out of p10_found; repeated rows
count once there; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrow import map_columns

#: What share of a run of upper-half characters well-formed spans must cover.
SHARE_WINDOWS, SHARE_MAC = 0.6, 0.8
#: Chance well-formed spans are shorter: Han characters in a span of UTF-8 read as GB18030, pairs in one of GB18030 read as Latin.
LEAST_HAN, LEAST_PAIRS = 3, 2


def _single_byte(name: str, c1: bool) -> dict[int, int]:
    """Code point to byte of a single-byte encoding's upper half; with c1 undefined bytes and C1 controls stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            pass
        if c1:
            out.setdefault(b, b)
    return out


_WINDOWS, _MAC = _single_byte("cp1252", True), _single_byte("mac_roman", False)
_UTF8 = (
    rb"[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    rb"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)
_SPAN = re.compile(rb"(?:" + _UTF8 + rb")+")
_LONG = re.compile(rb"[\xE0-\xF4]")
_CLASS = {id(m): "[" + re.escape("".join(map(chr, m))) + "]" for m in (_WINDOWS, _MAC)}
_RUN = {k: re.compile(v + "{2,}") for k, v in _CLASS.items()}


def _likely(decoded: str, raw: bytes) -> bool:
    """Whether text decoded from single bytes is text rather than chance: two-byte characters other than Latin ones need company."""
    if any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in decoded):
        return False
    if _LONG.search(raw):
        return True
    return raw[0] in (0xC2, 0xC3) or (len(decoded) > 2 and len({unicodedata.name(c, " ").split()[0] for c in decoded}) == 1)


def _from_single(text: str, table: dict[int, int], least: float) -> tuple[str, int]:
    """(text with well-formed UTF-8 spans of a single-byte encoding decoded, their number); spans must cover a share of their run."""
    found = 0

    def repair(m: re.Match) -> str:
        nonlocal found
        run = m[0]
        raw = bytes(map(table.__getitem__, map(ord, run)))
        spans = [(s.start(), s.end(), d) for s in _SPAN.finditer(raw) if _likely(d := s[0].decode("utf-8"), s[0]) and not (table is _MAC and _C1.search(d))]
        if sum(e - b for b, e, _ in spans) < least * len(raw) or not spans:
            return run
        out, at = [], 0
        for b, e, decoded in spans:
            out += [run[at:b], decoded]
            at = e
        found += len(spans)
        return "".join(out) + run[at:]

    return _RUN[id(table)].sub(repair, text), found


_HAN_RUN = re.compile(r"[^\x00-\x7F]{2,}")
#: Three-byte sequences of ideographs, their punctuation and full-width forms; ASCII may stand between, swallowed as a second byte.
_HAN_UTF8 = rb"(?:\xE2\x80[\x93-\xA6]|\xE3[\x80-\x83][\x80-\xBF]|[\xE3-\xE9][\x80-\xBF]{2}|\xEF[\xBC-\xBD][\x80-\xBF])"
_HAN_SPAN = {n: re.compile(rb"(?:" + _HAN_UTF8 + rb"[\x40-\x7E]?){%d,}" % n) for n in (LEAST_HAN, LEAST_HAN - 1)}


def _from_gb(text: str, least: int = LEAST_HAN) -> tuple[str, int]:
    """(text with UTF-8 spans that were read as GB18030 decoded, their number)."""
    found = 0

    def repair(m: re.Match) -> str:
        nonlocal found
        run = m[0]
        try:
            parts = [c.encode("gb18030") for c in run]
        except UnicodeEncodeError:
            return run
        for i, c in enumerate(run):
            if c == "�":  # before another character it can only have been byte 80; before ASCII it is not determined
                parts[i] = b"\x80" if i + 1 < len(run) else b"\xff"
        raw = b"".join(parts)
        spans = list(_HAN_SPAN[least].finditer(raw))
        if not spans:
            return run
        ends, at = {0: 0}, 0
        for i, part in enumerate(parts):
            at += len(part)
            ends[at] = i + 1
        out, done = [], 0
        for s in spans:
            first = s.start()
            while first not in ends and first < s.end():
                first += 3
            if first not in ends or ends[first] < done or (s.end() - first) // 3 < least:
                continue
            last, tail = s.end(), ""
            if last not in ends:  # half of a pair is left over: its other half is lost
                last, tail = last + 1, "�"
                if last not in ends:
                    continue
                while raw[last : last + 1] in (b"\x80", b"\xff"):
                    last += 1
            try:
                decoded = raw[first : s.end()].decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [run[done : ends[first]], decoded + tail]
            done = ends[last]
            found += 1
        return "".join(out) + run[done:]

    return _HAN_RUN.sub(repair, text), found


_LATIN_RUN = re.compile("(?:" + _CLASS[id(_WINDOWS)] + "[0-9@-~]?){%d,}" % (2 * LEAST_PAIRS))
_GB_SPAN = re.compile(rb"(?:[\xA1-\xFE][\xA1-\xFE]|[\x81-\xFE][\x40-\x7E\x80-\xFE]|[\x81-\xFE][0-9][\x81-\xFE][0-9]){%d,}" % LEAST_PAIRS)


def _common(decoded: str) -> float:
    """The share of everyday ideographs and Chinese punctuation (the first level of GB 2312 and its rows of signs)."""
    good = 0
    for c in decoded:
        b = c.encode("gb18030")
        good += len(b) == 2 and (0xB0 <= b[0] <= 0xD7 and b[1] >= 0xA1 or b[0] in (0xA1, 0xA3) and b[1] >= 0xA1)
    return good / len(decoded)


def _to_gb(text: str) -> tuple[str, int]:
    """(text with GB18030 spans that were read as Windows-1252 or Latin-1 decoded, their number)."""
    found = 0

    def repair(m: re.Match) -> str:
        nonlocal found
        run = m[0]
        raw = bytes(_WINDOWS.get(ord(c), ord(c)) for c in run)
        if sum(s.end() - s.start() for s in _SPAN.finditer(raw)) > 0.8 * sum(b > 0x7F for b in raw):
            return run
        out, at = [], 0
        for s in _GB_SPAN.finditer(raw):
            try:
                decoded = s[0].decode("gb18030")
            except UnicodeDecodeError:
                continue
            if len(decoded) >= LEAST_PAIRS and _common(decoded) >= 0.7:
                out += [run[at : s.start()], decoded]
                at = s.end()
                found += 1
        return "".join(out) + run[at:] if at else run

    return _LATIN_RUN.sub(repair, text), found


def _from_either(text: str) -> tuple[str, int]:
    """Of the two single-byte readings the one whose spans cover more."""
    windows, mac = _from_single(text, _WINDOWS, SHARE_WINDOWS), _from_single(text, _MAC, SHARE_MAC)
    best = mac if len(mac[0]) < len(windows[0]) else windows  # decoding makes a text shorter by what it covers
    return best


_REPAIRS = (_to_gb, _from_either, _from_gb)
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
_SUSPECT = re.compile("[\x80-\x84\x86-\xffŒ-ƒˆ˜–-™√∂∫∑∏π≈∆◊]{2}|[\x80-\x84\x86-\x9f�]|[^\x00-\x7f]{4}")


def restored(text: str | None) -> tuple[str | None, int, bool]:
    """(restored text, number of spans decoded anew, whether the text is garbled, restorable or not)."""
    if not text or text.isascii() or not _SUSPECT.search(text):
        return text, 0, False
    lost = "�" in text
    total, now = 0, text
    n = 1
    while n:  # ends, as every decoding makes a text shorter
        size = len(now)
        for repair in _REPAIRS:
            now, n = repair(now)
            if n:
                if repair is _from_gb:  # beside proven spans shorter ones are believed too
                    now, _ = _from_gb(now, LEAST_HAN - 1)
                break
        total += n
        if len(now) >= size:
            break
    return now, total, bool(total) or lost or _C1.search(now) is not None


def garbled(documents: DataFrame) -> DataFrame:
    """(doc_id) of each distinct document that is garbled."""

    def make():
        def step(batch: dict[str, pa.Array]) -> dict[str, list]:
            return {"doc_id": [d for d, t in zip(batch["doc_id"].to_pylist(), batch["text"]) if restored(t.as_py())[2]]}

        return step

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return map_columns(slim, make, "doc_id long").distinct()


def restore(documents: DataFrame) -> DataFrame:
    """(doc_id, text, spans, garbled) of every document, the text restored as far as it is determined."""

    def make():
        def step(batch: dict[str, pa.Array]) -> dict[str, list | pa.Array]:
            texts, spans, flags = zip(*(restored(t.as_py()) for t in batch["text"]))
            return {"doc_id": batch["doc_id"], "text": list(texts), "spans": list(spans), "garbled": list(flags)}

        return step

    return map_columns(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, text string, spans long, garbled boolean")
