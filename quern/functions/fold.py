"""Folding of printed text: compatibility forms, widths, traditional unit characters; plain forms of text functions for Arrow batches."""

from __future__ import annotations

import re
import unicodedata

#: Characters of unit words in their traditional or formal spelling.
_UNIT_CHARS = str.maketrans({"萬": "万", "億": "亿", "仟": "千", "佰": "百", "圓": "元", "幣": "币", "個": "个", "點": "点", "戶": "户", "’": "'", "‘": "'", "′": "'", "`": "'", "−": "-", "–": "-", "—": "-", "﹣": "-"})


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def unit_fold(text: str) -> str:
    """NFKC, lower case, simplified unit characters, plain minus and apostrophe."""
    return nfkc(text).translate(_UNIT_CHARS).lower()


#: Where a court's own reasoning begins; white space.
REASONING = ("本院认为", "本庭认为", "判决如下", "裁定如下")
_SPACE = " \t\n\x0b\f\r"
_SPACES = re.compile(f"[{_SPACE}][{_SPACE}]+")
_NOT_NORMAL = re.compile("[^㐀-鿿A-Za-z0-9]+")


def judged(text: str, most: int = 7500, head: int = 2500, tail: int = 5000) -> str:
    """The text before the reasoning; of very long ones only head and tail."""
    text = text[: min((k for k in map(text.find, REASONING) if k >= 0), default=None)].strip(_SPACE)
    return text if len(text) <= most else text[:head] + text[-tail:]


def spaced_lower(text: str) -> str:
    """Lower case, each character by itself as in SQL, and runs of white space as one blank."""
    return _SPACES.sub(" ", text.replace("İ", "i").replace("Σ", "σ").lower())


def normal_form(text: str) -> str:
    """Ideographs, ASCII letters and digits only, lower case."""
    return _NOT_NORMAL.sub("", text).lower()
