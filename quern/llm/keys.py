"""Keys of feed entries that do not depend on formatting: of titles, addresses, and the words of a title."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrow import map_columns
from quern.llm.characters import cleaner

# Parameters that only track where a reader came from; names beginning with utm_ as well.
TRACKING = ("gclid", "fbclid", "at_medium", "at_campaign", "ref", "ref_src", "spm", "from", "source", "mc_cid", "mc_eid")
_ADDRESS = r"(?s)^(?U:\s*)(?i:https)://([^/?#]*)([^?#]*?)/*(?:\?([^#]*?))?(?:#.*)?(?U:\s*)\z"
_TRACKS = rf"(?i)^(utm_[^=]*|{'|'.join(TRACKING)})(=.*)?$"


_NO_KEY = re.compile(r"[\W_]+")


def title_key(clean_title: str | None) -> str | None:
    """Letters and digits of an already cleaned title, case folded; None if there are none."""
    if not clean_title:
        return None
    return _NO_KEY.sub("", clean_title.casefold()) or None


def url_key(url: Column) -> Column:
    """The address without what does not change its target, inside generated code; null if it is no https address."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _ADDRESS, 1)), r"^www\.|:443$", "")
    parameters = F.array_sort(F.filter(F.split(F.regexp_extract(url, _ADDRESS, 3), "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(_TRACKS))))
    query = F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise("")
    return F.when(F.regexp_like(url, F.lit(_ADDRESS)) & (host != ""), F.concat(host, F.regexp_extract(url, _ADDRESS, 2), query))


_IDEOGRAPHS = "぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_IDEOGRAPH, _PIECE = re.compile(f"[{_IDEOGRAPHS}]"), re.compile(rf"[^\W_{_IDEOGRAPHS}]+")
_SHORT = re.compile(r"[A-Za-z]{1,3}")
#: A word after one of these may be capitalised without being a name.
_OPENERS = ":：“”\"'«»([{【（-–—|｜.!?。！？*…"
#: What joins the pieces of a product code without a space.
_JOINER = re.compile(r"[-‐‑‒–−_/]")


def _digits(w: str) -> bool:
    return not w.isalpha() and any(map(str.isdigit, w))


def _code(text: str, pieces: list[re.Match], i: int, telling: bool) -> bool:
    """Whether the short piece i is a code, as its own title tells: it is joined to a piece with digits; or in capitals where capitals
    tell (a single letter only behind a piece with digits or joined to capitals); or, where they do not, it stands behind the first such piece, if that
    has letters too (5R RL WITH, but 4J-5H ET)."""
    w = pieces[i][0]
    before = text[pieces[i - 1].end() : pieces[i].start()] if i else ""
    after = text[pieces[i].end() : pieces[i + 1].start()] if i + 1 < len(pieces) else ""
    joined = [pieces[j][0] for j, gap in ((i - 1, before), (i + 1, after)) if _JOINER.fullmatch(gap)]
    if any(map(_digits, joined)):
        return True
    behind = before.isspace() and _digits(pieces[i - 1][0])
    if telling:
        return w.isupper() and (len(w) > 1 or behind or any(x.isupper() for x in joined))
    return behind and not pieces[i - 1][0].isdigit() and not (i > 1 and _digits(pieces[i - 2][0]))


def words(clean_title: str | None) -> tuple[list[str], list[str], list[str], list[str], list[str]]:
    """(hard, short, upper, soft, names) of a title, in pieces of letters and digits or single ideographs, case folded.

    hard: pieces with digits and those of one to three ASCII letters that the title tells to be codes; short: the rest of one to
    three ASCII letters, both with repetitions; upper: those of short that are told by case, as "X+" if in capitals and "x-" if not;
    soft: the set of all other pieces; names: those of soft that are told to be names, being capitalised in a title of mixed case
    where other words are not.
    """
    text = clean_title or ""
    hard, short, upper, soft, names = [], [], [], set(_IDEOGRAPH.findall(text)), set()
    has_upper = any(c.isupper() for c in text)
    mixed = has_upper and any(c.islower() for c in text)
    telling = mixed or (has_upper and any(c.isalpha() and c.lower() == c.upper() for c in text))
    pieces = list(_PIECE.finditer(text))
    capitals_tell = has_upper and (any(len(m[0]) > 1 and m[0].isalpha() and m[0].islower() for m in pieces) or any(c.isalpha() and c.lower() == c.upper() for c in text))
    for i, m in enumerate(pieces):
        w = m[0]
        low = w.casefold()
        if _digits(w) or (_SHORT.fullmatch(w) and _code(text, pieces, i, capitals_tell)):
            hard.append(low)
        elif _SHORT.fullmatch(w):
            short.append(low)
            if telling and (w.isupper() or w.islower()):
                upper.append(low + ("+" if w.isupper() else "-"))
        else:
            soft.add(low)
            if mixed and w[0].isupper():
                before = text[: m.start()].rstrip()
                if before and before[-1] not in _OPENERS:
                    names.add(low)
    return sorted(hard), sorted(short), upper, sorted(soft), sorted(names)


_SCHEMA = "entry_id long, batch_no int, title_key string, url_key string"


def canonical_entries(entries: DataFrame, with_words: bool = False) -> DataFrame:
    """(entry_id, batch_no, title_key, url_key[, hard, soft with the short words, names]) of entries with an id; keys are null where there is none."""

    def make():
        tool = cleaner()

        def step(batch: dict[str, pa.Array]) -> dict[str, list | pa.Array]:
            titles = tool.clean(batch["title"])
            out = {"entry_id": batch["entry_id"], "batch_no": batch["batch_no"], "title_key": [title_key(t) for t in titles], "url_key": batch["url_key"]}
            if with_words:
                told = [words(t) for t in titles]
                out |= {"hard": [h for h, *_ in told], "soft": [sorted({*short, *soft}) for _, short, _, soft, _ in told], "names": [names for *_, names in told]}
            return out

        return step

    slim = entries.select(F.col("entry_id").cast("long").alias("entry_id"), F.col("batch_no").cast("int").alias("batch_no"), "title", url_key(F.col("url")).alias("url_key")).where("entry_id is not null")
    more = "".join(f", {c} array<string>" for c in ("hard", "soft", "names")) if with_words else ""
    return map_columns(slim, make, _SCHEMA + more)
