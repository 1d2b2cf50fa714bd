"""Problem 9: documents that repeat passages of held-out test items.

Method: a generalised suffix automaton of all normalised test items. Each document's normalised characters stream through it, and the
length of the longest match ending at each character is tracked; where it reaches LENGTH, the items that hold the match are reported.
The items are broadcast and the automaton is built once in each worker process: items are a held-out set, and an automaton takes at
most MOST_CHARS characters of them (some 400 bytes each); a larger set is divided into parts, each with an automaton and a pass over
the corpus of its own, so nothing that is broadcast or held grows with the corpus or the items.

The same matching lengths give the spans: the characters of a document that lie in any match of LENGTH or more. `cleaned` cuts these
spans out of the texts, and drops a text whose letters and digits lie in spans to more than COVERAGE.

Transitions after a failed match are resolved once per (state, character) and kept, so most characters cost one look-up.

Defined cases: null and empty texts and items leak nothing; letters and digits are compared in lower case and half width, all other
characters ignored; items shorter than LENGTH can match nothing; repeated rows of a document or item count once; matches never cross
documents or items; texts of any length are read whole; a null text stays null in the cleaned texts; further columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrow import map_columns

LENGTH = 50
#: A text is dropped as a whole if more than this share of its letters and digits is leaked.
COVERAGE = 0.5
#: The most characters of test items in one automaton.
MOST_CHARS = 500_000
#: Resolved transitions are dropped beyond this many.
_KEPT = 3_000_000
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    """Letters and digits only, lower case, half width."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _OTHER.sub("", text.lower())


def pieces(text: str) -> tuple[str, list[int], list[int]]:
    """The normalised text, and where in the text the character (with its accents) begins and ends that each of its characters comes from."""
    out, starts, ends = [], [], []
    at, size = 0, len(text)
    while at < size:
        end = at + 1
        while end < size and unicodedata.combining(text[end]):
            end += 1
        part = normalised(text[at:end])
        out.append(part)
        starts += [at] * len(part)
        ends += [end] * len(part)
        at = end
    return "".join(out), starts, ends


class SuffixAutomaton:
    """Of several strings. States know their longest string, suffix link and the items that hold their strings."""

    def __init__(self, strings: dict[int, str], least: int = LENGTH):
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        owners: dict[int, set[int]] = defaultdict(set)
        for item, s in strings.items():
            last = 0
            for c in s:
                last = self._extend(last, c)
                owners[last].add(item)
        # an item holds the strings of all suffix links of the states it passed through; only long enough states are asked for
        items: dict[int, frozenset[int]] = {}
        for state in sorted(range(len(self.next)), key=self.length.__getitem__, reverse=True):
            own = owners.pop(state, None)
            if own:
                if self.length[state] >= least:
                    items[state] = frozenset(own)
                up = self.link[state]
                if up > 0 and self.length[up] >= least:
                    owners[up] |= own
        # the shortest match of the wanted length decides: follow links while they are long enough
        self.items: list[tuple[int, ...] | None] = [None] * len(self.next)
        for state in sorted(items, key=self.length.__getitem__):
            up = self.link[state]
            self.items[state] = self.items[up] if up > 0 and self.length[up] >= least else tuple(sorted(items[state]))
        self.least = least

    def _extend(self, last: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy


class Matcher:
    """Streams texts through an automaton."""

    def __init__(self, automaton: SuffixAutomaton):
        self.automaton = automaton
        self.failed: list[dict[str, tuple[int, int]] | None] = [None] * len(automaton.next)
        self.kept = 0

    def _resolve(self, state: int, c: str) -> tuple[int, int]:
        """(state, match length) after c, which the state has no transition for."""
        a, p = self.automaton, state
        while p != -1 and c not in a.next[p]:
            p = a.link[p]
        found = (a.next[p][c], a.length[p] + 1) if p != -1 else (0, 0)
        if self.kept >= _KEPT:
            self.failed = [None] * len(a.next)
            self.kept = 0
        if self.failed[state] is None:
            self.failed[state] = {}
        self.failed[state][c] = found
        self.kept += 1
        return found

    def leaks(self, text: str) -> set[int]:
        """Items that share at least the wanted length with a normalised text."""
        a = self.automaton
        nxt, least, items = a.next, a.least, a.items
        if len(text) < least:
            return set()
        failed, resolve = self.failed, self._resolve
        found: set[int] = set()
        state = length = 0
        for c in text:
            to = nxt[state].get(c)
            if to is not None:
                state = to
                length += 1
                if length >= least:
                    found.update(items[state])
                continue
            known = failed[state]
            hit = known.get(c) if known is not None else None
            if hit is None:
                hit = resolve(state, c)
                failed = self.failed
            state, length = hit
            if length >= least:
                found.update(items[state])
        return found


    def spans(self, text: str) -> list[tuple[int, int]]:
        """The stretches of a normalised text that lie in matches of the wanted length, neighbouring ones joined."""
        a = self.automaton
        out: list[list[int]] = []
        state = length = 0
        for i, c in enumerate(text):
            to = a.next[state].get(c)
            if to is not None:
                state, length = to, length + 1
            else:
                known = self.failed[state]
                state, length = (known.get(c) if known else None) or self._resolve(state, c)
            if length >= a.least:
                start = i + 1 - length
                if out and start <= out[-1][1]:
                    out[-1] = [min(start, out[-1][0]), i + 1]
                else:
                    out.append([start, i + 1])
        return [tuple(s) for s in out]


def item_parts(items: DataFrame, most: int = MOST_CHARS, least: int = LENGTH) -> list[dict[int, str]]:
    """The normalised test items, in parts of bounded size. Items are a fixed held-out set; they stream in by partition."""
    parts: list[dict[int, str]] = [{}]
    size = 0
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        s = normalised(row.text)
        if len(s) < least:
            continue
        if size + len(s) > most and parts[-1] or row.item_id in parts[-1]:
            parts.append({})
            size = 0
        parts[-1][row.item_id] = s
        size += len(s)
    return [p for p in parts if p]


def leaked(documents: DataFrame, items: DataFrame, least: int = LENGTH) -> DataFrame:
    """(doc_id, item_id) of each document and test item that share at least `least` consecutive letters or digits."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    out = None
    for part in item_parts(items, least=least):
        strings = spark.sparkContext.broadcast(part)

        def make(strings=strings):
            matcher = Matcher(_automaton(strings.value, least))

            def step(batch: dict[str, pa.Array]) -> dict[str, list]:
                ids, found = [], []
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                    hits = matcher.leaks(normalised(text.as_py()))
                    ids += [doc] * len(hits)
                    found += sorted(hits)
                return {"doc_id": ids, "item_id": found}

            return step

        pairs = map_columns(docs, make, "doc_id long, item_id long")
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        return docs.where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"))
    return out.distinct()


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def cleaned(documents: DataFrame, items: DataFrame, least: int = LENGTH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, clean_text, spans, covered, dropped) of every document with an id: its text without the leaked spans (starts and ends
    in the text), the share of its letters and digits in them, and whether that is too much, so that nothing is left of the text.

    Spans are found in the text as it is, those of all parts of the items together: one pass over the corpus a part, all in one job.
    """
    spark = documents.sparkSession
    parts = [spark.sparkContext.broadcast(p) for p in item_parts(items, least=least)]
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    found = slim.select("doc_id", "text", F.array().cast("array<struct<low:int,high:int>>").alias("found"))
    for strings in parts:

        def make(strings=strings):
            matcher = Matcher(_automaton(strings.value, least))

            def step(batch: dict[str, pa.Array]) -> dict[str, list | pa.Array]:
                every = []
                for text, before in zip(batch["text"], batch["found"].to_pylist()):
                    t = text.as_py()
                    if t is not None and matcher.leaks(normalised(t)):
                        plain = pieces(t)[0]
                        before = before + [{"low": low, "high": high} for low, high in matcher.spans(plain)]
                    every.append(before)
                return {"doc_id": batch["doc_id"], "text": batch["text"], "found": every}

            return step

        found = map_columns(found, make, "doc_id long, text string, found array<struct<low:int,high:int>>")

    def finish():
        def step(batch: dict[str, pa.Array]) -> dict[str, list | pa.Array]:
            texts, spans, shares = [], [], []
            for text, stretches in zip(batch["text"].to_pylist(), batch["found"].to_pylist()):
                if not stretches:
                    texts.append(text)
                    spans.append([])
                    shares.append(0.0)
                    continue
                plain, starts, ends = pieces(text)
                held = _joined([(s["low"], s["high"]) for s in stretches])
                shares.append(sum(high - low for low, high in held) / len(plain))
                cut = [(starts[low], ends[high - 1]) for low, high in held]
                spans.append([{"low": low, "high": high} for low, high in cut])
                kept, at = [], 0
                for low, high in cut:
                    kept.append(text[at:low])
                    at = high
                texts.append(None if shares[-1] > coverage else "".join(kept) + text[at:])
            return {"doc_id": batch["doc_id"], "clean_text": texts, "spans": spans, "covered": shares, "dropped": [s > coverage for s in shares]}

        return step

    return map_columns(found, finish, "doc_id long, clean_text string, spans array<struct<low:int,high:int>>, covered double, dropped boolean")


_built: list[tuple[dict[int, str], int, SuffixAutomaton]] = []


def _automaton(strings: dict[int, str], least: int) -> SuffixAutomaton:
    """One automaton per worker process: the last one built is kept for the next task."""
    if not _built or _built[0][0] != strings or _built[0][1] != least:
        _built[:] = [(strings, least, SuffixAutomaton(strings, least))]
    return _built[0][2]
