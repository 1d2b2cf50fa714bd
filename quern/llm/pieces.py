"""Problem 3: items above a size limit cut into pieces under it, at natural boundaries where there are any, with a fixed overlap.

Method: structure-tree packing. A page's headings and list markers make sections, sections hold lines, lines hold sentences; a
grid's rows make the upper level, its cells the lower. Sibling subtrees are merged bottom-up as long as they fit; only oversized nodes
are opened. A leaf above the limit has no boundary inside and is cut hard, at a comma or space of its second half if it has one.

Each piece but the first begins with the last OVERLAP characters of the one before (the whole of it, if it is shorter), so a piece's
own part has at most LIMIT - OVERLAP characters. A sentence between these two lengths must be cut as well; it counts as no hard cut, as
TESTDATA.md counts only stretches above LIMIT.

Defined cases: null text or grid, and items up to LIMIT, are no item of the result; a null row counts as empty, a null cell as
empty; offsets count code points of the text, for a grid of its cells joined by " | " and its rows by a line break; an item
delivered several times counts once in p3_found and once per delivery otherwise unless the ids are made distinct first; null ids are
left out of p3_found; texts of any length are cut whole; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrow import map_columns

LIMIT, OVERLAP = 340, 35

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)+|[^\r\n]+\Z")
_SENTENCE = re.compile(r"[^。；！？\r\n]*[。；！？\r\n]+|[^。；！？\r\n]+\Z")
_STOPS = "。；！？\r\n"
#: Heading and list markers by depth.
_LEVELS = [
    re.compile(p)
    for p in (
        r"\s*第[一二三四五六七八九十百零〇\d]+[篇编章部]", r"\s*第[一二三四五六七八九十百零〇\d]+节|\s*#\s", r"\s*[一二三四五六七八九十]+、|\s*##\s", r"\s*[（(][一二三四五六七八九十]+[）)]|\s*###+\s",
        r"\s*\d+[.、．)]\s*(?=\D)", r"\s*[（(]\d+[）)]", r"\s*(?:[-*•·]|\d+[.)])\s",
    )
]
_SOFT = re.compile(r"[，、,:：\s]")

#: A node: its span, whether a boundary inside is impossible to find (a leaf), and how to open it.
Span = tuple[int, int]


class Node:
    __slots__ = ("start", "end", "stretch", "opener", "level")

    def __init__(self, start: int, end: int, stretch: int = 0, opener: Callable[[], list[Node]] | None = None, level: int = -1):
        self.start, self.end, self.stretch, self.opener, self.level = start, end, stretch, opener, level


def _sentences(text: str, start: int, end: int) -> list[Node]:
    out = []
    for m in _SENTENCE.finditer(text, start, end):
        s, e = m.span()
        stop = e
        while stop > s and text[stop - 1] in _STOPS:
            stop -= 1
        out.append(Node(s, e, stop - s))
    if out and out[-1].end < end:  # \Z does not match at a limit before the end
        out.append(Node(out[-1].end, end, end - out[-1].end))
    return out or [Node(start, end, end - start)]


def _level(text: str, start: int) -> int:
    for depth, pattern in enumerate(_LEVELS):
        if pattern.match(text, start):
            return depth
    return len(_LEVELS)


def _group(lines: list[Node]) -> list[Node]:
    """Lines gathered under their headings: a heading opens a section that reaches to the next one of its depth or above."""
    top = min(n.level for n in lines)
    if top == len(_LEVELS) or len(lines) == 1:
        return lines
    cuts = [i for i, n in enumerate(lines) if n.level == top]
    if cuts[0]:
        cuts.insert(0, 0)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(lines)]):
        part = lines[a:b]
        if len(part) == 1:
            out.append(part[0])
        else:
            out.append(Node(part[0].start, part[-1].end, 0, lambda p=part: _open_section(p)))
    return out


def _open_section(part: list[Node]) -> list[Node]:
    return [part[0], *_group(part[1:])]


def page_tree(text: str) -> Node:
    def lines() -> list[Node]:
        found = []
        for m in _LINE.finditer(text):
            s, e = m.span()
            found.append(Node(s, e, 0, lambda s=s, e=e: _sentences(text, s, e), _level(text, s)))
        return _group(found)

    return Node(0, len(text), 0, lines)


def grid_text(rows: list[list[str | None] | None]) -> tuple[str, Node]:
    """The joined text of a grid and its tree of rows and cells."""
    joined = [" | ".join(c or "" for c in row or []) for row in rows]
    text = "\n".join(joined)

    def row_nodes() -> list[Node]:
        out, at = [], 0
        for i, line in enumerate(joined):
            end = at + len(line) + (i < len(joined) - 1)
            node = Node(at, end, len(line))
            if len(line) > LIMIT - OVERLAP:
                node.opener = lambda at=at, end=end, row=rows[i] or []: cells(at, end, row, len(joined[i]))
            out.append(node)
            at = end
        return out

    def cells(at: int, end: int, row: list[str | None], _: int) -> list[Node]:
        out, s = [], at
        for k, c in enumerate(row):
            e = s + len(c or "") + (3 if k < len(row) - 1 else 0)
            out.append(Node(s, e, e - s))
            s = e
        if out:
            out[-1].end = end
        return out or [Node(at, end, end - at)]

    return text, Node(0, len(text), 0, row_nodes)


def _merge(spans: list[Span], size: int) -> list[Span]:
    out: list[Span] = []
    for s, e in spans:
        if out and e - out[-1][0] <= size:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _pack(node: Node, text: str, size: int, limit: int, hard: list[int]) -> list[Span]:
    """Spans of at most size that tile the node."""
    if node.stretch > limit:
        hard[0] = 1
    if node.end - node.start <= size:
        return [(node.start, node.end)]
    if node.opener is not None:
        children = node.opener()
        if len(children) > 1 or children[0].opener is not None or children[0].end - children[0].start < node.end - node.start:
            return _merge([s for child in children for s in _pack(child, text, size, limit, hard)], size)
        if children[0].stretch > limit:
            hard[0] = 1
    out, at = [], node.start
    while node.end - at > size:
        cut = at + size
        soft = [m.end() for m in _SOFT.finditer(text, at + size // 2, cut)]
        if soft:
            cut = soft[-1]
        out.append((at, cut))
        at = cut
    out.append((at, node.end))
    return out


def cut(text: str, tree: Node, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[Span], int]:
    """((start, end) of each piece, overlap included; 1 if a stretch above the limit had to be cut, else 0)."""
    hard = [0]
    spans, pieces = _pack(tree, text, limit - overlap, limit, hard), []
    for s, e in spans:
        start = s if not pieces else max(pieces[-1][0], s - overlap)
        pieces.append((start, e))
    return pieces, hard[0]


def _items(kind: str, rows: Iterator[tuple], with_text: bool) -> Iterator[tuple]:
    for item, content in rows:
        if content is None:
            continue
        if kind == "page":
            text = content
            if len(text) <= LIMIT:
                continue
            tree = page_tree(text)
        else:
            text, tree = grid_text(content)
            if len(text) <= LIMIT:
                continue
        pieces, hard = cut(text, tree)
        if with_text:
            for i, (s, e) in enumerate(pieces):
                yield kind, item, i, s, e, text[s:e], hard
        else:
            yield kind, item, len(pieces), hard


def _cut_table(df: DataFrame, kind: str, id_col: str, content_col: str, with_text: bool) -> DataFrame:
    names = ("item_kind", "item_id", "piece_no", "start_at", "end_at", "piece", "hard_cut") if with_text else ("item_kind", "item_id", "n_pieces", "hard_cut")
    schema = "item_kind string, item_id string, piece_no long, start_at long, end_at long, piece string, hard_cut long" if with_text else "item_kind string, item_id string, n_pieces long, hard_cut long"

    def make():
        def step(batch: dict[str, pa.Array]) -> dict[str, list]:
            rows = list(_items(kind, zip(batch["i"].to_pylist(), batch["c"].to_pylist()), with_text))
            return dict(zip(names, map(list, zip(*rows)) if rows else ([] for _ in names)))

        return step

    return map_columns(df.select(F.col(id_col).cast("string").alias("i"), F.col(content_col).alias("c")), make, schema)


def pieces(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(item_kind, item_id, piece_no, start_at, end_at, piece, hard_cut) of every delivery of every oversized item."""
    return _cut_table(pages, "page", "page_id", "text", True).unionByName(_cut_table(tables, "table", "table_id", "table_rows", True))


def oversized(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(item_kind, item_id, hard_cut) of each distinct oversized item."""
    both = _cut_table(pages, "page", "page_id", "text", False).unionByName(_cut_table(tables, "table", "table_id", "table_rows", False))
    return both.where("item_id is not null").groupBy("item_kind", "item_id").agg(F.max("hard_cut").alias("hard_cut"))
