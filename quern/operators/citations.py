"""Citations of articles in texts: balanced title marks, also one within another, and the list of articles right behind a title.

A title counts with all it holds; marks without a partner are no title. Behind it a list may give several articles, with the branch of
an article (one of those put in behind it later), paragraphs and items, joined by commas and conjunctions; prose ends the list.
White space anywhere is ignored. Titles and texts may be of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrow import map_columns

_NUMERAL = "[零〇一二两三四五六七八九十百千万0-9]+"
_ARTICLE = re.compile(f"第({_NUMERAL})条(?:之({_NUMERAL}))?")
_BETWEEN = f"(?:第{_NUMERAL}[款项]|[、，,及和至与]|[（(][^（()）]{{0,35}}[)）])*"
_LIST = re.compile(f"[（(]?(?:第{_NUMERAL}条(?:之{_NUMERAL})?{_BETWEEN})+")


def outer_titles(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the outermost balanced titles, marks included."""
    open_at: list[int] = []
    for m in re.finditer("[《》]", text):
        if m[0] == "《":
            open_at.append(m.start())
        elif open_at:
            start = open_at.pop()
            if not open_at:
                yield start, m.end()


def cited(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(title, article, branch) of each article cited, in order, once each."""
    bare = re.sub(r"\s+", "", text)
    seen = set()
    for start, end in outer_titles(bare):
        articles = _LIST.match(bare, end)
        for m in _ARTICLE.finditer(articles[0]) if articles else ():
            one = (bare[start + 1 : end - 1], m[1], m[2])
            if one not in seen:
                seen.add(one)
                yield one


def cited_articles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, no, title, article, branch) of each text's cited articles; null texts cite nothing."""

    def make():
        def step(batch: dict[str, pa.Array]) -> dict[str, list]:
            rows = [(i, n, *c) for i, t in zip(batch["i"].to_pylist(), batch["t"]) for n, c in enumerate(cited(t.as_py() or ""))]
            return dict(zip((id_col, "no", "title", "article", "branch"), map(list, zip(*rows)) if rows else ([] for _ in range(5))))

        return step

    return map_columns(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), make, f"{id_col} long, no int, title string, article string, branch string")
