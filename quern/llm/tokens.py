"""Problem 8: the whole corpus as token ids of a public byte-level BPE tokenizer.

Method: vectorised pre-tokenisation. All texts of a batch become one array of code points, each code point a class (letter, number,
white space, other), each position a symbol that also knows the class of its neighbours. A small automaton decides at each position
whether a token starts there; its transitions are functions on the states, composed associatively: blocks of the array are scanned
side by side, block results are composed, and each block is then replayed from its entry state. No regular expression is involved.
The slices between boundaries feed a cached pair merging over the tokenizer's ranks; their offsets decode ids back to text spans.

Defined cases: null and empty texts give an empty list; strings of special tokens count as ordinary text; no special tokens are added;
texts of any length are encoded whole; unpaired surrogates cannot occur in UTF-8 columns; repeated rows repeat their result; further
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrow import map_columns

#: Where the vocabulary files lie; a parameter of every function here.
VOCABULARY = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: The cache of merged slices is emptied beyond this many entries.
CACHE = 1_000_000
GROUP = 2_000_000
_BLOCK = 64

# White space as the tokenizer's pattern has it.
_WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
L, N, S, O = range(4)  # noqa: E741

# Symbols: letter, number, other, an apostrophe before s t m d, one before re ve ll, white space before more white space or the end,
# a space before text, other white space before text. Each once more for the first position of a text.
_SYM_L, _SYM_N, _SYM_O, _SYM_A2, _SYM_A3, _SYM_W, _SYM_J, _SYM_X = range(8)
# States: nothing open; inside letters, numbers, others, white space; an open space that the next token takes in; one or two letters of a contraction to come.
_CLOSED, _IN_L, _IN_N, _IN_O, _IN_W, _JOIN, _C1, _C2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token starts here)."""
    if state == _C2:
        return _C1, False
    if state == _C1:
        return _CLOSED, False
    if symbol == _SYM_L:
        return _IN_L, state not in (_IN_L, _JOIN)
    if symbol == _SYM_N:
        return _IN_N, state not in (_IN_N, _JOIN)
    if symbol == _SYM_O:
        return _IN_O, state not in (_IN_O, _JOIN)
    if symbol in (_SYM_A2, _SYM_A3):
        if state in (_IN_O, _JOIN):
            return _IN_O, False
        return (_C1 if symbol == _SYM_A2 else _C2), True
    if symbol == _SYM_W:
        return _IN_W, state != _IN_W
    return (_JOIN if symbol == _SYM_J else _CLOSED), True


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """next[state, symbol], starts[state, symbol], the transition functions reachable by composition, compose[f, symbol], apply[f, state]."""
    nxt = np.zeros((8, 16), np.uint8)
    starts = np.zeros((8, 16), bool)
    for state in range(8):
        for symbol in range(8):
            nxt[state, symbol], starts[state, symbol] = _step(state, symbol)
            nxt[state, symbol + 8], starts[state, symbol + 8] = _step(_CLOSED, symbol)
    functions = [tuple(range(8))]
    index = {functions[0]: 0}
    rows = []
    for f in functions:
        row = []
        for symbol in range(16):
            g = tuple(int(nxt[s, symbol]) for s in f)
            if g not in index:
                index[g] = len(functions)
                functions.append(g)
            row.append(index[g])
        rows.append(row)
    return nxt, starts, np.array(rows, np.int32), np.array(functions, np.uint8), np.arange(8)


class Pretokenizer:
    """Token boundaries of many texts at once."""

    def __init__(self) -> None:
        classes = np.full(0x110000, O, np.uint8)
        category = unicodedata.category
        for code in range(0x110000):
            c = category(chr(code))[0]
            if c == "L":
                classes[code] = L
            elif c == "N":
                classes[code] = N
        classes[_WHITE] = S
        self.classes = classes
        self.next, self.starts, self.compose, self.functions, _ = _automaton()

    def symbols(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """codes: the code points of all texts in a row; firsts: the position of each text's first one."""
        n = len(codes)
        kind = self.classes[codes]
        symbol = np.choose(kind, [_SYM_L, _SYM_N, _SYM_W, _SYM_O]).astype(np.uint8)
        last = np.zeros(n + 1, bool)
        last[firsts[1:] - 1] = True
        last[n - 1] = True
        before_text = np.zeros(n, bool)
        before_text[:-1] = kind[1:] != S
        before_text &= ~last[:n]
        white = (kind == S) & before_text
        symbol[white] = np.where(codes[white] == 0x20, _SYM_J, _SYM_X)
        for i in np.flatnonzero(codes == 0x27):
            if last[i]:
                continue
            a = codes[i + 1]
            if a in (0x73, 0x74, 0x6D, 0x64):
                symbol[i] = _SYM_A2
            elif not last[i + 1] and (a, codes[i + 2]) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
                symbol[i] = _SYM_A3
        symbol[firsts] += 8
        return symbol

    def boundaries(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Positions at which a token starts."""
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64)
        symbol = self.symbols(codes, firsts)
        blocks = -(-n // _BLOCK)
        grid = np.zeros(blocks * _BLOCK, np.uint8)
        grid[:n] = symbol
        grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T)
        function = np.zeros(blocks, np.int32)
        for row in grid:  # the composed transition function of every block
            function = self.compose[function, row]
        entry = np.zeros(blocks, np.uint8)
        table = self.functions[function]
        state = _CLOSED
        for b in range(blocks):  # the state each block is entered in
            entry[b] = state
            state = table[b, state]
        out = np.zeros((_BLOCK, blocks), bool)
        states = entry
        for k, row in enumerate(grid):
            out[k] = self.starts[states, row]
            states = self.next[states, row]
        return np.flatnonzero(out.T.reshape(-1)[:n])


class Encoder:
    """Ids by cached pair merging over the ranks of a vocabulary file."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pretokenizer = Pretokenizer()
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one slice: the adjacent pair of lowest rank is merged until no pair has a rank; leftmost first among equals."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        if n < 100:
            parts = [piece[i : i + 1] for i in range(n)]
            pairs = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(n - 1)]
            while pairs:
                low = min(pairs)
                if low == 1 << 30:
                    break
                i = pairs.index(low)
                parts[i] += parts[i + 1]
                del parts[i + 1], pairs[i]
                if i < len(pairs):
                    pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            return tuple(map(ranks.__getitem__, parts))
        return self._merge_long(piece)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs and linked parts, for slices of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            k = before[i]
            if k >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(chain.from_iterable(ids)) for ids, _ in self.slices(texts)]

    def encode_with_offsets(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """(ids, for each id the code point offset at which its slice starts) of each text."""
        out = []
        for ids, offsets in self.slices(texts):
            out.append(([i for x in ids for i in x], [o for x, o in zip(ids, offsets) for _ in x]))
        return out

    def slices(self, texts: list[str | None]):
        """(the ids of each slice, the slices' offsets) of each text, worked through in groups of about GROUP characters."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t or "")
            if size >= GROUP:
                yield from self._slices(group)
                group, size = [], 0
        yield from self._slices(group)

    def _slices(self, texts: list[str | None]):
        full = [t for t in texts if t]
        if not full:
            yield from (((), ()) for _ in texts)
            return
        joined = "".join(full)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, full), np.int64, len(full))
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        bounds = self.pretokenizer.boundaries(codes, firsts)
        first_bound = np.searchsorted(bounds, firsts)
        ends = [*first_bound[1:].tolist(), len(bounds)]
        starts = bounds.tolist()
        starts.append(len(joined))
        cache, merge, k = self.cache, self.merge, 0
        begins = first_bound.tolist()
        for t in texts:
            if not t:
                yield (), ()
                continue
            a, b = begins[k], ends[k]
            at = starts[a]
            ids = []
            for i in range(a, b):
                w = joined[starts[i] : starts[i + 1]]
                found = cache.get(w)
                if found is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    found = cache[w] = merge(w.encode())
                ids.append(found)
            yield ids, [s - at for s in starts[a:b]]
            k += 1


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """This worker process's encoder of a vocabulary, read for its first task and kept, with its cache, for the others."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document."""

    def make():
        encoder = _encoder(path)

        def step(batch: dict[str, pa.Array]) -> dict[str, list | pa.Array]:
            texts = batch["text"].to_pylist()
            offsets, values = [0], []
            for ids, _ in encoder.slices(texts):
                for x in ids:
                    values += x
                offsets.append(len(values))
            return {"doc_id": batch["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(values, np.int32)))}

        return step

    return map_columns(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, ids array<int>")
