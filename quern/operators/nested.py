"""Problem 6: deeply nested JSON records turned into related flat tables.

Method: a first pass infers the merged schema of all bodies: every path, with array positions and data-like keys folded to a wildcard,
the types seen there and how often. Its arrays and maps are the levels, each a table of its own: `table_levels` names them with the
table each hangs on, `wanted_columns` what is asked of them. A second pass explodes the records level after level along that schema:
every element of an array or map becomes a row of its level's table, with a surrogate key, its parent's key, the ordinal in its array
and its scalars as columns. Results are read from those tables.

A level's elements are taken from the rows of the level above, so a row always comes after its parent. Surrogate keys are the record
id and a running number within the record, which is the same in every run and on every executor; a child finds its parent by it.

An object key is data-like if it looks like a code; its value is then an element of a map's table, in every record alike. Paths of more
than DEEP keys are folded in the middle, so that a schema stays small whatever a damaged record holds; keys, links and values are not.

Defined cases: a null, empty or damaged body gives no row; a body that holds JSON as an encoded string, however often, is parsed
again; any depth of nesting is read; a byte-order mark is skipped; of a key given twice in one object the last counts; null scalars
give no leaf; half a surrogate pair comes out as a replacement character; record_kind or record_id may be null; repeated rows give
repeated results; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrow import map_columns
from quern.session import is_small, written

#: Longer schema paths keep so many keys at both ends.
DEEP = 400
_CODE = re.compile(r"[A-Za-z]{0,4}[-_]?\d[\w-]*")


class Number(str):
    """A number as written."""


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=Number)
_TOKEN = re.compile(r"[ \t\n\r]*(?:(?P<mark>[][{},:])|(?P<quote>\")|(?P<word>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity))")
_WORDS = {"true": True, "false": False, "null": None}


def parse_nested(text: str):
    """JSON of any depth, without recursion; ValueError if damaged. Slower than the library's parser, for what that one cannot hold."""
    at, holder, key = 0, [], 0
    stack: list = [holder]
    keys: list = [None]
    expect = "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip(" \t\n\r") or len(stack) > 1 or not holder:
                raise ValueError("damaged")
            return holder[0]
        at = m.end()
        mark, inner = m["mark"], stack[-1]
        if m["quote"] or m["word"] or mark in ("[", "{"):
            if m["quote"]:
                value, at = scanstring(text, at, True)
            elif m["word"]:
                value = _WORDS[m["word"]] if m["word"] in _WORDS else Number(m["word"])
            else:
                value = [] if mark == "[" else {}
            if expect in ("key", "first key"):
                if not m["quote"]:
                    raise ValueError("damaged")
                keys[-1], expect = value, ":"
                continue
            if expect not in ("value", "first value") or (len(stack) == 1 and holder):
                raise ValueError("damaged")
            if isinstance(inner, dict):
                inner[keys[-1]] = value
            else:
                inner.append(value)
            if mark:
                stack.append(value)
                keys.append(None)
                expect = "first value" if mark == "[" else "first key"
            else:
                expect = ","
        elif mark in ("]", "}"):
            if len(stack) == 1 or isinstance(inner, list) != (mark == "]") or expect not in (",", "first value", "first key"):
                raise ValueError("damaged")
            stack.pop()
            keys.pop()
            expect = ","
        elif mark == ":" and expect == ":":
            expect = "value"
        elif mark == "," and expect == "," and len(stack) > 1:
            expect = "key" if isinstance(inner, dict) else "value"
        else:
            raise ValueError("damaged")


def parse_body(body: str | None):
    """The parsed content, or None if there is none. Numbers come as Number. Every decoding makes a string shorter, so this ends."""
    while body is not None:
        text = body.lstrip("﻿")
        try:
            value = _DECODER.decode(text)
        except ValueError:
            return None
        except RecursionError:
            try:
                value = parse_nested(text)
            except ValueError:
                return None
        if isinstance(value, Number) or not isinstance(value, str):
            return value
        body = value
    return None


def pointer(key: str) -> str:
    return whole(key.replace("~", "~0").replace("/", "~1"))


@lru_cache(100_000)
def _step(key: str) -> tuple[str, str]:
    """(key of a pointer, key of a schema path): data-like keys are one in the schema."""
    own = pointer(key)
    return own, "*" if _CODE.fullmatch(key) else own


def _kind(value) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if value is None:
        return "null"
    if value is True or value is False:
        return "boolean"
    return "number" if isinstance(value, Number) else "string"


def scalar_text(value) -> str:
    if value is True or value is False:
        return "true" if value else "false"
    return whole(str(value))


def whole(text: str) -> str:
    """The text without halves of surrogate pairs, which JSON can hold but UTF-8 cannot."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


class _Path:
    """A place in a record: its key under the place above, and the schema path of both."""

    __slots__ = ("above", "key", "depth", "schema")

    def __init__(self, above: _Path | None, key: str, step: str):
        self.above, self.key = above, key
        if above is None:
            self.depth, self.schema = 0, ""
            return
        self.depth = depth = above.depth + 1
        if depth <= 2 * DEEP:
            self.schema = f"{above.schema}/{step}"
        else:  # too long: the first and the last keys
            parts = above.schema.split("/**/")
            if len(parts) == 1:
                every = above.schema.split("/")[1:]
                parts = ["/" + "/".join(every[:DEEP]), "/".join(every[DEEP:])]
            tail = f"{parts[1]}/{step}".split("/")[-DEEP:]
            self.schema = f"{parts[0]}/**/{'/'.join(tail)}"

    def text(self) -> str:
        """The JSON Pointer."""
        keys, at = [], self
        while at.above is not None:
            keys.append(at.key)
            at = at.above
        return "".join("/" + k for k in reversed(keys))

    def schema_text(self) -> str:
        """The schema path with nothing folded in the middle."""
        if self.depth <= 2 * DEEP:
            return self.schema
        steps, at = [], self
        while at.above is not None:
            steps.append(at.schema.rpartition("/")[2])
            at = at.above
        return "".join("/" + s for s in reversed(steps))


class Element:
    """One row of a level's table; columns are the scalars beneath it that belong to no further level."""

    __slots__ = ("place", "number", "parent", "ordinal", "columns", "inner")

    def __init__(self, place: _Path, number: int, parent: int | None, ordinal: int | None):
        self.place, self.number, self.parent, self.ordinal = place, number, parent, ordinal
        self.columns: list[tuple[_Path, object]] = []
        self.inner: list[tuple[_Path, str]] = []


def explode_record(content) -> Iterator[Element]:
    """The elements of a record, level after level: first the record itself, then what hangs on each row of the level before."""
    number = 0
    level = [(Element(_Path(None, "", ""), 0, None, None), content)]
    while level:
        below = []
        for element, value in level:
            open_values = [(element.place, value)]
            while open_values:
                place, v = open_values.pop()
                if isinstance(v, dict):
                    element.inner.append((place, "object"))
                    for i, (k, x) in enumerate(v.items()):
                        key, step = _step(k)
                        if step == "*" != key:
                            number += 1
                            below.append((Element(_Path(place, key, step), number, element.number, i), x))
                        else:
                            open_values.append((_Path(place, key, step), x))
                elif isinstance(v, list):
                    element.inner.append((place, "array"))
                    for i, x in enumerate(v):
                        number += 1
                        below.append((Element(_Path(place, str(i), "[]"), number, element.number, i), x))
                else:
                    element.columns.append((place, v))
            yield element
        level = below


def merged_schema(records: DataFrame) -> DataFrame:
    """(record_kind, schema_path, value_kind, n) over all bodies: which paths there are, with which types. Counted per batch before the shuffle."""

    def make():
        def step(batch: dict[str, pa.Array]) -> dict[str, list]:
            counts: dict[tuple, int] = {}
            for kind, body in zip(batch["record_kind"].to_pylist(), batch["body"].to_pylist()):
                content = parse_body(body)
                for element in explode_record(content) if content is not None else ():
                    for place, value_kind in element.inner:
                        counts[key] = counts.get(key := (kind, place.schema, value_kind), 0) + 1
                    for place, value in element.columns:
                        counts[key] = counts.get(key := (kind, place.schema, _kind(value)), 0) + 1
            rows = [(*k, n) for k, n in counts.items()]
            return dict(zip(("record_kind", "schema_path", "value_kind", "n"), map(list, zip(*rows)) if rows else ([], [], [], [])))

        return step

    parts = map_columns(records.select("record_kind", "body"), make, "record_kind string, schema_path string, value_kind string, n long")
    return parts.groupBy("record_kind", "schema_path", "value_kind").agg(F.sum("n").alias("n"))


def table_levels(schema: DataFrame) -> DataFrame:
    """The tables that the merged schema asks for: each array or map path, with the table it hangs on."""
    level = schema.select("record_kind", F.regexp_extract("schema_path", r"^(.*/(?:\[\]|\*))(?:/|$)", 1).alias("table_path")).where("table_path <> ''").distinct()
    parent = F.regexp_extract("table_path", r"^(.*/(?:\[\]|\*))/.*(?:\[\]|\*)$", 1)
    return level.withColumn("parent_table", F.when(F.col("table_path").rlike(r"(\[\]|\*).*(\[\]|\*)$"), parent).otherwise(F.lit("")))


def wanted_columns(schema: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(record_kind, table_path, column, schema_path) of the schema's scalars whose path a pattern of their kind matches: what is asked of which table."""
    asked = F.lit(False)
    for kind, pattern in wanted.items():
        asked = asked | ((F.col("record_kind") == kind) & F.col("schema_path").rlike(pattern))
    scalars = schema.where(~F.col("value_kind").isin("array", "object", "null") & asked).select("record_kind", "schema_path").distinct()
    table = F.regexp_extract("schema_path", r"^(.*/(?:\[\]|\*))(?:/|$)", 1)
    return scalars.select("record_kind", table.alias("table_path"), F.expr("substr(schema_path, length(regexp_extract(schema_path, '^(.*/(?:\\\\[\\\\]|\\\\*))(?:/|$)', 1)) + 1)").alias("column"), "schema_path")


_TABLE_SCHEMA = "record_id long, record_kind string, table_path string, row_key string, parent_key string, ordinal int, row_pointer string, columns map<string,string>"


def exploded(records: DataFrame, schema: DataFrame | None = None, wanted: dict[str, str] | None = None) -> DataFrame:
    """The rows of all tables, told apart by record_kind and table_path. columns holds scalars by their pointer beneath the row.

    With wanted (patterns of schema paths by record_kind) the rows are those of the levels that the merged schema says hold such columns,
    with these columns only; row_pointer is given only then. Without it all rows of all levels come out.
    """
    rules = wanted
    told: dict | None = None
    source = records.select("record_id", "record_kind", "body")
    if rules is not None:
        columns = wanted_columns(merged_schema(records) if schema is None else schema, rules)
        columns = written(columns, "wanted")
        if is_small(columns):  # the levels and columns to explode, by the schema; a schema too large to send is applied as its patterns
            told = {}
            for r in columns.select("record_kind", "schema_path").toLocalIterator():
                told.setdefault(r.record_kind, set()).add(r.schema_path)
        source = source.where(F.col("record_kind").isin(*rules))
    asked = records.sparkSession.sparkContext.broadcast(told)

    def make():
        patterns = None if rules is None else {k: re.compile(p) for k, p in rules.items()}

        def kept(kind, place: _Path) -> bool:
            if place.depth <= 2 * DEEP and asked.value is not None:
                return place.schema in asked.value.get(kind, ())
            return patterns[kind].search(place.schema_text()) is not None

        def step(batch: dict[str, pa.Array]) -> dict[str, list]:
            rows = []
            for rid, kind, body in zip(*(batch[n].to_pylist() for n in ("record_id", "record_kind", "body"))):
                content = parse_body(body)
                for e in explode_record(content) if content is not None else ():
                    columns = [(p, v) for p, v in e.columns if v is not None and (patterns is None or kept(kind, p))]
                    if patterns is not None and not columns:
                        continue
                    at = e.place.text() if columns else ""
                    parent = None if e.parent is None else f"{rid}#{e.parent}"
                    cells = [(p.text()[len(at) :], scalar_text(v)) for p, v in columns]
                    rows.append((rid, kind, e.place.schema, f"{rid}#{e.number}", parent, e.ordinal, at if patterns is not None else None, cells))
            names = ("record_id", "record_kind", "table_path", "row_key", "parent_key", "ordinal", "row_pointer", "columns")
            return dict(zip(names, map(list, zip(*rows)) if rows else ([] for _ in names)))

        return step

    return map_columns(source, make, _TABLE_SCHEMA)


#: What problem 6 asks for, as patterns over schema paths. Keys may stand anywhere beneath; the wildcard ends of arrays and maps too.
WANTED = {
    "manual-review": r"/companies/(?:.*/)?status$",
    "questions": r"/goldEvidence/(?:.*/)?values(?:/|$)",
    "manifest": r"/tableMethods(?:/|$)",
}


def wanted_leaves(records: DataFrame, wanted: dict[str, str] | None = None) -> DataFrame:
    """(record_id, leaf_path, leaf_value) of the leaves asked for, from the columns of the exploded tables."""
    rows = exploded(records, wanted=wanted or WANTED)
    leaves = rows.select("record_id", "row_pointer", F.explode("columns").alias("column", "leaf_value"))
    return leaves.select("record_id", F.concat("row_pointer", "column").alias("leaf_path"), "leaf_value")
