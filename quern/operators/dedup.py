"""Exact classes, near-duplicate links and greedy first-wins selection, without comparing all pairs and without one task per group."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quern.functions import fold
from quern.functions import text as T
from quern.functions.arrow import map_columns
from quern.session import BROADCAST_BYTES, is_small, plan_bytes, scratch_path, written

#: Jaccard of shingles, in hundredths so that integers decide; lengths and their ratios, in tenths.
JACCARD, LEAST_SHINGLED, RATIO_SHINGLED, LEAST_CONTAINED, RATIO_CONTAINED = 88, 120, 7, 100, 6
#: Winnowing: any shared stretch of LEAST_CONTAINED characters shares the least hash of a window of _WINDOW grams of _GRAM characters.
_GRAM = 40
_WINDOW = LEAST_CONTAINED - _GRAM + 1


def exact_classes(docs: DataFrame, id_col: str, form: Column) -> DataFrame:
    """(class_id, n, form) of each distinct non-empty form: the smallest id that has it and how many do. Combined before the shuffle."""
    return docs.select(F.col(id_col).alias("i"), form.alias("form")).where("form <> ''").groupBy("form").agg(F.min("i").alias("class_id"), F.count(F.lit(1)).alias("n"))


def rolling(form: str, gram: int) -> np.ndarray:
    """A hash of every stretch of `gram` characters, by position."""
    n = len(form) - gram + 1
    if n < 1:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(form.encode("utf-32-le"), np.uint32).astype(np.uint64)
    base, hashes = np.uint64(1_000_003), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            hashes = hashes * base + codes[k : k + n]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0x9E3779B97F4A7C15)
    return hashes.view(np.int64)


def winnowed(form: str) -> list[int]:
    """The least gram hash of every window, without repetitions."""
    hashes = rolling(form, _GRAM)
    if len(hashes) <= _WINDOW:
        return [int(hashes.min())] if len(hashes) else []
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, _WINDOW).min(axis=1)).tolist()


#: Whole items are looked for by the hash of their first so many characters.
_ANCHOR = 16


def holders(docs: DataFrame, id_col: str, form: Column, items: DataFrame, item_id: str, item_form: Column) -> DataFrame:
    """(id, item_id) of each document whose form holds the whole form of an item; empty forms hold and are held by nothing.

    The items are a stated set; they go to the executors in blocks below the broadcast bound, each block one pass over the documents.
    A document is hashed once per anchor length (one length, and one more for each length of items shorter than that).
    """
    spark = docs.sparkSession
    wanted = written(items.select(F.col(item_id).cast("long").alias("item"), item_form.alias("form")).where("item is not null and form <> ''").distinct(), "items")
    blocks = 1 + plan_bytes(wanted) // BROADCAST_BYTES
    slim = docs.select(F.col(id_col).cast("long").alias("d"), form.alias("form")).where("d is not null and form <> ''")
    out = None
    for b in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([(r["item"], r["form"]) for r in part.toLocalIterator()])

        def make(shared=shared):
            anchors: dict[int, dict[int, list[tuple[int, str]]]] = {}
            for item, text in shared.value:
                size = min(len(text), _ANCHOR)
                anchors.setdefault(size, {}).setdefault(int(rolling(text[:size], size)[0]), []).append((item, text))
            keys = {size: np.fromiter(found, np.int64) for size, found in anchors.items()}

            def step(batch: dict[str, pa.Array]) -> dict[str, list]:
                ids, held = [], []
                for d, text in zip(batch["d"].to_pylist(), batch["form"]):
                    text = text.as_py()
                    for size, known in keys.items():
                        hashes = rolling(text, size)
                        for h in np.unique(hashes[np.isin(hashes, known)]).tolist():
                            hit = [item for item, form in anchors[size][h] if form in text]
                            ids += [d] * len(hit)
                            held += hit
                return {"d": ids, "item": held}

            return step

        found = map_columns(slim, make, "d long, item long")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("d").alias(id_col), F.col("item").alias(item_id)).distinct()


def _containment(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of which one form holds the other. A short form probes with one fingerprint, its rarest."""
    schema = _parse_datatype_string("class_id long, len int, print long")
    arrow = to_arrow_schema(schema)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lens, found = [], [], []
            for i, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marks = winnowed(form)
                ids += [i] * len(marks)
                lens += [len(form)] * len(marks)
                found += marks
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lens, pa.int32()), pa.array(found, pa.int64())], schema=arrow)

    posted = written(classes.where(F.length("form") >= LEAST_CONTAINED).select("class_id", "form").mapInArrow(prints, schema), "prints")
    often = posted.groupBy("print").agg(F.count(F.lit(1)).alias("df"))
    probe = posted.join(often, "print").groupBy("class_id", "len").agg(F.min_by("print", F.struct("df", "print")).alias("print"))
    pairs = probe.alias("p").join(posted.alias("o"), "print").where(f"p.class_id <> o.class_id and p.len <= o.len and 10 * p.len >= {RATIO_CONTAINED} * o.len")
    pairs = pairs.select(F.col("p.class_id").alias("short"), F.col("o.class_id").alias("long")).distinct()
    forms = classes.select("class_id", "form")
    both = pairs.join(forms.withColumnsRenamed({"class_id": "short", "form": "fs"}), "short").join(forms.withColumnsRenamed({"class_id": "long", "form": "fl"}), "long")
    return both.where(F.contains("fl", F.col("fs"))).select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b"))


def _shingle_sets(classes: DataFrame) -> DataFrame:
    """(class_id, len, s, m0 .. m3): the set of hashes of a form's shingles (five characters at every second place, runs of digits as one),
    of forms long enough, and the set's parity map: whether the number of its hashes with each last byte is odd. 64 bits tell shingles
    apart. Where two maps differ, at least one shingle is in one set only."""

    def make():
        def step(batch: dict[str, pa.Array]) -> dict[str, list | pa.Array]:
            sets = [np.unique(rolling(t.as_py(), 5)[::2]) for t in batch["folded"]]
            offsets = np.cumsum([0, *map(len, sets)])
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            odd = [np.bincount(s & 255, minlength=256).astype(np.uint8) & 1 for s in sets]
            maps = np.packbits(np.array(odd, np.uint8).reshape(-1, 256), axis=1).view(np.int64)
            return {**{f"m{k}": pa.array(maps[:, k]) for k in range(4)}, "class_id": batch["class_id"], "len": batch["len"], "s": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))}

        return step

    long = classes.where(F.length("form") >= LEAST_SHINGLED).select("class_id", F.length("form").alias("len"), F.regexp_replace("form", "[0-9]+", "0").alias("folded"))
    return map_columns(long, make, "class_id long, len int, s array<long>, m0 long, m1 long, m2 long, m3 long").where("size(s) > 0")


def _shingled(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose shingle sets have the wanted Jaccard similarity, by prefix filtering: a pair must share one of each
    side's n - ceil(0.88 n) + 1 rarest shingles. Where it does, positions and parity maps bound what can be common before the sets are
    brought together. Only hashes are carried; forms stay where they are."""
    maps = ["m0", "m1", "m2", "m3"]
    sets = written(_shingle_sets(classes), "shingles")
    posted = sets.select("class_id", "len", F.size("s").alias("n"), *maps, F.explode("s").alias("shingle"))
    often = posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posted.join(often, "shingle")
    # shingles only one class holds are rarest of all but join nothing: they use up prefix places without being posted
    single = F.col("n") - F.size("ordered")
    ordered = shared.groupBy("class_id", "len", "n", *maps).agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ordered"))
    places = F.col("n") - F.ceil(F.col("n") * JACCARD / 100).cast("int") + 1 - single
    prefix = ordered.where(places > 0).select("class_id", "len", "n", *maps, (F.col("n") - F.size("ordered")).alias("single"), F.posexplode(F.slice("ordered", F.lit(1), places)).alias("p", "o"))
    prefix = written(prefix.select("class_id", "len", "n", *maps, (F.col("n") - F.col("single") - F.col("p")).alias("rest"), "o.shingle"), "prefix")
    near = (F.col("x.class_id") < F.col("y.class_id")) & (10 * F.least("x.len", "y.len") >= RATIO_SHINGLED * F.greatest("x.len", "y.len")) & (100 * F.least("x.n", "y.n") >= JACCARD * F.greatest("x.n", "y.n"))
    # at the first common shingle no more than the rest of either side, it included, can be common
    near = near & ((100 + JACCARD) * F.least("x.rest", "y.rest") >= JACCARD * (F.col("x.n") + F.col("y.n")))
    # sets that are similar enough differ in at most (1 - J) / (1 + J) of their sizes' sum, and at least where their maps do
    apart = sum((F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in maps), F.lit(0))
    near = near & ((100 + JACCARD) * apart <= (100 - JACCARD) * (F.col("x.n") + F.col("y.n")))
    pairs = prefix.alias("x").join(prefix.alias("y"), "shingle").where(near).select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("s").alias("sb")), "b")
    return both.where(_similar("sa", "sb")).select("a", "b")


def _similar(a: str, b: str) -> Column:
    common = F.size(F.array_intersect(a, b))
    return 100 * common >= JACCARD * (F.size(a) + F.size(b) - common)


def near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(classes, links): classes of equal normal forms, and links (a, b) between different classes that are near-duplicates: one form
    holds the other, or their shingles are similar. Copies are not expanded into pairs; no link between different texts is lost."""
    classes = written(exact_classes(docs.where(F.col(text_col).isNotNull()), id_col, T.normal_form(F.col(text_col))), "classes")
    return classes, written(_containment(classes).unionByName(_shingled(classes)).distinct(), "links")


@lru_cache(2000)
def _shingle_set(form: str) -> np.ndarray:
    return np.unique(rolling(re.sub("[0-9]+", "0", form), 5)[::2])


def is_near(a: str | None, b: str | None) -> bool:
    """Whether two normal forms are near-duplicates, by the rules of `near_duplicates`."""
    if not a or not b or a == b:
        return bool(a) and a == b
    low, high = sorted((len(a), len(b)))
    if low >= LEAST_CONTAINED and 10 * low >= RATIO_CONTAINED * high and (a in b or b in a):
        return True
    if low < LEAST_SHINGLED or 10 * low < RATIO_SHINGLED * high:
        return False
    x, y = _shingle_set(a), _shingle_set(b)
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < JACCARD * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= JACCARD * (len(x) + len(y) - common)


def near_marked(pairs: DataFrame, query_id: str, id_col: str, docs: DataFrame, text_col: str, part: Callable[[str], str] | None = None) -> DataFrame:
    """Stated pairs (query_id, id, score) with `same`: whether the two texts, or the parts of them that count, are near-duplicates. Only
    these pairs are compared, and only their texts brought to normal form."""

    def made() -> Callable[[str | None], str | None]:
        return lru_cache(2000)(lambda t: None if t is None else fold.normal_form(part(t) if part else t))

    def ask():
        form = made()
        return lambda batch: {query_id: batch[query_id], "asked": [form(t.as_py()) for t in batch["text"]]}

    def make():
        form = made()

        def step(batch: dict[str, pa.Array]) -> dict[str, list | pa.Array]:
            same = [is_near(a.as_py(), form(b.as_py())) for a, b in zip(batch["asked"], batch["text"])]
            return {query_id: batch[query_id], id_col: batch[id_col], "score": batch["score"], "same": same}

        return step

    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    chosen = texts.withColumnRenamed(id_col, query_id).join(_broadcast(pairs.select(query_id).distinct()), query_id, "left_semi")
    asked = written(map_columns(chosen, ask, f"{query_id} long, asked string"), "asked")
    both = texts.join(_broadcast(pairs), id_col).join(_broadcast(asked), query_id)
    return map_columns(both.select(query_id, id_col, "score", "asked", "text"), make, f"{query_id} long, {id_col} long, score double, same boolean")


def _broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def near_duplicate_summary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, n_links) of every document with a normal form."""
    classes, links = near_duplicates(docs, id_col, text_col)
    per = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    known = classes.join(per, "class_id", "left").select("form", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return docs.select(F.col(id_col), T.normal_form(F.col(text_col)).alias("form")).join(known, "form").select(id_col, "class_id", "n_links")


def greedy_first(items: DataFrame, id_col: str, order: Column, keys: Column) -> DataFrame:
    """Ids kept by going through the items in order and keeping each that shares no key with one kept before; a dropped item blocks none.

    Done in rounds over all items at once: an item that comes first among the undecided under each of its keys is kept, whatever shares a
    key with it is dropped. Rounds are as many as the longest chain of such decisions; each is written to the shared folder.
    """
    spark = items.sparkSession
    path = scratch_path(spark, "kept")
    base = written(items.select(F.col(id_col).alias("i"), F.struct(order.alias("o"), F.col(id_col).alias("i")).alias("ord"), F.array_distinct(F.array_compact(keys)).alias("ks")), "items")
    free = base.where("size(ks) = 0").select("i")
    free.write.parquet(path)
    left = written(base.where("size(ks) > 0").select("i", "ord", F.explode("ks").alias("k")), "undecided")
    while left.limit(1).count():
        first = left.groupBy("k").agg(F.min("ord").alias("first"))
        state = written(left.join(first, "k").groupBy("i").agg(F.every(F.col("ord") == F.col("first")).alias("keep")), "round")
        now = state.where("keep").select("i")
        now.write.mode("append").parquet(path)
        blocked = left.join(now, "i", "left_semi").select("k").distinct()
        gone = left.join(blocked, "k", "left_semi").select("i").distinct()
        left = written(left.join(gone, "i", "left_anti"), "undecided")
    return spark.read.schema(free.schema).parquet(path).withColumnRenamed("i", id_col)
