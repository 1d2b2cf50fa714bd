"""Connected components by alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond").

Each round is written to the shared folder, so lineage stays short and a lost executor costs one round. Minima are aggregated
before the shuffle; nothing but a checksum comes to the driver. Links up to FEW, which one task holds in a few megabytes, are put
together by that task instead; the components are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import written

#: So many links at most are handled by one task.
FEW = 200_000


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least: dict[int, int] = {}

    def root(x: int) -> int:
        at = x
        while (up := least.setdefault(at, at)) != at:
            at = up
        while least[x] != at:
            least[x], x = at, least[x]
        return at

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = sorted((root(u), root(v)))
            least[b] = a
    nodes = list(least)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], names=["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges holds u, v with u > v. Large: of u's neighbours (either way) those above u get u's minimum; small: those below."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, n_links: int | None = None) -> DataFrame:
    """(node, component) of every node of the undirected links (a, b); the component is named by its smallest node. n_links is told where it is known."""
    if n_links is not None and n_links <= FEW:
        return links.select("a", "b").repartition(1).mapInArrow(_in_one_task, "node long, component long")
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.count() <= FEW:
        return edges.repartition(1).mapInArrow(_in_one_task, "node long, component long")
    before = None
    while True:
        edges = written(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
