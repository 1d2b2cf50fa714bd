"""Writers: tables that appear whole or not at all, event lines, vectors, shards with digests, rendered briefs."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 500_000


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by Spark's committer: readers see the old files or the new."""
    df.write.mode(mode).parquet(path)


def write_json_whole(path: str | Path, value) -> None:
    """A small JSON document on the driver: written beside, flushed, renamed."""
    path = Path(path)
    fd, beside = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        Path(beside).unlink(missing_ok=True)
        raise


def write_status_then(path: str, status: DataFrame, rows: DataFrame, failed: bool) -> None:
    """The status replaces the old one even if the run failed; rows are written only if it did not."""
    status.write.mode("overwrite").json(f"{path}/status")
    if failed:
        raise RuntimeError("the run failed; its status is written")
    write_table(rows, f"{path}/rows")


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_vectors(df: DataFrame, path: str, id_col: str, column: str) -> None:
    """Vectors as arrays of floats, sorted by id within files, beside a table of their number, dimension and digest of ids."""
    rows = df.select(F.col(id_col).alias("id"), F.col(column).cast("array<float>").alias("vector"))
    rows.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/vectors")
    meta = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dimension"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("id_sum"))
    meta.write.mode("overwrite").json(f"{path}/meta")


def shards(name: str, content: bytes, size: int = SHARD_BYTES) -> tuple[list[tuple[str, bytes]], list[dict]]:
    """(shard name, bytes) of the packed content, the same for the same content, and their manifest rows."""
    packed = io.BytesIO()
    with gzip.GzipFile(fileobj=packed, mode="wb", mtime=0, filename="") as z:
        z.write(content)
    data, whole = packed.getvalue(), hashlib.sha256(content).hexdigest()
    parts = [(f"{name}.{i // size:04d}", data[i : i + size]) for i in range(0, max(len(data), 1), size)]
    rows = [{"name": name, "shard_no": k, "shard": s, "shard_sha256": hashlib.sha256(b).hexdigest(), "sha256": whole} for k, (s, b) in enumerate(parts)]
    return parts, rows


def write_if_changed(path: str | Path, data: bytes) -> bool:
    path = Path(path)
    if path.exists() and path.read_bytes() == data:
        return False
    path.write_bytes(data)
    return True


def brief_html(items: DataFrame, group: str, order: str) -> DataFrame:
    """One escaped HTML list per group, in order; only https links without user info are linked."""

    def escaped(c: str):
        x = F.coalesce(c, F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    safe = F.regexp_like("url", F.lit(r"^https://[^/@\s]+(/\S*)?$"))
    line = F.when(safe, F.concat(F.lit('<li><a href="'), escaped("url"), F.lit('">'), escaped("title"), F.lit("</a></li>"))).otherwise(F.concat(F.lit("<li>"), escaped("title"), F.lit("</li>")))
    lines = items.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("ls"))
    return lines.select(group, F.concat(F.lit("<ul>"), F.array_join(F.transform("ls", lambda x: x["l"]), ""), F.lit("</ul>")).alias("html"))
