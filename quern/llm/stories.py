"""Problem 7: each later batch of feed entries is compared with everything earlier batches brought, by an index that only grows.

Method: an inverted index of rare-token prefixes, partitioned by token. A batch's new titles are posted under the rarest of their
tokens and probe the partitions these fall into; candidates pass a length filter, then the overlap of their words is verified; the
batch's own postings are appended. Equal urls and equal titles (as in problem 5) are looked up in a table of keys, partitioned and
appended to likewise. What earlier batches brought is never cleaned, tokenised, posted or compared with itself again, and of the index
only the partitions that a batch touches are read.

Tokens are ordered from rare to frequent: those that are not in the list of frequent tokens (at most 1 / FREQUENT_SHARE times the words
of a title long) first, then the others by rising frequency. Two titles of one story share every code and number and at least OVERLAP
of their words; so of either's tokens at most `words - least common words` can come before the rarest common one, and none behind the
first code or number. That many are the prefix. Any order gives the same links. The list is counted when there are titles, and again, with
the postings written anew, whenever the titles have doubled since: a title is posted anew at most once for each doubling.

Codes and numbers (hard tokens) are all pieces with digits, and those of one to three ASCII letters that the title itself tells to be
codes, by what they are joined to and by their capitals. So a title means the same in every batch, whatever came before.

Two titles tell the same story if they have the same hard tokens, no word of either that is told to be a name is missing from the
other, and at least OVERLAP of all their other words are common (TESTDATA.md asks for light rewording here, not for the five-word
shingles other near-duplicate operators use). Links hold within a batch as well; stories are the connected components. Each batch
resolves its own links against the labels of the nodes they touch; two stories that a batch joins are one row of a table of merges.

A posting list that a share of all titles has in common is cut into blocks of BLOCK titles; each pair of blocks is a task of its own, so
none holds more than two blocks, and all pairs of blocks are compared.

A batch is taken in whole or not at all: its tables lie in a folder of its own that counts only once its commit file is written. A
batch whose label is committed is not taken in again; what a failed attempt left is written over.

Defined cases: entries without id or batch number are left out; an entry with neither title nor https url has no story; repeated
rows repeat their result; ties go to the smallest entry_id; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quern.functions.arrow import map_columns
from quern.llm.graph import components
from quern.llm.keys import canonical_entries
from quern.session import is_small, plan_bytes, scratch_path, written

OVERLAP = 0.45
FREQUENT_SHARE = 1e-3
#: Titles of a posting list that one task compares with as many others.
BLOCK = 2_000
#: Folders by hash that postings and marks are divided into; to be chosen so that one of a batch's files is worth opening.
PARTS = 8

_TABLES = {
    "postings": "token string, hard string, node long, soft array<string>, names array<string>, part int",
    # what = 'key': a and b are the halves of a key, c its node; 'label': a is a node, c its story; 'member': a is an entry, c its story; 'merge': the stories a and c are one
    "marks": "a long, b long, c long, batch_no int, what string, part int",
    "frequent": "token string, n long",
}
_BY = {"postings": "token", "marks": "a"}


class StoryIndex:
    """The growing index at a path of the shared folder. parts is taken when the index is made and kept with it."""

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int = PARTS):
        self.spark = spark
        self.path = path or scratch_path(spark, "stories")
        self.commits = self._read_commits()
        self.parts = self.commits[0]["parts"] if self.commits else parts
        self._frequent: tuple[int, Broadcast] | None = None

    # files

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read_commits(self) -> list[dict]:
        files, folder = self._file("commits")
        if not files.exists(folder):
            return []
        lines = self.spark.read.text(f"{self.path}/commits").collect()  # a line a batch
        return sorted((json.loads(r.value) for r in lines), key=lambda c: c["no"])

    def _commit(self, **what) -> None:
        """Make a batch count: its line is written beside the others and renamed, which happens whole or not at all."""
        line = {"no": len(self.commits), "parts": self.parts, **what}
        files, temporary = self._file(f"attempts/{line['no']:08d}")
        _, final = self._file(f"commits/{line['no']:08d}.json")
        files.mkdirs(final.getParent())
        stream = files.create(temporary, True)
        stream.write(bytearray(json.dumps(line).encode()))
        stream.close()
        if not files.rename(temporary, final):
            raise RuntimeError(f"batch {line['no']} is committed already")
        self.commits.append(line)

    @property
    def generation(self) -> int:
        return self.commits[-1]["generation"] if self.commits else 0

    def _folder(self, name: str, no: int, generation: int) -> str:
        return f"{self.path}/{name}/generation={generation if name in ('postings', 'frequent') else 0}/batch={no}"

    def folders(self, name: str) -> list[str]:
        """The committed folders of a table."""
        own = name in ("postings", "frequent")
        return [self._folder(name, c["no"], c["generation"]) for c in self.commits if name in c["tables"] and (not own or c["generation"] == self.generation)]

    def read(self, name: str, of: DataFrame | None = None) -> DataFrame:
        """A table; given the rows that will look something up in it, only of the partitions they fall into."""
        folders = self.folders(name)
        if not folders:
            return self.spark.createDataFrame([], _TABLES[name])
        rows = self.spark.read.schema(_TABLES[name]).option("basePath", f"{self.path}/{name}").parquet(*folders)
        if of is not None:
            touched = [r[0] for r in of.select(self._part(name)).distinct().collect()]  # at most `parts` numbers
            rows = rows.where(F.col("part").isin(touched))
        return rows

    def lookup(self, name: str, rows: DataFrame, on: list[str], few: bool) -> DataFrame:
        """The index's rows that agree with any of the given rows in the columns `on`. While the given rows are small they go to the index,
        which is scanned where it lies; a larger batch and the index are both shuffled."""
        asked = rows.select(*on).distinct()
        return self.read(name, asked if few else None).join(F.broadcast(asked) if is_small(rows) else asked, on, "left_semi")

    def _marks(self, what: str) -> DataFrame:
        return self.read("marks").where(F.col("what") == what)

    def _part(self, name: str) -> Column:
        return F.pmod(F.xxhash64(_BY[name]), F.lit(self.parts)).cast("int").alias("part")

    def _write(self, name: str, rows: DataFrame, generation: int) -> None:
        out = rows.select(*(self._part(name) if c == "part" else c for c in _parse_datatype_string(_TABLES[name]).names))
        folder = self._folder(name, len(self.commits), generation)
        if name in _BY:
            out.repartition("part").sortWithinPartitions("part", *(["what"] if name == "marks" else [])).write.mode("overwrite").partitionBy("part").parquet(folder)
        else:
            out.write.mode("overwrite").parquet(folder)

    # taking in

    def ingest(self, entries: DataFrame, label: str | None = None) -> bool:
        """Take in one batch, or a backlog of batches, later than all before. False if a batch of that label is in already."""
        if label is not None and any(c["label"] == label for c in self.commits):
            return False
        self._order_anew()
        generation, no = self.generation, len(self.commits)
        batch = entries if "title_k1" in entries.columns else written(canonical(entries), "batch")
        few = plan_bytes(batch) < self.parts << 10  # a larger batch touches every partition anyway

        halves = [F.struct(F.col(f"{kind}_k1").alias("a"), F.col(f"{kind}_k2").alias("b"), F.lit(kind == "title").alias("is_title")) for kind in ("title", "url")]
        ids = batch.select("entry_id", "batch_no", F.explode(F.array(*halves)).alias("k")).select("entry_id", "batch_no", "k.*").where("a is not null")
        before = self.lookup("marks", ids, ["a", "b"], few).where("what = 'key'").select("a", "b", F.col("c").alias("known"))
        keys = ids.groupBy("a", "b", "is_title").agg(F.min("entry_id").alias("first_id")).join(before, ["a", "b"], "left")
        keys = written(keys.withColumn("node", F.coalesce("known", "first_id")), "keys")
        held = ids.join(keys.select("a", "b", "node"), ["a", "b"]).select("entry_id", "batch_no", "node").distinct()
        held = written(held.withColumn("lowest", F.min("node").over(Window.partitionBy("entry_id", "batch_no"))), "held")

        new_titles = keys.where("known is null and is_title").select(F.col("first_id").alias("entry_id"), F.col("a").alias("title_k1"), F.col("b").alias("title_k2"))
        titles = batch.join(new_titles, ["entry_id", "title_k1", "title_k2"], "left_semi").dropDuplicates(["entry_id"]).select(F.col("entry_id").alias("node"), "hard", "soft", "names")
        n_titles = new_titles.count()
        fresh_order = bool(n_titles) and not self.folders("frequent")
        if fresh_order:
            titles = written(titles, "titles")
            self._write("frequent", _frequent(titles), generation)
        self._write("postings", _postings(titles, self._counts(no if fresh_order else None)), generation)
        postings = self.spark.read.schema(_TABLES["postings"]).parquet(self._folder("postings", no, generation))
        links = held.where("node <> lowest").select(F.col("node").alias("a"), F.col("lowest").alias("b")).unionByName(_verified(postings, self.lookup("postings", postings, ["token"], few)))
        links = written(links.distinct(), "links")

        touched = held.select(F.col("node").alias("a")).unionByName(links.select("a")).unionByName(links.select(F.col("b").alias("a"))).distinct()
        labels = self.lookup("marks", touched, ["a"], few).where("what = 'label'").select("a", F.col("c").alias("story"))
        known = written(touched.join(labels, "a", "left").select(F.col("a").alias("node"), "story", F.coalesce("story", "a").alias("at")), "labels")
        ends = links.join(known.select(F.col("node").alias("a"), F.col("at").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("at").alias("y")), "b")
        whole = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), links.count()).withColumnRenamed("node", "at")
        resolved = written(known.join(whole, "at", "left").select("node", "story", F.coalesce("component", "at").alias("now")), "resolved")

        members = held.select("entry_id", "batch_no", "lowest").distinct().join(resolved.select(F.col("node").alias("lowest"), "now"), "lowest")
        nothing = F.lit(None).cast("long").alias("b")
        parts = [
            keys.where("known is null").select("a", "b", F.col("node").alias("c"), F.lit(None).cast("int").alias("batch_no"), F.lit("key").alias("what")),
            resolved.where("story is null").select(F.col("node").alias("a"), nothing, F.col("now").alias("c"), F.lit(None).cast("int").alias("batch_no"), F.lit("label").alias("what")),
            resolved.where("story <> now").select(F.col("story").alias("a"), nothing, F.col("now").alias("c"), F.lit(None).cast("int").alias("batch_no"), F.lit("merge").alias("what")).distinct(),
            members.select(F.col("entry_id").alias("a"), nothing, F.col("now").alias("c"), "batch_no", F.lit("member").alias("what")),
        ]
        self._write("marks", reduce(DataFrame.unionByName, parts), generation)
        ranked_at = n_titles if fresh_order else (self.commits[-1]["ranked_at"] if self.commits else 0)
        self._commit(label=label, generation=generation, titles=n_titles, ranked_at=ranked_at, tables=["postings", "marks", *(["frequent"] if fresh_order else [])])
        return True

    def _counts(self, no: int | None = None) -> Broadcast:
        """The frequent tokens of this generation, kept with the executors: at most the words of a title divided by FREQUENT_SHARE."""
        if self._frequent is None or self._frequent[0] != self.generation or no is not None:
            rows = self.read("frequent") if no is None else self.spark.read.schema(_TABLES["frequent"]).parquet(self._folder("frequent", no, self.generation))
            self._frequent = (self.generation, self.spark.sparkContext.broadcast({r.token: r.n for r in rows.toLocalIterator()}))
        return self._frequent[1]

    def _order_anew(self) -> None:
        """Count the frequent tokens again and post all titles by the new order, once there are twice as many titles as when it was last done."""
        n = sum(c["titles"] for c in self.commits)
        if not n or n < 2 * self.commits[-1]["ranked_at"]:
            return
        generation = self.generation + 1
        titles = self.read("postings").dropDuplicates(["node"]).select("node", F.when(F.col("hard") == "", F.array().cast("array<string>")).otherwise(F.split("hard", " ")).alias("hard"), "soft", "names")
        titles = written(titles, "titles")
        frequent = written(_frequent(titles), "frequent")
        self._write("frequent", frequent, generation)
        counts = self.spark.sparkContext.broadcast({r.token: r.n for r in frequent.toLocalIterator()})
        self._write("postings", _postings(titles, counts), generation)
        self._commit(label=None, generation=generation, titles=0, ranked_at=n, tables=["frequent", "postings"])

    def found(self) -> DataFrame:
        """(accepted_id, entry_id) of each entry whose story an earlier batch brought. Hot stories are counted before the shuffle; the join
        back is left to the adaptive splitting of skewed partitions."""
        members = self._marks("member").select(F.col("a").alias("entry_id"), "batch_no", F.col("c").alias("story"))
        now = components(self._marks("merge").select("a", F.col("c").alias("b"))).select(F.col("node").alias("story"), "component")
        per = members.groupBy("story").agg(F.min("batch_no").alias("batch"), F.min("entry_id").alias("first_id"))
        per = written(per.join(now, "story", "left").withColumn("component", F.coalesce("component", "story")), "stories")
        whole = per.groupBy("component").agg(F.min("batch").alias("first_batch"), F.min("first_id").alias("accepted_id"))
        info = per.join(whole, "component").select("story", "first_batch", "accepted_id")
        return members.join(info, "story").where("batch_no > first_batch and accepted_id < entry_id").select("accepted_id", "entry_id").distinct()


def canonical(entries: DataFrame) -> DataFrame:
    """What the index takes in of each entry with a batch number and a key: keys, their halves, and the words of its title. Every row by itself."""
    rows = canonical_entries(entries.where("batch_no is not null"), with_words=True).where("title_key is not null or url_key is not null")
    return rows.withColumns({f"{kind}_{k}": _hash(kind, k) for kind in ("title", "url") for k in ("k1", "k2")}).drop("title_key", "url_key")


def _hash(kind: str, which: str) -> Column:
    """One half of a key's 128 bits; null without a key. Keys are told apart by both halves."""
    salt = F.lit(f"{kind} {which}")
    return F.when(F.col(f"{kind}_key").isNotNull(), F.xxhash64(salt, F.col(f"{kind}_key")))


def _tokens() -> Column:
    """A title's tokens, words and codes told apart by their first letter."""
    return F.concat(F.transform(F.array_distinct("hard"), lambda t: F.concat(F.lit("h"), t)), F.transform("soft", lambda t: F.concat(F.lit("s"), t)))


def _frequent(titles: DataFrame) -> DataFrame:
    n = titles.agg(F.count(F.lit(1)).alias("titles"))
    counts = titles.select(F.explode(_tokens()).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(n)).where(F.col("n") > F.greatest(F.col("titles") * FREQUENT_SHARE, F.lit(10))).select("token", "n")


def prefix(hard: list[str], soft: list[str], frequent: dict[str, int]) -> list[str]:
    """The rare-token prefix of a title: its tokens from rare to frequent, up to its first code or number, and no longer than the overlap demands."""
    tokens = sorted((frequent.get(t, 0), t) for t in {*("h" + h for h in hard), *("s" + s for s in soft)})
    out = []
    for _, token in tokens[: len(soft) - math.ceil(len(soft) * OVERLAP - 1e-9) + 1]:
        out.append(token)
        if token[0] == "h":
            break
    return out


def _postings(titles: DataFrame, counts: Broadcast) -> DataFrame:
    """A row for each token of each title's prefix."""

    def make():
        def step(batch: dict[str, pa.Array]) -> dict[str, list | pa.Array]:
            at, tokens = [], []
            for i, (hard, soft) in enumerate(zip(batch["hard"].to_pylist(), batch["soft"].to_pylist())):
                mine = prefix(hard, soft, counts.value)
                at += [i] * len(mine)
                tokens += mine
            joined = pc.binary_join(batch["hard"], " ")
            return {"token": tokens, "hard": joined.take(pa.array(at, pa.int64())), **{c: batch[c].take(pa.array(at, pa.int64())) for c in ("node", "soft", "names")}}

        return step

    return map_columns(titles.select("node", "hard", "soft", "names"), make, "token string, hard string, node long, soft array<string>, names array<string>")


def same_story(hard_a: str, soft_a: set[str], names_a: set[str], hard_b: str, soft_b: set[str], names_b: set[str]) -> bool:
    """Whether two titles are light rewordings of each other."""
    if hard_a != hard_b:
        return False
    low, high = sorted((len(soft_a), len(soft_b)))
    if low < OVERLAP * high - 1e-9:
        return False
    common = len(soft_a & soft_b)
    if common < OVERLAP * (len(soft_a) + len(soft_b) - common) - 1e-9 or not (common or hard_a):
        return False
    return names_a <= soft_b and names_b <= soft_a


def _verified(new: DataFrame, old: DataFrame) -> DataFrame:
    """Links (a, b) of new titles with old and new ones, from the postings of the tokens they share.

    The postings of one token (and the same codes and numbers, which a pair must have in common) meet sorted in one task, or, beyond
    BLOCK of them, each two blocks of them in one. A title is compared with the task's stories so far and linked to each it joins once,
    so n titles give at most n - 1 links a task.
    """
    columns = ["token", "hard", "node", "soft", "names"]
    both = old.select(*columns, F.lit(False).alias("fresh")).unionByName(new.select(*columns, F.lit(True).alias("fresh")))
    runs = both.groupBy("token", "hard").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("any_fresh")).where("n > 1 and any_fresh")
    runs = runs.select("token", "hard", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("mine")) | (F.col("blocks") == 1))
    paired = both.join(runs, ["token", "hard"]).withColumn("mine", mine).withColumn("other", F.explode(others))
    paired = paired.select("token", "hard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fresh", "node", "soft", "names")
    order = ["token", "hard", "i", "j"]
    tasks = paired.repartition(*order).sortWithinPartitions(*order, "fresh", "node")
    schema = _parse_datatype_string("a long, b long")
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stories = None, []
        for batch in batches:
            a, b = [], []
            for token, hard, i, j, fresh, node, soft, names in zip(*(c.to_pylist() for c in batch.columns)):
                if (token, hard, i, j) != key:
                    key, stories = (token, hard, i, j), []
                soft, names = set(soft), set(names)
                joined = []
                for story in stories if fresh else ():
                    for other, other_soft, other_names in story:
                        if same_story(hard, soft, names, hard, other_soft, other_names):
                            a.append(node)
                            b.append(other)
                            joined.append(story)
                            break
                me = (node, soft, names)
                if joined:
                    stories = [s for s in stories if not any(s is x for x in joined)]
                    stories.append([m for s in joined for m in s] + [me])
                else:
                    stories.append([me])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow)

    return tasks.mapInArrow(scan, schema).distinct()


def p7_pairs(entries: DataFrame, one_by_one: bool = False) -> DataFrame:
    """History first, then what waits: the later batches as one backlog, or each by itself, as it came, with the same result. Taking a
    batch in costs some twenty small jobs whatever its size, so a backlog is cheaper. Entries are made canonical, each by itself, once."""
    spark = entries.sparkSession
    index, path = StoryIndex(spark), scratch_path(spark, "canonical")
    rows = canonical(entries)
    rows.write.partitionBy("batch_no").parquet(path)
    stored = spark.read.schema(rows.schema).option("basePath", path)
    numbers = sorted(r.batch_no for r in stored.parquet(path).select("batch_no").distinct().collect())  # of the batches
    later = [n for n in numbers if n > 0]
    for batches in ([n for n in numbers if n <= 0], *([[n] for n in later] if one_by_one else [later])):
        if batches:
            index.ingest(stored.parquet(*(f"{path}/batch_no={n}" for n in batches)), f"batches {batches}")
    return index.found()
