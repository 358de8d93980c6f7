"""Line dedup over levelled sorted runs of line keys.

An index is a folder of runs. A run has a row for each key (a 128-bit digest of a stripped line in lower case): in how many documents it was seen and in
which last. Runs are bucketed by key and sorted within buckets. A new batch of documents is brought to one row for each
key and anti-joins the runs by merging: keys that a run already knows to be common, up to a document not before the batch's own, say nothing new.
What is left becomes a run of level 0; as soon as a level has FANOUT runs they are compacted to one run of the next level. So no key has more
than one row in a run, a batch is shuffled once, and the runs only when they are compacted.

A run is named after the batches in it, and counts once it is complete. A run whose batches are all in a larger one doesn't count, so a compaction
that breaks off, or whose inputs are not yet deleted, changes nothing.

Null and empty texts are one empty line. Rows without an id are no documents and keep all their lines. Rows that repeat an id are one document to the
count, and each loses its lines by itself. An empty table gives an empty result. Further columns stay; where they are called n_lines or n_dropped,
the new ones are n_lines_ and n_dropped_. A digest stands for its line: two lines of a corpus of 10^12 share one with a chance of about 10^-15.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, shared_dir, slices, table, written

#: Code points of a key, and documents that hold it, from which on its lines go.
LEAST_POINTS, LEAST_DOCS = 40, 5
#: Runs of a level that are compacted to one of the next; batches that a whole table is added in.
FANOUT, BATCHES = 3, 4
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of UTF-8 that begin no code point.
INSIDE = bytes(range(0x80, 0xC0))
RUN = "line_key binary, docs long, last {kind}"


def line_keys(text: bytes, least: int = LEAST_POINTS) -> list[bytes | None]:
    """For each line of a UTF-8 text, the digest of its key; None for a short one."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # bytes: A-Z alone change
        line = line.strip(BLANKS)
        long = len(line) >= least and (line.isascii() or len(line.translate(None, INSIDE)) >= least)
        out.append(hashlib.md5(line, usedforsecurity=False).digest() if long else None)
    return out


def keys_of(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_POINTS) -> DataFrame:
    """key and line_key, once for each key of a row; rows without an id have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, offsets = flat([list(set(line_keys(x or b"", least)) - {None}) for x in batch.column(1).to_pylist()])
            rows = [i for i in range(batch.num_rows) for _ in range(offsets[i + 1] - offsets[i])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.binary())], names=["row_key", "line_key"])

    chosen = docs.where(F.col(key).isNotNull()).select(F.col(key), F.col(text).cast("string").cast("binary"))
    return chosen.mapInArrow(run, f"row_key {docs.schema[key].dataType.simpleString()}, line_key binary").withColumnRenamed("row_key", key)


@dataclass(frozen=True)
class Run:
    """A run's folder, its level and the first and last batch in it."""

    path: str
    level: int
    first: int
    last: int

    def within(self, other: Run) -> bool:
        return self != other and other.first <= self.first and self.last <= other.last


@dataclass
class LineIndex:
    """The runs in a folder that all executors share; one writer at a time. A document (an id) is in one batch only.

    kind: the type of ids. buckets: as many for all runs of the folder; the session's shuffle partitions where the folder is new.
    """

    spark: SparkSession
    path: str
    kind: str = "bigint"
    least_docs: int = LEAST_DOCS
    fanout: int = FANOUT
    buckets: int = 0

    def __post_init__(self) -> None:
        known = {int(x.rsplit("-", 1)[1]) for x in self._names()}
        self.buckets = known.pop() if known else self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}

    def _folder(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        """Complete runs, by name."""
        folder, files = self._folder(self.path)
        if not files.exists(folder):
            return []
        every = [x.getPath() for x in files.listStatus(folder)]
        return [x.getName() for x in every if x.getName().startswith("run-") and files.exists(self._folder(f"{x}/_SUCCESS")[0])]

    def runs(self) -> list[Run]:
        """The runs that count, oldest first."""
        every = []
        for name in self._names():
            level, first, last = (int(x) for x in name.split("-")[1:4])
            every.append(Run(f"{self.path}/{name}", level, first, last))
        return sorted((x for x in every if not any(x.within(y) for y in every)), key=lambda x: x.first)

    def rows(self, run: Run) -> DataFrame:
        """line_key, docs and last of a run, as a bucketed table."""
        if run.path not in self.tables:
            self.tables[run.path] = f"line_run_{uuid.uuid4().hex}"
            columns = RUN.format(kind=self.kind)
            self.spark.sql(f"CREATE TABLE {self.tables[run.path]} ({columns}) USING parquet CLUSTERED BY (line_key) SORTED BY (line_key) INTO {self.buckets} BUCKETS LOCATION '{run.path}'")
        return self.spark.table(self.tables[run.path])

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{self.path}/run-{level}-{first}-{last}-{self.buckets}"
        # rows come by key already, in one partition for each bucket where the session's shuffle partitions are as many
        rows = rows.repartition(self.buckets, "line_key")
        rows.write.mode("overwrite").bucketBy(self.buckets, "line_key").sortBy("line_key").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the folder stays: readers name it anew

    def add(self, keys: DataFrame, key: str = "doc_id") -> None:
        """Adds a batch's rows (key, line_key)."""
        runs = self.runs()
        # the batch's rows are counted by id first, so that repeated ids count once and a hot key comes as one row from each task
        new = keys.select("line_key", F.col(key).alias("id")).distinct().groupBy("line_key").agg(F.count("*").alias("docs"), F.max("id").alias("last"))
        for run in runs:
            old = self.rows(run).select(F.col("line_key").alias("old_key"), F.col("docs").alias("old_docs"), F.col("last").alias("old_last"))
            new = new.join(old.where(F.col("old_docs") >= self.least_docs).hint("merge"), (F.col("line_key") == F.col("old_key")) & (F.col("last") <= F.col("old_last")), "left_anti")
        batch = max((x.last for x in runs), default=-1) + 1
        self._write(new, 0, batch, batch)
        self._compact()

    def merged(self, runs: list[Run]) -> DataFrame:
        """The rows of some runs as one run."""
        # read as plain files: a union of bucketed tables claims their partitioning and yet isn't read by it
        kind = RUN.format(kind=self.kind)
        every = self.spark.read.schema(kind).parquet(*(x.path for x in runs)) if runs else self.spark.createDataFrame([], kind)
        return every.groupBy("line_key").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def _compact(self) -> None:
        level = 0
        while len(own := [x for x in self.runs() if x.level == level]) >= self.fanout:
            self._write(self.merged(own), level + 1, own[0].first, own[-1].last)
            for run in own:
                folder, files = self._folder(run.path)
                files.delete(folder, True)
                if run.path in self.tables:
                    self.spark.sql(f"DROP TABLE {self.tables.pop(run.path)}")
            level += 1

    def common(self) -> DataFrame:
        """line_key and last of the keys that least_docs documents hold."""
        return self.merged(self.runs()).where(F.col("docs") >= self.least_docs).select("line_key", "last")


def batch_of(docs: DataFrame, key: str, batches: int) -> list:
    """Ids that part the documents into `batches` ranges of about equal size, largest first."""
    if batches < 2:
        return []
    at = docs.select(F.percentile_approx(key, [1 - i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted(set(at or []), reverse=True)


def index_of(docs: DataFrame, key: str = "doc_id", text: str = "text", least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> tuple[LineIndex, DataFrame]:
    """An index of all documents, added in batches from the largest ids down (a key's first batch then has its last document), and their keys."""
    spark, home = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/lines-{uuid.uuid4().hex}"
    edges = batch_of(docs, key, batches)
    number = sum((F.when(F.col(key) < x, 1).otherwise(0) for x in edges), F.lit(0))
    keys_of(docs, key, text, least_points).withColumn("batch", number).write.partitionBy("batch").parquet(f"{home}/keys")
    kind = docs.schema[key].dataType.simpleString()
    keys = spark.read.schema(f"`{key}` {kind}, line_key binary, batch int").parquet(f"{home}/keys")
    index = LineIndex(spark, f"{home}/runs", kind, least_docs, fanout)
    for i in range(len(edges) + 1):
        index.add(keys.where(F.col("batch") == i), key)
    return index, keys.drop("batch")


def without(text: bytes, drops: set[bytes], least: int = LEAST_POINTS) -> tuple[bytes, int, int]:
    """The text without the lines whose keys are in drops, its number of lines, and of those dropped."""
    lines = text.split(b"\n")
    left = [x for x, y in zip(lines, line_keys(text, least), strict=True) if y not in drops] if drops else lines
    return (b"\n".join(left) if drops else text), len(lines), len(lines) - len(left)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with common lines only in the largest id that holds them, and n_lines (before) and n_dropped."""
    index, keys = index_of(docs, key, text, least_points, least_docs, batches, fanout)
    common = written(index.common(), "common")
    # merged at every size; both sides are read from files, so that a hot key's partition can be split
    again = keys.join(common.hint("merge"), "line_key").where(F.col(key) < F.col("last"))
    drops = written(again.groupBy(F.col(key).alias("__id")).agg(F.collect_set("line_key").alias("__drops")), "drops")  # at most a document's own lines

    @F.pandas_udf("text binary, n_lines long, n_dropped long")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = [without(x or b"", set() if y is None else set(y), least_points) for x, y in zip(texts, gone, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    names = {x: x + "_" * next(i for i in range(len(docs.columns) + 1) if x + "_" * i not in docs.columns) for x in ("n_lines", "n_dropped")}
    joined = docs.join(drops.hint("merge"), F.col(f"`{key}`") == F.col("__id"), "left").withColumn("__cut", cut(F.col(f"`{text}`").cast("string").cast("binary"), F.col("__drops")))
    kept = F.when(F.col("__cut.n_dropped") > 0, F.col("__cut.text").cast("string")).otherwise(F.col(f"`{text}`").cast("string"))
    return joined.select(*(kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns), *(F.col(f"__cut.{x}").alias(y) for x, y in names.items()))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op13_line_dedup": op13_line_dedup}
ORACLE = {
    "op13_line_dedup": """
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT row_no, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM lines),
common AS (
  SELECT line_key, max(doc_id) AS last FROM keyed WHERE length(line_key) >= 40 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, coalesce(doc_id < last, false) AS gone FROM keyed LEFT JOIN common USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id"""
}
