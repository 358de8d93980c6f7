"""Secret scans over an incremental ledger of blobs.

A blob is one version of a text, addressed by its SHA-256. A ledger is a folder with two tables that only grow: `blobs` has a row for each blob and
rule version that was ever scanned, `versions` one for each path and blob that the path ever held. A scan
takes the blobs of its input, leaves out those that the ledger has under the present rules, scans each of the rest once however
many paths carry it, appends to both tables and joins findings back to all paths, or to all versions of all paths.

Null texts count as empty. Repeated rows and copies share one blob. Spans are in code points with exclusive ends. An empty table or
ledger is fine; further columns are left alone. Rows that a broken run appended twice count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, table

LEDGER = "sha string, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
FINDINGS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
VERSIONS = "path string, sha string"
BASE = ("assign", "access", "hex")
#: What stands between the lines of a key, also where line ends are written out.
GAP = r"(?:\\[nr]|\s)*+"
#: Patterns by kind; those of BASE come first. A private key is its BEGIN line, the headers and base64 that follow, and its END line, if that is next. Fixed values.
PATTERNS = {
    "assign": r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "private_key": rf"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:{GAP}(?:(?:Proc-Type|DEK-Info): [^\r\n]*|[A-Za-z0-9+/=]{{16,}}|[A-Za-z0-9+/]+={{1,2}}))*+(?:{GAP}[A-Za-z0-9+/=]{{0,76}}{GAP}-----END (?:[A-Z]+ )*PRIVATE KEY-----)?",
    "code_host": r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    "chat": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "web_token": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
}
#: Any text that the pattern matches has one of these, in lower case. Fixed values.
NEEDS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "private_key": ("-----begin",), "code_host": ("gh",), "chat": ("xox",), "web_token": ("eyj",)}


@dataclass(frozen=True)
class Rules:
    patterns: dict[str, str] = field(default_factory=lambda: dict(PATTERNS))

    @property
    def version(self) -> str:
        """Changes whenever a pattern does."""
        return hashlib.sha256(repr(list(self.patterns.items())).encode()).hexdigest()[:16]


def spans_of(text: str, compiled: list[tuple[str, re.Pattern]]) -> list[tuple[int, int, str]]:
    """(start, order of the kind, 'kind:start:end') of all secrets in text, in order."""
    lower, out = text.lower(), []
    for order, (kind, pattern) in enumerate(compiled):
        if kind in NEEDS and not any(x in lower for x in NEEDS[kind]):
            continue
        for m in pattern.finditer(text):
            if kind == "assign" and m.end(1) - m.start(1) < 6 or kind == "access" and m.end() - m.start() < 20:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def scan_blobs(blobs: DataFrame, rules: Rules) -> DataFrame:
    """A ledger row for each row of blobs (sha, text)."""
    version, names = rules.version, [x.split()[0] for x in LEDGER.split(", ")]
    patterns = list(rules.patterns.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(kind, re.compile(p)) for kind, p in patterns]
        for batch in slices(batches):
            rows = []
            for sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = spans_of(text, compiled)
                base = [x for x in found if compiled[x[1]][0] in BASE]
                n = [sum(compiled[x[1]][0] == kind for x in base) for kind in BASE]
                rows.append((sha, version, *n, hashlib.sha256(",".join(x[2] for x in base).encode()).hexdigest(), ",".join(x[2] for x in found)))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return blobs.mapInArrow(run, LEDGER)


def content(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


@dataclass(frozen=True)
class Ledger:
    """The ledger in a folder that all executors share; one writer at a time."""

    spark: SparkSession
    path: str

    def _table(self, name: str, schema: str) -> DataFrame:
        folder = f"{self.path}/{name}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(schema).parquet(folder) if there else self.spark.createDataFrame([], schema)

    def blobs(self, rules: Rules | None = None) -> DataFrame:
        """The rows scanned under these rules, one for each blob."""
        return self._table("blobs", LEDGER).where(F.col("rules") == (rules or Rules()).version).dropDuplicates(["sha"])

    def versions(self) -> DataFrame:
        """path and sha, once for each blob that a path ever held."""
        return self._table("versions", VERSIONS).distinct()

    def update(self, docs: DataFrame, rules: Rules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Scans the blobs of docs that are not in the ledger under these rules, and appends them and new versions; gives blobs()."""
        rules = rules or Rules()
        own = docs.select(F.sha2(content(text), 256).alias("sha"), content(text).alias("text"))
        unseen = own.dropDuplicates(["sha"]).join(self.blobs(rules).select("sha"), "sha", "left_anti")
        scan_blobs(unseen, rules).write.mode("append").parquet(f"{self.path}/blobs")
        paths = docs.select(F.col(key).cast("string").alias("path"), F.sha2(content(text), 256).alias("sha")).where("path is not null").distinct()
        paths.join(self.versions(), ["path", "sha"], "left_anti").write.mode("append").parquet(f"{self.path}/versions")
        return self.blobs(rules)

    def history(self, rules: Rules | None = None) -> DataFrame:
        """Each version (path, sha) that a path ever held with its blob's findings; versions not yet scanned under these rules have nulls."""
        return self.versions().join(self.blobs(rules).drop("rules"), "sha", "left").select("path", "sha", *FINDINGS)


def ledger_of(spark: SparkSession, corpus: str) -> Ledger:
    """The ledger of a corpus, by its location: in the folder that fieldstone.secret.ledger names, else in the shared folder."""
    home = spark.conf.get("fieldstone.secret.ledger", None) or f"{shared_dir(spark)}/secret-ledger"
    return Ledger(spark, f"{home}/{hashlib.sha256(corpus.encode()).hexdigest()[:16]}")


def findings(docs: DataFrame, blobs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each path (row) of docs with its blob's row of the ledger."""
    paths = docs.select(F.col(key), F.sha2(content(text), 256).alias("sha"))
    return paths.join(blobs.drop("rules"), "sha").select(key, "sha", *FINDINGS)


def redact(docs: DataFrame, blobs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each secret replaced by a mark; texts without one, and all other columns, stay as they are (n_chars follows the text)."""
    rows = blobs.where("spans != ''").select(F.col("sha").alias("__sha"), F.col("spans").alias("__spans"))
    whole = F.col(f"`{text}`").cast("string")
    ends = F.transform(F.split("__spans", ","), lambda x: F.transform(F.slice(F.split(x, ":"), 2, 2), lambda y: y.cast("int")))

    def cut(done: Column, span: Column) -> Column:
        start, end = span[0], span[1]
        more = F.concat(done["out"], F.substr(whole, done["at"] + 1, start - done["at"]), F.lit(mark))
        return F.struct(F.when(start >= done["at"], more).otherwise(done["out"]).alias("out"), F.greatest(done["at"], end).alias("at"))

    cuts = F.aggregate(ends, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), cut, lambda done: F.concat(done["out"], F.substr(whole, done["at"] + 1)))
    # the new text gets a name of its own: in one select, lambdas would read a new column "text" for the old one
    marked = docs.withColumn("__sha", F.sha2(content(text), 256)).join(rows, "__sha", "left").withColumn("__cut", F.when(F.col("__spans").isNotNull(), cuts))
    changed = {text: F.coalesce("__cut", whole)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length("__cut").cast(docs.schema["n_chars"].dataType))
    return marked.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = findings(docs, ledger_of(spark, f"{sf_dir}/documents").update(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLE: dict[str, str] = {}
