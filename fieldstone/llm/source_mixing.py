"""Mixing sources to target weights by hash order, distributed prefix sums and exact cuts.

Each row has a pseudo-random key. A source's rows are put in order of their keys: key ranges form cells of bounded expected size, the
cells' sums give where each cell begins, and a running sum inside each cell gives where each row begins. A source whose target
is e whole epochs and a rest takes every row e times, and the rest from the front of the order; the row at the cut gives a part.
A source never forms one group: its rows are spread over its cells.

Targets: sources share the whole by weight; none gets more than `most_epochs` times its size, and what is over goes to the others by
weight. Null texts have size 0 and are taken 0 times. Null sources are a source of their own, last in order. Ties in the key
fall in the order of id and text hash; rows equal in all of these are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import running
from .common import table, written

MOST_EPOCHS, SEED = 3, 11
WEIGHTS = (1, 2, 3)
#: Rows aimed at in a cell: the root of their number, so that neither a cell nor a source's list of cells grows long, and at least so many.
CELL_ROWS = 1_000
#: White space besides the blank.
WHITE = "\t\n\x0b\x0c\r"
#: Sources whose targets go to every executor; more are joined by shuffle.
MOST_BROADCAST = 20_000


def word_count(text: str) -> Column:
    """Runs of other characters than ASCII white space; 0 for null."""
    spaced = F.translate(F.col(f"`{text}`").cast("string"), WHITE, " " * len(WHITE))
    words = F.length(F.regexp_replace(F.concat(F.lit(" "), spaced), "(?s) +[^ ]?[^ ]*", "x"))
    return F.coalesce(F.when(F.trim(spaced) == "", F.lit(0)).otherwise(words - F.when(spaced.endswith(" "), 1).otherwise(0)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, weight and target from sizes (source, source_size).

    In order of cap / weight the sources that stop at their cap come first; the rest share what is left by weight.
    """
    n, everything = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    numbered = running(sizes.select("source", "source_size"), [F.col("source").isNull(), F.encode("source", "UTF-8")], {"place": F.lit(1)}, n)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    numbered = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_epochs)
    reach = F.col("cap") / F.col("weight")
    before = running(numbered, [reach, F.col("place")], {"caps": F.col("cap"), "weights": F.col("weight")}, n)
    all_weights = sum(weights) * (n // len(weights)) + sum(weights[: n % len(weights)])
    level = (F.lit(everything) - F.col("caps")) / (F.lit(all_weights) - F.col("weights"))
    # the first source in this order that its cap doesn't stop has the level of all that follow
    first_open = before.select(F.min(F.when(reach > level, F.struct(reach.alias("reach"), "place", level.alias("level"))))).first()[0]
    target = F.col("cap").cast("double")
    if first_open is not None:
        target = F.least(target, F.col("weight") * F.lit(first_open["level"]))
    return numbered.select("source", "source_size", "weight", target.alias("target"))


def ordered(rows: DataFrame, cells: int) -> DataFrame:
    """rows (source, row_key, tie, size) with begins: the words before each row in its source's hash order."""
    key = F.xxhash64(F.lit(SEED), F.col("row_key").cast("string"), F.col("tie"))
    keyed = rows.withColumn("order_key", key).withColumn("cell", F.floor((F.shiftright("order_key", 32) + (1 << 31)) * cells / (1 << 32)).cast("long"))
    sums = keyed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("cell_begins"))
    inside = Window.partitionBy("source", "cell").orderBy("order_key", "row_key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    return joined.withColumn("begins", F.col("cell_begins") + F.col("inside")).drop("s", "c", "cell", "cell_begins", "inside", "order_key")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """key, text_hash, source_name, size, source_size, target and taken of each row of docs."""
    rows = docs.select(F.col(key).alias("row_key"), F.xxhash64(F.col(text).cast("string")).alias("tie"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    rows = written(rows, "sizes")  # the texts are read once; what follows needs ids and sizes only
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    n_rows, n_sources = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    goal = targets(sizes.drop("n"), weights, most_epochs)
    goal = F.broadcast(goal) if n_sources <= MOST_BROADCAST else goal
    placed = ordered(rows, max(1, n_rows // max(CELL_ROWS, math.isqrt(n_rows)))).withColumnRenamed("source", "own")
    joined = placed.join(goal, F.col("own").eqNullSafe(F.col("source")))
    budget, whole = F.floor("target"), F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / whole).cast("long")
    rest = budget - epochs * whole
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("begins")))
    return joined.select(F.col("row_key").alias(key), F.col("tie").alias("text_hash"), F.col("own").alias("source_name"), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """docs as the mix takes them: a row for each time that a document is taken, with epoch (from 1) and taken, the words taken then.

    The one row of a source at which its budget ends has its text cut to these words (with single blanks; n_chars follows). Where docs have
    columns epoch or taken, these stay and the new ones are called epoch_ and taken_ (and so on).
    """
    kinds = mix(docs, key, text, source, weights, most_epochs).groupBy(F.col(key).alias("__mix_key"), F.col("text_hash").alias("__mix_hash"), F.col("source_name").alias("__mix_source"))
    totals = [F.max("size").alias("__mix_size"), F.max("taken").alias("__mix_most"), F.min("taken").alias("__mix_least"), F.sum("taken").alias("__mix_total"), F.count("*").alias("__mix_n")]
    kinds = written(kinds.agg(*totals).where("__mix_total > 0"), "taken")
    own = docs.withColumn("__mix_text", F.xxhash64(F.col(text).cast("string")))
    match = F.col(f"`{key}`").eqNullSafe(F.col("__mix_key")) & (F.col("__mix_text") == F.col("__mix_hash")) & F.col(f"`{source}`").cast("string").eqNullSafe(F.col("__mix_source"))
    columns = [*(F.col(f"`{c}`") for c in docs.columns), F.col("__mix_size")]
    rows = own.join(kinds.where("__mix_least = __mix_most"), match).select(*columns, F.col("__mix_most").alias("__mix_taken"))
    cut = kinds.where("__mix_least < __mix_most")
    if not cut.isEmpty():  # repeated rows at which a budget ends: some are taken once more than others
        rows = rows.unionByName(cut_copies(own.join(cut, match)).select(*columns, "__mix_taken"))
    rows = rows.where("__mix_taken > 0")
    epoch, taken = unused("epoch", docs.columns), unused("taken", docs.columns)
    rows = rows.withColumn("__mix_epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__mix_taken") / F.col("__mix_size")).cast("int"))))
    rows = rows.withColumn("__mix_now", F.least(F.col("__mix_size"), F.col("__mix_taken") - (F.col("__mix_epoch") - 1) * F.col("__mix_size")))
    words = F.split(F.trim(F.translate(F.col(f"`{text}`").cast("string"), WHITE, " " * len(WHITE))), " +")
    rows = rows.withColumn("__mix_cut", F.when(F.col("__mix_now") < F.col("__mix_size"), F.array_join(F.slice(words, F.lit(1), F.col("__mix_now").cast("int")), " ")))
    changed = {text: F.coalesce("__mix_cut", F.col(f"`{text}`"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__mix_cut").isNull(), F.col("n_chars")).otherwise(F.length("__mix_cut").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns), F.col("__mix_epoch").alias(epoch), F.col("__mix_now").alias(taken))


def unused(name: str, columns: list[str]) -> str:
    """name, with as many lines after it as make it differ from all columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def cut_copies(rows: DataFrame) -> DataFrame:
    """rows (copies with the totals of their kind) with __mix_taken: the first copies get a whole epoch more, the next what is left.

    Copies are numbered within the parts of a written table, and parts by their counts, so that no task gets all copies.
    """
    rows = written(rows.withColumn("__mix_no", F.monotonically_increasing_id()), "cut")
    part = F.shiftright("__mix_no", 33)
    kind = ["__mix_key", "__mix_hash", "__mix_source", "__mix_part"]
    rows = rows.withColumn("__mix_part", part)
    before = Window.partitionBy(*kind[:-1]).orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*kind).count().select(*(F.col(c).alias(f"{c}_of") for c in kind), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__mix_start"))
    placed = rows.withColumn("__mix_inside", F.row_number().over(Window.partitionBy(*kind).orderBy("__mix_no")) - 1)
    placed = placed.join(starts, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in kind]))
    size, whole = F.col("__mix_size"), F.floor(F.col("__mix_least") / F.col("__mix_size")) * F.col("__mix_size")
    more = F.col("__mix_total") - F.col("__mix_n") * whole - (F.col("__mix_start") + F.col("__mix_inside")) * size
    return placed.withColumn("__mix_taken", (whole + F.greatest(F.lit(0), F.least(size, more))).cast("long"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("text_hash", "source_name")


QUERIES = {"op3_source_mixing": op3_source_mixing}
ORACLE: dict[str, str] = {}
