"""Which strings lie within which, by their rarest runs of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Characters of a run.
RUN = 4


def runs(text: Column, size: int) -> Column:
    """The different runs of `size` characters of a text; none if it is shorter."""
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(size)))))


def contained(parts: DataFrame, wholes: DataFrame, size: int = RUN) -> DataFrame:
    """part and whole of each two different strings, one of parts (column part) lying in one of wholes (column whole); empty strings and nulls are in none.

    A part meets the wholes that have the rarest of its runs, counted over all wholes; a part shorter than a run is looked up as it is. Repeated
    strings count once, so that no common string is a key of many rows.
    """
    p = written(parts.where("part <> ''").select("part").distinct(), "parts")
    w = written(wholes.where("whole <> ''").select("whole").distinct(), "wholes")
    held = w.select("whole", F.explode(runs(F.col("whole"), size)).alias("run"))
    known = written(held.groupBy("run").agg(F.count("*").alias("n")), "runs")
    own = p.where(F.length("part") >= size).select("part", F.explode(runs(F.col("part"), size)).alias("run"))
    rare = own.join(known, "run").groupBy("part").agg(F.min(F.struct("n", "run")).alias("key"), F.count("*").alias("found"))
    keys = rare.where(F.col("found") == F.size(runs(F.col("part"), size))).select("part", F.col("key.run").alias("run"))  # a part with a run that no whole has is in none
    found = written(keys, "keys").join(held, "run")
    short = p.where(F.length("part") < size)
    if not short.isEmpty():
        pieces = w.select("whole", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*(runs(F.col("whole"), n) for n in range(1, size))))))).alias("run"))
        found = found.unionByName(short.select("part", F.col("part").alias("run")).join(pieces, "run"))
    return found.where(F.col("whole").contains(F.col("part")) & (F.col("whole") != F.col("part"))).select("part", "whole")
