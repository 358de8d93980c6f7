"""Approval model: transform statistics, encoding, logistic fit, calibration, leave-one-out, support checks, explanation.

Statistics over rows are Spark aggregations. The fits are fixed gradient schedules on a template's different training vectors with their counts; blocks of
held-out cases are groups of their own, so the refits run beside each other. A template too large for that is fitted by Newton steps on sums over all its
rows (refits): to the optimum, which the schedule has reached there to about 1e-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources.scratch import written
from . import refits
from .ranges import running

#: Schedules of the two fits, readiness, and distances beyond which a case is unlike training.
FIT = {"steps": 2400, "rate": 0.18, "cut": 0.55, "at": (800, 1600), "l2": 0.04}
PLATT = {"steps": 1600, "rate": 0.14, "cut": 0.6, "at": (600, 1200), "l2": 0.02}
LEAST_ROWS, LEAST_OF_CLASS = 7, 3
MEDIUM_DISTANCE, HIGH_DISTANCE = 1.8, 3.0
#: Cases of a template whose refits follow the schedule (larger ones are refitted by sums), refits of a task, and different vectors of a template that a task fits.
SCHEDULED, FOLD_BLOCK, MOST_VECTORS = 200, 25, 50_000
#: Values of a block of vectors that meets another one in a task (of 64 values 65,536 vectors, 32 MB), and the least vectors that are worth a further block.
BLOCK_VALUES, LEAST_BLOCK = 1 << 22, 4096
#: Rows times lists that are held against each other at once, rows and vectors of a product of matrices, and pairs whose exact distance is taken at once.
PROBES, TILE_ROWS, TILE, EXACT = 1 << 20, 1024, 4096, 1 << 14


def transform_spec(rows: DataFrame, numeric: list[str], groups: list[str] | None = None) -> DataFrame:
    """For each group and numeric feature: median of present values, mean and population deviation of the filled column (0 becomes 1), and whether any was missing."""
    groups = groups or []
    long = rows.select(*groups, F.posexplode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in numeric]))).select(*groups, "col.feature", "col.value")
    keys = [*groups, "feature"]
    middle = long.groupBy(*keys).agg(F.coalesce(F.median("value"), F.lit(0.0)).alias("median"), F.count("*").alias("n"), F.count("value").alias("present"))
    joined = long.join(middle, keys)
    filled = F.coalesce("value", "median")
    stats = joined.groupBy(*keys).agg(F.first("median").alias("median"), F.avg(filled).alias("mean"), F.stddev_pop(filled).alias("std"), (F.first("present") < F.first("n")).alias("any_missing"))
    return stats.select(*keys, F.round("median", 12).alias("median"), F.round("mean", 12).alias("mean"), F.round(F.when(F.col("std") > 0, F.col("std")).otherwise(1.0), 12).alias("std"), "any_missing")


def categories(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature and its sorted values, missing ones and empty texts left out."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])).alias("x"))
    return long.where("x.value is not null").groupBy("x.feature").agg(F.array_sort(F.collect_set("x.value")).alias("categories"))


def encoded(spec: dict[str, dict], category_spec: dict[str, list[str]], booleans: list[str]) -> tuple[Column, list[str]]:
    """The vector of a row, and the base feature of each of its places: z-scores with medians filled in and a missing flag where training had one, one-hot, 0/1."""
    parts, names = [], []
    for feature, s in sorted(spec.items()):
        value = F.col(feature).cast("double")
        parts.append((F.coalesce(value, F.lit(float(s["median"]))) - float(s["mean"])) / float(s["std"]))
        names.append(feature)
        if s["any_missing"]:
            parts.append(F.when(value.isNull(), 1.0).otherwise(0.0))
            names.append(feature)
    for feature, values in sorted(category_spec.items()):
        for v in values:
            parts.append(F.when(F.col(feature).cast("string") == v, 1.0).otherwise(0.0))
            names.append(feature)
    for feature in sorted(booleans):
        parts.append(F.when(F.coalesce(F.col(feature), F.lit(False)), 1.0).otherwise(0.0))
        names.append(feature)
    return F.array(*parts), names


def descend(x: np.ndarray, y: np.ndarray, n: np.ndarray, start: np.ndarray, steps: int, rate: float, cut: float, at: tuple[int, ...], l2: float) -> np.ndarray:
    """Full-batch gradient descent on log loss; the first place is the intercept, which isn't shrunk.

    One model for each column of start and of n, which says how often each row counts in it. x is the rows of all models, or a stack of one for each.
    """
    w, total = start.copy(), np.maximum(n.sum(axis=0), 1)
    forward, back = ("ij,jk->ik", "ij,ik->jk") if x.ndim == 2 else ("kij,jk->ik", "kij,ik->jk")
    for step in range(steps):
        if step in at:
            rate *= cut
        z = x @ w if x.ndim == 2 else np.einsum(forward, x, w)
        e = np.exp(-np.abs(z))
        gap = n * (np.where(z >= 0, 1.0, e) / (1 + e) - y[:, None])
        slope = (x.T @ gap if x.ndim == 2 else np.einsum(back, x, gap)) / total
        slope[1:] += l2 * w[1:]
        w -= rate * slope
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Intercept and coefficients; with several columns in n, a column of them for each."""
    counts = np.ones((len(y), 1)) if n is None else n
    w = descend(np.column_stack([np.ones(len(x)), x]), y, counts, np.zeros((x.shape[1] + 1, counts.shape[1])), **FIT)
    return w[:, 0] if n is None else w


def fit_platt(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """a and b of sigmoid(a + b logit(p)); begins at 0 and 1. With n, p has a column for each of its models."""
    counts = np.ones((len(y), 1)) if n is None else n
    q = np.clip(p.reshape(len(y), -1), 1e-6, 1 - 1e-6)
    logit = np.log(q / (1 - q)).T
    w = descend(np.stack([np.ones_like(logit), logit], axis=2), y, counts, np.repeat([[0.0], [1.0]], counts.shape[1], axis=1), **PLATT)
    return w[:, 0] if n is None else w


def compressed(rows: DataFrame, *columns: str) -> DataFrame:
    """template, vector, label, columns and n, how often they occur: equal rows meet before they reach a fit."""
    return rows.groupBy("template", "vector", "label", *columns).agg(F.count("*").alias("n"))


def by_size(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of templates with up to `most` rows, and those of larger ones."""
    held = written(rows, "sized")
    size = written(held.groupBy("template").agg(F.count("*").alias("__size")), "sizes")
    small, large = (size.where(test).select("template") for test in (F.col("__size") <= most, F.col("__size") > most))
    return held.join(small, "template", "left_semi"), held.join(large, "template", "left_semi")


def models(rows: DataFrame) -> DataFrame:
    """template, weights (intercept first), platt and n from training rows (template, vector, label)."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["label", "vector"], key=lambda c: c.map(tuple) if c.name == "vector" else c)
        x, y, n = np.array(group["vector"].tolist(), float), group["label"].to_numpy(float), group["n"].to_numpy(float)[:, None]
        w = fit_logistic(x, y, n)
        p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
        return pd.DataFrame({"template": group["template"].iloc[:1], "weights": [w[:, 0].tolist()], "platt": [fit_platt(p, y, n)[:, 0].tolist()], "n": [int(n.sum())]})

    small, large = by_size(compressed(rows), MOST_VECTORS)
    schema = f"template {small.schema['template'].dataType.simpleString()}, weights array<double>, platt array<double>, n long"
    out = small.groupBy("template").applyInPandas(fit, schema)
    if large.isEmpty():
        return out
    fits = refits.whole_fits(large, FIT["l2"])
    platts = refits.whole_fits(large, PLATT["l2"], {k: w for k, (w, _, _) in fits.items()})
    return out.unionByName(rows.sparkSession.createDataFrame([(k, w.tolist(), platts[k][0].tolist(), int(n)) for k, (w, _, n) in fits.items()], schema))


def cross_validated(rows: DataFrame) -> DataFrame:
    """template, case_id, label and probability by the model of all other cases of its template; null if those are of one class and many."""
    small, large = by_size(rows.select("template", "case_id", "vector", "label"), SCHEDULED)
    marked = written(small.withColumn("fold", F.row_number().over(Window.partitionBy("template").orderBy("case_id")) - 1), "folds")
    folds = marked.select("template", "fold").distinct().withColumn("block", F.floor(F.col("fold") / FOLD_BLOCK).cast("int"))
    blocks = folds.groupBy("template", "block").agg(F.array_sort(F.collect_list("fold")).alias("held"))
    spread = compressed(marked, "fold").join(blocks, "template")

    def refit(group: pd.DataFrame) -> pd.DataFrame:
        held = np.array(group["held"].iloc[0])
        x, y, fold = np.array(group["vector"].tolist(), float), group["label"].to_numpy(float), group["fold"].to_numpy()
        n = group["n"].to_numpy(float)[:, None] * (fold[:, None] != held)
        w = fit_logistic(x, y, n)
        platt = fit_platt(1 / (1 + np.exp(-(w[0] + x @ w[1:]))), y, n)
        return pd.DataFrame({"template": group["template"].iloc[0], "fold": held, "weights": w.T.tolist(), "platt": platt.T.tolist()})

    kind = rows.schema["template"].dataType.simpleString()
    fits = spread.groupBy("template", "block").applyInPandas(refit, f"template {kind}, fold int, weights array<double>, platt array<double>")
    scored = marked.join(fits, ["template", "fold"]).select("template", "case_id", "label", "vector", "weights", "platt")
    if not large.isEmpty():
        other = refits.left_out(compressed(large), FIT["l2"], PLATT["l2"])
        scored = scored.unionByName(large.join(other, ["template", "vector", "label"]).select(*scored.columns))
    return scored.select("template", "case_id", "label", calibrated(F.col("platt"), raw_probability(F.col("weights"), F.col("vector"))).alias("probability"))


def raw_probability(weights: Column, vector: Column) -> Column:
    dot = F.aggregate(F.zip_with(F.slice(weights, F.lit(2), F.size(vector)), vector, lambda w, x: w * x), F.lit(0.0), lambda s, x: s + x)
    return N.sigmoid(F.get(weights, F.lit(0)) + dot)


def calibrated(platt: Column, raw: Column) -> Column:
    p = N.probability(raw)
    return N.sigmoid(F.get(platt, F.lit(0)) + F.get(platt, F.lit(1)) * F.ln(p / (1 - p)))


def drivers(rows: DataFrame, key: str, coefficients: dict[str, float], n: int = 5) -> DataFrame:
    """key, direction, rank, feature and contribution of the n features that raise and lower a row's score most: coefficient times value (encoded columns), summed by base feature."""
    pairs = F.array(*[F.struct(F.lit(c.split("=")[0]).alias("feature"), (F.col(f"`{c}`") * F.lit(float(v))).alias("part")) for c, v in sorted(coefficients.items())])
    summed = rows.select(key, F.explode(pairs).alias("x")).groupBy(key, "x.feature").agg(F.sum("x.part").alias("contribution"))
    signed = summed.where("contribution <> 0").withColumn("direction", F.when(F.col("contribution") > 0, "positive").otherwise("negative"))
    order = Window.partitionBy(key, "direction").orderBy(F.abs("contribution").desc(), F.asc("feature"))
    return signed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(key, "direction", "rank", "feature", "contribution")


def explanations(contributions: DataFrame, missing: DataFrame, links: DataFrame, key: str, unknowns: int = 8, most_links: int = 12) -> DataFrame:
    """key with arrays of its drivers() up and down, of the first missing features by name, and of the first evidence links by position that lead anywhere.

    missing: key, feature. links: key, position, topic, source_label, source_url, source_snapshot_id, raw_asset_id.
    """
    way = lambda name: F.array_sort(F.collect_list(F.when(F.col("direction") == name, F.struct("rank", "feature", F.round("contribution", 6).alias("contribution"))))).alias(name)
    known = contributions.groupBy(key).agg(way("positive"), way("negative"))
    first = missing.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("feature"))).where(F.col("n") <= unknowns)
    first = first.groupBy(key).agg(F.array_sort(F.collect_list("feature")).alias("unknowns"))
    leading = links.where(F.coalesce("source_url", "source_snapshot_id", "raw_asset_id").isNotNull())
    cut = leading.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where(F.col("n") <= most_links)
    cut = cut.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "topic", "source_label", "source_url", "source_snapshot_id", "raw_asset_id"))).alias("evidence_links"))
    return known.join(first, key, "left").join(cut, key, "left")


def losses(rows: DataFrame, groups: list[str] | None = None, p: str = "probability", y: str = "label") -> DataFrame:
    """brier, log_loss (probabilities kept off 0 and 1) and case_count."""
    q = N.probability(F.col(p))
    loss = -F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q))
    return rows.groupBy(*(groups or [])).agg(N.round_half_up(F.avg(F.pow(F.col(p) - F.col(y), 2)), 6).alias("brier"), N.round_half_up(F.avg(loss), 6).alias("log_loss"), F.count("*").alias("case_count"))


def calibration(rows: DataFrame, p: str = "probability", y: str = "label") -> DataFrame:
    """band, case_count, mean_probability and observed_rate in steps of five per cent."""
    return rows.groupBy(N.calibration_band(F.col(p)).alias("band")).agg(F.count("*").alias("case_count"), F.avg(p).alias("mean_probability"), F.avg(F.col(y).cast("double")).alias("observed_rate"))


def nearest_rank(rows: DataFrame, value: str, share: float) -> DataFrame:
    """The value at place round((n - 1) share) of the sorted values, halves to the even place: from counts of the values before."""
    spread = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("times"))
    different, n = spread.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    before = running(spread, [F.col(value)], {"before": F.col("times")}, different)
    place = F.bround((F.lit(n) - 1) * F.lit(share), 0)
    return before.where(F.col("before") + F.col("times") > place).agg(F.min(value).alias("percentile"))


def nearest_distance(rows: DataFrame, training: DataFrame, key: str = "id", vector: str = "vector", size: int = 500, most_lists: int = 1024) -> DataFrame:
    """key and the distance to the nearest training vector of another id. Vectors that are null or hold something not finite take no part.

    Training vectors lie in lists around centroids, with the list's reach. Blocks of rows meet blocks of lists: first the block of a row's nearest list,
    which gives a bound, then those whose lists can hold something nearer, by the triangle inequality. A vector so travels once a block and not once a list,
    and a task holds two blocks at most. Within a block only such lists are looked through. The result is exact whatever the centroids are.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    types = [df.schema[vector].dataType for df in (rows, training)]
    array = types[0].simpleString() if types[0] == types[1] and types[0].elementType.simpleString() == "float" else "array<double>"
    sound = lambda df: df.select(key, F.col(vector).cast(array).alias(vector)).where(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    # equal vectors are one; where they are of several ids, each of their rows has one of another id at distance 0
    same = sound(training).groupBy(vector).agg(F.min(key).alias("lo"), (F.min(key) != F.max(key)).alias("several"))
    known = written(same.withColumn("draw", F.pmod(F.xxhash64("lo"), F.lit(1 << 30))), "known")
    n = known.count()
    lists = max(1, min(most_lists, n // size))
    middle = np.array([r[0] for r in known.where(F.col("draw") < int(min(1.0, 4 * lists / max(1, n)) * (1 << 30))).orderBy("draw", "lo").select(vector).limit(lists).collect()] or [r[0] for r in known.select(vector).limit(1).collect()], float)
    if not len(middle):
        return rows.select(key, F.lit(None).cast("double").alias("nearest_distance")).where("false")
    shared = spark.sparkContext.broadcast(middle)
    length = float(np.sqrt((middle**2).sum(axis=1)).max())
    step = max(1, PROBES // len(middle))  # rows that are held against all lists at once

    def gaps(found: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((found**2).sum(axis=1)[:, None] + (shared.value**2).sum(axis=1) - 2 * found @ shared.value.T, 0))

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for f in (whole.iloc[at : at + step] for whole in frames for at in range(0, len(whole), step)):
            yield f, np.array(f[vector].tolist(), float)

    def placed(df: DataFrame, filled: np.ndarray, label: str) -> DataFrame:
        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f, x in some(frames):
                gap = np.where(filled, gaps(x), np.inf)
                yield f.assign(list=gap.argmin(axis=1).astype(np.int32), gap=gap.min(axis=1))

        schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in df.schema) + ", list int, gap double"
        return written(df.mapInPandas(place, schema), label)

    def dealt(df: DataFrame, own: str, rank: dict[int, int]) -> tuple[DataFrame, dict[int, tuple[int, int]], np.ndarray]:
        """df with `block`, list after list, those of a large list in several; first and last block of each list, and the lists' reaches."""
        found = {r["list"]: r for r in df.groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("reach")).collect()}  # a row for each list
        total = sum(r["n"] for r in found.values())
        n_blocks = max(-(-total // max(1, BLOCK_VALUES // middle.shape[1])), min(math.ceil((4 * spark.sparkContext.defaultParallelism) ** 0.5), -(-total // LEAST_BLOCK)), 1)
        per, start, spans = max(1, -(-total // n_blocks)), 0, []
        for i in sorted(found, key=rank.get):
            spans.append((i, start, found[i]["n"]))
            start += found[i]["n"]
        at = F.broadcast(spark.createDataFrame(spans, "list int, start bigint, n bigint"))
        block = F.floor((F.col("start") + F.pmod(F.xxhash64(own), F.col("n"))) / per).cast("int")
        reach = np.array([found[i]["reach"] if i in found else -np.inf for i in range(len(middle))])
        return df.join(at, "list").withColumn("block", block).drop("start", "n", "gap"), {i: (a // per, (a + m - 1) // per) for i, a, m in spans}, reach

    along = (middle - middle.mean(axis=0)) @ np.linalg.svd(middle - middle.mean(axis=0), full_matrices=False)[2][0]
    rank = {int(i): place for place, i in enumerate(np.argsort(along))}  # neighbours lie in one block
    theirs, spans, reach = dealt(placed(known.drop("draw"), np.full(len(middle), True), "lists"), "lo", rank)
    about = spark.sparkContext.broadcast(reach)
    twins = known.where("several").select(vector, F.lit(True).alias("twin"))
    every = written(sound(rows).join(twins, vector, "left").select(key, vector, F.coalesce("twin", F.lit(False)).alias("twin")), "asked")
    at_once = every.where("twin").select(key, F.lit(0.0).alias("nearest_distance"))
    own, held, _ = dealt(placed(every.where("not twin").drop("twin"), np.isfinite(reach), "rows"), key, rank)
    if not held:
        return at_once.groupBy(key).agg(F.min("nearest_distance").alias("nearest_distance"))
    own = own.withColumnRenamed("block", "row_block")
    homes = F.broadcast(spark.createDataFrame([(i, x[0]) for i, x in spans.items()], "list int, block int"))
    own = own.join(homes, "list")

    def least(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({key: left[key].iloc[:0], "nearest_distance": np.zeros(0)})
        right = right.sort_values("list", kind="stable")
        y = np.array(right[vector].tolist(), float)
        names, begins = np.unique(right["list"].to_numpy(), return_index=True)
        ends = np.append(begins[1:], len(y))
        y_half = np.hstack([y, -(y**2).sum(axis=1)[:, None] / 2])
        xs, best = np.array(left[vector].tolist(), float), left["bound"].to_numpy(float).copy()
        # rows and vectors of one id, by row
        alone = pd.DataFrame({"id": right["lo"].to_numpy(), "at": np.arange(len(y))})[~right["several"].to_numpy(bool)]
        mine = pd.DataFrame({"id": left[key].to_numpy(), "row": np.arange(len(xs))}).merge(alone, on="id").sort_values("row")
        mine_row, mine_at = mine["row"].to_numpy(), mine["at"].to_numpy()

        def look(x: np.ndarray, who: np.ndarray, bound: np.ndarray, skip: tuple[np.ndarray, np.ndarray], lo: int, hi: int) -> None:
            own_x = x if len(who) == len(x) else x[who]
            square = (own_x**2).sum(axis=1)
            score = np.hstack([own_x, np.ones((len(own_x), 1))]) @ y_half[lo:hi].T  # the greater, the nearer
            inside = (skip[1] >= lo) & (skip[1] < hi)
            if inside.any():
                place = np.full(len(x), -1)
                place[who] = np.arange(len(who))
                r, c = place[skip[0][inside]], skip[1][inside] - lo
                score[r[r >= 0], c[r >= 0]] = -np.inf
            top = score.max(axis=1)
            error = 1e-12 * (square - 2 * y_half[lo:hi, -1].min())
            hit = np.flatnonzero(~(square - 2 * top > bound[who] ** 2 + error))  # what can't be compared is looked at, too
            near = score[hit]
            r, c = np.nonzero(~(near < (top - error / 2)[hit][:, None]) & (near != -np.inf))
            for at in range(0, len(r), EXACT):
                a, b = hit[r[at : at + EXACT]], lo + c[at : at + EXACT]
                np.fmin.at(bound, who[a], np.sqrt(((y[b] - own_x[a]) ** 2).sum(axis=1)))

        with np.errstate(all="ignore"):
            for at in range(0, len(xs), TILE_ROWS):
                x, bound = xs[at : at + TILE_ROWS], best[at : at + TILE_ROWS]
                inside = slice(*np.searchsorted(mine_row, (at, at + len(x))))
                skip = mine_row[inside] - at, mine_at[inside]
                gap = gaps(x)[:, names]
                nearest, gap = gap.argmin(axis=1), gap - about.value[names] - 1e-6 * (1 + length + np.sqrt((x**2).sum(axis=1)))[:, None]
                for first in (True, False):
                    for i, (begin, end) in enumerate(zip(begins, ends, strict=True)):
                        who = np.flatnonzero(nearest == i if first else (nearest != i) & ~(gap[:, i] > bound * (1 + 1e-9)))
                        for lo in range(begin, end if len(who) else begin, TILE):
                            look(x, who, bound, skip, lo, min(end, lo + TILE))
        nearer = best < left["bound"].to_numpy(float)
        return pd.DataFrame({key: pd.Series(left[key].to_numpy()[nearer], dtype=left[key].dtype), "nearest_distance": best[nearer]})

    def look_into(asked: DataFrame) -> DataFrame:
        """asked: key, vector, bound, row_block and block."""
        pairs = written(asked.select("row_block", "block").distinct(), "pairs")
        parts = min(4096, 4 * max(1, pairs.count()))
        left = asked.repartition(parts, "row_block", "block").groupBy("row_block", "block")
        right = theirs.join(pairs, "block").repartition(parts, "row_block", "block").groupBy("row_block", "block")
        met = left.cogroup(right).applyInPandas(least, f"{key} {kind}, nearest_distance double")
        return written(met.groupBy(key).agg(F.min("nearest_distance").alias("nearest_distance")), "nearest")

    near = look_into(own.select(key, vector, F.lit(float("inf")).alias("bound"), "row_block", "block"))
    found = near.unionByName(at_once)
    last = max(x[1] for x in spans.values())
    if last:  # there are other blocks
        begin, end = (np.array([spans.get(i, (0, -1))[side] for i in range(len(middle))]) for side in (0, 1))
        over = np.array([[a <= b <= z for b in range(last + 1)] for a, z in zip(begin, end, strict=True)], np.float32)  # which lists lie in which blocks

        def further(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f, x in some(frames):
                slack = 1e-6 * (1 + length + np.sqrt((x**2).sum(axis=1)))
                can = ~(gaps(x) - about.value - slack[:, None] > f["bound"].to_numpy(float)[:, None] * (1 + 1e-9))
                blocks = can.astype(np.float32) @ over > 0
                blocks[np.arange(len(f)), f["block"].to_numpy()] = False
                yield f[[key, vector, "bound", "row_block"]].assign(blocks=[np.flatnonzero(b).astype(np.int32) for b in blocks])

        bound = near.select(key, F.col("nearest_distance").alias("bound"))
        bounded = own.join(bound, key, "left").select(key, vector, F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "row_block", "block")
        rest = written(bounded.mapInPandas(further, f"{key} {kind}, {vector} {array}, bound double, row_block int, blocks array<int>"), "bounded")
        found = found.unionByName(look_into(rest.select(key, vector, "bound", "row_block", F.explode("blocks").alias("block"))))
    return found.groupBy(key).agg(F.min("nearest_distance").alias("nearest_distance"))


def support_status(distance: Column, template_support: Column, borough_support: Column, medium: float = MEDIUM_DISTANCE, high: float = HIGH_DISTANCE) -> Column:
    """IN_SUPPORT, EDGE_OF_SUPPORT or OUT_OF_DISTRIBUTION, in this order of rules."""
    return N.first_that_holds(
        [
            (template_support < LEAST_ROWS, "OUT_OF_DISTRIBUTION"), (borough_support <= 0, "EDGE_OF_SUPPORT"), (distance.isNull(), "EDGE_OF_SUPPORT"),
            (distance > high, "OUT_OF_DISTRIBUTION"), (distance > medium, "EDGE_OF_SUPPORT"),
        ],
        "IN_SUPPORT",
    )


def support_quality(template_support: Column, borough_support: Column, comparables: Column) -> Column:
    return (
        F.when((template_support >= 10) & (borough_support >= 3) & (comparables >= 4), "HIGH")
        .when((template_support >= 7) & (comparables >= 2), "MEDIUM").otherwise("LOW")
    )


def scenario_quality(stale: Column, status: Column, manual_review: Column) -> Column:
    return F.when(F.coalesce(stale, F.lit(False)) | (status != "CONFIRMED"), "LOW").when(F.coalesce(manual_review, F.lit(False)), "MEDIUM").otherwise("HIGH")


def execution_status(has_release: Column, has_storage: Column, eligibility: Column, pack_status: Column) -> Column:
    """Whether a score is worked out, or the first reason why not."""
    return N.first_that_holds(
        [
            (~has_release, "NO_ACTIVE_HIDDEN_RELEASE"), (~has_storage, "STORAGE_UNAVAILABLE"), (F.coalesce(pack_status, F.lit("")) != "SIGNED_OFF", "BASELINE_PACK_NOT_SIGNED_OFF"),
            (F.coalesce(eligibility, F.lit("")) != "PASS", "ABSTAIN"),
        ],
        "SCORED",
    )


def readiness(rows: DataFrame) -> DataFrame:
    """template, counts and whether it may be trained."""
    counts = rows.groupBy("template").agg(F.count("*").alias("case_count"), F.count_if(F.col("label") == 1).alias("positive_count"), F.count_if(F.col("label") == 0).alias("negative_count"))
    least = [F.col("case_count") >= LEAST_ROWS, F.col("positive_count") >= LEAST_OF_CLASS, F.col("negative_count") >= LEAST_OF_CLASS]
    return counts.withColumn("is_ready", reduce(lambda a, b: a & b, least))


def support_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("template", F.coalesce("borough_id", F.lit("unknown")).alias("borough_id")).agg(F.count("*").alias("case_count"))


def active_release(requests: DataFrame, scopes: DataFrame) -> DataFrame:
    """requests (template, borough_id) with release_id and scope: the borough's own active scope, else that of the whole city."""
    active = scopes.where(F.col("state") == "ACTIVE")
    own = active.where("borough_id is not null").select("template", "borough_id", F.col("release_id").alias("own"))
    city = active.where("borough_id is null").select("template", F.col("release_id").alias("city"))
    joined = requests.join(own, ["template", "borough_id"], "left").join(city, "template", "left")
    return joined.withColumns({"release_id": F.coalesce("own", "city"), "scope": F.when(F.col("own").isNotNull(), "BOROUGH").when(F.col("city").isNotNull(), "CITY")}).drop("own", "city")
