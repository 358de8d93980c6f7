"""Logistic fits and leave-one-out refits of templates of any size, as sums over rows.

The objectives are convex, so a fit is where their gradient is zero: Newton steps need the gradient and curvature summed over all rows, one row for each place
from every task. A model that leaves one row out lies close to that of all rows. All such models of a step are worked out in one job, in which blocks of models
meet blocks of rows; each is one step away from the whole fit's curvature without its row, until no model moves. Weights of whole fits alone
pass through the driver. Equal rows (vector and label) are one row with a count, and have one model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import superseded, written

#: Rows and models of a block; steps at most, and the step below which a fit stands still.
ROW_BLOCK, MODEL_BLOCK, MOST_STEPS, STILL = 8192, 1024, 60, 1e-11


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1 + e)


def with_one(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), float)
    return np.column_stack([np.ones(len(x)), x.reshape(len(x), -1)])


def logits(z: np.ndarray) -> np.ndarray:
    """What calibration reads: the logit of a probability cut to 1e-6 from its ends."""
    edge = np.log((1 - 1e-6) / 1e-6)
    return np.clip(z, -edge, edge)


def ridge(size: int, l2: float) -> np.ndarray:
    out = np.full(size, l2)
    out[0] = 0.0
    return out


def whole_fits(rows: DataFrame, l2: float, weights: dict | None = None) -> dict[object, tuple[np.ndarray, np.ndarray, float]]:
    """For each template of rows (template, vector, label, n), the weights (intercept first, not shrunk), the curvature summed over rows there, and the rows' number.

    With the weights of fits, their calibrations (a, b of sigmoid(a + b logit)) instead.
    """
    fits: dict[object, np.ndarray] = {}
    held: dict[object, tuple[float, np.ndarray]] = {}
    for _ in range(10 * MOST_STEPS):
        now, inner = dict(fits), weights

        def sums(frames: Iterator[pd.DataFrame], now=now, inner=inner) -> Iterator[pd.DataFrame]:
            found: dict[object, np.ndarray] = {}
            for f in frames:
                for template, g in f.groupby("template", dropna=False):
                    x, y, n = with_one(g["vector"]), g["label"].to_numpy(float), g["n"].to_numpy(float)
                    if inner is not None:
                        x = np.column_stack([np.ones(len(x)), logits(x @ inner[template])])
                    w = now.get(template, np.zeros(x.shape[1]) if inner is None else np.array([0.0, 1.0]))
                    z = x @ w
                    p = sigmoid(z)
                    loss = n @ (np.logaddexp(0, z) - y * z)
                    flat = np.concatenate([[n.sum(), loss], x.T @ (n * (p - y)), ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()])
                    found[template] = found[template] + flat if template in found else flat
            for template, flat in found.items():
                yield pd.DataFrame({"template": template, "place": np.arange(len(flat)), "value": flat})

        kind = rows.schema["template"].dataType.simpleString()
        parts = rows.select("template", "vector", "label", "n").mapInPandas(sums, f"template {kind}, place long, value double").groupBy("template", "place").agg(F.sum("value").alias("value"))
        table = parts.toPandas()  # a row for each template and place of its curvature
        moved, out = False, {}
        for template, g in table.groupby("template", dropna=False):
            flat = g.sort_values("place")["value"].to_numpy()
            size = int((np.sqrt(4 * len(flat) - 7) - 1) // 2)  # 2 + size + size^2 places
            n, loss, slope, curve = flat[0], flat[1], flat[2 : 2 + size], flat[2 + size :].reshape(size, size)
            w = now.get(template, np.zeros(size) if weights is None else np.array([0.0, 1.0]))
            shrink = ridge(size, l2)
            value = loss / n + 0.5 * shrink @ (w * w)
            if template in held and value > held[template][0] + 1e-12:  # too far: half way back
                fits[template], moved = (w + held[template][1]) / 2, True
                continue
            step = np.linalg.lstsq(curve / n + np.diag(shrink), slope / n + shrink * w, rcond=None)[0]
            held[template], out[template] = (value, w), (w, curve, n)
            if np.abs(step).max() > STILL * max(1.0, np.abs(w).max()):
                fits[template], moved = w - step, True
        if not moved:
            return out
    raise RuntimeError("fits did not settle")


def block_sums(models: DataFrame, rows: DataFrame, size: int, compute) -> DataFrame:
    """model_no and sums (of `size` places): what compute(models' frame, vectors with a leading 1, labels, counts) gives for each model and block of rows, added up."""
    count = rows.groupBy("template").agg(F.count("*").alias("n_rows"))
    blocks = written(count.select("template", F.ceil(F.col("n_rows") / ROW_BLOCK).alias("row_blocks"), F.ceil(F.col("n_rows") / MODEL_BLOCK).alias("model_blocks")), "blocks")
    left = models.join(blocks, "template").withColumns({"model_block": F.pmod(F.xxhash64("model_no"), F.col("model_blocks")), "row_block": F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))}).drop("row_blocks", "model_blocks")
    right = rows.join(blocks, "template").withColumns({"row_block": F.pmod(F.xxhash64("model_no"), F.col("row_blocks")), "model_block": F.explode(F.sequence(F.lit(0), F.col("model_blocks") - 1))}).drop("row_blocks", "model_blocks")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"model_no": pd.Series([], dtype="int64"), "sums": pd.Series([], dtype=object)})
        found = compute(a, with_one(b["vector"]), b["label"].to_numpy(float), b["n"].to_numpy(float))
        return pd.DataFrame({"model_no": a["model_no"], "sums": found.tolist()})

    keys = ["template", "model_block", "row_block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "model_no long, sums array<double>")
    return met.groupBy("model_no").agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(size))).alias("sums"))


def left_out(rows: DataFrame, l2: float, platt_l2: float) -> DataFrame:
    """template, vector, label, weights and platt: the model, and its calibration, of all rows (template, vector, label, n) but one like this row.

    Templates whose rows without the one are of one class have no such model: null weights.
    """
    classes = rows.groupBy("template").agg(*(F.sum(F.when(F.col("label") == i, F.col("n")).otherwise(0)).alias(f"of_{i}") for i in (0, 1)))
    both = rows.join(classes, "template").where(F.col("n") > 0).withColumn("left", F.least(F.col("of_0") - (F.col("label") == 0).cast("int"), F.col("of_1") - (F.col("label") == 1).cast("int")))
    fit_for = written(both.select("template", "vector", "label", "n", "left", F.monotonically_increasing_id().alias("model_no")), "rows")
    if fit_for.isEmpty():
        return rows.select("template", "vector", "label", F.lit(None).cast("array<double>").alias("weights"), F.lit(None).cast("array<double>").alias("platt"))
    fits = whole_fits(fit_for, l2)
    platts = whole_fits(fit_for, platt_l2, {k: w for k, (w, _, _) in fits.items()})
    kind = fit_for.schema["template"].dataType.simpleString()
    fields = f"template {kind}, vector array<double>, label int, n long, left long, model_no long, weights array<double>, platt array<double>, step double"

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["weights"] = [fits[t][0].tolist() for t in f["template"]]
            f["platt"] = [platts[t][0].tolist() for t in f["template"]]
            f["step"] = np.inf
            yield f

    columns = ["template", "vector", "label", "n", "left", "model_no"]
    asked = fit_for.where("left > 0").select("template", F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("int").alias("label"), F.col("n").cast("long").alias("n"), F.col("left").cast("long").alias("left"), "model_no")
    models = written(asked.mapInPandas(begin, fields), "models")
    size = max(len(w) for w, _, _ in fits.values())

    def slopes(a: pd.DataFrame, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.array(a["weights"].tolist())
        out = np.zeros((len(a), size))
        out[:, : x.shape[1]] = ((sigmoid(w @ x.T) - y) * n) @ x
        return out

    def step_weights(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            moved, steps = [], []
            for t, v, y, w, s in zip(f["template"], f["vector"], f["label"], f["weights"], f["sums"], strict=True):
                whole, curve, n = fits[t]
                x, w = np.concatenate([[1.0], v]), np.array(w)
                shrink = ridge(len(x), l2)
                p = float(sigmoid(np.array(x @ w)))
                slope = (np.array(s)[: len(x)] - x * (p - y)) / (n - 1) + shrink * w
                away = (curve - np.outer(x, x) * p * (1 - p)) / (n - 1) + np.diag(shrink)
                step = np.linalg.solve(away, slope)
                moved.append((w - step).tolist())
                steps.append(float(np.abs(step).max() / max(1.0, np.abs(w).max())))
            f["weights"], f["step"] = moved, steps
            yield f.drop(columns="sums")

    def bends(a: pd.DataFrame, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        w, ab = np.array(a["weights"].tolist()), np.array(a["platt"].tolist())
        q = logits(w @ x.T)
        p = sigmoid(ab[:, :1] + ab[:, 1:] * q)
        gap, curve = (p - y) * n, p * (1 - p) * n
        return np.stack([gap.sum(axis=1), (gap * q).sum(axis=1), curve.sum(axis=1), (curve * q).sum(axis=1), (curve * q * q).sum(axis=1)], axis=1)

    def step_platt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            moved, steps = [], []
            for t, v, y, w, ab, s in zip(f["template"], f["vector"], f["label"], f["weights"], f["platt"], f["sums"], strict=True):
                n, (a, b) = fits[t][2] - 1, ab
                q = float(logits(np.array(np.concatenate([[1.0], v]) @ np.array(w))))
                p = float(sigmoid(np.array(a + b * q)))
                s = np.array(s[:5]) - np.array([p - y, (p - y) * q, p * (1 - p), p * (1 - p) * q, p * (1 - p) * q * q])
                step = np.linalg.solve(np.array([[s[2], s[3]], [s[3], s[4]]]) / n + np.diag([0.0, platt_l2]), np.array([s[0], s[1]]) / n + np.array([0.0, platt_l2 * b]))
                moved.append([a - step[0], b - step[1]])
                steps.append(float(np.abs(step).max()))
            f["platt"], f["step"] = moved, steps
            yield f.drop(columns="sums")

    for compute, width, update in ((slopes, size, step_weights), (bends, 5, step_platt)):
        for _ in range(MOST_STEPS):
            last = models
            models = written(models.join(block_sums(models.select(*columns[:1], "model_no", "weights", "platt"), fit_for, width, compute), "model_no").select(*(x.split()[0] for x in fields.split(", ")), "sums").mapInPandas(update, fields), "models")
            superseded(last)
            if (models.agg(F.max("step")).first()[0] or 0.0) <= 1e-10:
                break
        else:
            raise RuntimeError("refits did not settle")
    out = fit_for.select("template", "vector", "label", "model_no").join(models.select("model_no", "weights", "platt"), "model_no", "left")
    return out.select("template", "vector", "label", "weights", "platt")
