"""Linear margins of least hinge loss over kernel features that are made anew in every pass.

The library's fit stores the kernel features of all rows, some twenty times the size of their predictors, and reads them from disk
some hundred times where they don't fit in memory. Here the scaled predictors are stored in blocks, as matrices, and a pass maps a
few hundred rows at a time to their features, which stay in a cache, adds up loss and gradient and forgets them.

Loss, penalty, scaling of the features and the way to the least loss are those of ``LinearSVC``: orthant-wise limited-memory
steps, ten of them remembered, with a backtracking line search (the Breeze library).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import work_path

#: Maps a matrix of scaled predictors to its kernel features.
Projection = Callable[[np.ndarray], np.ndarray]

# rows whose features are made together, and blocks of a stored file
_STEP, _FILE = 128, 2


def packed(rows: DataFrame, vector: str, label: str, weight: str | None = None) -> DataFrame:
    """Stored blocks of rows: predictors, then labels, then weights, as the bytes of their numbers.

    A few blocks a file, so that also small tables are read by many tasks.
    """
    held = F.col(weight) if weight else F.lit(1.0)
    plain = rows.select(vector_to_array(vector).alias("x"), F.col(label).cast("double").alias("y"), held.cast("double").alias("w"))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w = batch.columns
            truth, weights = y.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False)
            if not (np.isin(truth, (0.0, 1.0)).all() and (weights >= 0).all()):
                raise ValueError("a label is other than 0 and 1, or a weight is missing or negative")
            block = np.concatenate([x.flatten().to_numpy(zero_copy_only=False), truth, weights])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([block.tobytes()])], ["rows", "block"])

    path = work_path(rows.sparkSession, "blocks")
    plain.mapInArrow(run, "rows long, block binary").write.option("maxRecordsPerFile", _FILE).parquet(path)
    return rows.sparkSession.read.schema("rows long, block binary").parquet(path)


def _added(blocks: DataFrame, project: Projection, add: Callable, start: Callable[[], dict]) -> list[dict]:
    """What ``add`` makes of the features, labels and weights of a task's rows, one record a task, in the order of the tasks."""
    step = _STEP

    def run(batches: Iterable[pa.RecordBatch]):
        total = start()
        for batch in batches:
            for count, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers = np.frombuffer(block.as_buffer(), dtype=np.float64)
                x = numbers[:-2 * count].reshape(count, -1)
                y, w = numbers[-2 * count:-count], numbers[-count:]
                for a in range(0, count, step):
                    some = slice(a, a + step)
                    add(total, project(x[some]), y[some], w[some])
        values = [np.atleast_1d(v).tolist() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64())) for v in values], list(total))

    shape = ", ".join(f"{name} array<double>" for name in start())
    return [{k: np.array(v) for k, v in r.items()} for r in blocks.mapInArrow(run, shape).toArrow().to_pylist()]


@dataclass
class Spread:
    """Weight of the rows, and mean and unbiased deviation of every feature."""

    weight: float
    mean: np.ndarray
    deviation: np.ndarray


def spread(blocks: DataFrame, project: Projection, size: int) -> Spread:
    def start() -> dict:
        return {
            "weight": 0.0, "squares": 0.0, "top": -1.0, "sums": np.zeros(size), "products": np.zeros(size),
            "low": np.full(size, np.inf), "high": np.full(size, -np.inf),
        }

    def add(total: dict, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        total["weight"] += w.sum()
        total["squares"] += (w * w).sum()
        total["top"] = max(total["top"], y.max())
        total["sums"] += w @ z
        total["products"] += w @ (z * z)
        np.minimum(total["low"], z.min(0), out=total["low"])
        np.maximum(total["high"], z.max(0), out=total["high"])

    parts = _added(blocks, project, add, start)
    if not parts or max(p["top"][0] for p in parts) != 1:
        raise ValueError("no training row has label 1")
    weight, squares = (float(sum(p[k][0] for p in parts)) for k in ("weight", "squares"))
    sums, products = (sum(p[k] for p in parts) for k in ("sums", "products"))
    flat = np.min([p["low"] for p in parts], axis=0) == np.max([p["high"] for p in parts], axis=0)
    free = weight - squares / weight
    variance = np.maximum(products - sums**2 / weight, 0.0) / free if free > 0 else np.zeros(size)
    return Spread(weight, sums / weight, np.where(flat, 0.0, np.sqrt(variance)))


def _loss(blocks: DataFrame, project: Projection, seen: Spread, penalty: float) -> Callable:
    """Mean loss with its penalty, and its gradient, for coefficients of centred and scaled features, the intercept last."""
    size = len(seen.mean)
    inverse = np.divide(1.0, seen.deviation, out=np.zeros(size), where=seen.deviation != 0)
    centre = inverse * seen.mean

    def start() -> dict:
        return {"loss": 0.0, "pull": 0.0, "slope": np.zeros(size)}

    def calculate(at: np.ndarray) -> tuple[float, np.ndarray]:
        line, offset = at[:-1] * inverse, at[-1] - at[:-1] @ centre

        def add(total: dict, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
            side = 2.0 * y - 1.0
            slack = 1.0 - side * (z @ line + offset)
            pull = np.where(slack > 0, -side * w, 0.0)
            total["loss"] += np.maximum(slack, 0.0) @ w
            total["pull"] += pull.sum()
            total["slope"] += pull @ z

        parts = _added(blocks, project, add, start)
        pull = sum(p["pull"][0] for p in parts)
        slope = sum(p["slope"] for p in parts) * inverse - centre * pull
        value = float(sum(p["loss"][0] for p in parts)) / seen.weight + penalty * float(at[:-1] @ at[:-1]) / 2
        return value, np.concatenate([slope / seen.weight + penalty * at[:-1], [pull / seen.weight]])

    return calculate


class _Failed(Exception):
    """A step that can't be made."""


def _direction(grad: np.ndarray, history: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction; ``history`` has steps and changes of the gradient, the newest first."""
    scale = 1.0
    if history:
        step, change = history[0]
        turned = step @ change
        if turned < 0 or np.isnan(turned):
            raise _Failed
        scale = turned / (change @ change)
    way, shares = grad.copy(), []
    for step, change in history:
        share = (step @ way) / (step @ change)
        if np.isnan(share):
            raise _Failed
        shares.append(share)
        way = way - share * change
    way = way * scale
    for (step, change), share in reversed(list(zip(history, shares, strict=True))):
        way = way + (share - (change @ way) / (step @ change)) * step
    # nothing against the gradient
    return np.where(-way * grad < 0, -way, 0.0)


def least(loss: Callable, start: np.ndarray, rounds: int, tolerance: float = 1e-6, memory: int = 10) -> tuple[np.ndarray, list[float]]:
    """The point that Breeze's ``OWLQN`` without a penalty on absolute values ends at, and the losses on the way."""
    cached: list = [None, None]

    def calculate(at: np.ndarray) -> tuple[float, np.ndarray]:
        if cached[0] is None or not np.array_equal(cached[0], at):
            cached[:] = [at, loss(at)]
        return cached[1]

    def moved(x: np.ndarray, grad: np.ndarray, way: np.ndarray, share: float) -> np.ndarray:
        stepped = x + way * share
        # a coefficient doesn't cross zero in one step
        return np.where(np.sign(stepped) == np.where(x != 0, np.sign(x), np.sign(-grad)), stepped, 0.0)

    def searched(x: np.ndarray, value: float, grad: np.ndarray, way: np.ndarray, first: bool) -> float:
        share = 0.5 / np.linalg.norm(grad) if first else 1.0
        shrink, grow = 0.1 if first else 0.5, 2.1
        start_value, falls = calculate(moved(x, grad, way, 0.0))
        falls = falls @ way
        for trial in range(20):
            # the search takes the first point for as good as the start, so it shrinks without looking at it
            found = value if trial == 0 else calculate(moved(x, grad, way, share))[0]
            if found > start_value + share * falls * 1e-4:
                factor = shrink
            else:
                slope = calculate(moved(x, grad, way, share))[1] @ way
                if slope < 0.9 * falls:
                    factor = grow
                elif slope > -0.9 * falls:
                    factor = shrink
                else:
                    return share
            if not 1e-10 <= share * factor <= 1e10:
                raise _Failed
            if trial < 19:
                share *= factor
        # the last point it looked at will do
        return share

    x = start
    value, grad = calculate(x)
    history: list = []
    initial, recent, losses, failed, count = value, [np.inf], [value], False, 0
    while count < rounds:
        if len(recent) >= 2 and abs(value - max(recent)) <= tolerance * initial:
            break
        if np.linalg.norm(grad) <= max(tolerance * value, 1e-8):
            break
        try:
            way = _direction(grad, history)
            new = moved(x, grad, way, searched(x, value, grad, way, count < 1))
        except _Failed:
            losses.append(value)
            if failed:
                break
            failed, history = True, []
            continue
        found, slope = calculate(new)
        history = [(new - x, slope - grad), *history][:memory]
        x, value, grad, failed, count = new, found, slope, False, count + 1
        recent = [*recent, value][-20:]
        losses.append(value)
    return x, losses


def fit(blocks: DataFrame, project: Projection, size: int, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Coefficients of the features and the intercept."""
    seen = spread(blocks, project, size)
    at, _ = least(_loss(blocks, project, seen, penalty), np.zeros(size + 1), rounds)
    line = np.divide(at[:-1], seen.deviation, out=np.zeros(size), where=seen.deviation != 0)
    return line, float(at[-1] - line @ seen.mean)


def margins(blocks: DataFrame, project: Projection, line: np.ndarray, offset: float) -> DataFrame:
    """``label`` and ``margin`` of every row."""
    step = _STEP

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for count, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers = np.frombuffer(block.as_buffer(), dtype=np.float64)
                x, y = numbers[:-2 * count].reshape(count, -1), numbers[-2 * count:-count]
                found = np.concatenate([project(x[a:a + step]) @ line + offset for a in range(0, count, step)])
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(found)], ["label", "margin"])

    return blocks.mapInArrow(run, "label double, margin double")


def with_margin(df: DataFrame, vector: str, project: Projection, line: np.ndarray, offset: float, name: str) -> DataFrame:
    """Frame with the margin of the scaled ``vector``."""
    step = _STEP

    @F.arrow_udf("double")
    def margin(batch: pa.Array) -> pa.Array:
        if not len(batch):
            return pa.array([], pa.float64())
        x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        return pa.array(np.concatenate([project(x[a:a + step]) @ line + offset for a in range(0, len(x), step)]))

    return df.withColumn(name, margin(vector_to_array(vector)))
