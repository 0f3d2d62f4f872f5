"""Weighted softmax fit, or one fit per label, over compact blocks of rows: Spark sums loss and gradient, the driver takes
the steps (L-BFGS).

The same objective and steps as ``LogisticRegression`` without standardization: slots are scaled by their deviation and
centred for the steps, the penalty holds for the unscaled weights. Its vectors of 12 bytes an entry are read eight times
for a gradient of four labels, at places all over 8 MB; a block has the entries of a few thousand rows ordered by slot
(``hashed.unit_blocks``, under 2 bytes an entry), so that weights are read in order and all else stays in the caches.

A core has few tasks, which go through their files block by block: a task sends one dense sum, 8 MB, so that a pass
shuffles cores and not rows. Sums are cut in parts and added up (in two steps if there are many tasks); the driver gets
one, labels x slots.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions.hashed import Block, opened

#: In how many parts a sum is added up, and how many tasks' sums a task of the first step gets.
PARTS, BRANCH = 16, 64
#: Tasks of a pass a core, at most.
TURNS = 2
#: Entries worked on at once, about.
_CHUNK = 1 << 15
#: A block is some MB: few of them reach a worker at once. A pass's shuffle files go when it ends.
_PASS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2", **session.CLEAN}
#: Steps that a direction remembers, and when the fit has converged.
_MEMORY, _TOLERANCE = 10, 1e-6

_SENT = "task int, part int, sums binary"

#: Yields points and is sent values and gradients there.
Steps = Generator[np.ndarray, tuple[float, np.ndarray], Any]


def _added(table: pa.Table) -> pa.Table:
    """One sum of a part, in the order of the tasks."""
    table = table.sort_by("task")
    total = sum(np.frombuffer(s, np.float64) for s in table.column("sums").to_pylist())
    return pa.table([table.column("task")[:1], table.column("part")[:1], pa.array([total.tobytes()], pa.binary())], ["task", "part", "sums"])


def summed(blocks: DataFrame, size: int, add: Callable[[Block, np.ndarray], None]) -> np.ndarray:
    """What ``add`` adds for every block to an array of ``size``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size), 0
        for batch in batches:
            for block in opened(batch):
                add(block, total)
                rows += 1
        if rows:
            parts = [p.tobytes() for p in np.array_split(total, PARTS)]
            task = pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32())
            yield pa.RecordBatch.from_arrays([task, pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["task", "part", "sums"])

    tasks = min(blocks.rdd.getNumPartitions(), TURNS * blocks.sparkSession.sparkContext.defaultParallelism)
    with session.settings(blocks.sparkSession, _PASS):
        sent = blocks.coalesce(max(1, tasks)).mapInArrow(work, _SENT)
        if tasks > BRANCH:
            sent = sent.groupBy("part", F.floor(F.col("task") / BRANCH)).applyInArrow(_added, _SENT)
        found = {r.part: r.sums for r in sent.groupBy("part").applyInArrow(_added, _SENT).collect()}
    return np.concatenate([np.frombuffer(found[p], np.float64) for p in range(PARTS)]) if found else np.zeros(size)


def _moments(labels: int, buckets: int, slots: int):
    def add(b: Block, total: np.ndarray) -> None:
        first, second, counts = total[:slots], total[slots : 2 * slots], total[2 * slots :].reshape(2, -1)
        if len(b.row):
            value = b.n / b.length[b.row]
            once = b.weight[b.row] * value
            first[b.slots] += np.add.reduceat(once, b.starts)
            second[b.slots] += np.add.reduceat(once * value, b.starts)
        first[buckets:] += b.weight @ b.numbers
        second[buckets:] += b.weight @ b.numbers**2
        counts[0, :labels] += np.bincount(b.label, b.weight, labels)
        counts[1, :labels] += np.bincount(b.label, minlength=labels)
        counts[0, labels] += (b.weight**2).sum()

    return add


def _chunks(b: Block) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of slots with few enough entries for the caches: slots, the entries' rows, which entries count more than
    once and how often, and the entries' starts."""
    starts, low = b.starts, 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + _CHUNK)) - 1 if starts[-1] >= starts[low] + _CHUNK else len(starts))
        own = slice(starts[low], starts[high] if high < len(starts) else len(b.row))
        n = b.n[own]
        more = np.flatnonzero(n > 1)
        yield slice(low, high), b.row[own].astype(np.intp), more, n[more].astype(np.float64), starts[low:high] - starts[low]
        low = high


def _paired(lines: np.ndarray) -> np.ndarray:
    """Two lines each as the parts of complex numbers; the last may have no partner."""
    out = np.zeros(((len(lines) + 1) // 2, lines.shape[1]), np.complex128)
    out.real, out.imag[: len(lines) // 2] = lines[::2], lines[1::2]
    return out


def _slope(coefficients: np.ndarray, intercepts: np.ndarray, buckets: int, each: list[int] | None = None):
    """Gradient (slots x labels, then labels) and losses, not yet divided by the weights' sum: one loss for all labels, or
    one for each label of ``each`` against the rest."""
    labels, slots = coefficients.shape
    # Two labels are read and summed as one complex number.
    table = _paired(coefficients)

    def add(b: Block, total: np.ndarray) -> None:
        gradient, of_intercepts, losses = total[: labels * slots].reshape(slots, labels), total[labels * slots : -labels], total[-labels:]
        rows = np.arange(len(b.label))
        z = b.numbers @ coefficients[:, buckets:].T + intercepts
        text = np.zeros((labels, len(rows)))
        for part, row, more, times, _ in _chunks(b):
            for k, pair in enumerate(table):
                moved = np.repeat(pair[b.slots[part]], b.sizes[part])
                moved[more] *= times
                for into, own in zip(text[2 * k : 2 * k + 2], (moved.real, moved.imag), strict=False):
                    into += np.bincount(row, own, len(rows))
        z += (text / b.length).T
        if each is not None:
            own = b.label[:, None] == np.array(each)
            losses += b.weight @ (np.logaddexp(0.0, z) - own * z)
            p = 0.5 * (1 + np.tanh(0.5 * z)) - own
        else:
            top = z.max(axis=1)
            p = np.exp(z - top[:, None])
            sums = p.sum(axis=1)
            losses[0] += (b.weight * (np.log(sums) + top - z[rows, b.label])).sum()
            p /= sums[:, None]
            p[rows, b.label] -= 1
        p *= b.weight[:, None]
        of_intercepts += p.sum(axis=0)
        gradient[buckets:] += b.numbers.T @ p
        slope = _paired((p / b.length[:, None]).T)
        for part, row, more, times, starts in _chunks(b):
            sums = np.empty((len(starts), len(slope)), np.complex128)
            for k, pair in enumerate(slope):
                moved = pair.take(row)
                moved[more] *= times
                sums[:, k] = np.add.reduceat(moved, starts)
            gradient[b.slots[part]] += sums.view(np.float64)[:, :labels]

    return add


class _Line:
    """A function along a direction; ``at`` asks for its value and gradient at a point and gives value, slope and gradient."""

    def __init__(self, x: np.ndarray, direction: np.ndarray):
        self.x, self.direction = x, direction

    def at(self, t: float) -> Steps:
        value, gradient = yield self.x + t * self.direction
        return t, value, float(gradient @ self.direction), gradient


def _between(low: tuple, high: tuple) -> float:
    """Where the cubic through both ends has its least value, not too near to either."""
    (l, lv, ld, _), (r, rv, rd, _) = low, high
    d1 = ld + rd - 3 * (lv - rv) / (l - r)
    d2 = math.sqrt(max(0.0, d1 * d1 - ld * rd))
    t = r - (r - l) * (rd + d2 - d1) / (rd - ld + 2 * d2)
    near, far = sorted((l + 0.1 * (r - l), l + 0.9 * (r - l)))
    return min(max(t, near), far)


def _step(line: _Line, start: tuple, first: float) -> Steps:
    """A point along ``line`` that satisfies the strong Wolfe conditions; None if none was found."""
    _, value, slope, _ = start

    def zoom(low: tuple, high: tuple) -> Steps:
        for _ in range(10):
            c = yield from line.at(_between(high, low) if low[1] > high[1] else _between(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        return None

    low, t = start, first
    for turn in range(10):
        c = yield from line.at(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and turn):
            return (yield from zoom(low, c))
        if abs(c[2]) <= 0.9 * abs(slope):
            return c
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low, t = c, t * 1.5
    return None


def descent(x: np.ndarray, iterations: int) -> Steps:
    """Where L-BFGS gets from ``x`` in so many steps, or where it has converged. Asks for value and gradient at points."""
    value, gradient = yield x
    size, seen, steps = abs(value), [value], []
    for turn in range(iterations):
        if np.linalg.norm(gradient) <= max(_TOLERANCE * abs(value), 1e-8):
            break
        direction, factors = -gradient, []
        for s, y, rho in reversed(steps):
            factors.append(rho * (s @ direction))
            direction = direction - factors[-1] * y
        if steps:
            s, y, _ = steps[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(steps, reversed(factors), strict=True):
            direction += (a - rho * (y @ direction)) * s
        slope = float(gradient @ direction)
        if slope > 0:
            break
        found = yield from _step(_Line(x, direction), (0.0, value, slope, gradient), 1 / np.linalg.norm(direction) if turn == 0 else 1.0)
        if found is None:
            break
        t, value, _, changed = found
        moved, turned = t * direction, changed - gradient
        x, gradient = x + moved, changed
        if moved @ turned > 0:
            steps = [*steps, (moved, turned, 1 / (moved @ turned))][-_MEMORY:]
        if abs(max(seen[-20:]) - value) <= _TOLERANCE * size and len(seen) > 1:
            break
        seen.append(value)
    return x


def minima(f: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]], starts: list[np.ndarray], iterations: int) -> list[np.ndarray]:
    """Where ``descent`` gets from each start, every one for a function of its own; ``f`` is asked for all at once."""
    under_way = {i: descent(x, iterations) for i, x in enumerate(starts)}
    points, ends = {i: next(steps) for i, steps in under_way.items()}, {}
    while points:
        found, points = f(points), {}
        for i, answer in found.items():
            try:
                points[i] = under_way[i].send(answer)
            except StopIteration as end:
                ends[i] = end.value
    return [ends[i] for i in range(len(starts))]


class _Blocks:
    """Blocks with their moments: counts and weights by label, and mean and scale (one by deviation) of every slot."""

    def __init__(self, blocks: DataFrame, labels: int, buckets: int, numbers: int):
        self.blocks, self.buckets, self.slots = blocks, buckets, buckets + numbers
        found = summed(blocks, 2 * self.slots + 2 * (labels + 1), _moments(labels, buckets, self.slots))
        counts = found[2 * self.slots :].reshape(2, -1)
        self.known = np.flatnonzero(counts[1])
        if not len(self.known):
            raise ValueError("no rows to fit on")
        self.labels = int(self.known[-1]) + 1
        self.of, squares = counts[0, : self.labels], counts[0, -1]
        self.total = total = self.of.sum()
        self.mean, second = found[: self.slots] / total, found[self.slots : 2 * self.slots] / total
        spread = second - self.mean**2
        spread[spread <= 1e-12 * second] = 0  # a constant
        deviation = np.sqrt(spread * total / (total - squares / total)) if total > squares / total else np.zeros(self.slots)
        self.scale = np.divide(1.0, deviation, out=np.zeros(self.slots), where=deviation > 0)

    def unscaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercepts of the slots as they are."""
        weights = x[: -(len(x) // self.slots)].reshape(-1, self.slots) * self.scale
        return weights, x[weights.size :] - weights @ self.mean

    def loss(self, x: np.ndarray, penalty: float, each: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Losses, gradient (labels x slots) and that of the intercepts, of one pass over the blocks."""
        weights, intercepts = self.unscaled(x)
        labels, cut, buckets = len(weights), weights.size, self.buckets
        sent = self.blocks.sparkSession.sparkContext.broadcast((weights, intercepts))
        slope: list = []

        def add(block: Block, into: np.ndarray) -> None:
            if not slope:  # once a task
                slope.append(_slope(*sent.value, buckets, each))
            slope[0](block, into)

        out = summed(self.blocks, cut + 2 * labels, add) / self.total
        sent.destroy()
        gradient, of_intercepts, losses = out[:cut].reshape(-1, labels).T, out[cut:-labels], out[-labels:]
        gradient = (gradient - of_intercepts[:, None] * self.mean) * self.scale + penalty * weights * self.scale
        squares = (weights**2).sum(axis=1)
        losses = losses[:1] + 0.5 * penalty * squares.sum() if each is None else losses + 0.5 * penalty * squares
        return losses, gradient, of_intercepts


def fit_blocks(blocks: DataFrame, base: LogisticRegression, labels: int, buckets: int, numbers: int) -> LogisticRegressionModel:
    """Fit ``base`` (its steps and penalty) on ``blocks`` of ids under ``labels``, with so many buckets and numbers."""
    ready = _Blocks(blocks, labels, buckets, numbers)
    labels, slots, of, context = ready.labels, ready.slots, ready.of, blocks.sparkSession.sparkContext

    def loss(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        value, gradient, of_intercepts = ready.loss(points[0], base.getRegParam())
        return {0: (float(value[0]), np.r_[gradient.ravel(), of_intercepts])}

    if len(ready.known) > 1:
        start = np.log1p(of)
        weights, intercepts = ready.unscaled(minima(loss, [np.r_[np.zeros(labels * slots), start - start.mean()]], base.getMaxIter())[0])
        intercepts = intercepts - intercepts.mean()
    else:  # one label only
        weights, intercepts = np.zeros((labels, slots)), np.where(np.arange(labels) == labels - 1, np.inf, 0.0)
    matrix = _py2java(context, DenseMatrix(labels, slots, weights.ravel(order="F")))
    made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        base.uid, matrix, _py2java(context, DenseVector(intercepts)), labels, True
    )
    return LogisticRegressionModel(made)


def fit_each(blocks: DataFrame, base: LogisticRegression, labels: int, buckets: int, numbers: int) -> list[LogisticRegressionModel]:
    """Fit ``base`` for every label against the rest. The fits take their steps together: a pass serves all of them."""
    ready = _Blocks(blocks, labels, buckets, numbers)
    slots, of, context = ready.slots, ready.of, blocks.sparkSession.sparkContext
    known = [i for i in ready.known if len(ready.known) > 1]

    def loss(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        own = [known[i] for i in points]
        x = np.concatenate([x[:-1] for x in points.values()] + [[x[-1] for x in points.values()]])
        values, gradient, of_intercepts = ready.loss(x, base.getRegParam(), own)
        return {i: (float(v), np.r_[g, c]) for i, v, g, c in zip(points, values, gradient, of_intercepts, strict=True)}

    starts = [np.r_[np.zeros(slots), np.log(of[i] / (ready.total - of[i]))] for i in known]
    found = dict(zip(known, minima(loss, starts, base.getMaxIter()), strict=True))
    models = []
    for i in range(ready.labels):
        if i in found:
            weights, intercepts = ready.unscaled(found[i])
        else:  # no row of the label, or none of another
            weights, intercepts = np.zeros((1, slots)), [math.inf if i in ready.known else -math.inf]
        made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
            base.uid, _py2java(context, DenseVector(weights[0])), float(intercepts[0])
        )
        models.append(base._copyValues(LogisticRegressionModel(made)))
    return models
