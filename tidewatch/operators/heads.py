"""Linear models fitted by Spark: transition, risk, stage, baseline, compression."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.metrics import binary_metrics
from tidewatch.operators.series import sequences
from tidewatch.schema import STAGES

CERTAIN = 30.0  # log-odds standing in for an infinite intercept
NEVER = -700.0  # log-weight of a class that never occurred in training
PRODUCT_ROWS = 512  # rows whose products of features are held at a time


@dataclass(frozen=True)
class LinearScore:
    """Logistic score of one class: 1 / (1 + exp(-(x·coef + intercept)))."""

    coef: tuple[float, ...]
    intercept: float

    def margin(self, x: Column) -> Column:
        return dot(x, self.coef) + F.lit(self.intercept)

    def column(self, x: Column) -> Column:
        return 1 / (1 + F.exp(-self.margin(x)))


@dataclass(frozen=True)
class StageScore:
    """Softmax scores of all stages."""

    coef: tuple[tuple[float, ...], ...]
    intercept: tuple[float, ...]


@dataclass(frozen=True)
class Transition:
    """Next window as a linear function of the last `lags` windows."""

    lags: int
    weights: tuple[tuple[float, ...], ...]  # (1 + size * lags) rows of `size`, intercept first, oldest lag next

    @property
    def size(self) -> int:
        return len(self.weights[0])


@dataclass(frozen=True)
class ForecastModel:
    """Everything needed to forecast, small enough to travel with a task."""

    transition: Transition
    risk: tuple[LinearScore, ...]
    stage: tuple[StageScore, ...]
    sequence_length: int
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    label_semantics: str = "unknown"
    supervision: str = "unknown"
    training: dict = field(default_factory=dict)

    @property
    def horizon(self) -> int:
        return len(self.risk)


def model_to_json(model: ForecastModel) -> str:
    return json.dumps({
        "transition": {"lags": model.transition.lags, "weights": model.transition.weights},
        "risk": [{"coef": r.coef, "intercept": r.intercept} for r in model.risk],
        "stage": [{"coef": s.coef, "intercept": s.intercept} for s in model.stage],
        "sequence_length": model.sequence_length, "mean": model.mean, "scale": model.scale,
        "label_semantics": model.label_semantics, "supervision": model.supervision, "training": model.training,
    }, sort_keys=True, allow_nan=False)


def model_from_json(text: str) -> ForecastModel:
    d = json.loads(text)
    return ForecastModel(
        Transition(d["transition"]["lags"], tuple(map(tuple, d["transition"]["weights"]))),
        tuple(LinearScore(tuple(r["coef"]), r["intercept"]) for r in d["risk"]),
        tuple(StageScore(tuple(map(tuple, s["coef"])), tuple(s["intercept"])) for s in d["stage"]),
        d["sequence_length"], tuple(d["mean"]), tuple(d["scale"]), d["label_semantics"],
        d.get("supervision", "unknown"), d.get("training", {}),
    )


def dot(x: Column, weights: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0),
                       lambda total, part: total + part)


def list_values(lists: pa.Array, size: int) -> np.ndarray:
    """ARRAY<DOUBLE> cells of equal length as a (rows, size) matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)


def gram(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """Sum of z·zᵀ over all rows with z = (1, column).

    Every task adds up its own batches; the summed tables of at most (size + 1)² numbers are then
    grouped, so the result has a fixed size whatever the number of rows.
    """
    width = size + 1
    upper = np.triu_indices(width)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            values = list_values(batch.column(0), size)
            z = np.column_stack([np.ones(len(values)), values])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])],
                                         names=["cell", "value"])

    parts = rows.select(column).mapInArrow(add_up, "cell int, value double")
    cells = parts.groupBy("cell").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(len(upper[0]))
    for row in cells:
        flat[row["cell"]] = row["value"]
    matrix = np.zeros((width, width))
    matrix[upper] = flat
    return matrix + np.triu(matrix, 1).T


def fit_transition(windows: DataFrame, lags: int = 1, ridge: float = 1.0, keys: Sequence[str] = (), idx: str = "idx",
                   value: str = "features", size: int | None = None) -> Transition:
    """Ridge least squares of every window on the `lags` windows before it, in one pass."""
    if lags < 1:
        raise ValueError("lags must be at least 1")
    pairs = sequences(windows, lags + 1, keys, idx, value).select(F.flatten("history").alias("z"))
    size = size or len(windows.select(value).first()[0])
    matrix = gram(pairs, "z", size * (lags + 1))
    if not matrix[0, 0]:
        raise ValueError("fitting a transition needs at least one pair of consecutive windows")
    known = 1 + size * lags
    penalty = np.diag([0.0] + [float(ridge)] * (size * lags))
    # Least squares also copes with features that never vary.
    weights = np.linalg.lstsq(matrix[:known, :known] + penalty, matrix[:known, known:], rcond=None)[0]
    return Transition(lags, tuple(map(tuple, weights.tolist())))


@dataclass(frozen=True)
class Problem:
    """A regression to fit: class probabilities of the rows whose `step` is `step` (all rows, where it is None).

    `classes` are the labels with a margin of their own. With `reference`, all other rows have the margin 0 (two
    classes, one margin); else the classes share all rows. `weights` holds a weight per label.
    """

    name: str
    label: str
    classes: tuple[int, ...]
    reference: bool
    step: int | None = None
    weights: tuple[tuple[int, float], ...] = ()


def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def _weighted_products(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of weight·z·zᵀ over the rows for every column of `weights`: (columns, width, width).

    Products of the columns of z are made once for all weights, of a few rows at a time, half of them as they are symmetric.
    """
    width, columns = z.shape[1], weights.shape[1]
    if columns == 1:
        return ((z * weights).T @ z)[None]
    sums = np.zeros((columns, width * (width + 1) // 2))
    for k in range(0, len(z), PRODUCT_ROWS):
        part = z[k:k + PRODUCT_ROWS]
        sums += weights[k:k + PRODUCT_ROWS].T @ np.concatenate([part[:, i:i + 1] * part[:, i:] for i in range(width)], axis=1)
    out = np.empty((columns, width, width))
    rows, others = _upper(width)
    out[:, rows, others] = out[:, others, rows] = sums
    return out


def _terms(z: np.ndarray, label: np.ndarray, problem: Problem, theta: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper Hessian of some rows, in one list; theta is (classes, 1 + size)."""
    known = ~np.isnan(label)
    z, label = z[known], label[known].astype(np.int64)
    weight = np.ones(len(label))
    for value, w in problem.weights:
        weight[label == value] = w
    margin = z @ theta.T
    top = margin.max(axis=1, initial=0.0 if problem.reference else -np.inf) if len(z) else np.zeros(0)
    e = np.exp(margin - top[:, None])
    total = e.sum(axis=1) + (np.exp(-top) if problem.reference else 0.0)
    share = e / total[:, None]
    own = label[:, None] == np.asarray(problem.classes)[None, :]
    loss = float(weight @ (top + np.log(total) - (margin * own).sum(axis=1)))
    gradient = ((share - own) * weight[:, None]).T @ z
    count, width = theta.shape
    hessian = np.empty((count, width, count, width))
    first, second = _upper(count)
    for c, d, block in zip(first, second, _weighted_products(z, weight[:, None] * share[:, first] * ((first == second) - share[:, second]))):
        hessian[c, :, d, :] = hessian[d, :, c, :] = block
    return np.concatenate([[loss], gradient.ravel(), hessian.reshape(count * width, -1)[_upper(count * width)]])


def _summed(rows: DataFrame, features: str, size: int, asked: Sequence[tuple[Problem, np.ndarray]]) -> list[np.ndarray]:
    """`_terms` of every asked problem over all rows, by one aggregate.

    Each task adds up its own batches; tables of a fixed size are then grouped by cell.
    """
    labels = list(dict.fromkeys(p.label for p, _ in asked))
    stepped = any(p.step is not None for p, _ in asked)
    columns = [F.col(features), *[F.col(c).cast("double") for c in labels], *([F.col("step").cast("long")] if stepped else [])]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 + theta.size + theta.size * (theta.size + 1) // 2) for _, theta in asked]
        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), list_values(batch.column(0), size)])
            values = {name: batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k, name in enumerate(labels)}
            steps = batch.column(len(labels) + 1).to_numpy(zero_copy_only=False) if stepped else None
            for total, (problem, theta) in zip(totals, asked):
                mine = slice(None) if problem.step is None else steps == problem.step
                total += _terms(z[mine], values[problem.label][mine], problem, theta)
        for k, total in enumerate(totals):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), k, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)),
                                              pa.array(total)], names=["problem", "cell", "value"])

    parts = rows.select(*columns).mapInArrow(add_up, "problem int, cell int, value double")
    out = [np.zeros(1 + theta.size + theta.size * (theta.size + 1) // 2) for _, theta in asked]
    cells = parts.groupBy("problem", "cell").agg(F.sum("value").alias("value")).toArrow()
    for k, total in enumerate(out):
        mine = cells["problem"].to_numpy() == k
        total[cells["cell"].to_numpy()[mine]] = cells["value"].to_numpy()[mine]
    return out


def newton(rows: DataFrame, features: str, size: int, problems: Sequence[Problem], max_iter: int = 100,
           tol: float = 1e-8) -> list[np.ndarray]:
    """Coefficients (classes, 1 + size; intercept first) of all problems at once, by Newton's method.

    The sum of log losses plus half the squared coefficients (not the intercepts) is made least. Each step takes one
    aggregate of all unfinished problems' losses, gradients and Hessians; a step that doesn't lower its problem's loss is
    halved. A problem is finished when no part of its gradient exceeds `tol` times one more than its rows' loss at zero.
    """
    count = [len(p.classes) for p in problems]
    point = [np.zeros((c, size + 1)) for c in count]
    kept: list[tuple | None] = [None] * len(problems)  # (theta, loss, direction) of the best point so far
    scale, pace, open_ones = [0.0] * len(problems), [1.0] * len(problems), list(range(len(problems)))
    for _ in range(max_iter):
        if not open_ones:
            break
        found = _summed(rows, features, size, [(problems[k], point[k]) for k in open_ones])
        still = []
        for k, values in zip(open_ones, found):
            theta, n = point[k], point[k].size
            penalty = np.tile([0.0] + [1.0] * size, count[k])
            loss = values[0] + 0.5 * float(penalty @ theta.ravel() ** 2)
            gradient = values[1:1 + n] + penalty * theta.ravel()
            scale[k] = scale[k] or 1.0 + values[0]
            if kept[k] is not None and not loss <= kept[k][1] + 1e-12 * scale[k]:
                pace[k] /= 2
                if pace[k] > 1e-9:
                    point[k] = kept[k][0] + pace[k] * kept[k][2]
                    still.append(k)
                continue
            hessian = np.zeros((n, n))
            hessian[_upper(n)] = values[1 + n:]
            hessian = hessian + np.triu(hessian, 1).T + np.diag(penalty)
            # Features of very different sizes are brought to one before the equations are solved. The last term
            # settles what nothing depends on, the same number added to all classes' intercepts.
            unit = 1.0 / np.sqrt(np.maximum(np.diag(hessian), 1e-300))
            scaled = hessian * np.outer(unit, unit) + 1e-12 * np.eye(n)
            direction = -(unit * np.linalg.solve(scaled, unit * gradient)).reshape(theta.shape)
            kept[k], pace[k] = (theta, loss, direction), 1.0
            if np.abs(gradient).max() > tol * scale[k]:
                point[k] = theta + direction
                still.append(k)
        open_ones = still
    return [k[0] if k else p for k, p in zip(kept, point)]


def _label_counts(df: DataFrame, label: str, stepped: bool) -> dict[int | None, dict[int, int]]:
    # At most one row per step and stage id.
    by = ["step", label] if stepped else [label]
    out: dict[int | None, dict[int, int]] = {}
    for row in df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))).groupBy(*by).count().collect():
        out.setdefault(row[0] if stepped else None, {})[int(row[-2])] = row[-1]
    return out


def _bounded(intercept: float) -> float:
    return float(np.clip(intercept, -CERTAIN, CERTAIN))


def fit_scores(df: DataFrame, features: str = "x", risk: str | None = "y", stage: str | None = None, steps: Sequence[int | None] = (None,),
               balanced: bool = False, need_both: bool = False, max_iter: int = 100) -> tuple[tuple[LinearScore, ...], tuple[StageScore, ...]]:
    """A risk score and a stage score per step, all fitted by the same passes over `df`; unit inverse penalty.

    `balanced` gives both classes of a risk equal weight. Labels that are missing train nothing. One class alone gives a certain
    score; stages never seen get no weight.
    """
    stepped = steps[0] is not None
    size = len((df.select(features).first() or [()])[0])
    counts = {label: _label_counts(df, label, stepped) for label in (risk, stage) if label}
    problems = []
    for step in steps:
        if risk:
            seen = counts[risk].get(step, {})
            if len(seen) < 2 and (need_both or not seen):
                raise ValueError("logistic regression requires both benign and attack labels")
            total = sum(seen.values())
            weights = tuple((v, total / (2.0 * n)) for v, n in seen.items()) if balanced else ()
            if len(seen) > 1:
                problems.append(Problem(f"risk {step}", risk, (1,), True, step, weights))
        if stage:
            seen = counts[stage].get(step, {})
            if not seen:
                raise ValueError("stage fitting requires labelled rows")
            if len(seen) > 1:
                problems.append(Problem(f"stage {step}", stage, tuple(sorted(seen)), False, step))
    fitted = dict(zip([p.name for p in problems], newton(df, features, size, problems, max_iter))) if problems else {}
    risks, stages = [], []
    for step in steps:
        if risk:
            theta = fitted.get(f"risk {step}")
            if theta is None:
                risks.append(LinearScore((0.0,) * size, CERTAIN if 1 in counts[risk][step] else -CERTAIN))
            else:
                risks.append(LinearScore(tuple(theta[0, 1:].tolist()), _bounded(theta[0, 0])))
        if stage:
            coef, intercept = np.zeros((len(STAGES), size)), np.full(len(STAGES), NEVER)
            seen = sorted(counts[stage][step])
            theta = fitted.get(f"stage {step}", np.zeros((1, size + 1)))
            coef[seen], intercept[seen] = theta[:, 1:], np.clip(theta[:, 0] - theta[:, 0].mean(), NEVER, -NEVER)
            stages.append(StageScore(tuple(map(tuple, coef.tolist())), tuple(intercept.tolist())))
    return tuple(risks), tuple(stages)


def no_stages(size: int) -> StageScore:
    """Scores without meaning, for models whose labels are no stage ids."""
    return StageScore(((0.0,) * size,) * len(STAGES), (0.0,) * len(STAGES))


def fit_baseline(df: DataFrame, features: str = "features", label: str = "y") -> LinearScore:
    """Class-balanced logistic regression from the current window to attack or not."""
    return fit_scores(df, features, label, balanced=True, need_both=True)[0][0]


def predict(df: DataFrame, model: LinearScore, features: str = "features") -> DataFrame:
    """Probability and 0/1 prediction of a linear score."""
    margin = model.margin(F.col(features))
    return df.withColumns({"score": model.column(F.col(features)), "predicted": (margin > 0).cast("int")})


def evaluate_baseline(df: DataFrame, features: str = "features", label: str = "y") -> DataFrame:
    """Fit the baseline and measure it on the same rows."""
    return binary_metrics(predict(df, fit_baseline(df, features, label), features), label=label)


def compress(df: DataFrame, size: int, features: str = "features") -> DataFrame:
    """Principal components of every feature vector, its reconstruction and the mean squared error."""
    rows = df.withColumn("_x", array_to_vector(features))
    first = df.select(F.size(features)).first()
    if first is None:
        raise ValueError("compression needs at least one row")
    width = first[0]
    if not 1 <= size <= width:
        raise ValueError(f"size must be between 1 and {width}")
    fitted = PCA(k=size, inputCol="_x", outputCol="_z").fit(rows)
    axes = fitted.pc.toArray().T
    means = rows.agg(F.array(*[F.avg(F.col(features)[i]) for i in range(width)]).alias("m")).first()["m"]
    shift = [float(np.dot(axis, means)) for axis in axes]
    latent = F.zip_with(vector_to_array("_z"), F.array(*map(F.lit, shift)), lambda z, s: z - s)
    out = fitted.transform(rows).withColumn("latent", latent)
    restored = F.array(*[dot(F.col("latent"), axes[:, i].tolist()) + F.lit(float(means[i])) for i in range(width)])
    out = out.withColumn("restored", restored)
    error = F.aggregate(F.zip_with(F.col(features), F.col("restored"), lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                        lambda total, part: total + part) / width
    return out.withColumn("restore_error", error).drop("_x", "_z")
