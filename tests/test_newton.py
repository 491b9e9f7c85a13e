"""Scores fitted by Newton's method against plain numpy and their own equations."""

import numpy as np
import pytest

from tidewatch.operators import heads
from tidewatch.operators.heads import NEVER, fit_baseline, fit_scores


def rows(spark, seed=0, n=400, steps=3):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(1, steps + 1):
        x = rng.normal(size=(n, 4)) * [1, 5, 0.1, 1] + [0, 20, 0, 0]
        stage = np.clip((x[:, 0] * k + rng.normal(size=n)).round().astype(int), 0, 3)
        stage[stage == 2] = 3  # a stage in between that never comes
        for v, s in zip(x.tolist(), stage.tolist()):
            missing = rng.random() < 0.05
            out.append((k, v, None if missing else int(s > 0), None if missing else s))
    return out, spark.createDataFrame(out, "step int, x array<double>, y int, y_stage int")


def gradients(data, step, risk, stage):
    """What is left of the equations of one step's scores, per labelled row."""
    x = np.array([r[1] for r in data if r[0] == step and r[2] is not None])
    y = np.array([r[2] for r in data if r[0] == step and r[2] is not None])
    s = np.array([r[3] for r in data if r[0] == step and r[2] is not None])
    z = np.column_stack([np.ones(len(x)), x])
    theta = np.array([risk.intercept, *risk.coef])
    left = z.T @ (1 / (1 + np.exp(-z @ theta)) - y) + np.r_[0, theta[1:]]
    out = [left]
    margins = np.column_stack([x @ np.array(c) + i for c, i in zip(stage.coef, stage.intercept)])
    share = np.exp(margins - margins.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    for c in sorted(set(s.tolist())):
        out.append(z.T @ (share[:, c] - (s == c)) + np.r_[0, stage.coef[c]])
    return max(float(np.abs(g).max()) for g in out) / len(x)


def test_all_steps_at_once_solve_their_equations(spark, monkeypatch):
    data, df = rows(spark)
    passes = []
    summed = heads._summed
    monkeypatch.setattr(heads, "_summed", lambda *a: passes.append(len(a[3])) or summed(*a))
    risk, stage = fit_scores(df, "x", "y", "y_stage", (1, 2, 3))
    assert len(risk) == len(stage) == 3 and passes[0] == 6 and len(passes) < 25
    for k in (1, 2, 3):
        assert gradients(data, k, risk[k - 1], stage[k - 1]) < 1e-6
        assert stage[k - 1].intercept[2] == NEVER and set(stage[k - 1].coef[2]) == {0.0}
    again = fit_scores(df.repartition(7), "x", "y", "y_stage", (1, 2, 3))
    assert np.allclose(risk[0].coef, again[0][0].coef, rtol=1e-9) and np.allclose(stage[2].coef, again[1][2].coef, rtol=1e-7, atol=1e-9)


def test_classes_that_can_be_told_apart_and_balanced_weights(spark):
    data = [([float(k), 1e4 * (k % 7)], int(k > 27)) for k in range(30)]
    df = spark.createDataFrame(data, "features array<double>, y int")
    model = fit_baseline(df)
    z = np.array([[1.0, *x] for x, _ in data])
    y = np.array([v for _, v in data])
    w = np.where(y == 1, 30 / (2 * y.sum()), 30 / (2 * (1 - y).sum()))
    theta = np.array([model.intercept, *model.coef])
    left = z.T @ (w * (1 / (1 + np.exp(-z @ theta)) - y)) + np.r_[0, theta[1:]]
    assert np.abs(left / np.abs(z).max(0)).max() < 1e-4 and np.isfinite(theta).all()
    assert ((z @ theta > 0) == (y == 1)).all()


@pytest.mark.parametrize("labels", [[0, 0], [1, 1]])
def test_one_class_is_certain(spark, labels):
    df = spark.createDataFrame([([1.0], v, 0) for v in labels], "x array<double>, y int, y_stage int")
    risk, stage = fit_scores(df, "x", "y", "y_stage")
    assert risk[0].intercept == (heads.CERTAIN if labels[0] else -heads.CERTAIN) and stage[0].intercept[0] == 0.0
    with pytest.raises(ValueError):
        fit_scores(df.limit(0), "x", "y", "y_stage")


def test_products_of_many_weights_are_summed_a_few_rows_at_a_time(monkeypatch):
    monkeypatch.setattr(heads, "PRODUCT_ROWS", 7)
    rng = np.random.default_rng(2)
    z, weights = rng.normal(size=(40, 5)), rng.normal(size=(40, 3))
    for some in (weights, weights[:, :1], weights[:0]):
        want = np.einsum("rk,ri,rj->kij", some, z[:len(some)], z[:len(some)])
        assert np.allclose(heads._weighted_products(z[:len(some)], some), want, atol=1e-12)
