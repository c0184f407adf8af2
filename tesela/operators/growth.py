"""Growth models of yearly series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fit(f, start: np.ndarray, t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Least squares by damped Gauss-Newton steps; parameters and R²."""
    p, damp = start.astype(float), 1e-3
    err = ((y - f(p, t)) ** 2).sum()
    for _ in range(200):
        base = f(p, t)
        jac = np.stack([(f(p + np.eye(len(p))[i] * (1e-6 * max(abs(p[i]), 1e-3)), t) - base) / (1e-6 * max(abs(p[i]), 1e-3)) for i in range(len(p))], 1)
        a = jac.T @ jac
        step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), jac.T @ (y - base), rcond=None)[0]
        new = ((y - f(p + step, t)) ** 2).sum()
        if np.isfinite(new) and new < err:
            done = err - new < 1e-12 * max(err, 1e-12)
            p, err, damp = p + step, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    spread = ((y - y.mean()) ** 2).sum()
    return p, 1 - err / spread if spread > 0 else 0.0


def _exponential(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    return p[0] * np.exp(np.clip(p[1] * t, -50, 50))


def _logistic(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    return p[0] / (1 + np.exp(np.clip(-p[1] * (t - p[2]), -50, 50)))


def growth_models(series: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Exponential and logistic fits per series: rate, capacity, doubling time, both R² and the better model.

    One series is one small group (a value per period). Fewer than three points give nulls.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, y = pdf.t.to_numpy(float) - pdf.t.min(), pdf.v.to_numpy(float)
        k = pdf.k.iloc[0]
        names = ["k", "rate", "doubling", "exponential_r2", "capacity", "logistic_rate", "logistic_r2", "model"]
        if len(t) < 3:
            return pd.DataFrame([[k, *[None] * 7]], columns=names)
        b, a = np.polyfit(t, np.log(np.maximum(y, 0.5)), 1)
        e, r_e = _fit(_exponential, np.array([math.exp(a), b]), t, y)
        g, r_g = _fit(_logistic, np.array([max(y.max() * 1.2, 1.0), max(b, 0.1), t[len(t) // 2]]), t, y)
        return pd.DataFrame([[k, e[1], math.log(2) / e[1] if e[1] > 0 else None, r_e, g[0], g[1], r_g, "logistic" if r_g > r_e else "exponential"]], columns=names)

    rows = series.select(F.col(key).cast("string").alias("k"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("k").applyInPandas(run, "k string, rate double, doubling double, exponential_r2 double, capacity double, logistic_rate double, logistic_r2 double, model string")
