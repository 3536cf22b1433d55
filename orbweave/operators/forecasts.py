"""Forecasts of many series at once: Holt's linear trend and ARIMA by conditional least squares.

Rows become one value a period before a series is put together, so a series is as long as its periods, however many rows it has. Series
are spread over the tasks. Periods without rows are left out, as if the series went on from the one before.

Defined cases: rows with a null time or value count for nothing; a series of fewer than five periods has no forecast; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fewest periods that a forecast is made from.
LEAST = 5
#: Orders (p, d, q) that ``arima`` chooses from.
ORDERS = [(p, d, q) for d in (0, 1) for p in range(3) for q in range(3)]


def series(df: DataFrame, time: str, value: str, every: str = "month", by: list[str] | None = None, how: str = "avg") -> DataFrame:
    """by and ``values``: the mean (or sum, min, max, count) of each period that has rows, in order of time."""
    there = df.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    each = there.groupBy(*(by or []), F.date_trunc(every, F.col(time)).alias("_t")).agg(getattr(F, how)(F.col(value)).cast("double").alias("_v"))
    listed = each.groupBy(*(by or [])).agg(F.array_sort(F.collect_list(F.struct("_t", "_v"))).alias("_s"))  # one entry a period
    return listed.where(F.size("_s") > 0).select(*(by or []), F.transform("_s", lambda s: s["_v"]).alias("values"))


def _forecast(listed: DataFrame, fit: Callable[[np.ndarray], tuple[str, np.ndarray, np.ndarray]], by: list[str]) -> DataFrame:
    kind = T.StructType([*(listed.schema[c] for c in by), T.StructField("model", T.StringType()), T.StructField("period", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("forecast", "low", "high"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, models, middle, spread = [], [], [], []
            for i, values in enumerate(batch.column("values")):
                y = np.array(values.as_py(), float)
                if len(y) < LEAST or not np.isfinite(y).all():
                    continue
                model, f, se = fit(y)
                rows += [i] * len(f)
                models += [model] * len(f)
                middle.append(f)
                spread.append(se)
            if rows:
                f, se = np.concatenate(middle), np.concatenate(spread)
                periods = np.concatenate([np.arange(1, len(m) + 1) for m in middle]).astype(np.int32)
                keys = [batch.column(c).take(pa.array(rows)) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(models), pa.array(periods), pa.array(f), pa.array(f - 1.96 * se), pa.array(f + 1.96 * se)], kind.names)

    return listed.mapInArrow(run, kind)


def holt_fit(y: np.ndarray, periods: int) -> tuple[str, np.ndarray, np.ndarray]:
    """Level and trend begin at the first two values; the weights, tenths from 0.1 to 0.9, are those of least squared one-step errors (ties to the smaller)."""
    a, b = (w.ravel() for w in np.meshgrid(np.arange(1, 10) / 10, np.arange(1, 10) / 10, indexing="ij"))
    level, trend, sse = np.full(len(a), y[1]), np.full(len(a), y[1] - y[0]), np.zeros(len(a))
    for v in y[2:]:
        ahead = level + trend
        sse += (v - ahead) ** 2
        new = a * v + (1 - a) * ahead
        level, trend = new, b * (new - level) + (1 - b) * trend
    i = int(np.argmin(sse))
    h = np.arange(1, periods + 1)
    growth = np.cumsum(np.concatenate([[1.0], (a[i] * (1 + h[:-1] * b[i])) ** 2]))
    return f"holt({a[i]:.1f},{b[i]:.1f})", level[i] + h * trend[i], np.sqrt(sse[i] / (len(y) - 2) * growth)


def holt(df: DataFrame, time: str, value: str, periods: int = 12, every: str = "month", by: list[str] | None = None, how: str = "avg") -> DataFrame:
    """by, model, period, forecast, low, high: additive trend by exponential smoothing, with a 95 % interval."""
    return _forecast(series(df, time, value, every, by, how), lambda y: holt_fit(y, periods), by or [])


def _stable(raw: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from any numbers, row by row: they become partial correlations, and these coefficients."""
    partial = np.tanh(raw)
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - partial[:, k : k + 1] * before[:, ::-1]
        out[:, k] = partial[:, k]
    return out


def _errors(w: np.ndarray, params: np.ndarray, p: int, q: int, mean: bool) -> np.ndarray:
    """One-step errors after the first p values, for several parameters at once (a row each)."""
    phi, theta = _stable(params[:, :p]), -_stable(params[:, p : p + q])
    x = w[None] - params[:, -1:] if mean else np.repeat(w[None], len(params), 0)
    own = x[:, p:].copy()
    for i in range(p):
        own -= phi[:, i : i + 1] * x[:, p - 1 - i : len(w) - 1 - i]
    if q:
        for t in range(own.shape[1]):
            for j in range(min(q, t)):
                own[:, t] -= theta[:, j] * own[:, t - 1 - j]
    return own


def arima_fit(y: np.ndarray, periods: int, orders: list[tuple[int, int, int]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The order of least AIC, fitted by damped Gauss-Newton steps on the errors; a mean is fitted where nothing is differenced."""
    best = None
    for p, d, q in orders:
        w, mean = np.diff(y, d), d == 0
        if len(w) - p < p + q + mean + 2:
            continue
        params = np.zeros(p + q + mean)
        scale = max(w.std(), 1e-12)
        if mean:
            params[-1] = w.mean()
        steps = np.array([1e-5] * (p + q) + [1e-5 * scale] * mean)
        damp, old = 1e-3, None
        for _ in range(60 if len(params) else 1):
            e = _errors(w, np.concatenate([params[None], params + np.diag(steps)]) if len(params) else params[None], p, q, mean)
            sse = float(e[0] @ e[0])
            if not len(params) or (old is not None and old - sse <= 1e-10 * old):
                break
            old, moved = sse, False
            slope = (e[1:] - e[0]).T / steps
            system, right = slope.T @ slope, slope.T @ e[0]
            for _ in range(8):
                move = np.linalg.lstsq(system + damp * np.diag(np.diag(system) + 1e-12), right, rcond=None)[0]
                tried = _errors(w, (params - move)[None], p, q, mean)[0]
                if float(tried @ tried) < sse:
                    params, damp, moved = params - move, damp / 5, True
                    break
                damp *= 5
            if not moved:
                break
        e = _errors(w, params[None], p, q, mean)[0]
        sse = float(e @ e)
        aic = len(e) * np.log(max(sse / len(e), 1e-300)) + 2 * (len(params) + 1)
        if best is None or aic < best[0] - 1e-9:
            best = aic, (p, d, q), params, e, sse / max(1, len(e) - len(params))
    if best is None:
        return "last", np.full(periods, y[-1]), np.full(periods, np.std(np.diff(y))) * np.sqrt(np.arange(1, periods + 1))
    _, (p, d, q), params, e, variance = best
    phi, theta = _stable(params[None, :p])[0], -_stable(params[None, p : p + q])[0]
    mean = params[-1] if d == 0 else 0.0
    full = np.concatenate([[1.0], -phi])
    for _ in range(d):
        full = np.convolve(full, [1.0, -1.0])
    past, errors, out = list(y - mean), list(e), []
    for h in range(periods):
        v = -sum(c * past[-i] for i, c in enumerate(full[1:], 1)) + sum(c * errors[-j] for j, c in enumerate(theta, 1) if j <= len(errors))
        past.append(v)
        errors.append(0.0)
        out.append(v + mean)
    psi = [1.0]
    for j in range(1, periods):
        psi.append((theta[j - 1] if j <= q else 0.0) - sum(full[i] * psi[j - i] for i in range(1, min(j, len(full) - 1) + 1)))
    return f"arima({p},{d},{q})", np.array(out), np.sqrt(variance * np.cumsum(np.square(psi)))


def arima(df: DataFrame, time: str, value: str, periods: int = 12, every: str = "month", by: list[str] | None = None, how: str = "avg", orders: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """by, model, period, forecast, low, high: of the given orders (all of ORDERS) the one of least AIC, with a 95 % interval.

    A series too short for any of the orders goes on at its last value.
    """
    chosen = orders or ORDERS
    return _forecast(series(df, time, value, every, by, how), lambda y: arima_fit(y, periods, chosen), by or [])
