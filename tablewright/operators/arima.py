"""ARIMA forecasts of many series of any length.

No series is ever gathered in one task.  Numbered rows are cut into blocks;
each block yields the cross-products of its lagged values, which Spark adds up
per series.  Orders, coefficients and intervals follow from these few sums:

* differencing order from augmented Dickey-Fuller tests (constant, lags by AIC),
* a long autoregression for the innovations (first Hannan-Rissanen step),
* a regression on lagged values and lagged innovations (second step), the start of
* the least conditional sum of squares (``css``), which gives coefficients, AIC and BIC.

Missing rows are left out of all sums, and the forecast goes over them by a filter.
This estimates the same model as an exact likelihood fit; the digits differ by the weight of the first rows.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import checkpointed, col, stored
from tablewright.functions.ranks import in_blocks, index_rows
from tablewright.operators import css
from tablewright.operators.forecast import (
    SHORT_SERIES,
    Z_95,
    _per_series,
    _with_frequency,
    forecast_sma,
    future_date,
    numbered,
    series,
    window_rows,
)

EDGE = 32  # rows kept from both ends of a series for start values, at least
# Published response-surface coefficients of the Dickey-Fuller distribution (constant, one variable).
DF_MIN, DF_MAX, DF_STAR = -18.83, 2.74, -1.61
DF_LEFT = (2.1659, 1.4412, 0.038269)
DF_RIGHT = (1.7339, 0.93202, -0.12745, -0.010368)


def df_pvalue(stat: float) -> float:
    """Approximate p-value of a Dickey-Fuller statistic with a constant."""
    if stat > DF_MAX:
        return 1.0
    if stat < DF_MIN:
        return 0.0
    coefficients = DF_LEFT if stat <= DF_STAR else DF_RIGHT
    return NormalDist().cdf(sum(c * stat**i for i, c in enumerate(coefficients)))


def _test_lags(n: int, max_lag: int | None) -> int:
    """Lags of the unit-root test: the usual rule, or fewer where the caller says so."""
    lags = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    return lags if max_lag is None else min(max_lag, lags)


def _depth(n: int, max_lag: int | None) -> int:
    """Differences kept per row: enough for the tests on the series and on its first difference."""
    return max(_test_lags(n, max_lag), _test_lags(n - 1, max_lag) + 1)


def _long(n: int, p: int, q: int) -> int:
    """Lags of the long autoregression."""
    return max(1, min(max(2 * (p + q), 4), n // 4))


def _full_depth(n: int, max_lag: int | None, max_order: tuple[int, int, int], order: tuple[int, int, int] | None) -> int:
    """Differences kept per row: enough for the tests and for the long autoregression on any difference."""
    p, _, q = order or max_order
    return max(_depth(n, max_lag), _long(n, p, q) + 1)


def _basis(y: np.ndarray, depth: int) -> np.ndarray:
    """Rows ``(1, y[t-1], d[t], d[t-1], …, d[t-depth])`` with d the first difference; NaN where out of reach."""
    out = np.full((len(y), depth + 3), np.nan)
    out[:, 0] = 1
    out[1:, 1] = y[:-1]
    diff = np.full(len(y), np.nan)
    diff[1:] = y[1:] - y[:-1]
    for j in range(depth + 1):
        if j < len(y):
            out[j:, 2 + j] = diff[: len(y) - j]
    return out


def _sums(key: pd.DataFrame, x: np.ndarray, keys: list[str]) -> pd.DataFrame:
    gram = x.T @ x
    flat = gram[np.triu_indices(len(gram))]
    out = pd.DataFrame({"i": np.arange(len(flat), dtype=np.int32), "v": flat})
    for k in keys:
        out[k] = pd.Series([key[k].iloc[0]] * len(out), dtype=key[k].dtype)
    return out[[*keys, "i", "v"]]


def _unflatten(values: Sequence[float]) -> np.ndarray:
    size = int((math.sqrt(8 * len(values) + 1) - 1) / 2)
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = values
    return gram + np.triu(gram, 1).T


class _Moments:
    """Cross-products of a series' basis; single rows near its start are added where a regression reaches them."""

    def __init__(self, gram: np.ndarray, head: np.ndarray):
        self.gram, self.depth = gram, len(gram) - 3
        self.rows = _basis(head, self.depth)
        self.size = len(gram)

    def diff(self, j: int) -> np.ndarray:
        v = np.zeros(self.size)
        v[2 + j] = 1
        return v

    def level(self, i: int) -> np.ndarray:
        """y[t-i] as a combination of the basis."""
        v = np.zeros(self.size)
        v[1] = 1
        if i == 0:
            v[2] = 1
        for j in range(1, i):
            v[2 + j] -= 1
        return v

    def lagged(self, d: int, i: int) -> np.ndarray:
        """The d-th difference at t-i."""
        if d == 0:
            return self.level(i)
        return self.diff(i) if d == 1 else self.diff(i) - self.diff(i + 1)

    def regress(self, target: np.ndarray, inputs: list[np.ndarray], first: int) -> tuple[np.ndarray, float, int, np.ndarray]:
        """Least squares over the rows from ``first`` (0-based): coefficients, squared error, rows, inverse."""
        maps = np.array([*inputs, target]).T
        gram = maps.T @ self.gram @ maps
        count = self.gram[0, 0]
        early = self.rows[first : self.depth + 1]
        if len(early):
            used = np.abs(maps).sum(axis=1) > 0
            part = early[:, used] @ maps[used]
            part = part[~np.isnan(part).any(axis=1)]
            gram = gram + part.T @ part
            count += len(part)
        beta, error, inverse = _solve(gram)
        return beta, error, int(round(count)), inverse


def _solve(gram: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Regression of the last variable on the others, from their cross-products."""
    xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    scale = np.sqrt(np.diag(xx))
    if (scale <= 0).any():
        raise ValueError("a regressor is constant at zero")
    inverse = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ xy
    return beta, max(float(yy - beta @ xy), 0.0), inverse


def _unit_root(m: _Moments, d: int, n: int, max_lag: int | None) -> float:
    """p-value of the unit-root test on the d-th difference (n rows)."""
    return df_pvalue(_unit_root_test(m, d, n, max_lag)[0])


def _unit_root_test(m: _Moments, d: int, n: int, max_lag: int | None) -> tuple[float, int]:
    """Statistic of the unit-root test on the d-th difference (n rows), and the lags it uses."""
    lags = min(_test_lags(n, max_lag), m.depth - d)
    if lags < 0:
        raise ValueError("sample size is too short for the unit-root test")
    one = np.zeros(m.size)
    one[0] = 1
    target = m.lagged(d + 1, 0)

    def inputs(k: int) -> list[np.ndarray]:
        return [m.lagged(d, 1), one, *[m.lagged(d + 1, j) for j in range(1, k + 1)]]

    best, best_lag = math.inf, 0
    for k in range(lags + 1):
        _, error, rows, _ = m.regress(target, inputs(k), lags + 1 + d)
        if error <= 0:
            raise ValueError("the series is constant")
        aic = rows * (math.log(2 * math.pi * error / rows) + 1) + 2 * (k + 2)
        if aic < best:
            best, best_lag = aic, k
    beta, error, rows, inverse = m.regress(target, inputs(best_lag), best_lag + 1 + d)
    variance = error / (rows - best_lag - 2) * inverse[0, 0]
    if not variance > 0:
        raise ValueError("the series has no variation to test")
    return beta[0] / math.sqrt(variance), best_lag


def _ends(points: Sequence, n: int, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last ``edge`` rows of a series from its collected edge points."""
    values = {p["t"]: np.nan if p["value"] is None else p["value"] for p in points}
    head = np.array([values[t] for t in range(1, min(n, edge) + 1)], dtype=float)
    tail = np.array([values[t] for t in range(max(1, n - edge + 1), n + 1)], dtype=float)
    return head, tail


def _test_moments(sums: Sequence | None, head: Sequence | None) -> _Moments:
    if sums is None or len(sums) == 0:
        raise ValueError("sample size is too short for the unit-root test")
    return _Moments(_unflatten(list(sums)), np.array(list(head), dtype=float))


def _choose(row: dict, max_lag: int | None, order: tuple[int, int, int] | None, edge: int) -> dict:
    """Orders and long autoregression of one series from its sums.

    The tests are made on the series without its missing rows, and on its differences without theirs.
    """
    n = int(row["n"])
    head, _ = _ends(row["edge"], n, edge)
    moments = _test_moments(row["sums"], head)
    gaps = row["sums_0"] is not None
    if order:
        p, d, q = order
    else:
        d = 0
        if _unit_root(_test_moments(row["sums_0"], row["head_0"]) if gaps else moments, 0, int(row["n_0"]) if gaps else n, max_lag) > 0.05:
            if gaps:
                again = _unit_root(_test_moments(row["sums_1"], row["head_1"]), 0, int(row["n_1"]), max_lag)
            else:
                again = _unit_root(moments, 1, n - 1, max_lag)
            d = 2 if again > 0.05 else 1
        p, q = int(row["p"]), int(row["q"])
    long = _long(n, p, q)
    one = np.zeros(moments.size)
    one[0] = 1
    inputs = [one, *[moments.lagged(d, i) for i in range(1, long + 1)]]
    beta, _, _, _ = moments.regress(moments.lagged(d, 0), inputs, long + d)
    return {"p": p, "d": d, "q": q, "long_ar": beta.tolist()}


def _design(y: np.ndarray, p: int, d: int, q: int, long_ar: Sequence[float]) -> np.ndarray:
    """Rows ``(1, w lags, innovation lags, w)`` of the second step, NaN where out of reach."""
    w = y.astype(float)
    for _ in range(d):
        w = np.concatenate([[np.nan], w[1:] - w[:-1]])
    size = len(w)

    def lag(x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(size, np.nan)
        if k < size:
            out[k:] = x[: size - k]
        return out

    shock = w - long_ar[0]
    for i, phi in enumerate(long_ar[1:], start=1):
        shock = shock - phi * lag(w, i)
    return np.column_stack([np.ones(size), *[lag(w, i) for i in range(1, p + 1)], *[lag(shock, j) for j in range(1, q + 1)], w])


def _damped(coefficients: np.ndarray, sign: float) -> np.ndarray:
    """Coefficients pulled to a stable polynomial where an estimate is not stable."""
    if not len(coefficients):
        return coefficients
    roots = np.abs(np.roots(np.concatenate([[1.0], -sign * coefficients])))
    largest = roots.max() if len(roots) else 0.0
    if largest < 0.999:
        return coefficients
    return coefficients * (0.99 / largest) ** np.arange(1, len(coefficients) + 1)


def _start(gram: np.ndarray, orders: css.Orders) -> np.ndarray:
    """Start of the search: the second-step regression, pulled to a stable model."""
    rows, constant = gram[0, 0], orders.const
    keep = np.arange(0 if constant else 1, len(gram))  # a differenced series has no drift term
    gram = gram[np.ix_(keep, keep)]
    if rows <= len(gram):
        raise ValueError("too few complete rows for the chosen orders")
    beta, _, _ = _solve(gram)
    const, ar, ma = orders.split(beta)
    steady, still = _damped(ar, 1.0), _damped(ma, -1.0)
    if constant and (steady is not ar or still is not ma):
        mean = const / (1 - ar.sum()) if abs(1 - ar.sum()) > 1e-8 else gram[0, -1] / rows
        const = mean * (1 - steady.sum())
    return np.concatenate([[const] * constant, steady, still])


def _forecast(row: dict, periods: int, z: float, edge: int) -> dict:
    """Coefficients, fit measures and forecast of one series from its least sum of squares and its last state."""
    orders = css.Orders(int(row["p"]), int(row["d"]), int(row["q"]))
    beta, rows, n = np.array(list(row["beta"]), dtype=float), int(row["n_residuals"]), int(row["n"])
    if rows <= orders.size:
        raise ValueError("too few complete rows for the chosen orders")
    const, ar, ma = orders.split(beta)
    sigma2 = float(row["sse"]) / rows
    if not sigma2 > 0:
        raise ValueError("the fitted model leaves no error to scale intervals with")
    k = orders.size + 1
    loglik = -rows / 2 * (math.log(2 * math.pi * sigma2) + 1)
    head, tail = _ends(row["edge"], n, edge)
    need = max(orders.p, 1) + orders.d
    if row["filter"] is not None:
        mean, spread = css.filtered(_unpacked(row["filter"], orders), _known(head, orders))
    else:
        if len(tail) < need or np.isnan(tail[-need:]).any():
            raise ValueError(f"{need} rows are more than the series has")
        mean = css.known_state(tail[-need:], orders, list(row["residuals"]))
        spread = np.zeros((len(mean), len(mean)))
    path, variance = css.ahead(mean, spread, orders, beta, sigma2, periods)
    width = z * np.sqrt(variance)
    if not np.isfinite(path).all() or not np.isfinite(width).all():
        raise ValueError("the forecast is not finite")
    return {
        "ar": ar.tolist(),
        "ma": ma.tolist(),
        "const": float(const),
        "sigma2": sigma2,
        "aic": -2 * loglik + 2 * k,
        "bic": -2 * loglik + k * math.log(rows),
        "values": path.tolist(),
        "lowers": (path - width).tolist(),
        "uppers": (path + width).tolist(),
    }


def _known(head: np.ndarray, orders: css.Orders) -> np.ndarray:
    """State behind the first complete run among the first rows."""
    at = css.start_row(head, orders)
    if at is None:
        raise ValueError("no complete run among the first rows to start the filter from")
    return css.known_state(head[at + 1 - max(orders.p, 1) - orders.d : at + 1], orders)


def _packed(element: css.Element | None) -> list[float] | None:
    return None if element is None else np.concatenate([np.ravel(m) for m in element]).tolist()


def _unpacked(values: Sequence[float] | None, orders: css.Orders) -> css.Element | None:
    if values is None or not len(values):
        return None
    size = max(orders.p, 1) + orders.q + orders.d
    shapes = [(size, size), (size,), (size, size), (size,), (size, size)]
    ends = np.cumsum([math.prod(x) for x in shapes])
    parts = np.split(np.array(list(values), dtype=float), ends[:-1])
    return tuple(m.reshape(x) for m, x in zip(parts, shapes))


def _filter_part(t: np.ndarray, y: np.ndarray, head: np.ndarray, orders: css.Orders, beta: np.ndarray, sigma2: float) -> css.Element | None:
    """The filter over those of these rows that come after the start."""
    at = css.start_row(head, orders)
    return None if at is None else css.filter_steps(y[t > at + 1], orders, beta, sigma2)


_CHOICE = "p int, d int, q int, long_ar array<double>, error string"
_FIT = (
    "ar array<double>, ma array<double>, const double, sigma2 double, aic double, bic double, "
    "values array<double>, lowers array<double>, uppers array<double>, error string"
)


def _per_row(df: DataFrame, function, outputs: str) -> DataFrame:
    """Adds what ``function`` makes of each small row; its ValueErrors become the ``error`` column."""
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType([f for f in df.schema.fields if f.name not in added.names] + list(added.fields))
    names, new = [f.name for f in schema.fields], added.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch.to_dict("records"):
                result = dict.fromkeys(new)
                if record.get("error") is None:
                    try:
                        result.update(function(record))
                    except np.linalg.LinAlgError:
                        result["error"] = "the series is constant or its lags are collinear"
                    except ValueError as e:
                        result["error"] = str(e)
                else:
                    result["error"] = record["error"]
                out.append({**record, **result})
            frame = pd.DataFrame(out, columns=names)
            for f in added.fields:
                if isinstance(f.dataType, T.IntegerType):
                    frame[f.name] = frame[f.name].astype("Int32")
            yield frame

    return df.mapInPandas(run, schema)


def _add_to_series(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two one-row-per-series tables; a null key value matches itself."""
    other = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = reduce(Column.__and__, [col(k).eqNullSafe(col(f"_other_{k}")) for k in keys])
    return left.join(other, same, "left").drop(*[f"_other_{k}" for k in keys])


def _total(sums: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Block sums added per series and packed in one bounded array."""
    added = sums.groupBy(*[col(k) for k in keys], "i").agg(F.sum("v").alias("v"))
    packed = F.sort_array(F.collect_list(F.struct("i", "v")))
    return added.groupBy(*[col(k) for k in keys]).agg(packed.alias("packed")).select(
        *[col(k) for k in keys], F.col("packed.v").alias(name)
    )


def forecast_arima(
    df: DataFrame,
    ts: str,
    value: str,
    periods: int = 30,
    by: Sequence[str] = (),
    confidence: float = 0.95,
    order: tuple[int, int, int] | None = None,
    max_lag: int | None = None,
    max_order: tuple[int, int, int] = (5, 2, 2),
    block_rows: int = 65536,
    window_fraction: float = 0.3,
    min_window: int = 5,
) -> DataFrame:
    """ARIMA forecast per series; a series that cannot be fitted gets its moving average with the reason kept.

    Columns as in ``forecast_sma`` plus ``p, d, q, aic, bic``.  Rows whose
    needed lags are missing are left out of the fit.  Unit-root lags follow the usual rule,
    ceil(12 (n/100)^0.25) for a series of n rows, unless ``max_lag`` bounds them.
    """
    return _rows(
        fit_arima(df, ts, value, periods, by, confidence, order, max_lag, max_order, block_rows, window_fraction, min_window),
        by,
        periods,
        window_fraction,
        min_window,
    )


def fit_arima(
    df: DataFrame,
    ts: str,
    value: str,
    periods: int = 30,
    by: Sequence[str] = (),
    confidence: float = 0.95,
    order: tuple[int, int, int] | None = None,
    max_lag: int | None = None,
    max_order: tuple[int, int, int] = (5, 2, 2),
    block_rows: int = 65536,
    window_fraction: float = 0.3,
    min_window: int = 5,
) -> DataFrame:
    """One row per series: orders, coefficients, fit measures, date pattern and forecast arrays."""
    keys = list(by) or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    key_cols = [col(k) for k in keys]
    rows = checkpointed(numbered(source, ts, value, keys, previous=("ts", "value")))
    stats = _with_frequency(_per_series(rows, keys, window_rows(F.col("n"), window_fraction, min_window)))
    slim = rows.select(*key_cols, "t", "n", "value")
    key_schema = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    size = rows.agg(F.max("n").alias("n"), F.max(F.col("value").isNull()).alias("gaps")).first()
    # Rows that the longest series' lags reach back to: some tens, as the rule grows with the fourth root.
    depth = _full_depth(size["n"] or 1, max_lag, max_order, order)
    reach = depth + max(max_order[0], max_order[2], *(order or (0,))) + 4
    # Start values: the lags of a forecast, behind them those of its shocks.
    edge = max(EDGE, 2 * reach)
    block_rows = max(block_rows, reach)

    near_end = (F.col("t") <= edge) | (F.col("t") > F.col("n") - edge)
    # At most 2 * edge rows per series are gathered.
    edges = slim.groupBy(*key_cols).agg(
        F.max("n").alias("n"),
        F.max(F.col("value").isNull()).alias("gaps"),
        F.sort_array(F.collect_list(F.when(near_end, F.struct("t", "value")))).alias("edge"),
    )
    p = F.least(F.lit(max_order[0]), F.greatest(F.lit(1), F.floor(F.col("n") / 10).cast("int")))
    q = F.least(F.lit(max_order[2]), F.greatest(F.lit(1), F.floor(F.col("n") / 20).cast("int")))
    sums = _block_sums(slim, keys, key_schema, depth, block_rows, max_lag, max_order, order)
    joined = _add_to_series(edges, _total(sums, keys, "sums"), keys).withColumns({"p": p, "q": q})
    if size["gaps"] and not order:
        # The tests skip missing rows, so these are numbered anew.
        present = rows.where("value IS NOT NULL").select(*key_cols, "t", "value")
        steps = rows.select(*key_cols, "t", (F.col("value") - F.col("prev_value")).alias("value")).where("value IS NOT NULL")
        for name, part in (("0", present), ("1", steps)):
            again = checkpointed(index_rows(part.withColumnRenamed("t", "_at"), keys, ["_at"])).drop("_at")
            head = again.groupBy(*key_cols).agg(
                F.max("n").alias(f"n_{name}"), F.sort_array(F.collect_list(F.when(F.col("t") <= edge, F.struct("t", "value")))).alias("head")
            )
            head = head.withColumn(f"head_{name}", F.col("head.value")).drop("head")
            found = _total(_block_sums(again, keys, key_schema, depth, block_rows, max_lag, max_order, None), keys, f"sums_{name}")
            joined = _add_to_series(joined, _add_to_series(head, found, keys), keys)
        own = [F.when(F.col("gaps"), F.col(f"sums_{i}")).alias(f"sums_{i}") for i in (0, 1)]
        joined = joined.withColumns({f"sums_{i}": c for i, c in enumerate(own)})
    else:
        joined = joined.withColumn("sums_0", F.lit(None).cast("array<double>"))
    # Kept: the later steps must see the same orders.
    chosen = checkpointed(_per_row(joined, lambda r: _choose(r, max_lag, order, edge), _CHOICE))
    fits = _least_squares(slim, chosen, keys, key_schema, reach, block_rows, edge)
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    ready = _add_to_series(chosen.select(*key_cols, "n", "edge", "p", "d", "q", F.col("error").alias("choice_error")), fits, keys)
    ready = ready.withColumn("error", F.coalesce("choice_error", "error", F.when(F.col("beta").isNull(), F.lit("too few complete rows for the chosen orders"))))
    fitted = _per_row(ready.drop("choice_error"), lambda r: _forecast(r, periods, z, edge), _FIT)
    return _add_to_series(stats, fitted.drop("edge", "n", "beta", "sse", "start_sse", "n_residuals", "residuals", "filter"), keys).drop("_all")


def _block_sums(slim: DataFrame, keys: list[str], key_schema: str, depth: int, block_rows: int, max_lag, max_order, order) -> DataFrame:
    """Cross-products of the lagged values of each block."""

    def first_step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        n = int(pdf["n"].iloc[0])
        if _test_lags(n - 1, max_lag) < 0:
            return _sums(pdf, np.empty((0, 0)), keys)
        x = _basis(pdf["value"].to_numpy(dtype=float), _full_depth(n, max_lag, max_order, order))
        x = x[pdf["own"].to_numpy() & ~np.isnan(x).any(axis=1)]
        return _sums(pdf, x, keys)

    blocks = in_blocks(slim, depth + 3, block_rows)
    return blocks.groupBy(*[col(k) for k in keys], "block").applyInPandas(first_step, f"{key_schema}, i int, v double")


_SUMMARY = "gram array<double>, tail array<double>, n_residuals long"
_SEARCH = "beta array<double>, sse double, start_sse double, n_residuals long, residuals array<double>, filter array<double>"


def _found(search: css.Search, element: css.Element | None) -> dict:
    """The end of a search as a row of :data:`_SEARCH`."""
    return {
        "beta": search.best.tolist(),
        "sse": search.found["sse"],
        "start_sse": search.start_sse,
        "n_residuals": int(search.found["n"]),
        "residuals": search.found["residuals"].tolist(),
        "filter": _packed(element),
    }


def _least_squares(slim: DataFrame, chosen: DataFrame, keys: list[str], key_schema: str, reach: int, block_rows: int, edge: int) -> DataFrame:
    """The least conditional sum of squares of every series, with its last state.

    A series of one block is searched in one task.  Longer ones take one pass over their blocks for each step;
    what a pass gives of a block is a small matrix, and the search goes on from those.
    """
    key_cols = [col(k) for k in keys]
    last = F.floor((F.col("n") - 1) / F.lit(block_rows)).cast("long")
    # What a block needs to know of its series goes to every block, so no join meets a whole series under one key.
    plans = chosen.where("error IS NULL").select(*key_cols, "n", "gaps", "p", "d", "q", "long_ar", "edge", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = in_blocks(slim, reach, block_rows)

    def whole(orders: css.Orders, pdf: pd.DataFrame, plan: pd.Series, gram: np.ndarray) -> dict:
        y, own = pdf["value"].to_numpy(dtype=float), pdf["own"].to_numpy()
        search = css.fit([(y, own)], orders, _start(gram, orders))
        element = None
        if plan["gaps"] and search.found["n"] and search.found["sse"] > 0:
            head, _ = _ends(plan["edge"], int(plan["n"]), edge)
            element = _filter_part(pdf["t"].to_numpy(), y, head, orders, search.best, search.found["sse"] / search.found["n"])
        return _found(search, element)

    def second_step(key: tuple, pdf: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        if not len(plan) or not len(pdf):
            return pd.DataFrame(columns=[*keys, "gram2", "hint", *names, "error"])
        pdf, plan = pdf.sort_values("t"), plan.iloc[0]
        orders = css.Orders(int(plan["p"]), int(plan["d"]), int(plan["q"]))
        x = _design(pdf["value"].to_numpy(dtype=float), orders.p, orders.d, orders.q, list(plan["long_ar"]))
        x = x[pdf["own"].to_numpy() & ~np.isnan(x).any(axis=1)]
        gram = x.T @ x
        row: dict = dict.fromkeys(["gram2", "hint", *names, "error"])
        if int(plan["n"]) <= block_rows:
            try:
                row |= whole(orders, pdf, plan, gram)
            except np.linalg.LinAlgError:
                row["error"] = "the series is constant or its lags are collinear"
            except ValueError as e:
                row["error"] = str(e)
        else:
            row["gram2"] = gram[np.triu_indices(len(gram))].tolist()
            if int(plan["block"]) == 0:
                # The fit of the first block brings the search of the whole series near its end.
                with contextlib.suppress(np.linalg.LinAlgError, ValueError):
                    row["hint"] = whole(orders, pdf, plan, gram)["beta"]
        out = pd.DataFrame([row])
        for k, v in zip([*keys, "block"], key):
            if k != "block":
                out[k] = pd.Series([pdf[k].iloc[0]], dtype=pdf[k].dtype)
        return out[[*keys, "gram2", "hint", *names, "error"]]

    names = [c.split()[0] for c in _SEARCH.split(", ")]
    done = (
        blocks.groupBy(*key_cols, "block")
        .cogroup(plans.groupBy(*key_cols, "block"))
        .applyInPandas(second_step, f"{key_schema}, gram2 array<double>, hint array<double>, {_SEARCH}, error string")
    )
    if not chosen.where((F.col("n") > block_rows) & F.col("error").isNull()).limit(1).count():
        return done.drop("gram2", "hint")
    done = checkpointed(done)
    long = _long_series(slim, chosen, done, keys, key_schema, reach, block_rows, edge)
    return done.where("gram2 IS NULL").drop("gram2", "hint").unionByName(long)


def _long_series(slim: DataFrame, chosen: DataFrame, done: DataFrame, keys: list[str], key_schema: str, reach: int, block_rows: int, edge: int) -> DataFrame:
    """Series of many blocks: one pass over the blocks for each step of all their searches."""
    key_cols = [col(k) for k in keys]
    names = [c.split()[0] for c in _SEARCH.split(", ")]
    wanted = chosen.where((F.col("n") > block_rows) & F.col("error").isNull()).select(*key_cols, "n", "gaps", "p", "d", "q", "edge")
    added = done.where("gram2 IS NOT NULL").select(*key_cols, F.posexplode("gram2").alias("i", "v"))
    hints = done.where("hint IS NOT NULL").select(*key_cols, F.col("hint").alias("first_hint"))
    state = _add_to_series(_add_to_series(wanted, _total(added, keys, "gram2"), keys), hints, keys)

    def begin(row: dict) -> dict:
        orders = css.Orders(int(row["p"]), int(row["d"]), int(row["q"]))
        hint = None if row["first_hint"] is None else np.array(list(row["first_hint"]), dtype=float)
        return css.Search(orders, _start(_unflatten(list(row["gram2"])), orders), hint).row()

    # Written and read again in each pass, so that a pass's plan holds nothing of the passes before.
    state = stored(_per_row(state, begin, f"{css.Search.COLUMNS}, error string").drop("gram2", "first_hint"))
    search = ["p", "d", "q", *[c.split()[0] for c in css.Search.COLUMNS.split(", ")]]
    # A block of a series as one row, written once; every pass reads it where it lies.
    packed = in_blocks(slim.where(F.col("n") > block_rows), reach, block_rows).groupBy(*key_cols, "block")
    packed = checkpointed(packed.agg(F.sort_array(F.collect_list(F.struct("t", "value", "own"))).alias("rows")))
    packed = packed.select(*key_cols, "block", F.col("rows.t").alias("t"), F.col("rows.value").alias("y"), F.col("rows.own").alias("own"))

    def with_state(state: DataFrame, *columns: str) -> DataFrame:
        last = F.floor((F.col("n") - 1) / F.lit(block_rows)).cast("long")
        plans = state.select(*key_cols, *columns, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
        plans = plans.withColumnsRenamed({k: f"_other_{k}" for k in [*keys, "block"]})
        same = reduce(Column.__and__, [col(k).eqNullSafe(col(f"_other_{k}")) for k in [*keys, "block"]])
        return packed.join(plans, same).drop(*[f"_other_{k}" for k in [*keys, "block"]])

    def summary(row: dict) -> dict:
        search = css.Search.of(row)
        got = css.block_sums(np.array(row["y"], dtype=float), np.array(row["own"], dtype=bool), search.orders, search.candidate)
        return {"gram": got["gram"].ravel().tolist(), "tail": got["tail"].ravel().tolist(), "n_residuals": int(got["n"])}

    def advance(row: dict) -> dict:
        search = css.Search.of(row)
        if row["searching"]:
            width = search.orders.basis
            parts = [
                {"gram": np.reshape(b["gram"], (width, width)), "tail": np.reshape(b["tail"], (-1, width)), "n": b["n_residuals"]}
                for b in row["parts"]
            ]
            search.tell(css.series_sums(parts, search.orders))
        return search.row()

    while state.where("searching").limit(1).count():
        part = _per_row(with_state(state.where("searching"), *search), summary, f"{_SUMMARY}, error string")
        part = part.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct("block", "gram", "tail", "n_residuals"))).alias("parts"))
        told = _per_row(_add_to_series(state, part, keys), advance, f"{css.Search.COLUMNS}, error string")
        state = stored(told.drop("parts"))

    def over_gaps(row: dict) -> dict:
        search, own = css.Search.of(row), np.array(row["own"], dtype=bool)
        head, _ = _ends(row["edge"], int(row["n"]), edge)
        t, y = np.array(row["t"])[own], np.array(row["y"], dtype=float)[own]
        sigma2 = search.found["sse"] / max(search.found["n"], 1)
        return {"filter": _packed(_filter_part(t, y, head, search.orders, search.best, sigma2)) if sigma2 > 0 else None}

    def end(row: dict) -> dict:
        if row["error"]:
            raise ValueError(row["error"])
        search, element = css.Search.of(row), None
        if row["parts"] is not None:
            element = css.composed([e for e in (_unpacked(b["filter"], search.orders) for b in row["parts"]) if e is not None])
        return _found(search, element)

    gappy = with_state(state.where("gaps AND error IS NULL"), *search, "edge", "n")
    parts = _per_row(gappy, over_gaps, "filter array<double>, error string").where("filter IS NOT NULL")
    parts = parts.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct("block", "filter"))).alias("parts"))
    return _per_row(_add_to_series(state, parts, keys), end, f"{_SEARCH}, error string").select(*key_cols, *names, "error")


def unit_root_tests(
    df: DataFrame, ts: str, value: str, by: Sequence[str] = (), max_lag: int | None = None, block_rows: int = 65536
) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant of each series: ``(by…, n, lags, statistic, p_value, error)``.

    ``n`` are the rows that are not missing, lags are chosen by AIC.
    """
    keys = list(by) or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    present = series(source, ts, value, keys).where("value IS NOT NULL")
    rows = checkpointed(index_rows(present, keys, ["ts", "value"])).select(*[col(k) for k in keys], "t", "n", "value")
    depth = _full_depth(rows.agg(F.max("n")).first()[0] or 1, max_lag, (0, 0, 0), None)
    key_schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    first = F.sort_array(F.collect_list(F.when(F.col("t") <= depth + 2, F.struct("t", "value")))).alias("head")
    heads = rows.groupBy(*[col(k) for k in keys]).agg(F.max("n").alias("n"), first).withColumn("head", F.col("head.value"))
    sums = _total(_block_sums(rows, keys, key_schema, depth, max(block_rows, depth + 4), max_lag, (0, 0, 0), None), keys, "sums")

    def test(row: dict) -> dict:
        n = int(row["n"])
        statistic, lags = _unit_root_test(_test_moments(row["sums"], row["head"]), 0, n, max_lag)
        return {"lags": lags, "statistic": statistic, "p_value": df_pvalue(statistic)}

    found = _per_row(_add_to_series(heads, sums, keys), test, "lags int, statistic double, p_value double, error string")
    return found.select(*[col(b) for b in by], "n", "lags", "statistic", "p_value", "error")


def _rows(fits: DataFrame, by: Sequence[str], periods: int, fraction: float, least: int) -> DataFrame:
    enough = F.col("n") >= 3
    fitted = enough & F.col("error").isNull() & F.col("values").isNotNull()
    steps = F.when(enough, F.sequence(F.lit(1), F.lit(periods))).otherwise(F.array(F.lit(None).cast("int")))
    rows = fits.withColumn("step", F.explode(steps))
    known = F.col("step").isNotNull()
    at = F.col("step") - 1

    def pick(array: str, otherwise: Column) -> Column:
        return F.when(known, F.when(fitted, F.get(array, at)).otherwise(otherwise)).alias(
            {"values": "value", "lowers": "lower", "uppers": "upper"}[array]
        )

    return rows.select(
        *[col(b) for b in by],
        "step",
        F.when(known, future_date(F.col("last_ts"), F.col("unit"), F.col("step_size"), F.col("step"))).alias("ts"),
        pick("values", F.col("level")),
        pick("lowers", F.col("level") - Z_95 * F.col("spread")),
        pick("uppers", F.col("level") + Z_95 * F.col("spread")),
        F.when(fitted, "arima").otherwise("sma").alias("model"),
        "frequency",
        F.when(known & ~fitted, window_rows(F.col("n"), fraction, least)).alias("window_size"),
        F.when(~enough, F.lit(SHORT_SERIES)).otherwise(F.col("error")).alias("error"),
        *[F.when(fitted, F.col(c)).alias(c) for c in ("p", "d", "q", "aic", "bic")],
    )


def forecast(df: DataFrame, ts: str, value: str, periods: int = 30, model: str | None = None, **options) -> DataFrame:
    """Forecast by model name: ``arima`` or ``sma``; any other name means the moving average."""
    return (forecast_arima if model == "arima" else forecast_sma)(df, ts, value, periods, **options)
