"""Conditional sums of squares and the filter over missing rows against plain loops."""

import numpy as np
import pytest

from tablewright.operators import css


def _simulated(seed, n, ar=(), ma=(), const=0.0, d=0, holes=()):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n + 100), np.zeros(n + 100)
    for t in range(5, n + 100):
        w[t] = const + e[t] + sum(a * w[t - 1 - i] for i, a in enumerate(ar)) + sum(b * e[t - 1 - i] for i, b in enumerate(ma))
    y = w[100:]
    for _ in range(d):
        y = np.cumsum(y)
    y = y.copy()
    y[list(holes)] = np.nan
    return y


def _residuals(y, orders, beta):
    """Residuals row by row; every row that does not count starts them anew from 0."""
    const, ar, ma = orders.split(beta)
    w = y
    for _ in range(orders.d):
        w = np.concatenate([[np.nan], np.diff(w)])
    e, counted, run = np.zeros(len(y)), np.zeros(len(y), bool), 0
    for t in range(orders.p + orders.d, len(y)):
        if np.isnan(w[t - orders.p : t + 1]).any():
            run = t + 1
            continue
        counted[t] = True
        e[t] = w[t] - const - sum(a * w[t - 1 - i] for i, a in enumerate(ar))
        e[t] -= sum(b * e[t - 1 - j] for j, b in enumerate(ma) if t - 1 - j >= run)
    return e, counted


def _blocks(y, rows, lags):
    out = []
    for start in range(0, len(y), rows):
        first = max(0, start - lags)
        part = y[first : start + rows]
        out.append((part, np.arange(len(part)) >= start - first))
    return out


CASES = [
    ((1, 0, 0), (0.6,), (), 3.0, ()),
    ((2, 0, 1), (0.5, 0.2), (0.4,), -2.0, (40, 41, 90, 299)),
    ((0, 0, 2), (), (0.5, -0.3), 1.0, (0, 7, 100)),
    ((1, 1, 2), (0.4,), (0.3, 0.2), 0.0, (31, 32, 33, 200)),
    ((3, 2, 1), (0.3, 0.1, -0.2), (-0.5,), 0.0, (55,)),
    ((0, 1, 0), (), (), 0.0, (5,)),
]


@pytest.mark.parametrize("shape, ar, ma, const, holes", CASES)
def test_sums_do_not_depend_on_the_cut(shape, ar, ma, const, holes):
    orders = css.Orders(*shape)
    y = _simulated(1, 300, ar, ma, const, orders.d, holes)
    beta = np.array([*([const] * orders.const), *ar, *ma]) * 0.9
    e, counted = _residuals(y, orders, beta)
    # Derivatives by small steps of the plain recursion.
    step = 1e-6
    by = np.array([(_residuals(y, orders, beta + step * u)[0] - _residuals(y, orders, beta - step * u)[0]) / (2 * step) for u in np.eye(orders.size)]).reshape(orders.size, len(y))
    for rows in (300, 64, 7, 1):
        blocks = _blocks(y, rows, orders.p + orders.d + 1)
        sums = css.series_sums([css.block_sums(part, own, orders, beta) for part, own in blocks], orders)
        assert sums["n"] == counted.sum() and np.isclose(sums["sse"], e @ e, rtol=1e-10)
        assert np.allclose(sums["gradient"], by @ e, rtol=1e-5, atol=1e-4) and np.allclose(sums["normal"], by @ by.T, rtol=1e-5, atol=1e-4)
        assert np.allclose(sums["residuals"], e[::-1][: orders.q]) or not counted[-2:].all()


def test_filter_in_chunks():
    rng = np.random.default_rng(3)
    signals, before, ma = rng.normal(size=(1000, 3)), rng.normal(size=(2, 3)), np.array([0.7, -0.2])
    want, past = np.zeros((1002, 3)), before[::-1]
    want[:2] = past
    for t in range(1000):
        want[2 + t] = signals[t] - ma[0] * want[1 + t] - ma[1] * want[t]
    assert np.allclose(css.linear_filter(signals, ma, before), want[2:])


@pytest.mark.parametrize("shape, ar, ma, const, holes", [c for c in CASES if sum(c[0]) - c[0][1]])
def test_fit_is_the_least_sum(shape, ar, ma, const, holes):
    orders = css.Orders(*shape)
    y = _simulated(2, 1500, ar, ma, const, orders.d, holes)
    start = np.array([*([float(np.nanmean(y)) * 0.5] * orders.const), *[0.1] * orders.p, *[0.0] * orders.q])
    whole = css.fit([(y, np.ones(len(y), bool))], orders, start)
    cut = css.fit(_blocks(y, 130, orders.p + orders.d + 1), orders, start)
    assert np.allclose(whole.best, cut.best, atol=1e-6) and np.isclose(whole.found["sse"], cut.found["sse"], rtol=1e-9)
    e, _ = _residuals(y, orders, start)
    assert whole.found["sse"] <= whole.start_sse and np.isclose(whole.start_sse, e @ e)
    # Neither a neighbour nor the true model is better.
    for u in np.eye(orders.size):
        for side in (1e-3, -1e-3):
            e, _ = _residuals(y, orders, whole.best + side * u)
            assert e @ e >= whole.found["sse"] * (1 - 1e-12)
    e, _ = _residuals(y, orders, np.array([*([const] * orders.const), *ar, *ma]))
    assert whole.found["sse"] <= e @ e


def _plain_filter(y, orders, beta, sigma2, start, mean):
    move, add, load, read = css.transition(orders, beta)
    spread = np.zeros((len(mean), len(mean)))
    for value in y[start + 1 :]:
        mean, spread = move @ mean + add, move @ spread @ move.T + sigma2 * np.outer(load, load)
        if not np.isnan(value):
            gain = spread @ read / (read @ spread @ read)
            mean, spread = mean + gain * (value - read @ mean), spread - np.outer(gain, read @ spread)
    return mean, spread


@pytest.mark.parametrize("shape, ar, ma, const, holes", CASES)
@pytest.mark.parametrize("late", [(), (299,), (298,), (296, 297), (290, 293, 299)])
def test_forecast_over_holes_equals_a_plain_filter(shape, ar, ma, const, holes, late):
    orders = css.Orders(*shape)
    y = _simulated(5, 300, ar, ma, const, orders.d, (*holes, *late))
    beta, sigma2 = np.array([*([const] * orders.const), *ar, *ma]), 1.3
    at = css.start_row(y, orders)
    need = max(orders.p, 1) + orders.d
    mean = css.known_state(y[at + 1 - need : at + 1], orders)
    want = css.ahead(*_plain_filter(y, orders, beta, sigma2, at, mean), orders, beta, sigma2, 6)
    for rows in (300, 50, 1):
        parts = [y[max(a, at + 1) : a + rows] for a in range(0, 300, rows) if a + rows > at + 1]
        whole = css.composed([e for e in (css.filter_steps(p, orders, beta, sigma2, chunk=37) for p in parts) if e is not None])
        got = css.ahead(*css.filtered(whole, mean), orders, beta, sigma2, 6)
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])
    if not holes and not late:
        e, _ = _residuals(y, orders, beta)
        plain = css.ahead(css.known_state(y[-need:], orders, e[::-1][: orders.q]), np.zeros((len(mean),) * 2), orders, beta, sigma2, 6)
        assert np.allclose(plain[0], want[0]) and np.allclose(plain[1], want[1])


def test_a_hole_widens_the_interval():
    orders, beta = css.Orders(2, 0, 0), np.array([1.0, 0.5, 0.2])
    full = _simulated(7, 120, (0.5, 0.2), (), 1.0)
    for back in (1, 2):
        y = full.copy()
        y[-back] = np.nan
        widths = []
        for rows in (full, y):
            mean, spread = css.filtered(css.filter_steps(rows[2:], orders, beta, 1.0), css.known_state(rows[:2], orders))
            widths.append(css.ahead(mean, spread, orders, beta, 1.0, 3)[1])
        assert (widths[1] > widths[0]).all()


def test_start_without_a_full_run():
    assert css.start_row(np.array([1.0, np.nan, 2.0, np.nan]), css.Orders(2, 0, 0)) is None
    assert css.start_row(np.array([np.nan, 1.0, 2.0, 3.0]), css.Orders(1, 1, 1)) == 2
    assert not css.admissible(css.Orders(1, 0, 0), np.array([0.0, 1.01])) and css.admissible(css.Orders(0, 0, 1), np.array([0.0, 0.9]))
