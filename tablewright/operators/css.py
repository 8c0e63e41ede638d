"""Conditional sum of squares of ARMA models, block by block, and the filter that forecasts over missing rows.

The residuals ``e[t] = w[t] - c - sum ar[i] w[t-i] - sum ma[j] e[t-j]`` and their derivatives are
recursions in time.  Inside a block they are an affine function of what the block before
leaves (its last residuals and derivatives), so each block gives its sums for *any* such
state, and the states themselves follow from one small step a block.  A series is therefore
never gathered, and the result does not depend on how it was cut.

A row counts where it and the ``p`` rows before it are present; residuals start at 0 behind every other row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

CHUNK = 256  # rows that one matrix product filters
ROUNDS = 40  # steps tried at most for one series
LEAST_SCALE = 2.0**-8  # a step is halved so often at most
LEAST_GAIN = 1e-10  # expected share of the sum of squares below which a step is not worth taking
STEADY = 0.9995  # largest inverse root of an accepted polynomial


def linear_filter(signals: np.ndarray, ma: np.ndarray, before: np.ndarray) -> np.ndarray:
    """``x[t] = signals[t] - sum ma[j] x[t-j]`` down every column; ``before[j-1]`` is x[-j]."""
    q, n = len(ma), len(signals)
    if not q or not n:
        return signals.copy()
    size = min(CHUNK, n)
    response = np.zeros(size)
    response[0] = 1
    for k in range(1, size):
        response[k] = -sum(ma[j] * response[k - 1 - j] for j in range(min(q, k)))
    toeplitz = np.tril(response[np.abs(np.subtract.outer(np.arange(size), np.arange(size)))])
    # What past values add: x[-j] enters row t < j' through ma[j'], and its response from there on.
    enter = np.zeros((size, q))
    for j in range(q):
        for t in range(min(q - j, size)):
            enter[t, j] = -ma[j + t]
    past = toeplitz @ enter
    out, state = np.empty_like(signals, dtype=float), before.astype(float)
    for start in range(0, n, size):
        part = signals[start : start + size]
        found = toeplitz[: len(part), : len(part)] @ part + past[: len(part)] @ state
        out[start : start + size] = found
        state = np.concatenate([found[::-1], state])[:q]
    return out


def differenced(y: np.ndarray, d: int) -> np.ndarray:
    """The d-th difference, as long as the series; NaN where a value is missing."""
    w = y.astype(float)
    for _ in range(d):
        w = np.concatenate([[np.nan], w[1:] - w[:-1]])
    return w


def _shifted(x: np.ndarray, k: int, fill: np.ndarray | float = 0.0) -> np.ndarray:
    out = np.empty_like(x)
    out[:k], out[k:] = (fill if np.isscalar(fill) else fill[: len(out[:k])]), x[: max(len(x) - k, 0)]
    return out


@dataclass
class Orders:
    """Shape of a model; ``const`` where the (undifferenced) series has a mean."""

    p: int
    d: int
    q: int

    @property
    def const(self) -> int:
        return int(self.d == 0)

    @property
    def size(self) -> int:
        return self.const + self.p + self.q

    @property
    def basis(self) -> int:
        return 1 + self.size + self.q + self.q * self.q

    def split(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        beta = np.asarray(beta, dtype=float)
        return (beta[0] if self.const else 0.0), beta[self.const : self.const + self.p], beta[self.const + self.p :]


def block_sums(y: np.ndarray, own: np.ndarray, orders: Orders, beta: np.ndarray) -> dict:
    """Sums of a block, for any state that the block before may leave.

    ``gram`` are the products of: residuals and their derivatives from a zero start, the answer to each past
    residual, and its share in the derivatives by each ``ma``.  ``tail`` has the last q rows of the same, ``n``
    the residuals counted.  Rows that are not ``own`` only serve as lags; there must be p + d + 1 of
    them, or all there are.
    """
    const, ar, ma = orders.split(beta)
    p, q, width = orders.p, orders.q, orders.basis
    w = differenced(np.asarray(y, dtype=float), orders.d)
    lags = np.column_stack([_shifted(w, i, np.nan) for i in range(1, p + 1)]) if p else np.empty((len(w), 0))
    good = ~np.isnan(w) & ~np.isnan(lags).any(axis=1) & (np.arange(len(w)) >= p + orders.d)
    rows = np.flatnonzero(np.asarray(own, dtype=bool))
    gram, tail, count = np.zeros((width, width)), np.zeros((q, width)), 0
    if not len(rows):
        return {"gram": gram, "tail": tail, "n": 0}
    begin, end = rows[0], rows[-1] + 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], good[begin:end].astype(int), [0]])))
    for start, stop in zip(begin + edges[::2], begin + edges[1::2]):
        goes_on = start == begin and begin > 0 and bool(good[begin - 1])
        part, here = slice(start, stop), lags[start:stop]
        n = stop - start
        fixed = [-np.ones((n, 1))] * orders.const + [-here]
        first = linear_filter(np.column_stack([w[part] - const - here @ ar, *fixed]), ma, np.zeros((q, 1 + orders.const + p)))
        residual = first[:, 0]
        by_ma = linear_filter(np.column_stack([-_shifted(residual, k) for k in range(1, q + 1)]), ma, np.zeros((q, q))) if q else np.empty((n, 0))
        found = np.zeros((q + n, width))
        found[q:, : 1 + orders.size] = np.column_stack([first, by_ma])
        if goes_on and q:
            answer = linear_filter(np.zeros((n, q)), ma, np.eye(q))
            found[q:, 1 + orders.size : 1 + orders.size + q] = answer
            found[:q, 1 + orders.size : 1 + orders.size + q] = np.eye(q)[::-1]
            for k in range(1, q + 1):
                # Row t-k of the answer is, before the block, the past residual itself.
                late = -_shifted(answer, k, np.eye(q)[:k][::-1])
                at = 1 + orders.size + q + (k - 1) * q
                found[q:, at : at + q] = linear_filter(late, ma, np.zeros((q, q)))
        body = found[q:]
        gram += body.T @ body
        count += n
        tail = found[len(found) - q :] if stop == end else np.zeros((q, width))
    return {"gram": gram, "tail": tail, "n": count}


def _at_state(orders: Orders, state: np.ndarray) -> np.ndarray:
    """Residual and derivatives as combinations of the basis; ``state[-j]`` is the row j back, a residual and its derivatives."""
    q, size = orders.q, orders.size
    out = np.zeros((1 + size, orders.basis))
    out[:, : 1 + size] = np.eye(1 + size)
    back = state[::-1]  # row j-1 is j back
    out[:, 1 + size : 1 + size + q] = back.T
    for k in range(q):
        at = 1 + size + q + k * q
        out[1 + orders.const + orders.p + k, at : at + q] = back[:, 0]
    return out


def series_sums(blocks: Iterable[dict], orders: Orders) -> dict:
    """Sums of a whole series from those of its blocks, in order: squares, products with the derivatives, last state."""
    state, total, n = np.zeros((orders.q, 1 + orders.size)), np.zeros((1 + orders.size,) * 2), 0
    for block in blocks:
        maps = _at_state(orders, state)
        total += maps @ block["gram"] @ maps.T
        state = block["tail"] @ maps.T
        n += block["n"]
    return {"sse": max(float(total[0, 0]), 0.0), "gradient": total[1:, 0], "normal": total[1:, 1:], "n": n, "residuals": state[::-1, 0]}


def admissible(orders: Orders, beta: np.ndarray) -> bool:
    """Stationary and invertible."""
    _, ar, ma = orders.split(beta)
    for coefficients, sign in ((ar, 1.0), (ma, -1.0)):
        if len(coefficients) and np.abs(np.roots(np.concatenate([[1.0], -sign * coefficients]))).max(initial=0.0) >= STEADY:
            return False
    return True


class Search:
    """Gauss-Newton steps with halving; ``candidate`` is what the next sums are wanted for.

    After the first step the matrix follows the gradients as they change (BFGS), which saves sums where
    the model has more coefficients than the series shows.  A ``hint`` is tried right after the start.
    """

    def __init__(self, orders: Orders, start: np.ndarray, hint: np.ndarray | None = None):
        self.orders, self.candidate = orders, np.asarray(start, dtype=float)
        self.hint = None if hint is None or not admissible(orders, hint) else np.asarray(hint, dtype=float)
        self.best: np.ndarray | None = None
        self.inverse = np.zeros((orders.size, orders.size))
        self.step, self.scale, self.tried, self.done = np.zeros(orders.size), 1.0, 0, False
        self.found: dict = {}
        self.start_sse = math.nan

    #: A search as plain columns, to go on with it in another task.
    COLUMNS = (
        "candidate array<double>, hint array<double>, best array<double>, step array<double>, inverse array<double>, "
        "gradient array<double>, residuals array<double>, numbers array<double>, searching boolean"
    )

    def row(self) -> dict:
        numbers = [self.scale, self.tried, self.start_sse, self.found.get("sse", math.nan), self.found.get("n", 0)]
        arrays = {"candidate": self.candidate, "hint": self.hint, "best": self.best, "step": self.step, "inverse": self.inverse.ravel()}
        arrays |= {n: self.found.get(n) for n in ("gradient", "residuals")} | {"numbers": np.array(numbers, dtype=float)}
        return {n: None if a is None else a.tolist() for n, a in arrays.items()} | {"searching": not self.done}

    @classmethod
    def of(cls, row: dict) -> Search:
        at = {n: None if row[n] is None else np.array(list(row[n]), dtype=float) for n in ("candidate", "hint", "best", "step", "inverse", "gradient", "residuals")}
        out = cls(Orders(int(row["p"]), int(row["d"]), int(row["q"])), at["candidate"], at["hint"])
        out.best, out.step, out.done = at["best"], at["step"], not row["searching"]
        out.inverse = at["inverse"].reshape(out.inverse.shape)
        out.scale, tried, out.start_sse, sse, n = map(float, row["numbers"])
        out.tried = int(tried)
        if out.best is not None:
            out.found = {"sse": sse, "n": int(n), "gradient": at["gradient"], "residuals": at["residuals"]}
        return out

    def tell(self, sums: dict) -> None:
        self.tried += 1
        if self.best is None or sums["sse"] < self.found["sse"]:
            if self.best is None:
                self.start_sse = sums["sse"]
            if not self.orders.size or sums["n"] <= self.orders.size:
                self.best, self.found, self.done = self.candidate, sums, True
                return
            self._turn(sums)
            self.best, self.found, self.scale = self.candidate, sums, 1.0
            self.step = -self.inverse @ sums["gradient"]
            gain = -float(self.step @ sums["gradient"])
            self.done = not math.isfinite(gain) or gain <= LEAST_GAIN * sums["sse"]
        else:
            self.scale /= 2
        if self.hint is not None and not self.done:
            self.candidate, self.hint = self.hint, None
            return
        self._next()

    def _turn(self, sums: dict) -> None:
        """The inverse of the curvature at the candidate, whose sums these are."""
        moved = None if self.best is None else self.candidate - self.best
        change = None if moved is None else sums["gradient"] - self.found["gradient"]
        if moved is None or not moved @ change > 0:
            self.inverse = _inverse(sums["normal"])
            return
        weight = 1 / float(moved @ change)
        turn = np.eye(len(moved)) - weight * np.outer(moved, change)
        self.inverse = turn @ self.inverse @ turn.T + weight * np.outer(moved, moved)

    def _next(self) -> None:
        while not self.done:
            if self.scale < LEAST_SCALE or self.tried >= ROUNDS:
                self.done = True
                return
            self.candidate = self.best + self.scale * self.step
            if admissible(self.orders, self.candidate):
                return
            self.scale /= 2


def _inverse(normal: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.diag(normal))
    scale[scale <= 0] = 1.0
    return np.linalg.pinv(normal / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale)


def fit(blocks: list[tuple[np.ndarray, np.ndarray]], orders: Orders, start: np.ndarray) -> Search:
    """The whole search over blocks at hand."""
    search = Search(orders, start)
    while not search.done:
        search.tell(series_sums((block_sums(y, own, orders, search.candidate) for y, own in blocks), orders))
    return search


# The state behind a row: the last w, the last residuals, the levels from the highest difference down to the series.


def transition(orders: Orders, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, constant, loading of the shock, and the row that reads the series."""
    const, ar, ma = orders.split(beta)
    lags, q, d = max(orders.p, 1), orders.q, orders.d
    size = lags + q + d
    move, add, load = np.zeros((size, size)), np.zeros(size), np.zeros(size)
    move[0, : orders.p], move[0, lags : lags + q], add[0], load[0] = ar, ma, const, 1
    for i in range(1, lags):
        move[i, i - 1] = 1
    for j in range(1, q):
        move[lags + j, lags + j - 1] = 1
    if q:
        load[lags] = 1
    above = 0
    for i in range(lags + q, size):
        move[i], add[i], load[i] = move[above], add[above], 1
        move[i, i] += 1
        above = i
    read = np.zeros(size)
    read[size - 1 if d else 0] = 1
    return move, add, load, read


Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _compose(first: Element, then: Element) -> Element:
    """Two steps of the filter as one; associative, so steps may be put together in any grouping."""
    a1, b1, c1, e1, j1 = first
    a2, b2, c2, e2, j2 = then
    eye = np.eye(a1.shape[-1])
    turn = lambda m: np.swapaxes(m, -1, -2)
    apply = lambda m, v: (m @ v[..., None])[..., 0]
    forward = a2 @ np.linalg.inv(eye + c1 @ j2)
    backward = turn(a1) @ np.linalg.inv(eye + j2 @ c1)
    return (
        forward @ a1,
        apply(forward, b1 + apply(c1, e2)) + b2,
        forward @ c1 @ turn(a2) + c2,
        apply(backward, e2 - apply(j2, b1)) + e1,
        backward @ j2 @ a1 + j1,
    )


def composed(elements: list[Element]) -> Element | None:
    """All elements, in order, as one."""
    out = None
    for element in elements:
        out = element if out is None else _compose(out, element)
    return out


def filter_steps(y: np.ndarray, orders: Orders, beta: np.ndarray, sigma2: float, chunk: int = 2048) -> Element | None:
    """The filter over these rows as one element: a missing row moves the state on, any other one corrects it, too."""
    move, add, load, read = transition(orders, beta)
    size, parts = len(add), []
    noise = sigma2 * np.outer(load, load)
    seen = (np.eye(size) - np.outer(load, read)) @ move
    inform = move.T @ np.outer(read, read) @ move / sigma2
    for start in range(0, len(y), chunk):
        part = np.asarray(y[start : start + chunk], dtype=float)
        here, surprise = ~np.isnan(part), np.where(np.isnan(part), 0.0, part) - read @ add
        elements: Element = (
            np.where(here[:, None, None], seen, move),
            add + np.where(here, surprise, 0.0)[:, None] * load,
            np.where(here[:, None, None], 0.0, noise),
            np.where(here, surprise, 0.0)[:, None] * (move.T @ read) / sigma2,
            np.where(here[:, None, None], inform, 0.0),
        )
        # Neighbours are put together in a tree, all pairs of a level at once.
        while len(elements[0]) > 1:
            n = len(elements[0]) // 2 * 2
            pairs = _compose(tuple(m[0:n:2] for m in elements), tuple(m[1:n:2] for m in elements))
            elements = tuple(np.concatenate([a, m[n:]]) for a, m in zip(pairs, elements))
        parts.append(tuple(m[0] for m in elements))
    return composed(parts)


def start_row(head: np.ndarray, orders: Orders) -> int | None:
    """Number (from 0) of the row behind which the state is known: the first p + d rows in a row, one at least."""
    need = max(orders.p, 1) + orders.d
    run = 0
    for i, value in enumerate(head):
        run = 0 if math.isnan(value) else run + 1
        if run == need:
            return i
    return None


def known_state(rows: np.ndarray, orders: Orders, residuals: np.ndarray | None = None) -> np.ndarray:
    """The state behind the last of these present rows; residuals, newest first, are 0 unless given."""
    levels = [np.asarray(rows, dtype=float)]
    for _ in range(orders.d):
        levels.append(np.diff(levels[-1]))
    lags = max(orders.p, 1)
    past = np.zeros(orders.q) if residuals is None else np.asarray(residuals, dtype=float)
    return np.concatenate([levels[-1][::-1][:lags], past, [levels[k][-1] for k in range(orders.d - 1, -1, -1)]])


def filtered(element: Element | None, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the state behind an element that starts from a known state."""
    if element is None:
        return start, np.zeros((len(start), len(start)))
    move, shift, spread, _, _ = element
    return move @ start + shift, spread


def ahead(mean: np.ndarray, spread: np.ndarray, orders: Orders, beta: np.ndarray, sigma2: float, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and their variances from a state."""
    move, add, load, read = transition(orders, beta)
    noise = sigma2 * np.outer(load, load)
    values, variances = np.empty(periods), np.empty(periods)
    for h in range(periods):
        mean, spread = move @ mean + add, move @ spread @ move.T + noise
        values[h], variances[h] = read @ mean, read @ spread @ read
    return values, variances
