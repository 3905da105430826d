"""A cell of an overlay: its states and arcs as arrays, and the cheapest ways inside it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def spread(costs: np.ndarray, source: np.ndarray, into: np.ndarray, cost: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Least costs (a row per start) after any number of arcs; ``into``, the arcs' ends, is sorted.

    ``turn``, of the same shape, is told the round in which each was lowered last.
    """
    ends, first = np.unique(into, return_index=True)
    costs, n = costs.copy(), 0
    while len(into):
        new, n = np.minimum.reduceat(costs[:, source] + cost, first, axis=1), n + 1
        better = new < costs[:, ends]
        if not better.any():
            break
        costs[:, ends] = np.minimum(costs[:, ends], new)
        if turn is not None:
            turn[:, ends] = np.where(better, n, turn[:, ends])
    return costs


class Cell:
    """A packed cell: its states by index, inner arcs sorted by the state they lead to, and the ways through it."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.asarray(row[name], kind)
        self.states, self.lon, self.lat = get("states", np.int64), get("lon", float), get("lat", float)
        self.a, self.b, self.c = get("a", np.int64), get("b", np.int64), get("c", float)
        self.entries, self.outs, self.out_cost = get("entries", np.int64), get("outs", np.int64), get("out_cost", float)
        self.out_state, self.out_cell = get("out_state", np.int64), get("out_cell", np.int64)
        self.feet, self.geom, self.split = get("feet", float), get("geom", np.int64), get("split", bool)
        self._back: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._next: dict[int, list[int]] = {}
        self._ways: dict[tuple[int, int], list[int]] = {}

    def index(self, states: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.states, states)

    def _begun(self, starts: np.ndarray) -> np.ndarray:
        costs = np.full((len(starts), len(self.states)), np.inf)
        costs[np.arange(len(starts)), starts] = 0.0
        return costs

    def out_of(self, starts: np.ndarray) -> np.ndarray:
        """Costs inside the cell from each start to each arc that leaves it, without that arc."""
        return spread(self._begun(starts), self.a, self.b, self.c)[:, self.outs]

    def toward(self, ends: np.ndarray) -> None:
        """Makes what to() tells for several ends at once."""
        ends = np.setdiff1d(ends, list(self._back)).astype(int)
        if len(ends):
            by = np.argsort(self.a, kind="stable")
            turn = np.zeros((len(ends), len(self.states)), np.int32)
            costs = spread(self._begun(ends), self.b[by], self.a[by], self.c[by], turn)
            self._back |= {int(e): (costs[k], turn[k]) for k, e in enumerate(ends)}

    def to(self, end: int) -> np.ndarray:
        """Costs inside the cell from every state to ``end``."""
        self.toward(np.array([end]))
        return self._back[end][0]

    def _after(self, end: int) -> list[int]:
        """The state after each on its cheapest way to ``end``: of equals that whose cost was known first, so no way goes in rings."""
        if end not in self._next:
            left, (_, turn) = self.to(end), self._back[end]
            by = np.argsort(self.a, kind="stable")
            into = self.b[by]
            order = np.where(left[into] + self.c[by] == left[self.a[by]], turn[into].astype(np.int64) * len(by) + np.arange(len(by)), np.iinfo(np.int64).max)
            states, first = np.unique(self.a[by], return_index=True)
            after = np.full(len(self.states), -1)
            if len(by):
                after[states] = into[np.minimum.reduceat(order, first) % len(by)]
            self._next[end] = after.tolist()
        return self._next[end]

    def way(self, start: int, end: int) -> list[int]:
        """States (by index) after ``start`` up to ``end`` on the cheapest way inside the cell."""
        if (start, end) not in self._ways:
            after, at, out = self._after(end), start, []
            while at != end:
                at = after[at]
                out.append(at)
            self._ways[start, end] = out
        return self._ways[start, end]

    def path(self, start: int, end: int) -> list[int]:
        """The same by the states' ids."""
        return self.states[self.way(start, end)].tolist()


def unpacked(table: pa.Table, k: int = 0) -> Cell:
    """The k-th row as a cell."""
    return Cell({c: table[c][k].values.to_numpy(zero_copy_only=False) for c in _COLUMNS})


_COLUMNS = ("states", "lon", "lat", "feet", "geom", "split", "a", "b", "c", "entries", "outs", "out_cost", "out_state", "out_cell")
