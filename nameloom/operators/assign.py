"""Optimal one-to-one assignment, the only step of alignment that no built-in can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nameloom.functions.similarity import levenshtein_similarity

_PAIRS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


def solve(cost: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of a rectangular matrix with the smallest total, by rows; as many as the shorter side.

    Rows are added one by one along a shortest augmenting path over reduced costs.
    Of equal totals the columns with smaller numbers are tried first.
    """
    if not cost.size:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # row that a column belongs to; column m stands for the row being added
    for new in range(n):
        owner[m], at = new, m
        reach, came = np.full(m, np.inf), np.full(m, m)
        done = np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            r = owner[at]
            step = c[r] - row_price[r] - col_price[:m]
            better = ~done[:m] & (step < reach)
            reach[better], came[better] = step[better], at
            nearest = int(np.argmin(np.where(done[:m], np.inf, reach)))
            move = reach[nearest]
            used = np.flatnonzero(done)
            row_price[owner[used]] += move
            col_price[used] -= move
            reach[~done[:m]] -= move
            at = nearest
        while at != m:
            owner[at], at = owner[came[at]], came[at]
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((j, i) for i, j in pairs) if turned else sorted(pairs)


def solve_all(cost: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each matrix of cost (matrix, row, column) the row that each column belongs to, or -1: what solve gives, by the same steps for many matrices at once.

    rows: how many rows each matrix has, at most as many as it has columns; cells beyond a matrix are infinite.
    """
    count, n, m = cost.shape
    flat = cost.reshape(-1, m)
    row_price, col_price = np.zeros((count, n)), np.zeros((count, m))
    owner = np.full((count, m + 1), -1, np.int32)
    for new in range(int(rows.max(initial=0))):
        act = np.flatnonzero(rows > new)
        owner[act, m] = new
        ends, came = np.full(count, m), np.empty((count, m), np.int16 if m < 32_000 else np.int32)
        # c: the matrices whose path goes on, and some that have ended, until the arrays are made smaller; their tree by columns, rows and prices
        c, going, at = act, np.ones(len(act), bool), np.full(len(act), m)
        reach, w = np.full((len(c), m), np.inf), np.full((len(c), m), m, came.dtype)
        free = col_price[c]  # of columns in the tree -inf, so that no step to them is better
        cols, tree = np.empty((len(c), new + 1), np.int32), np.empty((len(c), new + 1), np.int32)
        down, up = np.empty((len(c), new + 1)), np.empty((len(c), new + 1))
        for k in range(new + 1):
            line = np.arange(len(c))
            r = owner[c, at]
            cols[:, k], tree[:, k], up[:, k] = at, r, row_price[c, r]
            if k:  # the first column stands for the row being added
                down[:, k] = free[line, at]
                free[line, at], reach[line, at] = -np.inf, np.inf
            step = flat[c * n + r]
            step -= up[:, k, None]
            step -= free
            better = step < reach
            np.minimum(reach, step, out=reach)
            w += (at[:, None].astype(w.dtype) - w) * better
            at = reach.argmin(1)
            move = reach[line, at][:, None]
            up[:, : k + 1] += move
            down[:, 1 : k + 1] -= move
            reach -= move
            stop = going & (owner[c, at] < 0)
            if stop.any():
                s, which = np.flatnonzero(stop), c[stop]
                row_price[which[:, None], tree[s, : k + 1]] = up[s, : k + 1]
                col_price[which[:, None], cols[s, 1 : k + 1]] = down[s, 1 : k + 1]
                came[which], ends[which] = w[s], at[s]
                going &= ~stop
                left = int(going.sum())
                if not left:
                    break
                if left < 0.75 * len(c):
                    c, at, reach, w, free, cols, tree, down, up = (z[going] for z in (c, at, reach, w, free, cols, tree, down, up))
                    going = np.ones(left, bool)
        back, at = act, ends[act]
        while len(back):
            before = came[back, at]
            owner[back, at] = owner[back, before]
            back, at = back[before < m], before[before < m]
    return owner[:, :m]


def _assign(cost: pd.Series) -> pd.Series:

    def one(m) -> list[tuple[int, int]] | None:
        if m is None:
            return None
        if len(m) == 0 or len(m[0]) == 0:
            return []
        return solve(np.array([np.asarray(r, float) for r in m]))

    return cost.map(one)


def assignment(cost: Column) -> Column:
    """ARRAY<ARRAY<DOUBLE>> -> [(i, j)] 0-based; null gives null, an empty matrix none. Rows must have one length.

    Marked as not deterministic so that no plan merges it into expressions that would run it again.
    """
    return F.pandas_udf(_assign, _PAIRS).asNondeterministic()(cost)


def cost_matrix(a: Column, b: Column, similarity: Callable[[Column, Column], Column] = levenshtein_similarity) -> Column:
    """1 - similarity of each member of a with each of b."""
    return F.transform(a, lambda x: F.transform(b, lambda y: F.lit(1.0) - similarity(x, y)))


def to_cost(profit: Column) -> Column:
    """A matrix of profits as costs: the largest profit less each."""
    top = F.array_max(F.flatten(profit))
    return F.transform(profit, lambda r: F.transform(r, lambda x: top - x))


def total_cost(cost: Column, pairs: Column) -> Column:
    """The total of the assigned cells."""
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(F.get(cost, p["i"]), p["j"]).cast("double"))
