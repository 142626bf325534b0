"""Ordered rule lists by incremental reduced-error pruning.

Rules for the positive class are grown one condition at a time by information
gain on two thirds of the examples left, then cut back from the end where that
does better on the other third; what a rule covers is taken out and the next rule
is grown, until a rule errs on more than half of the pruning examples it covers.
The learned thresholds leave as a SQL CASE expression that Spark evaluates itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Most labelled rows a fit takes.
MAX_LABELLED = 20_000
#: Thresholds tried for each feature in a step.
CUTS = 48


@dataclass(frozen=True)
class Condition:
    feature: str
    at_most: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] <= self.value if self.at_most else x[self.feature] > self.value

    def sql(self) -> str:
        return f"{self.feature} {'<=' if self.at_most else '>'} {self.value!r}D"


@dataclass(frozen=True)
class RuleList:
    rules: tuple[tuple[Condition, ...], ...]

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), bool)
        for r in self.rules:
            out |= np.logical_and.reduce([c.holds(x) for c in r])
        return out

    def sql(self) -> str:
        """CASE expression, true for the positive class; the first rule that holds decides."""
        if not self.rules:
            return "false"
        return "CASE " + " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN true" for r in self.rules) + " ELSE false END"


def _take(x: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[rows] for k, v in x.items()}


def _best(x: dict[str, np.ndarray], y: np.ndarray) -> Condition | None:
    """The condition with the highest information gain for the positives."""
    p, n = y.sum(), (~y).sum()
    base = np.log2(p / (p + n))
    top, best = 1e-9, None
    for name in x:
        v = x[name]
        ends = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)))
        for cut in (ends[1:] + ends[:-1]) / 2:
            low = v <= cut
            for at_most, inside in ((True, low), (False, ~low)):
                a = (inside & y).sum()
                if a:
                    gain = a * (np.log2(a / inside.sum()) - base)
                    if gain > top:
                        top, best = gain, Condition(name, at_most, float(round(cut, 4)))
    return best


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    while y.any() and not y.all() and len(rule) < 8:
        c = _best(x, y)
        if c is None:
            break
        inside = c.holds(x)
        if inside.all():
            break
        rule.append(c)
        x, y = _take(x, inside), y[inside]
    return rule


def _worth(rule: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> float:
    inside = np.logical_and.reduce([c.holds(x) for c in rule])
    p, n = (inside & y).sum(), (inside & ~y).sum()
    return (p - n) / (p + n) if p + n else -1.0


def irep(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 1) -> RuleList:
    """A rule list for y from features x; deterministic for a seed. Without positives it has no rules."""
    if len(y) > MAX_LABELLED:
        raise ValueError(f"{len(y)} labelled rows; a fit takes at most {MAX_LABELLED}")
    rng = np.random.default_rng(seed)
    rules: list[tuple[Condition, ...]] = []
    while y.any():
        part = rng.random(len(y)) < 2 / 3
        grow, prune = np.flatnonzero(part), np.flatnonzero(~part)
        rule = _grow(_take(x, grow), y[grow])
        if not rule or not len(prune):
            break
        px, py = _take(x, prune), y[prune]
        cuts = [(_worth(rule[:k], px, py), -k) for k in range(1, len(rule) + 1)]
        worth, k = max(cuts)
        rule = rule[:-k]
        if worth <= 0:
            break
        rules.append(tuple(rule))
        left = ~np.logical_and.reduce([c.holds(x) for c in rule])
        x, y = _take(x, left), y[left]
    return RuleList(tuple(rules))
