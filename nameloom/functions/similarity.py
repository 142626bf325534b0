"""String and token similarities as column expressions; Python only where no built-in can say it.

Each takes two columns and gives a double in [0, 1] (the long-text adjustment and
the square-root overlap of `features` aside); null in gives null out.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nameloom.functions import tokens as tk

# The boost of a common prefix, from this weight on, up to this length.
BOOST, BOOST_FROM, BOOST_LENGTH = 0.1, 0.7, 4


def _one_minus(d: Column, n: Column) -> Column:
    # kept as 1 - d/n: the form (n-d)/n rounds differently and moves values over bin edges
    return F.lit(1.0) - d.cast("double") / n.cast("double")


def _edit_similarity(distance: Column, na: Column, nb: Column, equal: Column) -> Column:
    """1 for equal inputs; against an empty one of n symbols 1 - n/(n+1); else 1 - d/max."""
    return (
        F.when(equal, F.lit(1.0))
        .when(na == 0, _one_minus(nb, nb + 1))
        .when(nb == 0, _one_minus(na, na + 1))
        .otherwise(_one_minus(distance, F.greatest(na, nb)))
    )


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """Of two texts, by code points."""
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, _edit_similarity(F.levenshtein(a, b), F.length(a), F.length(b), a == b))


def token_levenshtein_similarity(a: Column, b: Column) -> Column:
    """Of two token sequences: every token counts as one symbol."""

    def of(x: Column, y: Column) -> Column:
        edits = tk.let(F.array_distinct(F.concat(x, y)), lambda seen: F.levenshtein(tk.codes(x, seen), tk.codes(y, seen)))
        return _edit_similarity(edits, F.size(x), F.size(y), x == y)

    return F.when(a.isNotNull() & b.isNotNull(), _both(a, b, of))


def _both(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(a, b) with both computed once."""
    return tk.let(a, lambda x: tk.let(b, lambda y: f(x, y)))


@F.pandas_udf(T.IntegerType())
def damerau_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between two texts where swapping neighbours is one edit and no part is edited twice; null with a null text."""

    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        rows = [list(range(len(y) + 1))]
        for i, p in enumerate(x, 1):
            row = [i]
            for j, q in enumerate(y, 1):
                best = min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (p != q))
                if i > 1 and j > 1 and p == y[j - 2] and x[i - 2] == q:
                    best = min(best, rows[-2][j - 2] + 1)
                row.append(best)
            rows = [*rows[-1:], row]
        return rows[-1][-1]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int32")


def damerau_similarity(a: Column, b: Column) -> Column:
    """Levenshtein similarity that counts a swap of neighbours as one edit."""
    return F.when(a.isNotNull() & b.isNotNull(), _edit_similarity(damerau_distance(a, b), F.length(a), F.length(b), a == b))


def jaro_winkler(a: Column, b: Column, long_tolerance: bool = False, winklerize: bool = True) -> Column:
    """Of two token sequences (ARRAY<STRING>; for texts see text_jaro_winkler).

    The window is half the *shorter* length, rounded down, less one, at least
    zero. Tokens match greedily from the left. The prefix boost applies above
    BOOST_FROM only. An empty side gives 0.
    """
    weight = _both(a, b, lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(_winkler(x, y, long_tolerance, winklerize)))
    return F.when(a.isNotNull() & b.isNotNull(), weight)


def _winkler(a: Column, b: Column, long_tolerance: bool, winklerize: bool) -> Column:
    na, nb = F.size(a), F.size(b)
    short = F.least(na, nb)
    reach = F.greatest(F.floor(short / 2) - 1, F.lit(0)).cast("int")
    # partner[i]: position in b matched by a[i], or -1; each takes the first free equal one in reach
    free = lambda used, i: F.filter(
        F.sequence(F.greatest(i - reach, F.lit(0)), F.least(i + reach, nb - 1)),
        lambda j: (F.get(b, j) == F.get(a, i)) & ~F.array_contains(used, j),
    )
    step = lambda used, i: F.concat(used, F.array(F.when(i - reach > nb - 1, F.lit(-1)).otherwise(F.coalesce(F.get(free(used, i), F.lit(0)), F.lit(-1)))))
    partner = F.aggregate(F.sequence(F.lit(0), na - 1), F.expr("cast(array() as array<int>)"), step)

    def weigh(p: Column) -> Column:
        hits = F.filter(p, lambda j: j >= 0)
        m = F.size(hits).cast("double")
        mine = F.filter(F.transform(p, lambda j, i: F.when(j >= 0, i).otherwise(F.lit(-1))), lambda i: i >= 0)
        off = F.zip_with(mine, F.array_sort(hits), lambda i, j: F.when(F.get(a, i) == F.get(b, j), 0).otherwise(1))
        swaps = F.floor(F.aggregate(off, F.lit(0), lambda s, x: s + x) / 2)
        return F.when(m > 0, (m / na + m / nb + (m - swaps) / m) / F.lit(3.0)).otherwise(F.lit(0.0))

    weight = tk.let(partner, weigh)
    if winklerize:
        same = F.filter(F.sequence(F.lit(1), F.least(short, F.lit(BOOST_LENGTH))), lambda k: F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k))
        prefix = F.size(same)

        def boost(w: Column) -> Column:
            up = w + prefix * F.lit(BOOST) * (F.lit(1.0) - w)
            if long_tolerance:
                m = tk.let(partner, lambda p: F.size(F.filter(p, lambda j: j >= 0)))
                far = (short > 4) & (m > prefix + 1) & (2 * m >= short + prefix)
                up = F.when(far, up + (F.lit(1.0) - up) * ((m - prefix - 1) / (na + nb - prefix * 2 + 2).cast("double"))).otherwise(up)
            return F.when(w > BOOST_FROM, up).otherwise(w)

        weight = tk.let(weight, boost)
    return weight


def text_jaro_winkler(a: Column, b: Column, long_tolerance: bool = False, winklerize: bool = True) -> Column:
    return jaro_winkler(tk.chars(a), tk.chars(b), long_tolerance, winklerize)


def longest_common_run(a: Column, b: Column) -> Column:
    """Length of the longest common run of two texts over the longer length; two empty texts give 0.

    The longest run is found by keeping, for each position of a, how long the run
    ending there is at each position of b.
    """
    run = _both(tk.chars(a), tk.chars(b), _longest_run)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).when(a.isNotNull() & b.isNotNull(), run / F.greatest(F.length(a), F.length(b)).cast("double"))


def _longest_run(x: Column, y: Column) -> Column:
    nb = F.size(y)
    zero = F.transform(y, lambda _: F.lit(0))
    # state: run lengths of the row before, then the best so far
    row = lambda s, c: F.transform(F.sequence(F.lit(0), nb - 1), lambda j: F.when(F.get(y, j) == c, F.when(j == 0, F.lit(0)).otherwise(F.get(s, j - 1)) + 1).otherwise(F.lit(0)))
    step = lambda s, c: tk.let(row(s, c), lambda r: F.concat(r, F.array(F.greatest(F.element_at(s, -1), F.array_max(r)))))
    return F.element_at(F.aggregate(x, F.concat(zero, F.array(F.lit(0))), step), -1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if both are empty."""
    share = lambda x, y: F.when(F.size(x) + F.size(y) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double")).otherwise(F.lit(0.0))
    return _both(a, b, share)


#: Similarities of texts by name.
BY_NAME: dict[str, Callable[[Column, Column], Column]] = {"levenshtein": levenshtein_similarity, "jarowinkler": text_jaro_winkler}
#: The same of token sequences.
TOKENS_BY_NAME: dict[str, Callable[[Column, Column], Column]] = {"levenshtein": token_levenshtein_similarity, "jarowinkler": jaro_winkler}
