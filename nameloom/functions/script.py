"""Script conversion and transliteration by dictionaries.

Dictionaries are tables; one of at most `TABLE_LIMIT` rows becomes a literal or a
broadcast. Single characters go through `translate`, phrases through an
Arrow-batched function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows a dictionary may have.
TABLE_LIMIT = 200_000


def dictionary(table: DataFrame, key: str, value: str, order: str | None = None) -> dict[str, str]:
    """A table as a dict; null or empty keys are left out, null values are empty. Of repeated keys the last by `order` wins, else the largest value."""
    rows = table.where(F.col(key) != "").groupBy(key).agg(F.max_by(F.coalesce(F.col(value), F.lit("")), F.col(order or value)).alias("v")).limit(TABLE_LIMIT + 1).collect()
    if len(rows) > TABLE_LIMIT:
        raise ValueError(f"the dictionary has more than {TABLE_LIMIT} rows")
    return {r[0]: r[1] or "" for r in rows}


def convert_chars(text: Column, mapping: dict[str, str]) -> Column:
    """Characters replaced by one character each; entries of other lengths are not used here."""
    pairs = sorted((k, v) for k, v in mapping.items() if len(k) == 1 and len(v) == 1)
    return F.translate(text, "".join(k for k, _ in pairs), "".join(v for _, v in pairs)) if pairs else text


def segment(text: str, mapping: dict[str, str], longest: int) -> str:
    """The conversion with fewest segments.

    Of two segmentations with as many segments the one wins whose last branch was
    opened earlier: a longer phrase is a branch that opens at the phrase's first
    character, and again at each shorter phrase it passes.
    """
    n = len(text)
    # best[i]: (segments, branch, output) of the best conversion of the first i characters
    best: list[tuple[int, tuple, str] | None] = [(0, (-1, ()), "")] + [None] * n
    for i in range(n):
        count, branch, out = best[i]
        opened = branch
        for k in range(1, min(longest, n - i) + 1):
            piece = text[i : i + k]
            if k == 1:
                new = (count + 1, branch, out + mapping.get(piece, piece))
                opened = (i, branch)
            elif piece in mapping:
                new = (count + 1, opened, out + mapping[piece])
                opened = (i + k - 1, opened)
            else:
                continue
            if best[i + k] is None or new[:2] < best[i + k][:2]:
                best[i + k] = new
    return best[n][2]


def convert_phrases(text: Column, mapping: dict[str, str]) -> Column:
    """Texts converted with fewest segments; unknown characters pass through; null stays null."""
    longest = max(map(len, mapping), default=1)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else segment(x, mapping, longest))

    return F.pandas_udf(run, T.StringType())(text)


def convert(text: Column, mapping: dict[str, str]) -> Column:
    """Script conversion: by characters alone if the dictionary has no phrase, else with phrases."""
    phrases = any(len(k) != 1 or len(v) != 1 for k, v in mapping.items())
    return convert_phrases(text, mapping) if phrases else convert_chars(text, mapping)


def transliterate(text: Column, mapping: dict[str, str]) -> Column:
    """Greedy longest match from the left, without separators; unknown characters pass through; null stays null."""
    longest = max(map(len, mapping), default=1)

    def one(x: str) -> str:
        out, i = [], 0
        while i < len(x):
            k = next((k for k in range(min(longest, len(x) - i), 0, -1) if x[i : i + k] in mapping), 0)
            out.append(mapping[x[i : i + k]] if k else x[i])
            i += k or 1
        return "".join(out)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else one(x))

    return F.pandas_udf(run, T.StringType())(text)
