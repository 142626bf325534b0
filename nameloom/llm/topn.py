"""The N best rows of every group by a secondary sort (problem 6).

Rows are sorted by group, score and identifier, and Arrow batches stream through
a counter that passes the first N rows of each run of equal groups; no group is
ever held. It runs twice: within each input partition before the shuffle, so that
a group of any size sends at most N rows a partition, and again after rows were
hash-partitioned by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits with an optional sign, point and exponent, as plain number text.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPACES = r"^[\p{IsWhite_Space}\x1c-\x1f]+|[\p{IsWhite_Space}\x1c-\x1f]+$"


def number(text: Column) -> Column:
    """The finite number that a text holds without surrounding spaces, else null."""
    bare = F.regexp_replace(text, _SPACES, "")
    value = F.when(bare.rlike(_NUMBER), bare.try_cast("double"))
    return F.when((value < float("inf")) & (value > float("-inf")), value)


def _first_of_runs(n: int, key: str):
    """Passes the first n rows of each run of equal keys; between batches only the last key and its count are kept."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            if rows > 1:
                new = np.concatenate([[True], np.asarray(pc.not_equal(keys.slice(1), keys.slice(0, rows - 1)))])
            else:
                new = np.array([True])
            start = np.maximum.accumulate(np.where(new, np.arange(rows), 0))
            place = np.arange(rows) - start
            if last is not None and keys[0].as_py() == last:
                place = np.where(start == 0, place + seen, place)
            last, seen = keys[rows - 1].as_py(), int(place[-1]) + 1
            keep = place < n
            if keep.any():
                yield batch.filter(pa.array(keep))

    return stream


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """The n rows of each group with the highest score; of equal scores the smaller ident goes first.

    Rows with a null group or score are left out; a null ident goes last. Rows
    that repeat count each. The columns of df are kept as they are.
    """
    if n < 1:
        return df.limit(0)
    order = [F.col(group), F.col(score).desc(), F.col(ident).asc_nulls_last()]
    live = df.where(F.col(group).isNotNull() & F.col(score).isNotNull())
    pick = lambda x: x.mapInArrow(_first_of_runs(n, group), x.schema)
    local = pick(live.sortWithinPartitions(*order))
    return pick(local.repartition(F.col(group)).sortWithinPartitions(*order))
