"""Characters, n-grams and token codes as column expressions.

A token sequence is ARRAY<STRING>; null in gives null out, an empty sequence has no grams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters for the first token codes; further ones are spelled out.
_ALPHABET = "".join(map(chr, range(0xE000, 0xE400)))
#: Orders of n-grams in use.
ORDERS = (1, 2, 3)


def chars(text: Column) -> Column:
    """Code points of a text; an empty text has none."""
    return F.when(F.length(text) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(text, ""))


def grams(tokens: Column, n: int) -> Column:
    """All n-grams in order, tokens joined by a space; repeated ones stay."""
    some = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, some).when(tokens.isNotNull(), F.expr("cast(array() as array<string>)"))


def gram_set(tokens: Column, n: int) -> Column:
    return F.array_distinct(grams(tokens, n))


def gram_union(tokens: Column, orders: tuple[int, ...] = ORDERS) -> Column:
    """Different grams of all orders."""
    return F.array_distinct(F.concat(*(grams(tokens, n) for n in orders)))


def gram_list(tokens: Column, orders: tuple[int, ...] = ORDERS) -> Column:
    """Grams of all orders with repeats: the gram bag as a list."""
    return F.concat(*(grams(tokens, n) for n in orders))


def gram_bag(tokens: Column, orders: tuple[int, ...] = ORDERS) -> Column:
    """MAP gram -> number of occurrences."""
    count = lambda every, g: F.size(F.filter(every, lambda x: x == g)).cast("bigint")
    return let(gram_list(tokens, orders), lambda every: F.map_from_arrays(F.array_distinct(every), F.transform(F.array_distinct(every), lambda g: count(every, g))))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def codes(tokens: Column, seen: Column) -> Column:
    """A token sequence as a text with one character a token, by the token's place in `seen`, so that text functions count tokens."""
    one = lambda n: F.when(n <= len(_ALPHABET), F.substring(F.lit(_ALPHABET), n, F.lit(1))).otherwise(_private(n))
    return F.array_join(F.transform(tokens, lambda x: let(F.array_position(seen, x).cast("int"), one)), "")


def _private(n: Column) -> Column:
    """Character U+F0000 + n."""
    point = F.lit(0xF0000) + n
    byte = lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")
    # spelled by its UTF-8 bytes
    raw = F.concat(
        byte(F.lit(0xF0) + F.shiftright(point, 18)),
        byte(F.lit(0x80) + F.shiftright(point, 12).bitwiseAND(F.lit(0x3F))),
        byte(F.lit(0x80) + F.shiftright(point, 6).bitwiseAND(F.lit(0x3F))),
        byte(F.lit(0x80) + point.bitwiseAND(F.lit(0x3F))),
    )
    return F.decode(F.unhex(raw), "UTF-8")
