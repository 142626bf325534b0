"""Variant spellings of the names of one entity (problem 4).

A field is cut into tokens at punctuation and at form characters. A form character
(of "company", "town", "Mr" and the like) is no part of a name; which ones they are
is learned from all rows: where one name of a row holds it, the other one mostly
lacks it. A token is a sequence of units, by their sound: Han characters, spelled
syllables, words.

The symmetric-delete index works on tokens: a name has a key for its tokens as they
are, and one for each unit left out of one token, so two names share a key if and only
if their tokens are one to one alike but for one slip in one token. Units within a
token, and tokens within a name, have no order. Those that share a key are candidates;
the optimal assignment of their tokens has to leave at most OTHER written characters
without partner. Candidates are drawn with the first name of a key; where one of them
fails, all names of the key meet again by their characters, with as many left out as
may differ: those that share such a part are alike by construction, so none is lost.

A single token does not tell an entity (two may share one of their names), so only
names of two or more tokens are indexed by themselves. The two fields of a row have to
speak of one entity: their tokens are aligned by optimal assignment that permits equal
sounds, slips, initials, abbreviations and nicknames. Where they do not align, or no
field has two tokens, the tokens of both fields together are the name of the row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameloom.functions.tokens import let
from nameloom.llm.components import component_ids
from nameloom.operators import scratch
from nameloom.operators.assign import solve
from nameloom.operators.skew import salted_join

#: A form character is absent from the other name in more than this share of its rows, and stands in at least so many.
ABSENT, FORM_ROWS = 2 / 3, 3
#: Share of the shorter name's units that have a partner in the other name of a row that speaks of one entity.
SHARED = 0.4
#: Written characters in which two names of one sound may differ.
OTHER = 2
#: Letters from which a word can hold a slip.
SLIP_LETTERS = 4
#: Between the units of a token and the tokens of a name, in text form.
UNIT, TOKEN = " ", "\x1e"
#: Keys are sums of hashes below this, so that a unit can be left out of a sum.
_RING = 1 << 61

_HAN = "㐀-鿿"
_CHARACTER = re.compile(f"[{_HAN}]")
_PIECE = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+")
_LATIN = rf"[^\W\d_{_HAN}]"
_JOINED = re.compile(rf"(?<={_LATIN})[-'’](?={_LATIN})")
_CAMEL = re.compile("(?<=[a-z0-9])(?=[A-Z][a-z])")
_BREAK = re.compile(r"[^\w\s]+|_")
_GAP = re.compile(rf"(?<=[{_HAN}])\s+(?=[{_HAN}])")


def _one_edit(a: str, b: str) -> bool:
    """Whether two words are at most one inserted, deleted or replaced letter apart."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) <= 1 and (a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


class Reader:
    """Reads typed fields. simple: character -> simplified one; sounds: character -> syllable without tone; form: the form characters."""

    def __init__(self, simple: dict[str, str], sounds: dict[str, str], form: str = "") -> None:
        self.simple, self.sounds = str.maketrans(simple), sounds
        self.syllables = set(sounds.values())
        self.longest = max(map(len, self.syllables), default=0)
        self.form = re.compile("[" + re.escape(form) + "]") if form else None

    def clean(self, text: str) -> str:
        """One width, script form and case; Latin words that are joined by hyphens or capitals set apart."""
        s = (text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).translate(self.simple)
        return _JOINED.sub(" ", s if s.isupper() else _CAMEL.sub(" ", s)).lower()

    def sound(self, unit: str) -> str:
        return self.sounds.get(unit, unit)

    def absences(self, a: str, b: str) -> list[tuple[str, bool]]:
        """The Han characters of two fields, each with whether the other field lacks its sound; none unless both have some."""
        x, y = set(_CHARACTER.findall(self.clean(a))), set(_CHARACTER.findall(self.clean(b)))
        if not x or not y:
            return []
        sx, sy = set(map(self.sound, x)), set(map(self.sound, y))
        return [(c, self.sound(c) not in sy) for c in x] + [(c, self.sound(c) not in sx) for c in y]

    def spell(self, word: str) -> list[str] | None:
        """A word as syllables (fewest pieces), or None if it is not made of them."""
        best: list[list[str] | None] = [[]] + [None] * len(word)
        for i in range(len(word)):
            if best[i] is not None:
                for k in range(1, min(self.longest, len(word) - i) + 1):
                    piece = word[i : i + k]
                    if piece in self.syllables and (best[i + k] is None or len(best[i + k]) > len(best[i]) + 1):
                        best[i + k] = best[i] + [piece]
        return best[-1] or None

    def tokens(self, text: str, gaps: bool = False) -> list[tuple[str, ...]]:
        """The tokens of a field as units as written. White space between Han characters divides tokens only with `gaps`."""
        return self._cut(self.clean(text), gaps)

    def _cut(self, s: str, gaps: bool) -> list[tuple[str, ...]]:
        if gaps:
            s = _GAP.sub(",", s)
        if self.form:
            s = self.form.sub(",", s)
        out = []
        for part in _BREAK.split(s):
            units = _PIECE.findall(part)
            if units and not _CHARACTER.search(part):
                spelled = [self.spell(u) for u in units]
                if 2 * sum(map(bool, spelled)) >= len(units):
                    units = [x for u, parts in zip(units, spelled) for x in parts or [u]]
            if units:
                out.append(tuple(units))
        return out

    def letters(self, token: tuple[str, ...]) -> tuple[str, ...]:
        """The units that a slip can be in: of words only, their letters; a short word is one unit."""
        if all(not _CHARACTER.match(u) and u not in self.syllables for u in token):
            every = "".join(token)
            return tuple(every) if len(every) >= SLIP_LETTERS else (every,)
        return token

    def names(self, a: str, b: str) -> tuple[bool, list[list[tuple[str, ...]]]]:
        """(both, names): the names that stand for a row, as tokens; both: they are of the two fields together."""
        a, b = self.clean(a), self.clean(b)
        ta, tb = self._cut(a, False), self._cut(b, False)
        if self.agree(ta, tb):
            gaps = [self._cut(x, True) if _GAP.search(x) else t for x, t in ((a, ta), (b, tb))]
            every = [[t for t in x if len(t) > 1 or len(t[0]) > 1] for x in (ta, tb, *gaps)]
            full = [x for x in every if len(x) > 1]
            if full:
                return False, full
        return True, [ta + [t for t in tb if t not in ta]]

    def matched(self, x: list[str], y: list[str]) -> int:
        """How many units of x have a partner in y: of equal sound, an initial, or a word with a slip; in any order, so abbreviations match whole. A doubled unit, as in nicknames, needs only one."""
        rest, n = list(y), 0
        once = len(set(x)) == 1
        for u in x:
            if u in rest:
                near = u
            elif u[0] > "\u02ff":
                continue  # a Han character without a reading
            else:
                near = next((r for r in rest if (len(u) == 1 and r.startswith(u)) or (len(u) >= SLIP_LETTERS and u not in self.syllables and _one_edit(u, r))), None)
            if near is not None:
                n += 1
                if not once:
                    rest.remove(near)
        return n

    def agree(self, a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> bool:
        """Whether two fields can name one entity: under the best assignment of their tokens enough units of the shorter one have a partner."""
        if not a or not b:
            return True
        if sum(map(len, a)) > sum(map(len, b)):
            a, b = b, a
        a, b = [list(map(self.sound, t)) for t in a], [list(map(self.sound, t)) for t in b]
        wanted = SHARED * sum(map(len, a))
        gain = [[self.matched(x, y) for y in b] for x in a]
        # any assignment gives at most as much as the best one, and the best one at most what each token gets alone
        taken, got = set(), 0
        for row in gain:
            j = max((j for j in range(len(b)) if j not in taken), key=row.__getitem__, default=None)
            if j is not None:
                got += row[j]
                taken.add(j)
        if got >= wanted or sum(map(max, gain)) < wanted:
            return got >= wanted
        cost = -np.array(gain, float)
        return -sum(cost[p] for p in solve(cost)) >= wanted


def alike(a: str, b: str) -> bool:
    """Whether two names (tokens and units in text form) differ in at most OTHER kinds of written units under the best assignment of their tokens."""
    p, q = a.split(TOKEN), b.split(TOKEN)
    if len(p) == len(q) == len(set(p)) == len(set(q)):
        s, t = set(p) - set(q), set(q) - set(p)
        if not s or len(s) == 1 < len(p):  # the other tokens are written alike
            s, t = set(UNIT.join(s).split(UNIT)), set(UNIT.join(t).split(UNIT))
            return max(len(s - t), len(t - s)) <= OTHER
    x, y = ([frozenset(t.split(UNIT)) for t in n] for n in (p, q))
    left, right = list((Counter(x) - Counter(y)).elements()), list((Counter(y) - Counter(x)).elements())
    if max(len(left), len(right)) > OTHER + 1:
        return False  # each of these costs one at least
    if not left or not right:
        return sum(map(len, left + right)) <= OTHER
    apart = np.array([[max(len(s - t), len(t - s)) for t in right] for s in left], float)
    pairs = solve(apart)
    alone = [s for i, s in enumerate(left) if i not in {p[0] for p in pairs}] + [t for j, t in enumerate(right) if j not in {p[1] for p in pairs}]
    return sum(apart[p] for p in pairs) + sum(map(len, alone)) <= OTHER and bool(frozenset().union(*x) & frozenset().union(*y))


def reader_tables(readings: DataFrame, variants: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """The tables of a Reader; of several readings the first counts, without its tone. One row a character, so Unicode bounds them."""
    v = variants.where("length(simplified) = 1 and length(traditional) = 1").groupBy("traditional").agg(F.min("simplified")).collect()
    r = readings.where("length(ch) = 1 and mandarin <> ''").groupBy("ch").agg(F.min("mandarin")).collect()
    sounds = {ch: re.split(r"\W", m.strip())[0].rstrip("012345").lower() for ch, m in map(tuple, r)}
    return dict(map(tuple, v)), {k: s for k, s in sounds.items() if s}


def form_characters(df: DataFrame, tables: tuple[dict[str, str], dict[str, str]]) -> str:
    """The form characters of all rows of df (name1, name2), sorted. One row a character reaches the driver."""

    def run(batches):
        reader, rows, missing = Reader(*tables), Counter(), Counter()
        for b in batches:
            for x, y in zip(b.name1, b.name2):
                for c, lacks in reader.absences(x, y):
                    rows[c] += 1
                    missing[c] += lacks
        yield pd.DataFrame([(c, rows[c], missing[c]) for c in rows], columns=["ch", "n", "absent"])

    every = df.select("name1", "name2").mapInPandas(run, "ch string, n bigint, absent bigint").groupBy("ch").agg(F.sum("n").alias("n"), F.sum("absent").alias("absent"))
    return "".join(sorted(r.ch for r in every.where((F.col("n") >= FORM_ROWS) & (F.col("absent") > ABSENT * F.col("n"))).select("ch").collect()))


def row_names(df: DataFrame, readings: DataFrame, variants: DataFrame) -> DataFrame:
    """(ord, both, name, said): the names that stand for each row of df (ord, name1, name2), in text form as written and by sound.

    Rows with a null ord, or a null or empty name, are left out; a name without
    any letter or digit stands as it is.
    """
    rows = df.where("ord is not null and name1 <> '' and name2 <> ''").select("ord", "name1", "name2")
    tables = reader_tables(readings, variants)
    form = form_characters(rows, tables)

    def run(batches):
        reader = Reader(*tables, form)
        for b in batches:
            out = []
            for o, x, y in zip(b.ord, b.name1, b.name2):
                both, names = reader.names(x, y)
                for n in (n for k, n in enumerate(names) if n not in names[:k]):
                    parts = sorted(reader.letters(t) for t in n) or [(x,), (y,)]
                    out.append((o, both, TOKEN.join(map(UNIT.join, parts)), TOKEN.join(UNIT.join(map(reader.sound, t)) for t in parts)))
            yield pd.DataFrame(list(dict.fromkeys(out)), columns=["ord", "both", "name", "said"])

    return rows.mapInPandas(run, "ord bigint, both boolean, name string, said string")


def _ring(x: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(x), 3)


def token_keys(said: Column) -> Column:
    """Hashes of a name's tokens as they are, and with each unit left out of one token of several; a token is the sum of its units' hashes, a name that of its tokens', so each key takes one step."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: F.pmod(s + x, F.lit(_RING)))
    tokens = F.transform(F.split(said, TOKEN), lambda t: F.transform(F.split(t, UNIT), _ring))
    less = lambda s, x: F.pmod(s - x, F.lit(_RING))

    def of(ts: Column, sums: Column, whole: Column) -> Column:
        without = lambda t, i: F.transform(F.array_distinct(t), lambda u: F.pmod(less(whole, _ring(F.get(sums, i))) + _ring(less(F.get(sums, i), u)), F.lit(_RING)))
        slips = F.transform(ts, lambda t, i: F.when(F.size(t) > 1, without(t, i)).otherwise(F.expr("cast(array() as array<bigint>)")))
        return F.array_distinct(F.concat(F.array(whole), F.flatten(slips)))

    return let(tokens, lambda ts: let(F.transform(ts, total), lambda sums: let(total(F.transform(sums, _ring)), lambda whole: of(ts, sums, whole))))


def _kinds(name: Column) -> Column:
    """Different written units of a name."""
    return F.array_distinct(F.split(name, f"[{UNIT}{TOKEN}]"))


def _subsets(c: Column, fewer: int) -> Column:
    """Hashes of a set and of every subset with up to `fewer` members less; the empty one is left out.

    Two sets share one of these if and only if each has at most `fewer` members that the
    other lacks, and one in common. A set's hash is the exclusive or of its members', so
    leaving a member out takes no look at the others.
    """

    def of(h):
        every = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)))
        for _ in range(fewer):
            every = let(every, lambda e: F.array_distinct(F.concat(e, F.flatten(F.transform(e, lambda s: F.transform(h, lambda x: s.bitwiseXOR(x)))))))
        return F.filter(every, lambda s: s != 0)

    return let(F.transform(c, lambda x: F.xxhash64(x)), of)


def name_links(known: DataFrame) -> DataFrame:
    """(a, b): links between alike names of `known` (id, both, name, said), enough to join every two that are alike."""
    near = scratch.write(known.select("id", F.explode(F.transform(token_keys(F.col("said")), lambda k: F.xxhash64("both", k))).alias("key")), "neighbourhoods")
    near, total = near.df, near.stats["rows"]
    several = near.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b <> top").select("key", "b")
    tried = scratch.write(salted_join(near, several, "key", total, F.col("id")).where("id <> b").select("key", F.col("id").alias("a"), "b"), "candidates").df
    text = known.select(F.col("id").alias("a"), F.col("name").alias("na"))
    pairs = tried.select("a", "b").distinct().join(text.hint("merge"), "a")
    pairs = salted_join(pairs, text.toDF("b", "nb"), "b", total, F.col("a"))
    check = F.pandas_udf(lambda x, y: pd.Series([alike(p, q) for p, q in zip(x, y)], dtype=bool), "boolean")
    judged = scratch.write(pairs.select("a", "b", check("na", "nb").alias("same")), "judged", failed=~F.col("same"))
    linked = judged.df.where("same").select("a", "b")
    if not judged.stats["failed"]:
        return linked
    failed = judged.df.where("not same").select("a", "b")
    # one member that is not like the first leaves open who is like whom: all members of such a key meet by their characters
    open_keys = tried.join(failed.hint("merge"), ["a", "b"], "left_semi").select("key").distinct()
    rest = salted_join(near, open_keys, "key", total, F.col("id"), "left_semi").join(known.select("id", "name").hint("merge"), "id")
    part = rest.select("id", F.explode(_subsets(_kinds(F.col("name")), OTHER)).alias("part"), "key")
    part = scratch.write(part.select("id", F.xxhash64("key", "part").alias("key")), "parts")
    first = part.df.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b <> top").select("key", "b")
    met = salted_join(part.df, first, "key", part.stats["rows"], F.col("id")).where("id <> b").select(F.col("id").alias("a"), "b")
    return linked.union(met).distinct()


def link_rows(df: DataFrame, readings: DataFrame, variants: DataFrame) -> DataFrame:
    """(ord, entity): the entity number of every row that has one; rows of one entity share it.

    Rows with a null or empty name have none. Repeated rows, and rows that share an
    ord, are rows of one entity. An empty table gives no rows.
    """
    lists = scratch.write(row_names(df, readings, variants), "row-names")
    lists, total = lists.df, lists.stats["rows"]
    known = scratch.write(lists.select("both", "name", "said").distinct().withColumn("id", F.monotonically_increasing_id()), "names").df
    hung = salted_join(lists.select("ord", F.xxhash64("both", "name").alias("key"), "both", "name"), known.select(F.xxhash64("both", "name").alias("key"), F.col("both").alias("_b"), F.col("name").alias("_n"), "id"), "key", total, F.col("ord"))
    hung = scratch.write(hung.where("both = _b and name = _n").select("ord", "id"), "row-ids").df
    # a row with several names joins them
    first = scratch.write(hung.groupBy("ord").agg(F.min("id").alias("a"), F.collect_set("id").alias("every")), "row-first").df
    joined = first.select("a", F.explode("every").alias("b")).where("a <> b").distinct()
    roots = component_ids(name_links(known).union(joined))
    # a name that is linked to no other stands for itself
    return salted_join(first.select("ord", F.col("a").alias("id")), roots, "id", total, F.col("ord"), "left").select("ord", F.coalesce("root", "id").alias("entity"))


def variant_groups(df: DataFrame, readings: DataFrame, variants: DataFrame) -> DataFrame:
    """(ord, entity, links): every row with the smallest ord of its entity and the number of other rows there."""
    with scratch.scope():
        e = scratch.write(link_rows(df, readings, variants), "entities").keep()
    size = e.df.groupBy("entity").agg(F.min("ord").alias("first"), (F.count(F.lit(1)) - 1).alias("links"))
    return salted_join(e.df, size, "entity", e.stats["rows"], F.col("ord")).select("ord", F.col("first").alias("entity"), "links")


def variant_pairs(df: DataFrame, readings: DataFrame, variants: DataFrame) -> DataFrame:
    """(ord_a, ord_b), ord_a < ord_b: every pair of rows of one entity. `variant_groups` gives the same as one row for each row."""
    with scratch.scope():
        e = scratch.write(link_rows(df, readings, variants), "entities").keep()
    total = e.stats["rows"]
    several = e.df.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity")
    live = scratch.write(salted_join(e.df, several, "entity", total, F.col("ord"), "left_semi"), "live").df
    a, b = live.select(F.col("ord").alias("ord_a"), "entity"), live.select(F.col("ord").alias("ord_b"), "entity")
    return salted_join(a, b, "entity", total, F.col("ord_a")).where("ord_a < ord_b").select("ord_a", "ord_b")
