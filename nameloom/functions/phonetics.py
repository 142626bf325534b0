"""Readings, syllables and phonemes as column expressions.

A `Lexicon` holds the readings of single characters. In an expression it is one
text of all characters and one array of what belongs to them, so that a lookup is
a search in a short text and an array access, with no join and no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameloom.functions import tokens as tk

# Onsets of two letters.
ONSETS = {"mandarin": ("zh", "ch", "sh"), "cantonese": ("gw", "ct", "ng", "kw")}
VOWELS = "aeiouvy"
#: Most characters of a lexicon in an expression.
LEXICON_LIMIT = 60_000


class Lexicon:
    """Syllables without tone of single characters, by language; an empty Cantonese reading falls back to Mandarin."""

    def __init__(self, rows: list[tuple[str, str | None, str | None]]) -> None:
        table = {ch: (m or "", c or "") for ch, m, c in rows if ch and len(ch) == 1}
        if len(table) > LEXICON_LIMIT:
            raise ValueError(f"a lexicon may have {LEXICON_LIMIT} characters")
        self.chars = "".join(sorted(table))
        self.readings = {"mandarin": [table[c][0] for c in self.chars], "cantonese": [table[c][1] or table[c][0] for c in self.chars]}

    @staticmethod
    def of(readings: DataFrame) -> Lexicon:
        """From (ch, mandarin, cantonese); of a repeated character the largest readings count."""
        rows = readings.where("ch <> ''").groupBy("ch").agg(F.max("mandarin"), F.max("cantonese")).limit(LEXICON_LIMIT + 1).collect()
        return Lexicon([tuple(r) for r in rows])

    @staticmethod
    def first(reading: str) -> str:
        """The first of several readings, with its tone."""
        return next(iter(re.split(r"[^A-Za-z0-9_]", reading)), "")

    def syllable_table(self, language: str) -> list[str]:
        return [self.first(r)[:-1] for r in self.readings[language]]


def _lookup(lexicon: Lexicon, values: list[str], ch: Column) -> Column:
    if not lexicon.chars:
        return F.lit(None).cast("string")
    # one literal that the optimizer folds to an array, not one expression a character
    table = F.split(F.lit("|".join(v.replace("|", "") for v in values)), r"\|")
    return F.get(table, F.position(ch, F.lit(lexicon.chars)) - 1)


def pronounce(text: Column, lexicon: Lexicon, language: str = "mandarin") -> Column:
    """First reading of each known character, joined, without digits; unknown characters are dropped."""
    values = [r.split(",")[0] for r in lexicon.readings[language]]
    found = F.array_compact(F.transform(tk.chars(text), lambda c: _lookup(lexicon, values, c)))
    return F.regexp_replace(F.array_join(found, ""), "[0-9]", "")


def syllables(text: Column, lexicon: Lexicon, language: str = "mandarin") -> Column:
    """Syllables of the known characters in order, without tone; a character without any reading has none."""
    values = lexicon.syllable_table(language)
    return F.filter(F.transform(tk.chars(text), lambda c: _lookup(lexicon, values, c)), lambda x: x.isNotNull() & (x != ""))


def split_syllable(syllable: Column, language: str = "mandarin") -> Column:
    """Onset and rest: the first two letters if they are an onset, else the first letter; an empty rest is left out."""
    two = F.substring(syllable, 1, 2).isin(*ONSETS[language])
    cut = F.when(two, 2).otherwise(1)
    parts = F.array(F.substring(syllable, F.lit(1), cut), F.substring(syllable, cut + 1, F.length(syllable)))
    return F.filter(parts, lambda x: x != "")


def phonemes(text: Column, lexicon: Lexicon, language: str = "mandarin") -> Column:
    """Onsets and rests of all syllables in order."""
    return F.flatten(F.transform(syllables(text, lexicon, language), lambda s: split_syllable(s, language)))


def onset(reading: Column) -> Column:
    """Leading consonants of a reading: two letters if the second is no vowel letter, else one; null for an empty reading."""
    second = F.substring(reading, 2, 1)
    return F.when(F.length(reading) > 0, F.when((second != "") & ~second.isin(*VOWELS), F.substring(reading, 1, 2)).otherwise(F.substring(reading, 1, 1)))


def onset_inventory(readings: DataFrame, column: str = "cantonese") -> DataFrame:
    """(onset): the different onsets of a column of readings."""
    return readings.select(onset(F.col(column)).alias("onset")).where("onset is not null").distinct()
