"""One form for text that looks the same (problem 5).

`compose` brings a text to compatibility form (width, ligatures, composed accents,
one kind of space and middle dot) and drops characters that show nothing. What is
left are letters of another script drawn alike. The repair is script-aware: a
token's dominant script is found, and its look-alikes of other scripts are
substituted only if the result stands in the vocabulary of the corpus. A token
wholly of look-alikes is tried in each other script too, as it has no native
letter that speaks for its own.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nameloom.operators import scratch
from nameloom.operators.skew import salted_join

# Middle dots of other blocks drawn like U+00B7.
DOTS = "\u2027\u2219\u22c5\u30fb\uff65\u16eb\u2e31\ua78f\u2e33\U00010101"
# Characters that show nothing beyond the categories Cf and Cc.
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\u180b\u180c\u180d\u180f\u2800"


# Letters of Greek and Cyrillic drawn like the Latin letter below them.
_GREEK = "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖον"
_GREEK_AS = "ABEHIKMNOPTXYZov"
_CYRILLIC = "АВСЕНІЈКМОРЅТХУасеіјорѕхуһԁԛԝӀѴѵԌҮү"
_CYRILLIC_AS = "ABCEHIJKMOPSTXYaceijopsxyhdqwIVvGYy"
#: Letter of another script -> Latin letter drawn alike.
LOOK_ALIKES = dict(zip(_GREEK, _GREEK_AS)) | dict(zip(_CYRILLIC, _CYRILLIC_AS))
#: The way back, by script; of several letters the first, which is the common one.
FROM_LATIN = {"GREEK": dict(zip(_GREEK_AS, _GREEK)), "CYRILLIC": dict(zip(reversed(_CYRILLIC_AS), reversed(_CYRILLIC)))}
_SHARED = set(_GREEK_AS) | set(_CYRILLIC_AS)


def script(ch: str) -> str:
    """LATIN, GREEK, CYRILLIC, HAN, OTHER for a letter; empty for anything else."""
    if not ch.isalpha():
        return ""
    n = ord(ch)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "LATIN"
    if 0x370 <= n < 0x400 or 0x1F00 <= n < 0x2000:
        return "GREEK"
    if 0x400 <= n < 0x530:
        return "CYRILLIC"
    if 0x3400 <= n < 0xA000 or n >= 0x20000:
        return "HAN"
    return "OTHER"


#: Anything beyond the characters that names mostly consist of and that stay as they are.
_TO_LOOK_AT = re.compile("[^\\x20-\\x7e\\xb7\\xc0-\\u024f\\u3001\\u3002\\u300a\\u300b\\u4e00-\\u9fff]")


def compose(s: str) -> str:
    """Compatibility form with one kind of space and middle dot, without characters that show nothing. Idempotent."""
    for _ in range(3):
        before = s
        s = unicodedata.normalize("NFKC", s)
        if not _TO_LOOK_AT.search(s):
            return s
        out = []
        for ch in s:
            if ch in DOTS:
                out.append("·")
            elif ch in UNSEEN or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
                continue
            elif ch in "\t\n\v\f\r\x85\u2028\u2029" or unicodedata.category(ch) == "Zs":
                out.append(" ")
            elif unicodedata.category(ch) not in ("Cf", "Cc"):
                out.append(ch)
        s = "".join(out)
        if s == before:
            break
    return unicodedata.normalize("NFKC", s)


def to_latin(s: str) -> str:
    """Every look-alike as its Latin letter, accented ones too; accents stand behind their letters."""
    return "".join(map(lambda ch: LOOK_ALIKES.get(ch, ch), unicodedata.normalize("NFD", s)))


def skeleton(s: str) -> str:
    """The form under which all texts that look the same are equal, without regard to any vocabulary."""
    return compose(to_latin(compose(s)))


def candidates(token: str) -> list[str]:
    """Repairs of a token, best first: its look-alikes replaced by letters of its dominant script; none if nothing is to be repaired.

    The dominant script is the one with most letters that no other script draws
    alike, then with most letters at all, Latin before Greek before Cyrillic. A
    token of look-alikes only gets a candidate for each script it can be written in.
    """
    # letters without their accents: one composed with an accent is in no table of look-alikes
    kinds = [(ch, script(ch)) for ch in unicodedata.normalize("NFD", token)]
    present = {k for _, k in kinds if k in ("LATIN", "GREEK", "CYRILLIC")}
    if not present - {"LATIN"}:
        return []
    latin = to_latin(token)
    own = {k: sum(s == k and not (ch in LOOK_ALIKES or k == "LATIN" and ch in _SHARED) for ch, s in kinds) for k in present | {"LATIN"}}
    every = {k: sum(s == k for _, s in kinds) for k in present | {"LATIN"}}
    order = sorted(("LATIN", "GREEK", "CYRILLIC"), key=lambda k: (-own.get(k, 0), -every.get(k, 0)))
    sure = any(own.values())
    out = []
    for k in order[:1] if sure else ["LATIN", *[k for k in order if k != "LATIN"]]:
        done = latin if k == "LATIN" else "".join(FROM_LATIN[k].get(ch, ch) if script(ch) == "LATIN" else ch for ch in latin)
        done = unicodedata.normalize("NFKC", done)
        if done != token and done not in out and len({script(ch) for ch in done} & {"LATIN", "GREEK", "CYRILLIC"}) == 1:
            out.append(done)
    return out


def _map(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(run, T.StringType())


#: Matches the runs of letters and marks of one alphabetic script mix: a token of the repair.
_TOKEN = r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{M}]+"
_FOREIGN = r"[\p{IsGreek}\p{IsCyrillic}]"


def _pieces(c: Column) -> Column:
    """The text cut into tokens and what stands between them, in order."""
    return F.regexp_extract_all(c, F.lit(rf"({_TOKEN}|[^\p{{IsLatin}}\p{{IsGreek}}\p{{IsCyrillic}}\p{{M}}]+)"), F.lit(1))


def repair(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """df with `<column>_form` for each of `columns`: the consistent form of its text.

    key: a column that tells most rows apart, by which a hot text is split. Null stays null, empty stays empty.
    The vocabulary holds every token of these columns that has no letter of
    Greek or Cyrillic drawn like a Latin one, and every repair that two different
    spellings share. Only rows with such letters are taken apart; the others pass
    as composed. Where no repair stands in the vocabulary the token stays.
    """
    fix = _map(compose)
    base = scratch.write(df.withColumns({f"{c}_form": fix(F.col(c)) for c in columns}), "composed").df
    # most texts have no letter of an alphabet and take no part in what follows
    every = base.select(F.explode(F.array(*(F.col(f"{c}_form") for c in columns))).alias("t")).where(F.col("t").rlike(_TOKEN)).distinct()
    texts = scratch.write(every, "texts").df
    odd = texts.where(F.col("t").rlike(_FOREIGN))
    tokens = odd.select(F.explode(F.regexp_extract_all("t", F.lit(f"({_TOKEN})"), F.lit(1))).alias("token")).distinct()
    options = F.pandas_udf(lambda s: s.map(candidates), T.ArrayType(T.StringType()))
    tried = scratch.write(tokens.select("token", F.posexplode(options("token")).alias("rank", "word")), "tried").df
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit(f"({_TOKEN})"), F.lit(1))).alias("word")).distinct()
    clean = words.join(tried.select(F.col("token").alias("word")).distinct().hint("merge"), "word", "left_anti")
    shared = tried.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("word")
    known = tried.join(clean.union(shared).distinct().hint("merge"), "word", "left_semi")
    fixes = known.groupBy("token").agg(F.min(F.struct("rank", "word")).alias("best")).select("token", F.col("best.word").alias("word"))
    parts = scratch.write(odd.select("t", F.posexplode(_pieces(F.col("t"))).alias("i", "token")), "pieces")
    placed = salted_join(parts.df, fixes, "token", parts.stats["rows"], F.xxhash64("t", "i"), "left")
    whole = placed.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("word", "token").alias("w")))).alias("ws"))
    mended = scratch.write(whole.select("t", F.array_join(F.transform("ws", lambda x: x["w"]), "").alias("mended")).where("t <> mended"), "mended").df
    # rows with foreign letters meet their repaired texts; all others keep out of the joins
    foreign = F.lit(False)
    for c in columns:
        foreign = foreign | F.coalesce(F.col(f"{c}_form").rlike(_FOREIGN), F.lit(False))
    rows = scratch.write(base.where(foreign), "foreign")
    done = rows.df
    for c in columns:
        done = salted_join(done, mended.select(F.col("t").alias(f"{c}_form"), F.col("mended").alias("_m")), f"{c}_form", rows.stats["rows"], F.xxhash64(key), "left")
        done = done.withColumn(f"{c}_form", F.coalesce("_m", f"{c}_form")).select(*base.columns)
    return base.where(~foreign).unionByName(done)


def looks(df: DataFrame) -> scratch.Table:
    """(ord, form, spelling) of the rows of df (ord, name1, name2) with both names: what they look like and how they are written, as 128-bit keys."""
    rows = df.select("ord", "name1", "name2").where("name1 <> '' and name2 <> '' and ord is not null")
    with scratch.scope():
        formed = repair(rows, ["name1", "name2"], "ord")
        digest = lambda a, b: F.unhex(F.md5(F.concat_ws("\x00", a, b)))
        return scratch.write(formed.select("ord", digest("name1_form", "name2_form").alias("form"), digest("name1", "name2").alias("spelling")), "looks").keep()


def look_classes(df: DataFrame) -> DataFrame:
    """(ord, first_ord, links): every row that looks like rows written in another way, with the smallest ord of all that look like it and the number of those written in another way."""
    keyed = looks(df)
    spelled = scratch.write(keyed.df.groupBy("form", "spelling").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")), "spellings")
    every = spelled.df.groupBy("form").agg(F.sum("n").alias("of"), F.min("first").alias("first_ord"), F.count(F.lit(1)).alias("ways")).where("ways > 1")
    classes = salted_join(spelled.df, every, "form", spelled.stats["rows"], F.col("first")).select("spelling", "first_ord", (F.col("of") - F.col("n")).alias("links"))
    return salted_join(keyed.df, classes, "spelling", keyed.stats["rows"], F.col("ord")).select("ord", "first_ord", "links")


def same_looking(df: DataFrame) -> DataFrame:
    """(ord_a, ord_b), ord_a < ord_b: rows of df (ord, name1, name2) that look the same in both names but differ in code points.

    Rows with a null or empty name are left out. Rows written alike are one class;
    pairs of classes of one form are expanded to rows, so nothing compares rows
    within a class. `look_classes` gives the same as one row for each row.
    """
    keyed = looks(df)
    classes = keyed.df.select("form", "spelling").distinct()
    several = keyed.df.groupBy("form").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("form")
    live = scratch.write(classes.join(several.hint("merge"), "form", "left_semi"), "spellings")
    two = salted_join(live.df.toDF("form", "sa"), live.df.toDF("form", "sb"), "form", live.stats["rows"], F.col("sa")).where("sa < sb").select("sa", "sb")
    total = keyed.stats["rows"]
    a = salted_join(keyed.df.select(F.col("ord").alias("oa"), F.col("spelling").alias("sa")), two, "sa", total, F.col("oa")).select("oa", "sb")
    b = salted_join(keyed.df.select(F.col("ord").alias("ob"), F.col("spelling").alias("sb")), a, "sb", total, F.col("ob"))
    return b.where("oa <> ob").select(F.least("oa", "ob").alias("ord_a"), F.greatest("oa", "ob").alias("ord_b"))
