"""Pair lists: orientation, deduplication, cleaning, splits and negative pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nameloom.functions import similarity as sim
from nameloom.functions import tokens as tk
from nameloom.operators import ordered, scratch
from nameloom.operators.skew import salted_join

# Endings and parts of names that are no names.
NOISE_ENDINGS = ["列表", "将军", "代表", "运动", "问题"]
NOISE_PARTS = ["维基", "慰安妇"]
#: Negative pairs a source gets.
NEGATIVES = 10
#: Most targets of a block that is sent to all rows instead of meeting them by a shuffle.
SENT_TARGETS = 1000
#: Rows of a block that meets another whole.
BLOCK = 5_000
# Steps of the random draw; those that divide the number of rows are not used.
_STEPS = [7919, 104729, 1299709, 15485863, 32452843, 49979687, 67867967, 86028121, 104395301, 122949823]


def traditional_only(variants: DataFrame, limit: int = 100_000) -> str:
    """All characters that are a traditional form and no simplified one, as one text. The table is a fixed one, bounded by `limit`."""
    t = variants.select(F.col("traditional").alias("ch")).where("ch <> ''").distinct()
    only = t.join(variants.select(F.col("simplified").alias("ch")), "ch", "left_anti").limit(limit + 1).collect()
    if len(only) > limit:
        raise ValueError("too many variant characters for a literal")
    return "".join(sorted(r.ch for r in only))


def has_any(text: Column, characters: str) -> Column:
    """Whether a text holds one of the characters; null for null."""
    return F.length(F.translate(text, characters, "")) < F.length(text) if characters else text.isNull() & F.lit(False)


def orient(df: DataFrame, characters: str) -> DataFrame:
    """name1 and name2 swapped where name1 holds one of the (traditional) characters, so that the source is simplified."""
    swap = F.coalesce(has_any(F.col("name1"), characters), F.lit(False))
    return df.withColumns({"name1": F.when(swap, F.col("name2")).otherwise(F.col("name1")), "name2": F.when(swap, F.col("name1")).otherwise(F.col("name2"))})


def dedup_consecutive(df: DataFrame, *order: Column, name: str = "name1") -> DataFrame:
    """df without rows whose name equals that of the row before in the order; a null equals nothing."""
    return ordered.previous(df, name, *order, name="_before").where(F.col("_before").isNull() | F.col(name).isNull() | (F.col("_before") != F.col(name))).drop("_before")


def is_noise(c: Column, simplified: Column | None = None) -> Column:
    """Whether a field is only ASCII word characters, spaces and hyphens (the empty field too), or its simplified form is no name by its ending or a part. Null is noise."""
    raw = F.coalesce(c, F.lit(""))
    text = F.coalesce(simplified if simplified is not None else c, F.lit(""))
    out = raw.rlike(r"^[A-Za-z0-9_ -]*\z")
    for x in [*(text.endswith(x) for x in NOISE_ENDINGS), *(text.contains(x) for x in NOISE_PARTS)]:
        out = out | x
    return out


def noise_filter(df: DataFrame, fields: tuple[str, ...] = ("name1", "name2"), simplify: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows none of whose fields is noise; `simplify` gives the simplified form of a field."""
    keep = F.lit(True)
    for f in fields:
        keep = keep & ~is_noise(F.col(f), simplify(F.col(f)) if simplify else None)
    return df.where(keep)


def modulo_split(df: DataFrame, *order: Column, fold: int = 5) -> DataFrame:
    """df with `fold_split`: by place in the order, fold-2 of fold rows train, one dev, one test."""
    place = F.pmod(F.col("_i"), F.lit(fold))
    split = F.when(place < fold - 2, "train").when(place == fold - 2, "dev").otherwise("test")
    return ordered.dense_index(df, *order, name="_i").withColumn("fold_split", split).drop("_i")


def kfold_blocks(df: DataFrame, *order: Column, fold: int = 5, block: int = 11) -> DataFrame:
    """df with `fold_id`: contiguous test folds of whole blocks of rows; rows past the last whole fold are left out."""
    indexed = scratch.write(ordered.dense_index(df, *order, name="_i"), "kfold").df
    size = indexed.count() // block // fold * block
    if not size:
        return indexed.limit(0).withColumn("fold_id", F.lit(0)).drop("_i")
    return indexed.where(F.col("_i") < size * fold).withColumn("fold_id", F.floor(F.col("_i") / size).cast("int")).drop("_i")


def marker_groups(df: DataFrame, marker: str, *order: Column) -> DataFrame:
    """df with `group_id`: each row whose marker is true opens the next group, from 1; rows before the first are in group 0."""
    return ordered.running_sum(df.withColumn("_m", F.coalesce(F.col(marker), F.lit(False)).cast("int")), "_m", *order, name="group_id").drop("_m")


def all_pairs(df: DataFrame, limit: int | None = 10_000) -> DataFrame:
    """Every source with every target: (ord, name1, name2, label, target_ord), label true for its own.

    The result has n*n rows, so more rows than `limit` are refused unless it is
    None. Sources and targets meet block by block: each is dealt to blocks of about
    BLOCK rows by a hash of ord, and copied once for each block of the other side.
    Rows with a null ord are left out. Order: by ord, own target first, then target_ord.
    """
    rows = df.where("ord is not null")
    n = rows.count()
    if limit is not None and n > limit:
        raise ValueError(f"{n} rows would give {n * n} pairs; give limit=None for more than {limit} rows")
    blocks = F.lit(n // BLOCK + 1)
    mine, other = F.pmod(F.xxhash64("ord"), blocks), F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1))
    sources = rows.select("ord", "name1", mine.alias("_s"), other.alias("_t"))
    targets = rows.select(F.col("ord").alias("target_ord"), "name2", mine.alias("_t"), other.alias("_s"))
    return sources.join(targets.hint("merge"), ["_s", "_t"]).select("ord", "name1", "name2", (F.col("ord") == F.col("target_ord")).alias("label"), "target_ord")


def _draws(index: Column, n: int, count: int, seed: int) -> Column:
    """`count` different indexes below n, other than `index`, drawn by hash; all others if there are no more."""
    steps = [s for s in _STEPS if (n - 1) % s] or [1]
    start = F.pmod(F.xxhash64(index, F.lit(seed)), F.lit(max(n - 1, 1)))
    step = F.get(F.array(*(F.lit(s).cast("bigint") for s in steps)), F.pmod(F.xxhash64(index, F.lit(seed + 1)), F.lit(len(steps))).cast("int"))
    some = F.transform(F.sequence(F.lit(0), F.lit(min(count, n - 1) - 1)), lambda k: F.pmod(start + k * step, F.lit(n - 1)))
    return F.transform(some, lambda j: F.when(j >= index, j + 1).otherwise(j))


def random_pairs(df: DataFrame, negatives: int = NEGATIVES, seed: int = 1) -> DataFrame:
    """(ord, name1, name2, label): each row with its own target and with `negatives` targets of other rows, drawn without replacement; with fewer rows, all of them."""
    indexed = scratch.write(ordered.dense_index(df.select("ord", "name1", "name2"), F.col("ord"), name="_i"), "indexed").df
    n = indexed.count()
    own = indexed.select("ord", "name1", "name2", F.lit(True).alias("label"))
    if n < 2:
        return own
    drawn = indexed.select("ord", "name1", F.explode(_draws(F.col("_i"), n, negatives, seed)).alias("_i"))
    return own.unionByName(drawn.join(indexed.select("_i", "name2"), "_i").select("ord", "name1", "name2", F.lit(False).alias("label")))


def confused_pairs(df: DataFrame, negatives: int = NEGATIVES, seed: int = 1, top_up: bool = True, first_block: int | None = None) -> DataFrame:
    """(ord, name1, name2, label, target_ord): each row with its own target and with the first `negatives` targets in order of ord that are similar.

    A target is similar if its Levenshtein similarity to name1 is above 0; it must
    differ from name1 and from name2, and not be the row's own. Such a target shares
    a character, so candidates come from a join on characters. As only the first
    ones count, targets are taken in blocks of growing size (the first of four times
    `negatives`, unless given), and each block meets only the rows that still lack some. With `top_up`, rows that end short get
    random other targets. Null names take no part; targets that repeat count each.
    """
    rows = df.where("ord is not null and name1 is not null and name2 is not null").select("ord", "name1", "name2")
    indexed = scratch.write(ordered.dense_index(rows, F.col("ord"), name="_i"), "confuse").df
    n = indexed.count()
    open_rows = scratch.write(indexed.select("_i", "ord", "name1", "name2", F.lit(negatives).alias("_lack")), "open")
    found, low, size = None, 0, first_block or 4 * negatives
    while low < n and not open_rows.df.isEmpty():
        block = indexed.where((F.col("_i") >= low) & (F.col("_i") < low + size)).select(F.col("_i").alias("_j"), F.col("ord").alias("target_ord"), F.col("name2").alias("_t"))
        signs = block.select("*", F.explode(F.array_distinct(tk.chars(F.col("_t")))).alias("_c"))
        mine = open_rows.df.select("*", F.explode(F.array_distinct(tk.chars(F.col("name1")))).alias("_c"))
        # a pair is looked at under the first character of name1 that both hold, so it comes out once
        first = F.get(F.array_intersect(tk.chars(F.col("name1")), tk.chars(F.col("_t"))), F.lit(0)) == F.col("_c")
        cand = mine.join(signs.hint("broadcast" if size <= SENT_TARGETS else "merge"), "_c").where((F.col("_i") != F.col("_j")) & (F.col("_t") != F.col("name1")) & (F.col("_t") != F.col("name2")) & first)
        hits = cand.where(sim.levenshtein_similarity(F.col("name1"), F.col("_t")) > 0).select("_i", "ord", "name1", "_lack", "_j", "target_ord", "_t")
        # the first of each row; the group limit of the window keeps as many of each task before the shuffle
        place = F.row_number().over(W.partitionBy("_i").orderBy("_j"))
        firsts = hits.withColumn("_k", place).where(F.col("_k") <= negatives).where("_k <= _lack")
        taken = scratch.write(firsts.select("_i", "ord", "name1", "_j", "target_ord", F.col("_t").alias("name2")), "taken").df
        found = taken if found is None else found.unionByName(taken)
        got = taken.groupBy("_i").agg(F.count(F.lit(1)).cast("int").alias("_got"))
        left = open_rows.df.join(got, "_i", "left").withColumn("_lack", F.col("_lack") - F.coalesce("_got", F.lit(0))).where("_lack > 0").drop("_got")
        nxt = scratch.write(left, "open")
        open_rows.drop()
        open_rows, low, size = nxt, low + size, size * 4
    own = indexed.select("ord", "name1", "name2", F.lit(True).alias("label"), F.col("ord").alias("target_ord"))
    if found is None:
        return own
    out = own.unionByName(found.select("ord", "name1", "name2", F.lit(False).alias("label"), "target_ord"))
    if top_up and n > 1:
        # draws that may fall on targets taken already: as many more are drawn as could
        short = open_rows.df.select("_i", "ord", "name1", "_lack", F.explode(_draws(F.col("_i"), n, 2 * negatives, seed)).alias("_j"))
        fresh = short.join(found.select("_i", "_j"), ["_i", "_j"], "left_anti")
        picked = fresh.groupBy("_i", "ord", "name1", "_lack").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("_i", "_j").alias("h"), "_j"))).alias("_l"))
        picked = picked.select("ord", "name1", F.explode(F.slice("_l", F.lit(1), F.col("_lack"))).alias("x")).select("ord", "name1", "x._j")
        target = indexed.select(F.col("_i").alias("_j"), F.col("ord").alias("target_ord"), "name2")
        out = out.unionByName(salted_join(picked, target, "_j", n, F.col("ord")).select("ord", "name1", "name2", F.lit(False).alias("label"), "target_ord"))
    return out
