"""Feature ids of a name pair and the dictionaries of gram pairs they refer to."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nameloom.functions import bins, script, similarity as sim
from nameloom.functions import tokens as tk
from nameloom.functions.phonetics import Lexicon
from nameloom.operators import assign, batches, ordered, scratch

#: Between the grams of a pair feature.
SEPARATOR = "--"
#: Length differences from this on are one.
LONGEST_DIFFERENCE = 5
#: Positive pairs that must hold a gram pair.
SUPPORT = 2
#: Most entries of a dictionary that is sent whole to all executors (three numbers each).
SENT_ENTRIES = 1_000_000
_OVERLAP = len(tk.ORDERS) * len(bins.EDGES) + 1
_NONE = "cast(array() as array<int>)"


@dataclass(frozen=True)
class FeatureConfig:
    """mode: 6 * representation (0 joined sounds, 1 syllables, 2 phonemes) + block left out (0 overlap, 1 surname, 2 length, 3 distance, 4 character grams, 5 sound grams). align: gram pairs by assignment, or all of them."""

    mode: int = 17
    align: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.mode < 18:
            raise ValueError("mode must be from 0 to 17")

    @property
    def left_out(self) -> int:
        return self.mode % 6

    def sounds(self, rep: str) -> Column:
        """The token sequence of the representation in use."""
        return [tk.chars(F.col(f"{rep}.pinyin")), F.col(f"{rep}.syll"), F.col(f"{rep}.phon")][self.mode // 6]

    def offsets(self) -> dict[str, int]:
        """First id of each block in use; later blocks move up when one is left out."""
        out, at = {}, 1
        for i, (name, width) in enumerate((("overlap", 2 * _OVERLAP), ("surname", 2), ("length", LONGEST_DIFFERENCE + 1), ("distance", len(bins.EDGES)))):
            if i != self.left_out:
                out[name] = at
                at += width
        return out | {"grams": at}


def overlap_rates(a: Column, b: Column) -> list[Column]:
    """Jaccard of the gram sets of each order."""
    return [sim.jaccard(tk.gram_set(a, n), tk.gram_set(b, n)) for n in tk.ORDERS]


def overlap_bins(a: Column, b: Column, begin: int = 1) -> Column:
    """Bins of the gram overlap by order, and a last id if no order overlaps."""

    def ids(rates: Column) -> Column:
        some = [bins.binarize(rates[i], begin + i * len(bins.EDGES)) for i in range(len(tk.ORDERS))]
        return F.concat(*some, F.when(F.array_max(rates) == 0, F.array(F.lit(begin + _OVERLAP - 1))).otherwise(F.expr(_NONE)))

    return tk.let(a, lambda x: tk.let(b, lambda y: tk.let(F.array(*overlap_rates(x, y)), ids)))


def surname_ids(a: Column, b: Column, surnames: list[str], begin: int = 1) -> Column:
    """First id: first characters equal; second: the equal first one or two characters are a surname. Empty names have none."""
    one, two = F.substring(a, 1, 1), F.substring(a, 1, 2)
    same1, same2 = (one == F.substring(b, 1, 1)) & (one != ""), two == F.substring(b, 1, 2)
    known = (same1 & one.isin(surnames)) | (same2 & two.isin(surnames))
    return F.array_compact(F.array(F.when(same1, F.lit(begin)), F.when(known, F.lit(begin + 1))))


def length_id(a: Column, b: Column, begin: int = 1) -> Column:
    """One id by the difference of lengths, capped."""
    return F.array(F.lit(begin) + F.least(F.abs(F.length(a) - F.length(b)), F.lit(LONGEST_DIFFERENCE)))


def distance_ids(a: Column, b: Column, begin: int = 1, measure: int = 1) -> Column:
    """Bins of a similarity of token sequences: 1 Levenshtein, 2 Jaro-Winkler, 3 longest common run (of the joined tokens)."""
    values = {1: lambda: sim.token_levenshtein_similarity(a, b), 2: lambda: sim.jaro_winkler(a, b), 3: lambda: sim.longest_common_run(F.array_join(a, ""), F.array_join(b, ""))}
    return bins.binarize(values[measure](), begin)


def gram_pair_rows(df: DataFrame, keep: list[str], a: Column, b: Column) -> DataFrame:
    """(*keep, pair): every pair of grams of both sides, and the grams of one side only with nothing; as rows of two generators in compiled code, without an array of them."""

    def marked(x: Column, y: Column) -> Column:
        """Each gram and whether the other side lacks it, and a last one that stands for no gram."""
        return F.concat(F.transform(x, lambda g: F.struct(g.alias("g"), (~F.array_contains(y, g)).alias("only"))), F.array(F.struct(F.lit(None).cast("string").alias("g"), F.lit(False).alias("only"))))

    both = tk.let(tk.gram_union(a), lambda x: tk.let(tk.gram_union(b), lambda y: F.struct(marked(x, y).alias("a"), marked(y, x).alias("b"))))
    rows = df.select(*keep, both.alias("_g")).select(*keep, F.explode("_g.a").alias("_x"), F.col("_g.b").alias("_b")).select(*keep, "_x", F.explode("_b").alias("_y"))
    x, y = F.col("_x.g"), F.col("_y.g")
    wanted = (x.isNotNull() & y.isNotNull()) | (y.isNull() & F.col("_x.only")) | (x.isNull() & F.col("_y.only"))
    return rows.where(wanted).select(*keep, F.concat(F.coalesce(x, F.lit("")), F.lit(SEPARATOR), F.coalesce(y, F.lit(""))).alias("pair"))


def aligned_gram_pairs(df: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """df with `name`: the pairs of the best assignment of the (sorted) grams, and what is left of the longer side with nothing."""
    step = df.withColumn("_ga", F.array_sort(tk.gram_union(a))).withColumn("_gb", F.array_sort(tk.gram_union(b)))
    step = step.withColumn("_cost", assign.cost_matrix(F.col("_ga"), F.col("_gb"))).withColumn("_p", assign.assignment(F.col("_cost")))
    # the costs stay in the written table: used once only, they would be merged into the argument of the assignment
    step = scratch.write(step, "assigned").df.drop("_cost")
    got = F.transform("_p", lambda p: F.concat(F.get("_ga", p["i"]), F.lit(SEPARATOR), F.get("_gb", p["j"])))
    rest = lambda g, side: F.filter(F.transform(g, lambda x, i: F.when(~F.exists("_p", lambda p: p[side] == i), x)), lambda x: x.isNotNull())
    left = F.when(F.size("_ga") > F.size("_gb"), F.transform(rest(F.col("_ga"), "i"), lambda x: F.concat(x, F.lit(SEPARATOR))))
    right = F.when(F.size("_gb") > F.size("_ga"), F.transform(rest(F.col("_gb"), "j"), lambda x: F.concat(F.lit(SEPARATOR), x)))
    return step.withColumn(name, F.concat(got, F.coalesce(left, right, F.expr("cast(array() as array<string>)")))).drop("_ga", "_gb", "_p")


def pair_rows(df: DataFrame, keep: list[str], a: Column, b: Column, align: bool) -> DataFrame:
    """(*keep, pair): the gram pairs of each row, all of them or those of the best assignment."""
    if not align:
        return gram_pair_rows(df, keep, a, b)
    return aligned_gram_pairs(df, a, b, "_pairs").select(*keep, F.explode("_pairs").alias("pair"))


def gram_pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, cnt): how many of the rows (pair) hold each gram pair, combined before the shuffle."""
    return rows.groupBy("pair").agg(F.count(F.lit(1)).alias("cnt"))


def pair_dictionary(df: DataFrame, config: FeatureConfig, support: int = SUPPORT) -> DataFrame:
    """(pair, cnt, id): the gram pairs of positive and unlabelled rows with enough support, ids dense from 0 by pair.

    df has rep1, rep2, label. Characters are counted first and pruned; then sounds
    are added to the survivors and pruned again, as one dictionary serves both.
    """
    rows = df.where("label is null or label")
    kept = None
    for i, (a, b) in enumerate(((tk.chars(F.col("rep1.simp")), tk.chars(F.col("rep2.simp"))), (config.sounds("rep1"), config.sounds("rep2")))):
        if config.left_out == 4 + i:
            continue
        counts = gram_pair_counts(pair_rows(rows, [], a, b, config.align))
        if kept is not None:
            counts = kept.unionByName(counts).groupBy("pair").agg(F.sum("cnt").alias("cnt"))
        kept = counts.where(F.col("cnt") >= support)
    kept = scratch.write(kept, "kept").df  # ordering reads its input twice
    return ordered.dense_index(kept, F.col("pair"), name="id").select("pair", "cnt", F.col("id").cast("int").alias("id"))


def gram_idf(df: DataFrame, columns: list[Column]) -> DataFrame:
    """(gram, idf): 1 + in how many names each gram stands; columns are token sequences of df."""
    grams = df.select(F.explode(F.array(*(tk.gram_union(c) for c in columns))).alias("g")).select(F.explode("g").alias("gram"))
    return grams.groupBy("gram").agg((F.count(F.lit(1)) + 1).alias("idf"))


def tfidf_similarity(df: DataFrame, key: str, a: Column, b: Column, idf: DataFrame, name: str = "tfidf") -> DataFrame:
    """(key, tfidf): the normed product of the weights of shared grams, weights being counts over idf; null where no gram is shared.

    Both norms run over shared grams only. A gram without idf counts as 1.
    """
    bag = lambda c: tk.gram_list(c)
    shared = df.select(key, F.explode(F.array_intersect(tk.gram_union(a), tk.gram_union(b))).alias("gram"), bag(a).alias("_a"), bag(b).alias("_b"))
    count = lambda c: F.size(F.filter(c, lambda x: x == F.col("gram"))).cast("double")
    rows = shared.select(key, "gram", count(F.col("_a")).alias("x"), count(F.col("_b")).alias("y")).join(idf, "gram", "left").withColumn("idf", F.coalesce("idf", F.lit(1)))
    x, y = F.col("x") / F.col("idf"), F.col("y") / F.col("idf")
    return rows.groupBy(key).agg((F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias(name))


def fixed_ids(config: FeatureConfig, surnames: list[str]) -> Column:
    """Ids of the blocks that need no dictionary."""
    at = config.offsets()
    a, b = F.col("rep1.simp"), F.col("rep2.simp")
    sa, sb = config.sounds("rep1"), config.sounds("rep2")
    parts = []
    if "overlap" in at:
        parts += [overlap_bins(tk.chars(a), tk.chars(b), at["overlap"]), overlap_bins(sa, sb, at["overlap"] + _OVERLAP)]
    if "surname" in at:
        parts.append(surname_ids(a, b, surnames, at["surname"]))
    if "length" in at:
        parts.append(length_id(a, b, at["length"]))
    if "distance" in at:
        parts.append(distance_ids(sa, sb, at["distance"]))
    return F.concat(*parts)


def extract(df: DataFrame, key: str, config: FeatureConfig, surnames: list[str], dictionary: DataFrame) -> DataFrame:
    """(key, features): sorted active ids of each row of df (key, rep1, rep2).

    Gram pairs meet the dictionary by two hashes of the pair, together 128 bits. A
    dictionary of at most SENT_ENTRIES is broadcast; a larger one is merge-joined.
    Which side is small is said here, as the planner takes the exploded one for small.
    Ids that occur twice are one.
    """
    sides = [(tk.chars(F.col("rep1.simp")), tk.chars(F.col("rep2.simp"))), (config.sounds("rep1"), config.sounds("rep2"))]
    hashes = lambda h, g: (F.xxhash64("pair").alias(h), F.xxhash64("pair", F.lit(1)).alias(g))
    known = dictionary.select(*hashes("_h", "_g"), (F.col("id") + config.offsets()["grams"]).alias("id"))
    known = known.hint("broadcast" if dictionary.count() <= SENT_ENTRIES else "merge")
    every = df.select(key, F.explode_outer(fixed_ids(config, surnames)).alias("id"))
    for i, (a, b) in enumerate(sides):
        if config.left_out != 4 + i:
            mine = pair_rows(df, [key], a, b, config.align).select(key, *hashes("_h", "_g2"))
            every = every.unionByName(mine.join(known, "_h").where("_g = _g2").select(key, "id"))
    return every.groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("features"))


# The same in arrays, for configurations without grams of sounds.

_NAMES = ("_n1", "_n2", "_s1", "_s2")


def _named(df: DataFrame, simplify: dict[str, str], *keep: str) -> DataFrame:
    """df (*keep, name1, name2) with both names as written and converted, over more tasks than cores."""
    both = {f"_{k}{i}": c for i in (1, 2) for k, c in (("n", F.col(f"name{i}")), ("s", script.convert(F.col(f"name{i}"), simplify)))}
    return scratch.spread(df.select(*keep, *(c.alias(n) for n, c in both.items())), *("ord",) * ("ord" in keep))


def array_align_totals(df: DataFrame, key: str, a: str, b: str, name: str) -> DataFrame:
    """(key, name): the total cost of the best assignment of the grams of two texts; null with a null text."""

    def totals(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some, texts in batches.over(part, ("_a", "_b")):
                null = [x is None or y is None for x, y in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(batches.align_totals(*texts), mask=np.array(null, bool))], [key, name])

    rows = scratch.spread(df.select(key, F.col(a).alias("_a"), F.col(b).alias("_b")), key)
    return rows.mapInArrow(totals, T.StructType([df.schema[key], T.StructField(name, T.DoubleType())]))


def array_features(config: FeatureConfig, lexicon: Lexicon, surnames: list[str], cantonese: bool = False) -> batches.Features:
    sounds = batches.Sounds(lexicon, config.mode // 6, ("mandarin", "cantonese" if cantonese else "mandarin"))
    return batches.Features(config.offsets(), config.align, sounds, surnames, LONGEST_DIFFERENCE)


def array_dictionary(df: DataFrame, simplify: dict[str, str], of: batches.Features, support: int = SUPPORT) -> scratch.Table:
    """(pair, cnt, id, x, y), written in order of the grams x and y: pair_dictionary of df (name1, name2, label), counted by the numbers of the grams, which are written out for those with enough support only."""

    def pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, texts in batches.over(part, _NAMES):
                for x, y in of.pairs(*texts):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

    def written(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = batches.pair_texts(part.column(0).to_numpy(), part.column(1).to_numpy(), SEPARATOR)
            yield pa.RecordBatch.from_arrays([texts, *part.columns], ["pair", "x", "y", "cnt"])

    with scratch.scope():
        rows = _named(df.where("(label is null or label) and name1 is not null and name2 is not null"), simplify).mapInArrow(pairs, "x bigint, y bigint")
        kept = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= support)
        kept = scratch.write(kept.mapInArrow(written, "pair string, x bigint, y bigint, cnt bigint"), "kept").df
        known = ordered.dense_index(kept, F.col("pair"), name="id").select("pair", "cnt", F.col("id").cast("int").alias("id"), "x", "y")
        return scratch.write(known.repartitionByRange("x", "y").sortWithinPartitions("x", "y"), "dictionary").keep()


def array_extract(df: DataFrame, simplify: dict[str, str], of: batches.Features, path: str) -> DataFrame:
    """df (ord, name1, name2, ...) with `features`, sorted ids, none where a name is null or has no known sound; path: of the dictionary.

    Rows stay where they are; only those whose ord stands more than once are put together. No ord, no features.
    """
    rest = [c for c in df.columns if c not in ("name1", "name2", "features")]
    rows = _named(df, simplify, *rest, *(c for c in ("name1", "name2") if c in df.columns))
    fields = T.StructType([*(rows.schema[c] for c in df.columns if c != "features"), T.StructField("features", T.ArrayType(T.IntegerType(), False))])
    names = [f.name for f in fields][:-1]

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = batches.Index.of(path)
        for part in parts:
            for some, texts in batches.over(part, _NAMES):
                column = lambda n: some.column(some.schema.get_field_index(n))  # noqa: B023, E731
                ids = of.of(*texts, index, column("ord").is_valid().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(column(n) for n in names), ids], [*names, "features"])

    out = rows.mapInArrow(found, fields)
    twice = df.where("ord is not null").groupBy("ord").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("ord")
    if twice.isEmpty():
        return out
    twice = scratch.write(twice, "twice").df
    again = out.join(twice, "ord", "left_semi")
    one = again.groupBy("ord").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("features")))).alias("features"))
    return out.join(twice, "ord", "left_anti").select(*out.columns).unionByName(again.drop("features").join(one, "ord"))


# Legacy text features.


def sqrt_overlap_ids(source: Column, target: Column, begin: int = 1, edges: tuple[float, ...] = bins.EDGES) -> Column:
    """Cumulative bins, by order, of the target's grams found in the source over the root of the target's grams."""
    ids = lambda have, t: F.concat(*(bins.cumulative(_root_share(tk.gram_set(t, n), have), begin + i * len(edges), edges) for i, n in enumerate(tk.ORDERS)))
    return tk.let(tk.gram_union(source), lambda have: tk.let(target, lambda t: ids(have, t)))


def _root_share(grams: Column, have: Column) -> Column:
    """Grams that are in `have`, over the root of their number; null without grams."""
    return tk.let(grams, lambda g: F.when(F.size(g) > 0, F.size(F.array_intersect(g, have)) / F.sqrt(F.size(g).cast("double"))))


def sound_and_character_ids(source: Column, target: Column, begin: int = 1, edges: tuple[float, ...] = bins.EDGES) -> Column:
    """The same of `sounds:characters` texts: three orders of the sounds, two of the characters, and an id if no character is shared."""
    part = lambda c, i: tk.chars(F.coalesce(F.get(F.split(c, ":"), F.lit(i)), F.lit("")))
    width = len(edges)

    def of(side: int, orders: tuple[int, ...], first: int) -> Column:
        ids = lambda have, t: F.concat(*(bins.cumulative(_root_share(tk.gram_set(t, n), have), begin + (first + i) * width, edges) for i, n in enumerate(orders)))
        return tk.let(tk.gram_union(part(source, side), orders), lambda have: tk.let(part(target, side), lambda t: ids(have, t)))

    shared = F.arrays_overlap(part(source, 1), part(target, 1))
    none = F.when(~F.coalesce(shared, F.lit(False)), F.array(F.lit(begin + 5 * width))).otherwise(F.expr(_NONE))
    return F.concat(of(0, tk.ORDERS, 0), of(1, (1, 2), 3), none)


def libsvm_text(label: Column, ids: Column) -> Column:
    """One line of the sparse text format: label and `id:1` for each id in order."""
    head = F.when(label, "1").otherwise("0")
    return F.concat_ws(" ", head, F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda i: F.concat(i.cast("string"), F.lit(":1"))), " "))
