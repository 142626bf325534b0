"""Records of evaluation splits that also stand, exactly or almost, in training (problem 2).

An exact prefix-filter join. A record is the text `name1 separator name2`, with
everything dropped that does not count. Two texts within k edits of each other
lose at most k*q of their q-shingles, so of the k*q+1 rarest shingles of either
one - in one global order, by frequency over all records - at least one stands in
both prefixes, no further than k positions apart, and their lengths differ by k at
most. Evaluation prefixes are indexed (in both orders of the names, for each
length a partner may have), training prefixes probe the index with the length and
position filters, and every candidate is verified by edit distance.

The shingle size follows the length of the training text, so both sides use the
same one. Texts too short for any shingle prefix meet in a deletion neighbourhood
instead, which is as exact.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nameloom.llm.visual import skeleton
from nameloom.operators import scratch
from nameloom.operators.skew import salted_join

#: Edits allowed over both names together.
EDITS = 2
#: Between the names of a record; no name holds it, as controls are dropped.
SEP = "\x1f"
#: Bound of the variant character table, which is a fixed one.
VARIANT_LIMIT = 20_000
#: Longest shingle.
MAX_Q = 4
_DROPPED = r"[\p{IsWhite_Space}\x1c-\x1f\p{P}]+"


def _skeletons(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else skeleton(x))


def plain(c: Column, variants: DataFrame) -> Column:
    """Text without case, white space, punctuation, invisible differences and script form.

    variants: (simplified, traditional), one to one; at most `VARIANT_LIMIT` rows
    become a translation table.
    """
    rows = variants.where("length(simplified) = 1 and length(traditional) = 1").select("traditional", "simplified").distinct().limit(VARIANT_LIMIT + 1).collect()
    if len(rows) > VARIANT_LIMIT:
        raise ValueError("more variant characters than a translation table should hold")
    table = dict(sorted((r.traditional, r.simplified) for r in rows))
    seen = F.pandas_udf(_skeletons, T.StringType())(c)
    bare = F.lower(F.regexp_replace(F.upper(seen), _DROPPED, ""))
    return F.translate(bare, "".join(table), "".join(table.values())) if table else bare


def shingle_size(length: Column) -> Column:
    """Shingle size for training texts of this length (with the separator); 0: too short for a prefix.

    Padded with q-1 marks at both ends a text of n characters has n+q-1 shingles;
    the shortest partner has n-k characters and must keep more than k*q.
    """
    # n - k + q - 1 >= k*q + 1  <=>  q*(k-1) <= n - k - 2
    return F.greatest(F.lit(0), F.least(F.lit(MAX_Q), F.floor((length - EDITS - 2) / (EDITS - 1)))).cast("int")


def _shingles(text: Column, q: Column) -> Column:
    """[(position, shingle)] of the padded text, shingles as 64-bit hashes with their size: two that fall together only add a candidate."""
    pad = F.repeat(F.lit("\x02"), q - 1)
    padded = F.concat(pad, text, F.repeat(F.lit("\x03"), q - 1))
    n = F.length(text) + q - 1
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.substring(padded, i, q), q).alias("gram")))


def _classes(records: DataFrame, label: str) -> scratch.Table:
    """One row for each different (a, b): id, a, b, text, len. Copies never meet each other."""
    distinct = records.select("a", "b").distinct().withColumn("text", F.concat_ws(SEP, "a", "b"))
    return scratch.write(distinct.withColumn("id", F.monotonically_increasing_id()).withColumn("len", F.length("text")), label)


def _deletions(text: Column, k: int) -> Column:
    """All texts that k or fewer deletions leave."""
    level = F.array(text)
    out = level
    for _ in range(k):
        level = F.array_distinct(F.flatten(F.transform(level, lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>")))))
        out = F.concat(out, level)
    return F.array_distinct(out)


def near_classes(train: DataFrame, evaluation: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train classes, evaluation classes, links): both inputs have a, b; links are (tid, eid) within EDITS edits in the given or the swapped order, as ids of the classes."""
    t, e = _classes(train, "train-classes"), _classes(evaluation, "eval-classes")
    q = shingle_size(F.col("len"))
    # every evaluation class stands in both orders, with each shingle size that a partner's length asks for
    both = e.df.select("id", "text", "len").union(e.df.where("a <> b").select("id", F.concat_ws(SEP, "b", "a"), "len"))
    sizes = F.array_distinct(F.transform(F.sequence(F.col("len") - EDITS, F.col("len") + EDITS), shingle_size))
    eg = _grams(both.withColumn("row", F.monotonically_increasing_id()).withColumn("q", F.explode(sizes)), "row", "id", "len")
    tg = _grams(t.df.withColumn("q", q), "id", "len")
    # one order of shingles for both sides: by how many training records hold them, then by the shingle
    frequency = scratch.write(tg.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "shingles").df
    ep = scratch.write(_prefix(eg, frequency, "row", "id", "len").drop("row", "q"), "eval-prefixes")
    tp = scratch.write(_prefix(tg, frequency, "id", "len").drop("q"), "train-prefixes")
    near = (F.abs(F.col("tpos") - F.col("epos")) <= EDITS) & (F.abs(F.col("tlen") - F.col("elen")) <= EDITS)
    probe, index = tp.df.toDF("tid", "tlen", "gram", "tpos"), ep.df.toDF("eid", "elen", "gram", "epos")
    found = salted_join(probe, index, "gram", tp.stats["rows"], F.col("tid")).where(near).select("tid", "eid")
    # texts too short for a prefix, and all partners they can have
    rests = lambda i: (F.col("id").alias(i), F.explode(F.transform(_deletions(F.col("text"), EDITS), lambda x: F.xxhash64(x))).alias("rest"))
    short = scratch.write(t.df.where(q == 0).select(*rests("tid")), "train-rests")
    longest = EDITS + 2 + (EDITS - 1) - 1
    partner = both.where(F.col("len") <= longest + EDITS).select(*rests("eid")).distinct()
    pairs = scratch.write(found.union(salted_join(short.df, partner, "rest", short.stats["rows"], F.col("tid")).select("tid", "eid")).distinct(), "candidates")
    n = pairs.stats["rows"]
    cand = salted_join(pairs.df, t.df.select(F.col("id").alias("tid"), "a", "b"), "tid", n, F.col("eid"))
    cand = salted_join(cand, e.df.select(F.col("id").alias("eid"), F.col("a").alias("c"), F.col("b").alias("d")), "eid", n, F.col("tid"))
    straight = F.levenshtein("a", "c", EDITS), F.levenshtein("b", "d", EDITS)
    crossed = F.levenshtein("a", "d", EDITS), F.levenshtein("b", "c", EDITS)
    close = [(x >= 0) & (y >= 0) & (x + y <= EDITS) for x, y in (straight, crossed)]
    links = scratch.write(cand.where(close[0] | close[1]).select("tid", "eid"), "links")
    for kept in (t, e, links):
        kept.keep()
    return t.df, e.df, links.df


def _grams(texts: DataFrame, *keep: str) -> DataFrame:
    return texts.where("q > 0").select(*keep, "q", F.explode(_shingles(F.col("text"), F.col("q"))).alias("g")).select(*keep, "q", "g.pos", "g.gram")


def _prefix(grams: DataFrame, frequency: DataFrame, *owner: str) -> DataFrame:
    """(*owner, q, gram, pos): the EDITS*q+1 rarest shingles of each owner that training holds.

    Shingles that no training record holds are the rarest of all and find nothing:
    they never leave the join, and their number, which follows from the length,
    takes as many places of the prefix.
    """
    ranked = grams.join(frequency.hint("merge"), "gram")  # the exploded side is never the one to broadcast; skewed shingles are split at run time
    lists = ranked.groupBy(*owner, "q").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "pos"))).alias("all"))
    absent = F.col("len") + F.col("q") - 1 - F.size("all")
    rare = F.slice("all", F.lit(1), F.greatest(F.col("q") * EDITS + 1 - absent, F.lit(0)))
    return lists.select(*owner, "q", F.explode(rare).alias("g")).select(*owner, "q", "g.gram", "g.pos")


def cross_split(df: DataFrame, variants: DataFrame) -> DataFrame:
    """(train_ord, eval_ord): rows of split train and rows of dev or test that are the same record or within EDITS edits.

    df: ord, name1, name2, split. Rows with a null or empty name or another split
    take no part; a name of which nothing is left once case, space and marks are
    dropped counts as empty text and is compared as such. Repeated rows count each.
    """
    rows = df.select("ord", "name1", "name2", "split").where("name1 <> '' and name2 <> '' and ord is not null and split in ('train', 'dev', 'test')")
    base = scratch.write(rows.select("ord", "split", plain(F.col("name1"), variants).alias("a"), plain(F.col("name2"), variants).alias("b")), "plain")
    base, total = base.df, base.stats["rows"]
    train, evaluation = base.where("split = 'train'"), base.where("split <> 'train'")
    with scratch.scope():
        t, e, links = near_classes(train, evaluation)
    # a record may stand in any number of rows: both sides are split where it is hot
    key = F.md5(F.concat_ws(SEP, "a", "b"))
    hit_t, hit_e = t.join(links.select(F.col("tid").alias("id")).distinct(), "id", "left_semi"), e.join(links.select(F.col("eid").alias("id")).distinct(), "id", "left_semi")
    trows = salted_join(train.select(key.alias("key"), F.col("ord").alias("train_ord")), hit_t.select(key.alias("key"), F.col("id").alias("tid")), "key", total, F.col("train_ord")).select("tid", "train_ord")
    erows = salted_join(evaluation.select(key.alias("key"), F.col("ord").alias("eval_ord")), hit_e.select(key.alias("key"), F.col("id").alias("eid")), "key", total, F.col("eval_ord")).select("eid", "eval_ord")
    linked = salted_join(trows, links, "tid", total, F.col("train_ord")).select("eid", "train_ord")
    return salted_join(linked, erows, "eid", total, F.col("train_ord")).select("train_ord", "eval_ord")


def overlap_pairs(df: DataFrame, variants: DataFrame) -> DataFrame:
    """(ord_a, ord_b), ord_a < ord_b: the overlaps as pairs of rows."""
    return cross_split(df, variants).select(F.least("train_ord", "eval_ord").alias("ord_a"), F.greatest("train_ord", "eval_ord").alias("ord_b")).where("ord_a < ord_b").distinct()


def overlap_report(df: DataFrame, variants: DataFrame) -> DataFrame:
    """(split, source, rows, overlapping): evaluation rows, and those among them that stand in training, by split and source."""
    hit = cross_split(df, variants).select(F.col("eval_ord").alias("ord")).distinct().withColumn("hit", F.lit(1))
    rows = df.where("split in ('dev', 'test')").select("ord", "split", "source").join(hit, "ord", "left")
    return rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("hit", F.lit(0))).alias("overlapping"))
