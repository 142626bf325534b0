"""Queries of the core operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameloom.functions import bins, phonetics, script
from nameloom.functions import similarity as sim
from nameloom.functions import tokens as tk
from nameloom.operators import evaluate, features, model, pairs, represent, rowcheck, scratch
from nameloom.plans import sql
from nameloom.sources import files
from nameloom.streaming import scorer

#: Most surnames that become a literal.
SURNAME_LIMIT = 10_000

_registered: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable:
    _registered[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


class Tables:
    """The tables of a folder, and the small dictionaries made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def named_pairs(self) -> DataFrame:
        return self.pairs.where("name1 is not null and name2 is not null").select("ord", "name1", "name2", "label")

    def names(self) -> DataFrame:
        """(name): every different name of the pairs."""
        p = self.pairs
        return p.select(F.col("name1").alias("name")).union(p.select("name2")).where("name is not null").distinct()

    def lexicon(self) -> phonetics.Lexicon:
        return phonetics.Lexicon.of(self.readings)

    def simplify(self) -> dict[str, str]:
        return script.dictionary(self.variant_chars, "traditional", "simplified")

    def surname_list(self) -> list[str]:
        """The surnames; a fixed list, sent along in expressions."""
        rows = self.surnames.where("surname <> ''").distinct().limit(SURNAME_LIMIT + 1).collect()
        if len(rows) > SURNAME_LIMIT:
            raise ValueError(f"more than {SURNAME_LIMIT} surnames do not belong into an expression")
        return sorted(r[0] for r in rows)


def _text(ids) -> F.Column:
    """An array as one text, for comparison."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


# Sources.


@query
def pair_parse(t: Tables) -> DataFrame:
    return files.parse_pairs(t.raw_lines.select(F.col("line_no").alias("ord"), "line"), strict=False)


@query
def raw_parse(t: Tables) -> DataFrame:
    return files.parse_raw(t.raw_lines.select(F.col("line_no").alias("ord"), "line"))


@query
def surname_set(t: Tables) -> DataFrame:
    return t.surnames.select("surname").where("surname <> ''").distinct()


@query
def traditional_only(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(c,) for c in pairs.traditional_only(t.variant_chars)], "ch string")


@query
def prediction_lines(t: Tables) -> DataFrame:
    return files.prediction_lines(t.scored.where("name1 is not null and name2 is not null and score is not null"))


# Similarities.


@query
def lev_pairs(t: Tables) -> DataFrame:
    return t.named_pairs().select("ord", F.round(sim.levenshtein_similarity(F.col("name1"), F.col("name2")), 9).alias("score"))


@query
def lev_tokens(t: Tables) -> DataFrame:
    lx = t.lexicon()
    p = t.named_pairs().select("ord", phonetics.syllables(F.col("name1"), lx).alias("a"), phonetics.syllables(F.col("name2"), lx).alias("b"))
    return p.select("ord", F.round(sim.token_levenshtein_similarity(F.col("a"), F.col("b")), 9).alias("score"))


@query
def damerau_pairs(t: Tables) -> DataFrame:
    return t.named_pairs().select("ord", F.round(sim.damerau_similarity(F.col("name1"), F.col("name2")), 9).alias("score"))


@query
def jaro_winkler_pairs(t: Tables) -> DataFrame:
    return t.named_pairs().select("ord", F.round(sim.text_jaro_winkler(F.col("name1"), F.col("name2")), 9).alias("score"))


@query
def lcs_ratio(t: Tables) -> DataFrame:
    return t.named_pairs().select("ord", F.round(sim.longest_common_run(F.col("name1"), F.col("name2")), 9).alias("score"))


@query
def match_lev(t: Tables) -> DataFrame:
    return scorer.with_score(t.named_pairs(), sim.levenshtein_similarity, 0.5).select("ord", "prediction")


@query
def stream_score(t: Tables) -> DataFrame:
    stream = t.spark.readStream.schema(t.pairs.schema).parquet(f"{t.dir}/pairs.parque[t]").where("name1 is not null and name2 is not null").select("ord", "name1", "name2")
    out, state = scratch.new_path(t.spark, "stream"), scratch.new_path(t.spark, "stream-state")
    scorer.score_stream(stream, sim.levenshtein_similarity, 0.5, out, state).awaitTermination()
    return t.spark.read.schema("ord bigint, name1 string, name2 string, score double, prediction boolean").parquet(out).select("ord", "prediction")


# Grams and features.


@query
def ngram_union(t: Tables) -> DataFrame:
    return t.names().select("name", F.array_join(F.array_sort(tk.gram_union(tk.chars(F.col("name")))), "|").alias("grams"))


@query
def ngram_by_order(t: Tables) -> DataFrame:
    c = tk.chars(F.col("name"))
    return t.names().select("name", *(F.array_join(F.array_sort(tk.gram_set(c, n)), "|").alias(f"grams{n}") for n in tk.ORDERS))


@query
def gram_bag(t: Tables) -> DataFrame:
    every = t.names().select("name", F.explode(tk.gram_bag(tk.chars(F.col("name")))).alias("gram", "n"))
    return every.groupBy("gram").agg(F.sum("n").alias("n"))


@query
def jaccard_rate(t: Tables) -> DataFrame:
    rates = features.overlap_rates(tk.chars(F.col("name1")), tk.chars(F.col("name2")))
    return t.named_pairs().select("ord", *(F.round(r, 9).alias(f"rate{i + 1}") for i, r in enumerate(rates)))


@query
def jaccard_bins(t: Tables) -> DataFrame:
    return t.named_pairs().select("ord", _text(features.overlap_bins(tk.chars(F.col("name1")), tk.chars(F.col("name2")))).alias("ids"))


@query
def lev_bins(t: Tables) -> DataFrame:
    return t.named_pairs().select("ord", _text(bins.binarize(sim.levenshtein_similarity(F.col("name1"), F.col("name2")), 77)).alias("ids"))


@query
def length_diff_onehot(t: Tables) -> DataFrame:
    return t.named_pairs().select("ord", _text(features.length_id(F.col("name1"), F.col("name2"), 71)).alias("ids"))


@query
def surname_match(t: Tables) -> DataFrame:
    return t.named_pairs().select("ord", _text(features.surname_ids(F.col("name1"), F.col("name2"), t.surname_list(), 69)).alias("ids"))


@query
def gram_idf(t: Tables) -> DataFrame:
    return features.gram_idf(t.named_pairs(), [tk.chars(F.col("name1")), tk.chars(F.col("name2"))])


@query
def tfidf_sim(t: Tables) -> DataFrame:
    p, a, b = t.named_pairs(), tk.chars(F.col("name1")), tk.chars(F.col("name2"))
    idf = scratch.write(features.gram_idf(p, [a, b]), "idf").df
    out = features.tfidf_similarity(p, "ord", a, b, idf)
    return out.select("ord", F.round("tfidf", 9).alias("tfidf"))


@query
def pair_feature_dict(t: Tables) -> DataFrame:
    rows = features.gram_pair_rows(scratch.spread(t.named_pairs().where("label is null or label"), "ord"), [], tk.chars(F.col("name1")), tk.chars(F.col("name2")))
    return features.gram_pair_counts(rows).where(F.col("cnt") >= features.SUPPORT)


@query
def aligned_feature_dict(t: Tables) -> DataFrame:
    p = scratch.spread(t.named_pairs().where("label is null or label"), "ord").select("name1", "name2")
    rows = features.pair_rows(p, [], tk.chars(F.col("name1")), tk.chars(F.col("name2")), align=True)
    return features.gram_pair_counts(rows).where(F.col("cnt") >= features.SUPPORT)


@query
def align_cost(t: Tables) -> DataFrame:
    return features.array_align_totals(t.named_pairs(), "ord", "name1", "name2", "total").withColumn("total", F.round("total", 6))


@query
def feature_ids(t: Tables) -> DataFrame:
    m = _matcher(t)
    m.learn(t.named_pairs().where("ord is not null"))
    return m.features_of(t.named_pairs()).select("ord", _text("features").alias("ids"))


@query
def feature_ids_aligned(t: Tables) -> DataFrame:
    m = _matcher(t, align=True)
    m.learn(t.named_pairs().where("ord is not null"))
    return m.features_of(t.named_pairs()).select("ord", _text("features").alias("ids"))


@query
def sqrt_overlap_bins(t: Tables) -> DataFrame:
    return t.named_pairs().select("ord", _text(features.sqrt_overlap_ids(tk.chars(F.col("name1")), tk.chars(F.col("name2")))).alias("ids"))


@query
def dist_bins_cumulative(t: Tables) -> DataFrame:
    return t.named_pairs().select("ord", _text(bins.cumulative(sim.levenshtein_similarity(F.col("name1"), F.col("name2")), 34)).alias("ids"))


@query
def sound_character_bins(t: Tables) -> DataFrame:
    lx = t.lexicon()
    both = lambda n: F.concat_ws(":", F.array_join(phonetics.syllables(F.col(n), lx), ""), F.regexp_replace(n, ":", ""))
    return t.named_pairs().select("ord", both("name1").alias("a"), both("name2").alias("b")).select("ord", _text(features.sound_and_character_ids(F.col("a"), F.col("b"))).alias("ids"))


@query
def libsvm_lines(t: Tables) -> DataFrame:
    ids = features.sqrt_overlap_ids(tk.chars(F.col("name1")), tk.chars(F.col("name2")))
    return t.named_pairs().where("label is not null").select("ord", features.libsvm_text(F.col("label"), ids).alias("line"))


# Script and sound.


@query
def script_convert(t: Tables) -> DataFrame:
    return t.names().select("name", script.convert(F.col("name"), t.simplify()).alias("converted"))


@query
def script_phrases(t: Tables) -> DataFrame:
    back = script.dictionary(t.variant_chars, "simplified", "traditional")
    return t.names().select("name", script.convert_phrases(F.col("name"), back).alias("converted"))


@query
def transliterate(t: Tables) -> DataFrame:
    table = script.dictionary(t.readings, "ch", "mandarin")
    return t.names().select("name", script.transliterate(F.col("name"), table).alias("latin"))


@query
def pronounce(t: Tables) -> DataFrame:
    return t.names().select("name", phonetics.pronounce(F.col("name"), t.lexicon()).alias("latin"))


@query
def syllable_split(t: Tables) -> DataFrame:
    lx = t.lexicon()
    said = lambda l: F.array_join(phonetics.syllables(F.col("name"), lx, l), " ").alias(l)  # noqa: E731, E741
    return t.names().select("name", said("mandarin"), said("cantonese"))


@query
def phoneme_split(t: Tables) -> DataFrame:
    lx = t.lexicon()
    said = lambda l: F.array_join(phonetics.phonemes(F.col("name"), lx, l), " ").alias(l)  # noqa: E731, E741
    return t.names().select("name", said("mandarin"), said("cantonese"))


@query
def onset_inventory(t: Tables) -> DataFrame:
    return phonetics.onset_inventory(t.readings)


@query
def mode_scores(t: Tables) -> DataFrame:
    lx, simple, a, b = t.lexicon(), t.simplify(), F.col("name1"), F.col("name2")
    return t.named_pairs().select("ord", *(F.round(represent.mode_score(m, a, b, "levenshtein", lx, simple), 6).alias(m) for m in represent.MODES))


# Pair lists.


@query
def orient_pairs(t: Tables) -> DataFrame:
    return pairs.orient(t.matches.select("ord", "name1", "name2"), pairs.traditional_only(t.variant_chars))


@query
def dedup_consecutive(t: Tables) -> DataFrame:
    return pairs.dedup_consecutive(t.predictions.select("ord", "name1", "name2"), F.col("ord"))


@query
def noise_filter(t: Tables) -> DataFrame:
    simple = t.simplify()
    return pairs.noise_filter(t.aliases.select("ord", "name1", "name2"), simplify=lambda c: script.convert(c, simple))


@query
def mod_split(t: Tables) -> DataFrame:
    return pairs.modulo_split(t.matches.select("ord"), F.col("ord"))


@query
def kfold_blocks(t: Tables) -> DataFrame:
    return pairs.kfold_blocks(t.pairs.select("ord"), F.col("ord"))


@query
def group_by_marker(t: Tables) -> DataFrame:
    return pairs.marker_groups(t.scored.select("ord", "label"), "label", F.col("ord"))


@query
def neg_all(t: Tables) -> DataFrame:
    names = t.nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name1"), F.col("n_name").alias("name2"))
    return pairs.all_pairs(names)


@query
def neg_random(t: Tables) -> DataFrame:
    return pairs.random_pairs(t.matches.where("name1 is not null and name2 is not null"))


@query
def neg_confuse(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name1"), F.col("p_name").alias("name2"))
    return pairs.confused_pairs(names, top_up=False)


@query
def neg_confuse_matches(t: Tables) -> DataFrame:
    return pairs.confused_pairs(pairs.orient(t.matches.select("ord", "name1", "name2"), pairs.traditional_only(t.variant_chars)))


# Evaluation.


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query
def rank_eval(t: Tables) -> DataFrame:
    return _rounded(evaluate.rank_eval(t.scored))


@query
def rank_errors(t: Tables) -> DataFrame:
    return evaluate.rank_errors(t.scored)


@query
def f1_eval(t: Tables) -> DataFrame:
    return _rounded(evaluate.f1_eval(t.scored))


@query
def threshold_search(t: Tables) -> DataFrame:
    return _rounded(evaluate.threshold_search(t.scored, 100))


@query
def topk_eval(t: Tables) -> DataFrame:
    return _rounded(evaluate.topk_eval(t.scored, 3))


@query
def threshold_eval(t: Tables) -> DataFrame:
    return _rounded(evaluate.threshold_eval(t.scored, 0.5))


@query
def error_diff(t: Tables) -> DataFrame:
    s = t.scored.where("name1 is not null")
    return evaluate.error_diff(s.where("prediction <> label"), s.where("(score > 0.5) <> label"), "name1")


@query
def log_runs(t: Tables) -> DataFrame:
    lines = t.scored.select("ord", F.when(F.pmod("ord", F.lit(500)) == 0, F.lit("Selected threshold")).otherwise(F.concat(F.lit("error term "), F.coalesce("name1", F.lit("-")))).alias("line"))
    return evaluate.log_runs(lines)


# The classifier.


def _matcher(t: Tables, align: bool = False) -> model.NameMatcher:
    return model.NameMatcher(features.FeatureConfig(mode=17, align=align), t.lexicon(), t.simplify(), t.surname_list())


@query
def svm_train_score(t: Tables) -> DataFrame:
    m = _matcher(t)
    m.train(t.named_pairs().join(t.pairs.where("split = 'train'").select("ord"), "ord", "left_semi"), penalty=0.01)
    return m.score(t.named_pairs()).select("ord", F.round("score", 6).alias("score"), "prediction")


@query
def svm_grid(t: Tables) -> DataFrame:
    m, p = _matcher(t), t.named_pairs()
    split = lambda s: p.join(t.pairs.where(F.col("split") == s).select("ord"), "ord", "left_semi")
    m.learn(split("train"))
    have = m.features_of(split("train")).where(F.size("features") > 0)
    _, _, results = model.search(have, m.features_of(split("dev")), m.size)
    return t.spark.createDataFrame(results, "penalty double, weight double, mrr double")


# Rows that fail to parse.


@query
def p7_found(t: Tables) -> DataFrame:
    return rowcheck.row_errors(t.raw_lines)


@query
def p7_clean(t: Tables) -> DataFrame:
    return rowcheck.clean_rows(t.raw_lines)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registered)


def oracle_sql() -> dict[str, str]:
    return sql.statements()
