"""What a user calls: scoring of pairs by a similarity or a classifier, jobs over files, and SQL functions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameloom.functions import script
from nameloom.functions import similarity as sim
from nameloom.functions.phonetics import Lexicon
from nameloom.operators import evaluate, model, pairs, represent, scratch
from nameloom.operators.features import FeatureConfig
from nameloom.sources import files

_matchers: dict[str, model.NameMatcher] = {}


@dataclass(frozen=True)
class FunctionMatcher:
    """Matches by a similarity in one of represent.MODES; immutable, with_ gives a changed copy."""

    function: str = "levenshtein"
    mode: str = "pronun1"
    threshold: float = 0.5
    lexicon: Lexicon | None = None
    simplify: dict[str, str] = field(default_factory=dict)
    strict: bool = False

    def with_(self, **changes) -> FunctionMatcher:
        return FunctionMatcher(**(self.__dict__ | changes))

    def score(self, df: DataFrame) -> DataFrame:
        s = represent.mode_score(self.mode, F.col("name1"), F.col("name2"), self.function, self.lexicon, self.simplify, self.strict)
        return df.withColumn("score", s).withColumn("prediction", F.coalesce(F.col("score") > self.threshold, F.lit(False)))


def score_pairs(df: DataFrame, path: str) -> DataFrame:
    """df (ord, name1, name2) with score and prediction of the classifier saved at `path`, which is loaded once."""
    if path not in _matchers:
        _matchers[path] = model.NameMatcher.load(df.sparkSession, path)
    return _matchers[path].score(df)


def reset_models() -> None:
    _matchers.clear()


def tune_function(df: DataFrame, base: FunctionMatcher, levels: int = 100) -> list[tuple[str, float, dict]]:
    """For each mode (mode, threshold, rank metrics): the threshold with the highest F1 on df (ord, name1, name2, label)."""
    out = []
    for mode in represent.MODES:
        written = scratch.write(base.with_(mode=mode).score(df), "scored")
        scored = written.df
        t = evaluate.threshold_search(scored, levels).where("best").first()["threshold"]
        out.append((mode, t, evaluate.rank_eval(scored).first().asDict()))
        written.drop()
    return out


def load_input(spark: SparkSession, path: str, kind: str, variants: DataFrame | None = None) -> DataFrame:
    """`paired` files as they are; `raw` ones oriented, deduplicated, given confusing negatives, and saved beside as `.paired`."""
    if kind == "paired":
        return files.read_pairs(spark, path)
    if kind != "raw":
        raise ValueError("kind must be paired or raw")
    raw = files.read_raw(spark, path)
    raw = pairs.orient(raw, pairs.traditional_only(variants)) if variants is not None else raw
    files.write_pairs(pairs.confused_pairs(pairs.dedup_consecutive(raw, F.col("ord"))), f"{path}.paired")
    return files.read_pairs(spark, f"{path}.paired")


def score_file(spark: SparkSession, path: str, matcher, kind: str = "paired", out: str | None = None, variants: DataFrame | None = None) -> dict | None:
    """Scores a file, writes predictions to `out`, and returns rank metrics if any row has a label."""
    scored = scratch.write(matcher.score(load_input(spark, path, kind, variants)), "scored").df
    if out:
        files.write_predictions(scored, out)
    labelled = not scored.where("label is not null").isEmpty()
    return evaluate.rank_eval(scored).first().asDict() if labelled else None


def train(df: DataFrame, dev: DataFrame | None, matcher: model.NameMatcher, tune: bool = False, select_threshold: bool = True, levels: int = 20, penalty: float = model.PENALTY, weight: float = model.POSITIVE_WEIGHT) -> dict:
    """Trains a classifier; dev defaults to the training rows. Unlike the thresholds given, a selected one replaces the matcher's."""
    dev = df if dev is None else dev
    if tune:
        matcher.learn(df)
        have = matcher.features_of(df).where(F.size("features") > 0)
        _, (penalty, weight), _ = model.search(have, matcher.features_of(dev), matcher.size, model.grid(penalty))
    matcher.train(df, penalty, weight)
    scored = scratch.write(matcher.score(dev), "scored").df
    if select_threshold:
        matcher.threshold = evaluate.threshold_search(scored, levels).where("best").first()["threshold"]
    return {"penalty": penalty, "weight": weight, "threshold": matcher.threshold, "dev": evaluate.rank_eval(scored).first().asDict()}


def preprocess(spark: SparkSession, path: str, fold: int = 5, simplify: dict[str, str] | None = None, variants: DataFrame | None = None) -> dict[str, DataFrame]:
    """Noise filter and split of a raw file, each part oriented, deduplicated and given confusing negatives, written as `.filtered.<part>.paired`.

    The filter looks at the fields between tabs and leaves out lines with more than
    two; the names of what is left stand between any white space, as in raw files.
    """
    lines = files.read_lines(spark, path)
    field = F.split(F.trim("line"), "\t")
    one, two = F.get(field, F.lit(0)), F.get(field, F.lit(1))
    noise = lambda c: pairs.is_noise(c, script.convert(c, simplify or {}))
    kept = lines.where(F.size(field) <= 2).withColumns({"_1": one, "_2": two}).where(~noise(F.col("_1")) & (F.col("_2").isNull() | ~noise(F.col("_2")))).select("line", "ord")
    split = scratch.write(pairs.modulo_split(kept, F.col("ord"), fold=fold), "split").df
    characters = "" if variants is None else pairs.traditional_only(variants)
    out = {}
    for part in ("train", "dev", "test"):
        rows = pairs.orient(files.parse_raw(split.where(F.col("fold_split") == part).select("line", "ord")), characters)
        files.write_pairs(pairs.confused_pairs(pairs.dedup_consecutive(rows, F.col("ord"))), f"{path}.filtered.{part}.paired")
        out[part] = files.read_pairs(spark, f"{path}.filtered.{part}.paired")
    return out


def convert_file(spark: SparkSession, source: str, target: str, mapping: dict[str, str]) -> None:
    """Script conversion of a text file, line by line."""
    spark.read.text(source).select(script.convert(F.col("value"), mapping).alias("value")).write.mode("overwrite").text(target)


def register_sql(spark: SparkSession) -> None:
    """SQL functions: name_similarity(a, b), inlined into the plan by Catalyst, and name_damerau(a, b)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION name_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN a = b THEN 1D WHEN length(a) = 0 THEN 1D - length(b) / (length(b) + 1D) WHEN length(b) = 0 THEN 1D - length(a) / (length(a) + 1D) ELSE 1D - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END")
    spark.udf.register("name_damerau", sim.damerau_distance)
