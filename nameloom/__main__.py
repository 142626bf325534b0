"""The jobs over files as commands: python -m nameloom COMMAND --help."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nameloom import api
from nameloom.functions import phonetics, script
from nameloom.operators import model
from nameloom.operators.features import FeatureConfig
from nameloom.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="nameloom", description="Matching of names.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *flags: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text, description=text)
        for f in flags:
            p.add_argument(f"--{f}", required=True)
        p.add_argument("--readings", help="comma-separated values of readings of characters")
        p.add_argument("--variants", help="file of tokens simplified=traditional")
        p.add_argument("--surnames", help="file of surnames")
        return p

    def matcher(p: argparse.ArgumentParser) -> None:
        p.add_argument("--data-type", choices=["raw", "paired"], required=True)
        p.add_argument("--matcher", choices=["classifier", "jarowinkler", "levenshtein"], required=True)
        p.add_argument("--model-file", help="folder of a saved classifier")

    def learner(p: argparse.ArgumentParser) -> None:
        p.add_argument("--feature-mode", type=int, default=17)
        p.add_argument("--align-mode", choices=["align", "all"], default="all")
        p.add_argument("--contains-cantonese", choices=["true", "false"], default="false")

    test = command("test", "Scores a file.", "data")
    matcher(test)
    test.add_argument("--output-file")
    test.add_argument("--threshold", type=float)
    train = command("train", "Trains a classifier, or finds the best threshold of a similarity.", "train-data")
    matcher(train)
    learner(train)
    train.add_argument("--dev-data")
    train.add_argument("--tune-parameters", choices=["true", "false"], default="false")
    train.add_argument("--select-threshold", choices=["true", "false"], default="false")
    train.add_argument("--threshold", type=float, default=0.5)
    train.add_argument("--C", type=float, default=model.PENALTY)
    train.add_argument("--w1", type=float, default=model.POSITIVE_WEIGHT)
    cross = command("cross-validate", "Area under the curve of each point of the grid.", "train-data")
    matcher(cross)
    learner(cross)
    command("preprocess", "Filters and splits a raw file, with confusing negatives.", "data")
    convert = command("convert", "Converts a text file between script forms.", "data", "output-file")
    convert.add_argument("--to", choices=["simplified", "traditional"], default="simplified")
    command("pronounce", "Prints the pronunciation of a text.", "text")
    return top


def run(spark: SparkSession, argv: list[str] | None = None) -> dict | list | str | None:
    """Runs one command and returns what it reports."""
    o = parser().parse_args(argv)
    variants = files.read_variants(spark, o.variants) if o.variants else None
    mapping = lambda a, b: script.dictionary(variants, a, b) if variants is not None else {}
    simplify = mapping("traditional", "simplified")
    lexicon = phonetics.Lexicon.of(files.read_readings(spark, o.readings)) if o.readings else None
    if o.command == "preprocess":
        return {part: df.count() for part, df in api.preprocess(spark, o.data, simplify=simplify, variants=variants).items()}
    if o.command == "convert":
        return api.convert_file(spark, o.data, o.output_file, simplify if o.to == "simplified" else mapping("simplified", "traditional"))
    if o.command == "pronounce":
        return spark.range(1).select(phonetics.pronounce(F.lit(o.text), lexicon)).first()[0]
    classifier = o.matcher == "classifier"
    if classifier and (lexicon is None and o.command != "test"):
        raise SystemExit("a classifier is trained with --readings")
    if o.command == "test":
        m = model.NameMatcher.load(spark, o.model_file) if classifier else api.FunctionMatcher(o.matcher, "pronun1" if lexicon else "original", lexicon=lexicon, simplify=simplify)
        if o.threshold is not None:
            m = m.with_(threshold=o.threshold) if not classifier else _with_threshold(m, o.threshold)
        return api.score_file(spark, o.data, m, o.data_type, o.output_file, variants)
    rows = api.load_input(spark, o.train_data, o.data_type, variants)
    if not classifier:
        base = api.FunctionMatcher(o.matcher, lexicon=lexicon, simplify=simplify)
        return api.tune_function(rows, base)
    surnames = [r[0] for r in files.read_surnames(spark, o.surnames).collect()] if o.surnames else []
    m = model.NameMatcher(FeatureConfig(o.feature_mode, o.align_mode == "align"), lexicon, simplify, sorted(surnames), cantonese=o.contains_cantonese == "true")
    if o.command == "cross-validate":
        m.learn(rows)
        return [r.asDict() for r in model.cross_validate(m.features_of(rows).where(F.size("features") > 0), m.size, model.grid()).collect()]
    dev = api.load_input(spark, o.dev_data, o.data_type, variants) if o.dev_data else None
    m.threshold = o.threshold
    report = api.train(rows, dev, m, o.tune_parameters == "true", o.select_threshold == "true", penalty=o.C, weight=o.w1)
    if o.model_file:
        m.save(o.model_file)
    return report


def _with_threshold(m: model.NameMatcher, threshold: float) -> model.NameMatcher:
    m.threshold = threshold
    return m


def main() -> None:
    print(json.dumps(run(SparkSession.builder.appName("nameloom").getOrCreate()), ensure_ascii=False))


if __name__ == "__main__":
    main()
