"""Which documents are no natural prose (problem 10).

A rule list is learned by incremental reduced-error pruning on labelled texts
whose statistics Spark computes, and applied as a SQL CASE expression to the same
statistics of every document. Only the labelled sample, bounded by
rules.MAX_LABELLED, comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameloom.llm import labelled, quality
from nameloom.llm.rules import MAX_LABELLED, RuleList, irep

#: Statistics that do not depend on how long a text is; only these enter a rule.
FEATURES = [s for s in quality.STATS if s not in ("n_chars", "n_words", "n_lines", "mean_line_len", "distinct_share")]
#: Labelled texts for a fit.
SAMPLE = 8000

_learned: dict[tuple[int, int], RuleList] = {}


def fit(labels: DataFrame, text: str = "text", label: str = "junk", seed: int = 1) -> RuleList:
    """Rules from labelled texts (at most MAX_LABELLED rows); rows with a null label are left out."""
    rows = quality.with_stats(labels.where(F.col(label).isNotNull()), text).select(label, *FEATURES).limit(MAX_LABELLED + 1).toPandas()
    return irep({f: rows[f].to_numpy(float) for f in FEATURES}, rows[label].to_numpy(bool), seed)


def default_rules(spark: SparkSession, n: int = SAMPLE, seed: int = 7) -> RuleList:
    """The rules learned from `n` generated examples; learned once a process."""
    if (n, seed) not in _learned:
        rows = labelled.examples(n, seed)
        df = spark.createDataFrame(rows, "text string, junk boolean").repartition(8)
        # examples are in the order they were made only after a sort, and the split of a fit goes by order
        stats = quality.with_stats(df, "text").orderBy(F.xxhash64("text")).select("junk", *FEATURES).toPandas()
        _learned[n, seed] = irep({f: stats[f].to_numpy(float) for f in FEATURES}, stats["junk"].to_numpy(bool), 1)
    return _learned[n, seed]


def flag_junk(df: DataFrame, rules: RuleList | None = None, text: str = "text") -> DataFrame:
    """df with the statistics and `junk`: true for a text that is no prose. A null or empty text has no content and is junk."""
    stats = quality.with_stats(df, text)
    rules = rules or default_rules(df.sparkSession)
    return stats.withColumn("junk", (F.col("n_chars") == 0) | F.expr(rules.sql()))
