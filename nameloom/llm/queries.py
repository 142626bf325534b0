"""Queries of the problems of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameloom.llm import components, ledger, mixing, overlap, prose, quality, topn, variants, visual, wumanber
from nameloom.operators import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.found_copies(_table(spark, sf_dir, "matches"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.records(ledger.build_ledger(_table(spark, sf_dir, "matches")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_pairs(_table(spark, sf_dir, "pairs"), _table(spark, sf_dir, "variant_chars"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(_table(spark, sf_dir, "pairs"), _table(spark, sf_dir, "variant_chars"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.name_groups(_table(spark, sf_dir, "scored").where("label").select("name1", "name2"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_pairs(*(_table(spark, sf_dir, t) for t in ("aliases", "readings", "variant_chars")))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(*(_table(spark, sf_dir, t) for t in ("aliases", "readings", "variant_chars")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.same_looking(_table(spark, sf_dir, "pairs"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.look_classes(_table(spark, sf_dir, "pairs"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "pairs").select("ord", "name1", "name2")
    return visual.repair(pairs, ["name1", "name2"], "ord").select("ord", "name1_form", "name2_form")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _table(spark, sf_dir, "predictions").select("name1", "ord", topn.number(F.col("score")).alias("score"))
    return topn.top_n(scored, "name1", "score", "ord", 3).select("name1", "ord")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wumanber.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "test_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wumanber.leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "test_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _table(spark, sf_dir, "mix_targets")
    mixed = scratch.write(mixing.mix(_table(spark, sf_dir, "documents"), targets), "mix").df
    return mixing.shares(mixed, targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.flag_junk(_table(spark, sf_dir, "documents").select("doc_id", "text")).where("junk").select("doc_id")


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.with_stats(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return stats.select("doc_id", *(F.round(c, 6).alias(c) for c in quality.STATS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "p1_found p1_records p2_found p2_report p3_found p4_found p4_groups p5_found p5_classes p5_forms p6_found p8_found p8_report p9_mix p9_shares p10_found p10_stats".split()
    return {n: globals()[n] for n in names}


_KEYED = r"""
keyed AS (
  SELECT ord, name1, name2,
         lower(upper(regexp_replace(name1, '[\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\pP]+', '', 'g'))) AS a,
         lower(upper(regexp_replace(name2, '[\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\pP]+', '', 'g'))) AS b
  FROM matches WHERE name1 IS NOT NULL AND name2 IS NOT NULL)"""


_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\pL\pN]+', '', 'g') AS s FROM documents),
w AS (SELECT item_id, lang, list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '[^\pL\pN]+', '', 'g')), lambda x: x <> '') AS words,
             regexp_replace(lower(text), '[^\pL\pN]+', '', 'g') AS s FROM test_items),
p AS (SELECT item_id, array_to_string(words[i:i+11], '') AS pat FROM (SELECT *, unnest(generate_series(1, len(words) - 11)) AS i FROM w WHERE lang <> 'zh')
      UNION SELECT item_id, substring(s, i, 24) FROM (SELECT *, unnest(generate_series(1, length(s) - 23)) AS i FROM w WHERE lang = 'zh')),
leaks AS (SELECT DISTINCT d.doc_id, p.item_id FROM d JOIN p ON contains(d.s, p.pat))
"""


def oracle_sql() -> dict[str, str]:
    number = r"CASE WHEN regexp_full_match(trim(score, E' \t\n\r'), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim(score, E' \t\n\r') AS DOUBLE) END"
    return {
        "p1_found": f"""
WITH {_KEYED}, firsts AS (SELECT ord, min(ord) OVER (PARTITION BY least(a, b), greatest(a, b)) AS first_ord FROM keyed)
SELECT first_ord, ord AS copy_ord FROM firsts WHERE ord <> first_ord""",
        "p1_records": f"""
WITH {_KEYED}
SELECT min(ord) AS first_ord, arg_min(name1, ord) AS name1, arg_min(name2, ord) AS name2, count(*) AS copies
FROM keyed GROUP BY least(a, b), greatest(a, b)""",
        "p3_found": """
WITH RECURSIVE links AS (
  SELECT DISTINCT name1 AS a, name2 AS b FROM scored WHERE label AND name1 IS NOT NULL AND name2 IS NOT NULL AND name1 <> name2),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(name, other) AS (
  SELECT a, a FROM both_ways
  UNION
  SELECT r.name, e.b FROM reach r JOIN both_ways e ON r.other = e.a)
SELECT name, min(other) AS group_name FROM reach GROUP BY name""",
        "p6_found": f"""
WITH s AS (SELECT name1, ord, {number} AS v FROM predictions WHERE name1 IS NOT NULL),
r AS (SELECT name1, ord, row_number() OVER (PARTITION BY name1 ORDER BY v DESC, ord) AS k FROM s WHERE v IS NOT NULL AND isfinite(v))
SELECT name1, ord FROM r WHERE k <= 3""",
        "p8_found": _LEAKS + "SELECT doc_id, item_id FROM leaks",
        "p8_report": _LEAKS + "SELECT i.item_id, i.split, i.lang, count(*) AS documents FROM leaks JOIN test_items i USING (item_id) GROUP BY i.item_id, i.split, i.lang",
    }
