"""Loading tab-separated lines while setting aside those that do not parse (problem 7).

The parsed cells of a line are exploded into (line, column, value), joined with a
table of rules, and each rule is evaluated on its cells; column -1 holds the form of
the whole line. The failures are aggregated to one reason a line, and the clean rows
are what is left by an anti join with them. Parsing is one possessive regular expression, so a line of any
length is read in one pass without recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nameloom.operators import scratch

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"(?=\t|\z)'
_PLAIN = r'(?!")[^\t]*+'
_FIELD = f"(?:{_QUOTED}|{_PLAIN})"
#: A line whose quoted fields all close right before a tab or the end.
WELL_QUOTED = rf"(?s)\A{_FIELD}(?:\t{_FIELD})*+\z"
#: One field with the tab before it; the line gets one in front, so that no match is empty.
_CELL = rf"(?s)\t({_FIELD})"
#: Anything but a space of any kind.
_BLANK = r"(?s)\A[\p{IsWhite_Space}\x1c-\x1f]*+\z"
_SPACES = r"\A[\p{IsWhite_Space}\x1c-\x1f]++|[\p{IsWhite_Space}\x1c-\x1f]++\z"
_BAD_CHAR = r"[\p{Cc}\x{FFFD}&&[^\t]]"

#: Column and value of a cell that stands for the whole line: LINE holds the number of fields, or OPEN where quotes do not close.
LINE, OPEN = -1, "open"
#: column (0-based), rule, reason. The order of reasons is their precedence.
RULES = [(LINE, "open_quotes", "quoting"), (LINE, "field_count", "columns"), (0, "blank", "value"), (0, "bad_char", "value"), (1, "blank", "value"), (1, "bad_char", "value"), (2, "not_boolean", "value")]
REASONS = ["quoting", "columns", "value"]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _SPACES, "")


def _fails(rule: Column, value: Column) -> Column:
    return (
        F.when(rule == "open_quotes", value == OPEN)
        .when(rule == "field_count", ~value.isin(OPEN, "2", "3"))
        .when(rule == "blank", value.rlike(_BLANK))
        .when(rule == "bad_char", value.rlike(_BAD_CHAR))
        .when(rule == "not_boolean", ~F.lower(strip(value)).isin("true", "false"))
        .otherwise(F.lit(False))
    )


def parse_cells(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds `_cells`: the fields of a well quoted line without their quotes, null for any other line (a null line too)."""
    raw = F.regexp_extract_all(F.concat(F.lit("\t"), F.col(line)), F.lit(_CELL), F.lit(1))
    unquoted = F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return df.withColumn("_cells", F.when(F.col(line).rlike(WELL_QUOTED), unquoted))


def rule_table(spark: SparkSession, rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "col int, rule string, reason string")


def row_errors(df: DataFrame, key: str = "line_no", line: str = "line", rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    """(key, reason): one row for each line that cannot be loaded, with the first reason of REASONS that holds.

    A null line has no fields and fails with `columns`; an empty line is one
    empty field and does too. Keys are taken as unique; a repeated key gets one
    row. The rule table has a handful of rows and is broadcast.
    """
    return _errors(parse_cells(df.select(F.col(key).alias("_key"), F.col(line).alias("_line")), "_line"), rules).withColumnRenamed("_key", key)


def _errors(parsed: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """(_key, reason) of parsed lines (_key, _line, _cells)."""
    form = F.when(F.col("_line").isNull(), "0").when(F.col("_cells").isNull(), OPEN).otherwise(F.size("_cells").cast("string"))
    cell = lambda v, i: F.struct(i.cast("int").alias("col"), v.alias("value"))
    every = F.concat(F.array(cell(form, F.lit(LINE))), F.coalesce(F.transform("_cells", cell), F.expr("cast(array() as array<struct<col:int,value:string>>)")))
    cells = parsed.select("_key", F.explode(every).alias("c")).select("_key", "c.col", "c.value")
    checked = cells.join(F.broadcast(rule_table(parsed.sparkSession, rules)), "col").where(_fails(F.col("rule"), F.col("value")))
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    errors = checked.groupBy("_key").agg(F.min(rank).alias("_rank"))
    return errors.select("_key", F.element_at(F.array(*map(F.lit, REASONS)), F.col("_rank").cast("int")).alias("reason"))


def clean_rows(df: DataFrame, key: str = "line_no", line: str = "line", rules: list[tuple[int, str, str]] = RULES) -> DataFrame:
    """(key, name1, name2, label) of the lines without an error; names and label without surrounding spaces, label null where the line has two fields."""
    parsed = parse_cells(df.select(F.col(key).alias("_key"), F.col(line).alias("_line")), "_line")
    parsed = scratch.write(parsed.withColumn("_line", F.substring("_line", 1, 0)), "parsed").df  # parsed once; of the line only whether it is null is still asked
    cells = parsed.join(_errors(parsed, rules).select(F.col("_key").alias("_bad")), F.col("_key").eqNullSafe(F.col("_bad")), "left_anti")
    label = F.lower(strip(F.get("_cells", F.lit(2)))) == "true"
    return cells.select(F.col("_key").alias(key), strip(F.get("_cells", F.lit(0))).alias("name1"), strip(F.get("_cells", F.lit(1))).alias("name2"), label.alias("label"))
