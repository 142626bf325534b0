"""Per-document text statistics, all in built-in expressions (problem 10).

`with_stats` adds one struct column; nothing is shuffled and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Very common words of English, German and French.
COMMON_LATIN = (
    "the of and was were that to in is are which who with for about so even but not never only more than as when if had has have been it on at by from this his her their they we he she you there no any some all would could what where why how before after then into out up over nobody my your me him us our one two can will do did be an or i"
    " der die das und war hatte dass zu ist mit von für nur mehr als auch den dem des ein eine nicht über wir uns sich wie es im an auf bei nach vor aus so man wenn nie wieder am zum zur sie er wurde konnte viele selbst warum wo aber niemand noch schon ohne während sind sein ihr ihre"
    " le la les de du et que qui dans en pour avec plus une un ne pas était avait est sont nous il elle ils sur au aux ce cette se mais comme par même si jamais à où on tout tous son sa ses leur encore personne était étaient avaient fait après avant"
).split()
# Very common words of two or three characters of Chinese.
COMMON_HAN = "没有 我们 他们 你们 大家 因为 所以 可是 但是 不过 什么 怎么 那么 这么 一起 附近 正是 就是 还是 不是 不会 不能 可以 告诉 知道 觉得 已经 现在 时候 自己 这个 那个 一个 如果 虽然 以后 以前 之前 之后 然后 而且 或者 起来 出来 留下 再也 到处 从前 另外 相信 也说 还要 却还 只有 只是 有人 的人 人说 一回 谈起 谈到 想到 哪里 为什 要不 遇见 放在 件事 中的 里的 了一 的是 也不 都是 不知 看见 听说 开始 最后 今天 昨天 明天 晚上 早上 今年 去年".split()
# Function characters of Chinese.
FUNCTION_HAN = "的了在是和有就不也而把被到从比还都很这那个们着过为与及或"



def _any_of(words: list[str]) -> str:
    """A pattern for any of the words that looks at each character once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    some = [h + (_any_of(rest) if rest != [""] else "") for h, rest in heads.items() if h]
    return f"(?:{'|'.join(some)}){'?' if '' in heads else ''}"


_WORD = r"[\p{L}&&[^\p{IsHan}]][\p{L}\p{M}'’&&[^\p{IsHan}]]*"
_HAN = r"\p{IsHan}"
_COMMON = rf"(?<![\p{{L}}\p{{M}}]){_any_of(COMMON_LATIN)}(?![\p{{L}}\p{{M}}])"
_COMMON_HAN = _any_of(COMMON_HAN)
_END = r"[.!?。！？…][\"'”’»)）」』]*$"
_MARK = r"^\s*(?:[-*•·–—▪◦‣+]|\(?\d{1,3}[.)、．])\s"

#: Names of the statistics, in order.
STATS = ["n_chars", "n_words", "n_lines", "mean_word_len", "mean_line_len", "symbol_ratio", "digit_ratio", "separator_ratio", "end_punct_share", "marked_share", "common_share", "function_share", "prose_share", "stop_rate", "comma_rate", "distinct_share"]


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _per_line(x: Column) -> Column:
    """Of a line: words, Han characters, common words, common Han words, length."""
    return F.array(_count(x, _WORD), _count(x, _HAN), _count(x, _COMMON), _count(x, _COMMON_HAN), F.length(x).cast("double"))


def _sum_lines(counts: Column) -> Column:
    """The sums of _per_line over all lines, then the characters in lines that read as sentences."""
    reads = lambda x: ((x[0] >= 4) & (x[2] >= 0.2 * x[0])) | ((x[1] >= 6) & (x[3] * 25 >= x[1]))
    zero = F.array(*[F.lit(0.0)] * 6)
    return F.aggregate(counts, zero, lambda s, x: F.array(*(s[i] + x[i] for i in range(5)), s[5] + F.when(reads(x), x[4]).otherwise(F.lit(0.0))))


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of STATS (doubles); columns of these names are replaced. Null and empty texts give zeros.

    A word is a run of letters, in Han script a character. symbol_ratio: marks
    that are neither letter, digit, space nor common punctuation; separator_ratio:
    tabs, bars, slashes and angle brackets; end_punct_share: lines that end a
    sentence; marked_share: lines with a list mark or number; common_share: words
    among the common ones; function_share: Han characters that are function words;
    prose_share: characters in lines that read as sentences by their common words;
    stop_rate and comma_rate: sentence ends and commas a word; distinct_share:
    different words among the words.
    """
    keep = [c for c in df.columns if c not in STATS]
    # each step stands in a projection of its own, so what later steps share is computed once
    step = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    step = step.select(*keep, "_t", F.lower("_t").alias("_low"))
    step = step.select(*keep, "_t", "_low", F.filter(F.split("_low", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0).alias("_lines"))
    step = step.select(*keep, "_t", "_low", "_lines", _sum_lines(F.transform("_lines", _per_line)).alias("_sum"))
    tokens = F.regexp_extract_all("_low", F.lit(rf"({_WORD}|{_HAN}{{2}})"), F.lit(1))
    t, lines = F.col("_t"), F.col("_lines")
    step = step.select(*keep, "_t", "_lines", "_sum", tokens.alias("_tokens"), _count(t, r"[\p{L}\p{M}]").alias("_letters"))
    latin, han, in_lines, in_prose = F.col("_sum")[0], F.col("_sum")[1], F.col("_sum")[4], F.col("_sum")[5]
    words, common = latin + han, F.col("_sum")[2] + 2 * F.col("_sum")[3]
    chars, n_lines = F.length(t).cast("double"), F.size(lines).cast("double")
    share = lambda p: _ratio(F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(p))).cast("double"), n_lines)
    values = [
        chars, words, n_lines,
        _ratio(F.col("_letters") - han, latin), _ratio(in_lines, n_lines),
        _ratio(_count(t, r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()，。；：！？、“”‘’„«»（）《》–—-]"), chars),
        _ratio(_count(t, r"\p{N}"), chars), _ratio(_count(t, r"[\t|/>→\\]"), words),
        share(_END), share(_MARK), _ratio(common, words), _ratio(_count(t, f"[{FUNCTION_HAN}]"), han),
        _ratio(in_prose, in_lines), _ratio(_count(t, r"[.!?。！？]"), words), _ratio(_count(t, r"[,，、;；]"), words),
        _ratio(F.size(F.array_distinct("_tokens")).cast("double"), F.size("_tokens").cast("double")),
    ]
    return step.select(*keep, *(v.alias(n) for v, n in zip(values, STATS)))
