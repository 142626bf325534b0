"""Golden values and differential checks of the scalar functions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nameloom.functions import bins, phonetics, script
from nameloom.functions import similarity as sim
from nameloom.functions import tokens as tk
from nameloom.operators import assign, features, represent


def value(spark, df_rows, schema, column):
    return [r[0] for r in spark.createDataFrame(df_rows, schema).select(column).collect()]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_winkler(a, b):
    if not a or not b:
        return 0.0
    reach = max(min(len(a), len(b)) // 2 - 1, 0)
    free, mine = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(i - reach, 0), min(i + reach, len(b) - 1) + 1):
            if free[j] and b[j] == x:
                free[j] = False
                mine.append(i)
                break
    if not mine:
        return 0.0
    theirs = [j for j, f in enumerate(free) if not f]
    m, t = len(mine), sum(a[i] != b[j] for i, j in zip(mine, theirs)) // 2
    w = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if w > 0.7:
        k = 0
        while k < min(len(a), len(b), 4) and a[k] == b[k]:
            k += 1
        w += k * 0.1 * (1 - w)
    return w


def test_levenshtein_similarity(spark):
    data = [("abc", "abc", 1.0), ("", "", 1.0), ("", "abc", 0.25), ("ab", "ba", 0.0), ("kitten", "sitting", 0.571428571), ("佛罗伦萨", "翡冷翠", 0.0), ("张伟", "张玮", 0.5), (None, "a", None)]
    got = value(spark, [d[:2] for d in data], "a string, b string", sim.levenshtein_similarity(F.col("a"), F.col("b")))
    assert got == [pytest.approx(d[2], abs=1e-9) if d[2] is not None else None for d in data]


def test_token_similarities(spark):
    data = [(["zhang", "san", "feng"], ["zhang", "shan"]), ([], ["a"]), (["a"], ["a"]), (["x"] * 3, ["x"])]
    a, b = F.col("a"), F.col("b")
    got = value(spark, data, "a array<string>, b array<string>", sim.token_levenshtein_similarity(a, b))
    assert got == [pytest.approx(x) for x in (1 / 3, 0.5, 1.0, 1 / 3)]
    got = value(spark, data, "a array<string>, b array<string>", sim.jaro_winkler(a, b))
    assert got[0] == pytest.approx(0.611111111) and got[1] == 0


def test_many_tokens_beyond_the_alphabet(spark):
    left = [f"t{i}" for i in range(1500)]
    right = left[:700] + ["other"] + left[701:]
    got = value(spark, [(left, right)], "a array<string>, b array<string>", sim.token_levenshtein_similarity(F.col("a"), F.col("b")))
    assert got == [pytest.approx(1 - 1 / 1500)]


def test_jaro_winkler(spark):
    data = [("MARTHA", "MARHTA", 0.961111111), ("dixon", "dicksonx", 0.55), ("abcd", "dabc", 0.833333333), ("ab", "ba", 0.0), ("张三丰", "张三峰", 0.822222222), ("", "a", 0.0), ("a", "a" * 30, None)]
    got = value(spark, [d[:2] for d in data], "a string, b string", sim.text_jaro_winkler(F.col("a"), F.col("b")))
    assert got == [pytest.approx(d[2] if d[2] is not None else plain_winkler(d[0], d[1]), abs=1e-9) for d in data]


def test_against_plain_versions(spark):
    r = random.Random(3)
    data = [("".join(r.choices("ab张三", k=r.randint(0, 8))), "".join(r.choices("ab张三", k=r.randint(0, 8)))) for _ in range(300)]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(data, "a string, b string")
    for (x, y), row in zip(data, df.select(F.levenshtein(a, b), sim.text_jaro_winkler(a, b), sim.longest_common_run(a, b), sim.token_levenshtein_similarity(tk.chars(a), tk.chars(b)), sim.levenshtein_similarity(a, b), sim.damerau_distance(a, b)).collect()):
        assert row[0] == plain_edits(x, y)
        assert row[1] == pytest.approx(plain_winkler(x, y), abs=1e-12)
        run = max((k for i in range(len(x)) for k in range(1, len(x) - i + 1) if x[i : i + k] in y), default=0)
        assert row[2] == pytest.approx(run / max(len(x), len(y)) if x and y else 0)
        assert row[3] == pytest.approx(row[4])
        assert row[5] <= row[0]


def test_damerau_swap(spark):
    got = value(spark, [("ab", "ba"), ("abcd", "acbd"), (None, "a")], "a string, b string", sim.damerau_distance(F.col("a"), F.col("b")))
    assert got == [1, 1, None]


def test_bins(spark):
    data = [(0.0,), (0.05,), (0.1,), (0.3,), (1 - 0.7,), (0.95,), (1.0,), (None,)]
    got = value(spark, data, "v double", bins.binarize(F.col("v")))
    assert got == [[], [0, 1], [0, 1], [2, 3], [3, 4], [9, 10], [9, 10], []]
    assert value(spark, [(0.25,), (None,)], "v double", bins.cumulative(F.col("v"), 1)) == [[1, 2, 3], []]


def test_grams(spark):
    got = value(spark, [("abc",), ("",), (None,)], "s string", tk.gram_union(tk.chars(F.col("s"))))
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], [], None]
    bag = value(spark, [("aba",)], "s string", tk.gram_bag(tk.chars(F.col("s")), (1,)))
    assert bag == [{"a": 2, "b": 1}]
    rates = features.overlap_rates(tk.chars(F.col("a")), tk.chars(F.col("b")))
    assert value(spark, [("abc", "abd")], "a string, b string", F.array(*rates)) == [[pytest.approx(0.5), pytest.approx(1 / 3), 0.0]]


def test_segments():
    mapping = {"A": "[A]", "AB": "[AB]", "BC": "[BC]", "BCD": "[BCD]"}
    expect = {"ABC": "[AB]C", "ABCD": "[A][BCD]", "B": "B", "BX": "BX", "XAB": "X[AB]", "": ""}
    assert {k: script.segment(k, mapping, 3) for k in expect} == expect


def test_conversion(spark):
    df = spark.createDataFrame([("張三豐",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(script.convert(F.col("s"), {"張": "张", "豐": "丰"})).collect()] == ["张三丰", "", None]
    assert [r[0] for r in df.select(script.convert(F.col("s"), {"張三": "X", "豐": "丰"})).collect()] == ["X丰", "", None]
    assert [r[0] for r in df.select(script.transliterate(F.col("s"), {"張": "zhang", "張三": "zs"})).collect()] == ["zs豐", "", None]


LEXICON = [("张", "zhang1", "zoeng1"), ("三", "san1", "saam1"), ("丰", "feng1", "fung1"), ("安", "an1", "on1"), ("吴", "wu2", "ng4"), ("儿", "er2", ""), ("行", "hang2,xing2", None), ("空", "", "")]


def test_phonetics(spark):
    lx = phonetics.Lexicon(LEXICON)
    df = spark.createDataFrame([("张三丰",), ("安",), ("儿",), ("吴",), ("Q",), ("行",), ("空",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(phonetics.syllables(F.col("s"), lx)).collect()] == [["zhang", "san", "feng"], ["an"], ["er"], ["wu"], [], ["hang"], [], [], None]
    assert [r[0] for r in df.select(phonetics.phonemes(F.col("s"), lx)).collect()][:3] == [["zh", "ang", "s", "an", "f", "eng"], ["a", "n"], ["e", "r"]]
    assert [r[0] for r in df.select(phonetics.phonemes(F.col("s"), lx, "cantonese")).collect()][2:4] == [["e", "r"], ["ng"]]
    assert [r[0] for r in df.select(phonetics.pronounce(F.col("s"), lx)).collect()][5] == "hang"


def test_surnames_and_lengths(spark):
    data = [("张三", "张四"), ("欧阳明", "欧阳清"), ("Q三", "Q四"), ("", ""), ("甲", "乙")]
    got = value(spark, data, "a string, b string", features.surname_ids(F.col("a"), F.col("b"), ["张", "欧阳"]))
    assert got == [[1, 2], [1, 2], [1], [], []]
    assert value(spark, [("a" * 9, "a"), ("", "")], "a string, b string", features.length_id(F.col("a"), F.col("b"))) == [[6], [1]]


def test_offsets():
    assert features.FeatureConfig(17).offsets() == {"overlap": 1, "surname": 69, "length": 71, "distance": 77, "grams": 88}
    assert features.FeatureConfig(6).offsets() == {"surname": 1, "length": 3, "distance": 9, "grams": 20}
    with pytest.raises(ValueError):
        features.FeatureConfig(18)


def test_modes(spark):
    lx, a, b = phonetics.Lexicon(LEXICON), F.col("a"), F.col("b")
    df = spark.createDataFrame([("张三", "張三"), ("Q", "R")], "a string, b string")
    score = lambda m, **k: [r[0] for r in df.select(represent.mode_score(m, a, b, "levenshtein", lx, {"張": "张"}, **k)).collect()]
    assert score("original") == [0.5, 0.0]
    assert score("simplified")[0] == 1.0 and score("pinyin")[0] == 1.0
    assert score("pronun1")[1] == 1.0 and score("pronun1", strict=True)[1] == 0.0
    with pytest.raises(ValueError):
        represent.mode_score("unknown", a, b, "levenshtein")


def brute(m):
    from itertools import permutations

    m = np.array(m, float)
    if m.shape[0] > m.shape[1]:
        m = m.T
    return min(sum(m[i, j] for i, j in enumerate(p)) for p in permutations(range(m.shape[1]), m.shape[0]))


@pytest.mark.parametrize("matrix,total", [([[400, 150, 400], [400, 450, 600], [300, 225, 300]], 850), ([[400, 150, 400, 1], [400, 450, 600, 2], [300, 225, 300, 3]], 452), ([[10, 10, 8], [9, 8, 1], [9, 7, 4], [3, 2, 8]], 11), ([[10, 10, 8, 11], [9, 8, 1, 1], [9, 7, 4, 10]], 15), ([[5, 9, 1], [10, 3, 2], [8, 7, 4]], 12)])
def test_assignment_totals(matrix, total):
    m = np.array(matrix, float)
    assert sum(m[i, j] for i, j in assign.solve(m)) == total


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.randoms(use_true_random=False))
def test_assignment_is_optimal(n, m, r):
    c = np.array([[r.randint(0, 6) / 2 for _ in range(m)] for _ in range(n)])
    pairs = assign.solve(c)
    assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    assert sum(c[i, j] for i, j in pairs) == pytest.approx(brute(c))


def test_aligned_pairs(spark):
    df = spark.createDataFrame([("abc", "abd"), ("a", ""), ("xy", "x")], "a string, b string")
    out = features.aligned_gram_pairs(df, tk.chars(F.col("a")), tk.chars(F.col("b")), "g").collect()
    got = {r.a: sorted(r.g) for r in out}
    assert got["a"] == ["a--"] and "x--x" in got["xy"] and len(got["xy"]) == 3
    assert len(got["abc"]) == 6 and "a--a" in got["abc"] and "a b--a b" in got["abc"]
