"""Pair lists, evaluation, ordered operations, row checks, skew-safe joins, sources and the classifier."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from nameloom import api
from nameloom.functions.phonetics import Lexicon
from nameloom.operators import evaluate, features, model, ordered, pairs, rowcheck, scratch, skew
from nameloom.plans import queries
from nameloom.sources import files

SCORED = "ord bigint, name1 string, label boolean, score double, prediction boolean"
FIXTURE = [(0, "A", True, 0.9), (1, "A", False, 0.9), (2, "A", False, 0.1), (3, "B", True, 0.2), (4, "B", False, 0.8), (5, "B", False, 0.1), (6, "C", True, 0.0), (7, "C", False, 0.0), (8, "D", True, 0.7)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(*r, r[3] > 0.5) for r in FIXTURE], SCORED)


def test_rank_eval(scored):
    r = evaluate.rank_eval(scored).first()
    assert (r.groups, r.hits1, r.hits2, r.hits3, r.mrr) == (4, pytest.approx(0.3), pytest.approx(0.6), pytest.approx(0.65), pytest.approx(0.51225))
    assert {x.name1 for x in evaluate.rank_errors(scored).collect()} == {"B", "C", "D"}


def test_f1_eval(scored):
    r = evaluate.f1_eval(scored).first()
    assert (r.precision, r.recall, r.f1) == (pytest.approx(0.5), pytest.approx(0.5), pytest.approx(0.5))


def test_f1_stops_at_first_false(spark):
    df = spark.createDataFrame([(0, "a", True, 0.9, False), (1, "a", True, 0.8, True), (2, "b", True, 0.7, True), (3, None, None, None, None)], SCORED)
    r = evaluate.f1_eval(df).first()
    assert (r.groups, r.predicted, r.correct) == (3, 1, 1)


def test_thresholds(scored, spark):
    assert evaluate.thresholds(0.3, 3) == [0.0, 0.3 / 3, 0.3 / 3 + 0.3 / 3]
    rows = evaluate.threshold_search(scored, 10).collect()
    assert len(rows) == 10 and sum(r.best for r in rows) == 1
    best = next(r for r in rows if r.best)
    assert best.f1 == max(r.f1 for r in rows) and best.threshold == min(r.threshold for r in rows if r.f1 == best.f1)
    zero = evaluate.threshold_search(spark.createDataFrame([(0, "a", True, -1.0, True)], SCORED), 4).collect()
    assert {r.threshold for r in zero} == {0.0}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCORED)
    assert evaluate.rank_eval(none).first().groups == 0
    assert evaluate.f1_eval(none).first().f1 == 0
    assert evaluate.topk_eval(none).first().groups == 0
    assert evaluate.threshold_eval(none, 0.5).first().groups == 0
    assert len(evaluate.threshold_search(none, 5).collect()) == 5
    empty = spark.createDataFrame([], "ord bigint, name1 string, name2 string, label boolean")
    for f in (pairs.all_pairs, pairs.random_pairs, pairs.confused_pairs):
        assert f(empty).count() == 0
    assert pairs.kfold_blocks(empty, F.col("ord")).count() == 0
    assert rowcheck.row_errors(spark.createDataFrame([], "line_no bigint, line string")).count() == 0


def test_topk_and_walk(scored):
    r = evaluate.topk_eval(scored, 1).first()
    assert (r.groups, r.hits, r.not_in_top) == (4, pytest.approx(0.75), 1)
    w = evaluate.threshold_eval(scored, 0.5).first()
    # A is met at 1 and its walk ends at 3; B only after the end at 2; C after the end at 1; D at 1
    assert (w.precision, w.recall, w.not_in_top) == (pytest.approx(0.5), pytest.approx((1 / 3 + 1) / 4), 2)
    assert w.mrr == pytest.approx((1 + 1 / 2 + 1 + 1) / 4)


def test_ordered(spark):
    r = random.Random(1)
    data = [(i, r.choice([None, 1, 2, 3]), r.choice("ab")) for i in r.sample(range(1000), 300)]
    df = spark.createDataFrame(data, "ord bigint, v bigint, extra string").repartition(5)
    want = sorted(data)
    assert [(x.ord, x.idx) for x in ordered.dense_index(df, F.col("ord")).orderBy("ord").collect()] == [(d[0], i) for i, d in enumerate(want)]
    total, sums = 0, []
    for d in want:
        total += d[1] or 0
        sums.append(total)
    assert [x.total for x in ordered.running_sum(df, "v", F.col("ord")).orderBy("ord").collect()] == sums
    assert [x.prev for x in ordered.previous(df, "v", F.col("ord")).orderBy("ord").collect()] == [None, *[d[1] for d in want[:-1]]]
    ranks = {x.ord: x.rk for x in ordered.ranked(df, "extra", F.col("v").desc(), F.col("ord")).collect()}
    for g in "ab":
        for i, d in enumerate(sorted((d for d in want if d[2] == g), key=lambda d: (-(d[1] if d[1] is not None else -1), d[0])), 1):
            assert ranks[d[0]] == i


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join(spark, rows, how):
    left = spark.createDataFrame([("hot", i) for i in range(400)] + [("k1", 1), ("k1", 2), ("gone", 3), (None, 4)], "k string, v bigint")
    right = spark.createDataFrame([("hot", "x"), ("k1", "y"), ("more", "z")], "k string, w string")
    got = skew.salted_join(left, right, "k", left.count(), F.col("v"), how, salts=4, share=0.1, floor=10)
    want = left.join(right, "k", how)
    assert rows(got.select(*want.columns)) == rows(want)
    assert skew.hot_keys(left, "k", left.count(), 0.1, 10).count() == 1


def test_orient_and_dedup(spark, rows):
    df = spark.createDataFrame([(1, "張三", "张三"), (2, "张三", "X"), (3, "张三", "Y"), (4, None, "Z"), (5, "李", None)], "ord bigint, name1 string, name2 string")
    out = pairs.orient(df, "張")
    assert [r.name1 for r in out.orderBy("ord").collect()] == ["张三", "张三", "张三", None, "李"]
    assert [r.ord for r in pairs.dedup_consecutive(out, F.col("ord")).orderBy("ord").collect()] == [1, 4, 5]


def test_noise_and_split(spark):
    df = spark.createDataFrame([(i, n, "张") for i, n in enumerate(["abc -1", "国家列表", "维基百科", "张三", "", None, "é", "a\n"])], "ord bigint, name1 string, name2 string")
    assert [r.ord for r in pairs.noise_filter(df).orderBy("ord").collect()] == [3, 6, 7]
    split = [r.fold_split for r in pairs.modulo_split(spark.range(7).select(F.col("id").alias("ord")), F.col("ord")).orderBy("ord").collect()]
    assert split == ["train", "train", "train", "dev", "test", "train", "train"]


def plain_similar(a, b):
    from tests.test_functions import plain_edits

    return a == b or bool(a and b and plain_edits(a, b) < max(len(a), len(b))) or (not a) != (not b)


def test_confused_pairs(spark):
    r = random.Random(5)
    data = [(i * 3, "".join(r.choices("abcdef", k=r.randint(1, 4))), "".join(r.choices("abcdefgh", k=r.randint(1, 4)))) for i in range(120)]
    df = spark.createDataFrame(data, "ord bigint, name1 string, name2 string")
    got = {}
    for x in pairs.confused_pairs(df, 10, top_up=False, first_block=16).collect():
        got.setdefault(x.ord, []).append((not x.label, x.target_ord))
    for o, a, b in data:
        want = [t for t, _, c in data if t != o and c != a and c != b and plain_similar(a, c)][:10]
        assert sorted(got[o]) == [(False, o), *[(True, t) for t in want]]
    full = pairs.confused_pairs(df, 10).groupBy("ord").agg(F.count("*").alias("n"), F.countDistinct("target_ord").alias("d"))
    assert {(x.n, x.d) for x in full.collect()} == {(11, 11)}


def test_random_pairs(spark):
    df = spark.createDataFrame([(i, f"a{i}", f"b{i}") for i in range(40)], "ord bigint, name1 string, name2 string")
    per = pairs.random_pairs(df).groupBy("ord").agg(F.count("*").alias("n"), F.countDistinct("name2").alias("d"))
    assert {(x.n, x.d) for x in per.collect()} == {(11, 11)}
    assert pairs.random_pairs(df.limit(4)).count() == 4 * 4


def plain_reason(line):
    """The rules for a line, read character by character."""
    import unicodedata

    cells, i = [], 0
    while line is not None:
        if line[i : i + 1] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= len(line):
                    return "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    break
                cell, i = cell + line[i], i + 1
            i += 1
            if i < len(line) and line[i] != "\t":
                return "quoting"
        else:
            end = line.find("\t", i)
            end = len(line) if end < 0 else end
            cell, i = line[i:end], end
        cells.append(cell)
        if i >= len(line):
            break
        i += 1
    if not 2 <= len(cells) <= 3:
        return "columns"
    bad = lambda s: not s.strip() or any(c == "�" or c != "\t" and unicodedata.category(c) == "Cc" for c in s)
    if bad(cells[0]) or bad(cells[1]) or len(cells) == 3 and cells[2].strip().lower() not in ("true", "false"):
        return "value"
    return None


def test_row_errors(spark):
    r = random.Random(11)
    lines = [None, "", "\t", '"', '""', '"a"\tb', 'a\t"b""c"', 'a\t"b"c', "a\tb\t TRUE ", "a\tb\tx", "a\tb\t", "a\t　\ttrue", "a\tb\x07", "a\tb�\tfalse", 'a"b\tc', "a\tb\ttrue\t", '"a\tb"\tc', "a\tb\nc", '"' + "x" * 200_000 + '"\tb', '"' + '""' * 100_000 + "\tb"]
    lines += ["".join(r.choices('ab"\t \ntrue', k=r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string").withColumn("reason", F.lit("clash"))
    got = {x.line_no: x.reason for x in rowcheck.row_errors(df).collect()}
    assert got == {i: w for i, x in enumerate(lines) if (w := plain_reason(x))}
    clean = {x.line_no: x for x in rowcheck.clean_rows(df).collect()}
    assert set(clean) == set(range(len(lines))) - set(got)
    assert (clean[6].name2, clean[8].label, clean[5].label) == ('b"c', True, None)


def test_files(spark, tmp_path):
    text = tmp_path / "in.tsv"
    text.write_text("张三\t張三\tTrue\n a \t b \nx\ty\tfalse\textra\n", encoding="utf-8")
    df = files.read_pairs(spark, str(text))
    assert [tuple(r) for r in df.orderBy("ord").collect()] == [(0, "张三", "張三", True), (1, "a", "b", None), (2, "x", "y", False)]
    files.write_pairs(df.where("label is not null"), str(tmp_path / "out"))
    assert files.read_pairs(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="no label"):
        files.parse_pairs(spark.createDataFrame([("a\tb\tmaybe", 0)], "line string, ord bigint")).collect()
    raw = tmp_path / "raw.txt"
    raw.write_text("a b\nc\td\n x  y z\nq\n", encoding="utf-8")
    assert [(r.name1, r.name2) for r in files.read_raw(spark, str(raw)).orderBy("ord").collect()] == [("a", "b"), ("c", "d")]
    (tmp_path / "t.txt").write_text("张三 zhang san\n张 a\n张 b\nnospace\n", encoding="utf-8")
    assert {r.key: r.value for r in files.read_transliterations(spark, str(tmp_path / "t.txt")).collect()} == {"张三": "zhang san", "张": "b", "nospac": "nospace"}


def test_error_log(spark, rows):
    log = spark.createDataFrame([("error term a x", 0), ("Selected threshold 1", 1), ("error term b", 2), ("error term b", 3), ("other", 4)], "line string, ord bigint")
    assert rows(evaluate.log_runs(log)) == [(0, "a"), (1, "b")]
    assert rows(evaluate.error_diff(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string"), "k")) == [("a", "first"), ("c", "second")]


def test_sigmoid(spark):
    got = spark.createDataFrame([(0.3,), (1000.0,), (-1000.0,)], "s double").select(model.probability(F.col("s"))).collect()
    assert [r[0] for r in got] == [pytest.approx(0.645656306), 1.0, 0.0]


def test_classifier(spark, tmp_path):
    lx = Lexicon([(c, s, None) for c, s in (("张", "zhang1"), ("三", "san1"), ("山", "shan1"), ("李", "li3"), ("四", "si4"), ("王", "wang2"), ("五", "wu3"))])
    good = [("张三", "张三"), ("张三", "张山"), ("李四", "李四"), ("王五", "王五"), ("王三", "王山")] * 3
    wrong = [("张三", "李四"), ("李四", "王五"), ("王五", "张山"), ("王三", "李四"), ("张四", "王五")] * 3
    df = spark.createDataFrame([(i, a, b, i < 15) for i, (a, b) in enumerate(good + wrong)] + [(98, "Q", "Q", True), (99, None, "张", False)], "ord bigint, name1 string, name2 string, label boolean")
    m = model.NameMatcher(features.FeatureConfig(17, False), lx, {}, ["张"])
    m.train(df, penalty=1.0)
    out = {r.ord: r for r in m.score(df).collect()}
    assert len(out) == 32 and all(out[i].prediction == (i < 15) for i in range(30))
    assert out[98].score == 0.0 and out[99].score == 0.0 and not out[99].prediction
    m.save(str(tmp_path / "m"))
    again = {r.ord: r.score for r in api.score_pairs(df, str(tmp_path / "m")).collect()}
    assert again == {k: pytest.approx(v.score) for k, v in out.items()}
    cv = model.cross_validate(m.features_of(df).where(F.size("features") > 0), m.size, [(1.0, 2.0)], folds=3, iterations=10).first()
    assert cv.auc > 0.8


def small_tables(spark, path):
    rows = [(0, "张三", "张山", True, "train"), (1, "张三", "李四", False, "train"), (2, "张三", "张山", None, "train"), (3, "王五", "王五", True, "dev"), (4, "王五", "李四", False, "dev"), (5, "王三", "张三山", None, "test"), (6, None, "王", True, "dev"), (7, "", "王", True, "test")]
    spark.createDataFrame(rows, "ord bigint, name1 string, name2 string, label boolean, split string").write.parquet(f"{path}/pairs.parquet")
    said = [(c, s, None) for c, s in (("张", "zhang1"), ("三", "san1"), ("山", "shan1"), ("李", "li3"), ("四", "si4"), ("王", "wang2"), ("五", "wu3"))]
    spark.createDataFrame(said, "ch string, mandarin string, cantonese string").write.parquet(f"{path}/readings.parquet")
    spark.createDataFrame([("张", "張")], "simplified string, traditional string").write.parquet(f"{path}/variant_chars.parquet")
    spark.createDataFrame([("张",)], "surname string").write.parquet(f"{path}/surnames.parquet")
    return str(path), rows


def test_align_cost_of_every_row(spark, tmp_path):
    path, data = small_tables(spark, tmp_path)

    def grams(s):
        return list(dict.fromkeys(" ".join(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)))

    def cost(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1] / max(len(x), len(y))

    want = {}
    for o, a, b, *_ in data:
        if a is not None and b is not None:
            short, long = sorted((grams(a), grams(b)), key=len)
            want[o] = pytest.approx(min(sum(map(cost, short, p)) for p in permutations(long, len(short))), abs=1e-6)
    assert {r.ord: r.total for r in queries.queries()["align_cost"](spark, path).collect()} == want


def test_aligned_counts_have_unlabelled_rows(spark, tmp_path):
    path, _ = small_tables(spark, tmp_path)
    got = {r.pair: r.cnt for r in queries.queries()["aligned_feature_dict"](spark, path).collect()}
    # 张三/张山 stands once with label true and once without label
    assert got["三--山"] == 2 and got["张 三--张 山"] == 2 and not any("李" in p for p in got)
    ids = {r.ord: r.ids for r in queries.queries()["feature_ids_aligned"](spark, path).collect()}
    every = {r.ord: r.ids for r in queries.queries()["feature_ids"](spark, path).collect()}
    assert set(ids) == set(every) and ids[0] and ids[0] == ids[2] and len(ids[0].split()) < len(every[0].split())


def test_grid_is_whole(spark, tmp_path, monkeypatch):
    path, _ = small_tables(spark, tmp_path)
    fit, asked, one = model.fit_sparse, [], []

    def noted(df, penalty, weight, iterations):
        asked.append((penalty, weight, iterations))
        one[:] = one or [fit(df, penalty, weight, 1)]
        return one[0]

    monkeypatch.setattr(model, "fit_sparse", noted)
    got = queries.queries()["svm_grid"](spark, path).collect()
    points = [(0.000625 * 5.0**i, w) for i in range(-4, 5) for w in (2.0, 4.0, 6.0, 8.0, 10.0)]
    assert asked == [(p, w, 60) for p, w in points] and [(r.penalty, r.weight) for r in got] == points


def test_function_matcher_and_sql(spark):
    df = spark.createDataFrame([(0, "ab", "ab"), (1, "ab", "xy"), (2, None, "a")], "ord bigint, name1 string, name2 string")
    out = {r.ord: (r.score, r.prediction) for r in api.FunctionMatcher(mode="original").score(df).collect()}
    assert out == {0: (1.0, True), 1: (0.0, False), 2: (None, False)}
    api.register_sql(spark)
    assert spark.sql("SELECT name_similarity('', 'abc'), name_damerau('ab', 'ba')").first()[:] == (0.25, 1)


def test_scope_drops_tables(spark):
    with scratch.scope():
        a, b = scratch.write(spark.range(3), "a"), scratch.write(spark.range(3), "b").keep()
    assert a.dropped and not b.dropped and b.df.count() == 3


def test_assignments_at_once_are_those_one_by_one():
    import numpy as np

    from nameloom.operators import assign

    draw = np.random.default_rng(3)
    rows = draw.integers(0, 7, 200)
    columns = np.array([draw.integers(n, 9) for n in rows])
    cost = np.full((200, 6, 8), np.inf)
    for c, n, m in zip(cost, rows, columns):
        c[:n, :m] = 1.0 - (1.0 - draw.integers(0, 6, (n, m)) / draw.choice([3.0, 5.0], (n, m)))
    got = assign.solve_all(cost, rows)
    assert [sorted((int(i), j) for j, i in enumerate(g) if i >= 0) for g in got] == [assign.solve(c[:n, :m]) for c, n, m in zip(cost, rows, columns)]


def test_align_cost_is_fast(spark, tmp_path):
    """Solved one by one 12,000 rows of such names take half a minute and more of one core."""
    import time

    from nameloom.operators import batches

    texts = ["".join(chr(0x4E00 + (i * 7 + k * 31) % 97) for k in range(9)) + " Li" * (i % 2) for i in range(12_000)]
    began = time.process_time()
    totals = batches.align_totals(texts, texts[1:] + texts[:1])
    assert time.process_time() - began < 20 and len(totals) == 12_000 and totals.min() > 0
    assert batches.align_totals(["ab", "", "a b", "--"], ["ab", "x", "a b", "--"]).tolist() == [0.0, 0.0, 0.0, 0.0]


ODD = [(0, "张三", "张山", True), (1, "张三", "李四-", False), (2, "张三 四", "张山 -", None), (3, "-三", "三", True), (4, "三", "-三", True), (4, "王五", "李四", True), (5, "王三", None, True), (None, "张三", "张山", True), (6, "xyz", "张", True), (7, "", "王", True), (8, "張三" * 30, "张三山", None)]
ODD_LEXICON = [(c, s, None) for c, s in (("张", "zhang1"), ("張", "zhang1"), ("三", "san1"), ("山", "shan1"), ("李", "li3"), ("四", "si4"), ("王", "wang2"), ("五", "wu3"))]


@pytest.mark.parametrize("align", [False, True])
def test_features_in_arrays_are_those_of_expressions(spark, align, monkeypatch):
    """Dictionary and ids equal those of the expressions, and no row of a gram pair is joined or moved, however large the dictionary."""
    from nameloom.operators import represent

    df = spark.createDataFrame(ODD, "ord bigint, name1 string, name2 string, label boolean")
    lx, simple, known = Lexicon(ODD_LEXICON), {"張": "张"}, ["张", "王"]
    m = model.NameMatcher(features.FeatureConfig(17, align), lx, simple, known)
    m.learn(df)
    rows = scratch.write(represent.represent(df, lx, simple), "rows").df
    rows = rows.where(represent.has_sounds(rows))
    want = features.pair_dictionary(rows, m.config)
    assert sorted((r.pair, r.cnt, r.id) for r in m.dictionary.collect()) == sorted((r.pair, r.cnt, r.id) for r in want.collect())
    found = {r.ord: r.features for r in features.extract(rows, "ord", m.config, known, want).collect() if r.ord is not None}
    assert sorted((str(r.ord), r.features) for r in m.features_of(df).collect()) == sorted((str(o), found.get(o, [])) for o, *_ in ODD)
    monkeypatch.setattr(features, "SENT_ENTRIES", 0)
    plan = m.features_of(df.where("ord <> 4"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange") == 1


def drawn_rows(count, size, seed=5):
    """(label, features) with columns that stand in the same rows."""
    import numpy as np

    draw = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        label = bool(draw.random() < 0.3)
        ids = set((draw.integers(1, size // 2, 6) + (size // 4 if label else 0)).tolist()) | {size - 1, size}
        rows.append((label, sorted(ids)))
    return rows


def test_fit_reaches_the_minimum(spark):
    """The objective of the model, from its weights and the rows, is no worse than that of Spark's own classifier, for easy and hard penalties."""
    import numpy as np

    rows = drawn_rows(300, 80)
    kept = model.TrainingRows.of(spark.createDataFrame([*rows, (None, [1, 2])], "label boolean, features array<int>"), 80)

    def objective(m, penalty, weight):
        w, y = m.coefficients.toArray(), np.array([1.0 if label else -1.0 for label, _ in rows])
        f = np.array([w[np.array(ids) - 1].sum() for _, ids in rows]) + m.intercept
        assert w[78] == pytest.approx(w[79])
        return w @ w / 2 + penalty * (np.where(y > 0, weight, 1.0) * np.maximum(0, 1 - y * f)).sum()

    for penalty, weight in ((0.0001, 2.0), (0.01, 4.0), (1.0, 10.0)):
        mine, theirs = model.fit_sparse(kept, penalty, weight).model, model._fit_over_all(kept, penalty, weight, 60).model
        assert objective(mine, penalty, weight) <= objective(theirs, penalty, weight) * 1.001


def test_fit_takes_few_jobs(spark):
    """A job for each step and fit, as before, took most of the time."""
    df = spark.createDataFrame(drawn_rows(200, 60), "label boolean, features array<int>")
    spark.sparkContext.setJobGroup("one fit", "")
    m = model.fit(df, 60, 0.01, 4.0)
    dev = df.selectExpr("monotonically_increasing_id() AS ord", "cast(features[0] % 20 AS string) AS name1", "label", "features")
    spark.sparkContext.setJobGroup("grid", "")
    best, point, results = model.search(df, dev, 60, iterations=20)
    spark.sparkContext.setJobGroup("rest", "")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    assert m.numFeatures == 60 and len(jobs("one fit")) < 15 and len(jobs("grid")) < 60
    for i in (0, 22, 44):
        p, w, mrr = results[i]
        want = evaluate.rank_eval(model.decide(dev, model.fit(df, 60, p, w, 20))).first()["mrr"]
        assert mrr == pytest.approx(want)
    assert max(r[2] for r in results) == next(r[2] for r in results if r[:2] == point) and best.model.numFeatures == 60


def test_points_share_each_pass(spark):
    """Each point went over all rows by itself, and each gradient over all rows with a loss."""
    from nameloom.operators import linear

    path = model.TrainingRows.of(spark.createDataFrame(drawn_rows(300, 80), "label boolean, features array<int>"), 80).table.path
    rows = linear.Rows(path, 80)
    times_columns, add_rows, passes, read = rows.times_columns, rows.add_rows, [], []
    rows.times_columns = lambda vectors: passes.append(len(vectors)) or times_columns(vectors)
    rows.add_rows = lambda to, c: read.append(int((c != 0).sum())) or add_rows(to, c)
    points = [(0.01, 4.0, 60), (1.0, 10.0, 60)]
    both = linear.solve(rows, points)
    assert passes[0] == 2 and len(passes) <= 60 and sum(read) < 300 * len(read) / 4
    for point, (weights, intercept, objective) in zip(points, both):
        alone = linear.solve(rows, [point])[0]
        assert (weights.tolist(), intercept, objective) == (alone[0].tolist(), *alone[1:])
    linear.Rows.forget(path)


def test_weights_stay_with_the_executors(spark, tmp_path, monkeypatch):
    """Training and scoring brought all weights to the driver, and sent them from there."""
    path, _ = small_tables(spark, tmp_path)
    want = {r.ord: r.score for r in queries.queries()["svm_train_score"](spark, path).collect()}

    def held(fit):
        raise AssertionError("the driver holds the weights")

    monkeypatch.setattr(model.Fit, "model", property(held))
    monkeypatch.setattr(model, "WEIGHTS_LIMIT", 0)
    monkeypatch.setattr(model.linear, "PART", 2)
    got = {r.ord: r.score for r in queries.queries()["svm_train_score"](spark, path).collect()}
    assert got == want and len({*got.values()}) > 1


def test_search_holds_little_by_column(spark, monkeypatch):
    """More than 500 million ids went to Spark's classifier, whose vectors fill the driver; a search held 120 bytes a column and point."""
    import tracemalloc

    import numpy as np

    from nameloom.operators import linear

    draw = np.random.default_rng(2)
    drawn = [(i % 3 == 0, (np.flatnonzero(draw.random(200_000) < 0.3) + 1).tolist()) for i in range(40)]
    kept = model.TrainingRows.of(spark.createDataFrame(drawn, "label boolean, features array<int>"), 200_000)
    rows = linear.Rows(kept.table.path, 200_000)
    assert len(rows.times) > 190_000
    tracemalloc.start()
    linear.solve(rows, [(0.01, 4.0, 30), (1.0, 10.0, 30)])
    assert tracemalloc.get_traced_memory()[1] < 100 * len(rows.times)
    tracemalloc.stop()
    linear.Rows.forget(kept.table.path)

    def over_all(*_):
        raise AssertionError("the driver fits")

    monkeypatch.setattr(model, "_fit_over_all", over_all)
    monkeypatch.setattr(model.TrainingRows, "cells", lambda rows: 700_000_000)
    monkeypatch.setattr(linear, "HELD", 10)
    small = model.TrainingRows.of(spark.createDataFrame(drawn_rows(100, 80), "label boolean, features array<int>"), 80)
    weights = model.fit_sparse(small, 0.01, 4.0).model.coefficients.toArray()
    monkeypatch.setattr(linear, "HELD", 1000)
    small.done.clear()
    assert weights.any() and weights.tolist() == model.fit_sparse(small, 0.01, 4.0).model.coefficients.toArray().tolist()


def test_rows_in_any_order_and_none(spark, monkeypatch):
    rows = [(True, [3, 1, 3, 9]), (False, [2]), (False, []), (True, [1])]
    df = spark.createDataFrame(rows, "label boolean, features array<int>")
    m, same = model.fit(df, 3, 1.0, 1.0), model.fit(spark.createDataFrame([(a, sorted({i for i in b if i <= 3})) for a, b in rows], df.schema), 3, 1.0, 1.0)
    assert m.coefficients.toArray().tolist() == same.coefficients.toArray().tolist() and m.numFeatures == 3
    assert m.coefficients.toArray() == pytest.approx([4 / 3, -1 / 3, 1 / 3], abs=0.005)  # the minimum, by its dual
    assert model.fit(df.limit(0), 3).coefficients.toArray().tolist() == [0, 0, 0]
    monkeypatch.setattr(model.linear, "CELLS", 1)
    assert model.fit(df, 3, 1.0, 1.0).coefficients.toArray() == pytest.approx(m.coefficients.toArray(), abs=0.2)


def test_alignments_solve_few_empty_cells():
    """Rows of other lengths went into one batch, so much of what was solved lay beyond the ends of the texts."""
    import numpy as np

    from nameloom.operators import batches

    draw = np.random.default_rng(7)
    a, b = draw.integers(1, 20, 20_000), draw.integers(1, 20, 20_000)
    short, long, seen, solved = np.minimum(a, b), np.maximum(a, b), [], 0
    for some in batches.chunks(a, b, True):
        seen += some.tolist()
        solved += 9 * len(some) * int(short[some].max()) * int(long[some].max())
    assert sorted(seen) == list(range(20_000)) and solved < 1.3 * 9 * int((a * b).sum())
    texts = [("".join(chr(0x4E00 + int(c)) for c in draw.integers(0, 9, n)), "".join(chr(0x4E00 + int(c)) for c in draw.integers(0, 9, m))) for n, m in zip(a[:300], b[:300])] + [("", ""), ("", "ab"), ("abc", "")]
    one = [float(batches.align_totals([x], [y])[0]) for x, y in texts]
    assert batches.align_totals(*map(list, zip(*texts))).tolist() == one
    assert batches.align_totals(*map(list, zip(*((y, x) for x, y in texts)))) == pytest.approx(one)
