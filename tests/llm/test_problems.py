"""Each problem against a brute-force version on small fixtures, and its edge cases: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import random
import re
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nameloom.llm import components, labelled, ledger, mixing, overlap, prose, quality, rules, topn, variants, visual, wumanber
from nameloom.operators import scratch

PAIRS = "ord bigint, name1 string, name2 string, split string, source string"


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# 1


def bare(s):
    return "".join(c for c in s if not c.isspace() and not unicodedata.category(c).startswith("P")).upper().lower()


def test_ledger(spark, rows):
    r = random.Random(1)
    names = ["Ab c", "aB-C", "a　b c", "x_y", "XY", "张·三", "张三", "", " ", "ß", "SS", "a​b", None, "z" * 100_000]
    data = [(i, r.choice(names), r.choice(names), "clash", 7) for i in range(300)]
    df = spark.createDataFrame(data, "ord bigint, name1 string, name2 string, key string, n int")
    groups = defaultdict(list)
    for o, a, b, *_ in data:
        if a is not None and b is not None:
            groups[tuple(sorted((bare(a), bare(b))))].append(o)
    book = ledger.build_ledger(df, batches=4, buckets=5)
    assert rows(ledger.copies(df, book)) == sorted((min(g), o) for g in groups.values() for o in g if o != min(g))
    got = {x.first_ord: (x.name1, x.copies) for x in ledger.records(book).collect()}
    assert got == {min(g): (data[min(g)][1], len(g)) for g in groups.values()}
    # the state is read back, and a further batch is added to it
    again = ledger.CopyLedger(spark, book.path, 5)
    again.update(spark.createDataFrame([(-5, "AB", "c"), (1000, "new", "one")], "ord bigint, name1 string, name2 string"))
    assert again.state().agg(F.sum("n")).first()[0] == sum(map(len, groups.values())) + 2
    assert again.state().count() == len(groups) + 2 and again.state().where("n > 1").count() == sum(len(g) > 1 for g in groups.values())


def test_ledger_of_nothing(spark):
    none = spark.createDataFrame([], "ord bigint, name1 string, name2 string")
    book = ledger.build_ledger(none)
    assert ledger.records(book).count() == 0 and ledger.copies(none, book).count() == 0


# 2


def plain_key(s, simple):
    return bare(visual.skeleton(s)).translate(str.maketrans(simple))


def test_overlaps(spark):
    r = random.Random(2)
    letters = "abcd张張三"
    data = []
    for i in range(260):
        a, b = ("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(2))
        if data and r.random() < 0.6:
            _, a, b, _, _ = r.choice(data)
            a, b = a or "q", b or "q"
            for _ in range(r.randint(0, 3)):
                p = r.randrange(len(a) + 1)
                a = a[:p] + r.choice(["", "x", " ", "-", "​"]) + a[p + r.randint(0, 1) :]
            if r.random() < 0.3:
                a, b = b, a
        data.append((i, a, b, r.choice(["train", "train", "dev", "test", None, "other"]), r.choice(["s1", None])))
    data += [(1000, None, "a", "train", "s"), (1001, "", "a", "dev", "s"), (1002, "·", "·", "train", "s"), (1003, "-", "a", "dev", "s"), (1004, "l" * 3000, "m" * 3000, "train", "s"), (1005, "l" * 3000, "m" * 2999 + "n", "dev", "s")]
    data += [(2000 + i, "同名", "一样", "train" if i % 2 else "dev", "s") for i in range(12)]
    df = spark.createDataFrame(data, PAIRS).withColumn("id", F.lit(1)).withColumn("text", F.lit("clash"))
    chars = spark.createDataFrame([("张", "張")], "simplified string, traditional string")
    keys = {o: (plain_key(a, {"張": "张"}), plain_key(b, {"張": "张"}), s) for o, a, b, s, _ in data if a and b and s in ("train", "dev", "test")}
    want = set()
    for (o, (a, b, s)), (p, (c, d, t)) in combinations(keys.items(), 2):
        if (s == "train") != (t == "train") and min(abs(len(a) + len(b) - len(c) - len(d)), 3) < 3:
            if len(a) > 100:
                want.add((o, p))
            elif min(plain_edits(a, c) + plain_edits(b, d), plain_edits(a, d) + plain_edits(b, c)) <= 2:
                want.add((o, p))
    want = {(min(x), max(x)) for x in want}
    got = {tuple(x) for x in overlap.overlap_pairs(df, chars).collect()}
    assert len(want) > 100 and got == want
    report = {(x.split, x.source): (x.rows, x.overlapping) for x in overlap.overlap_report(df, chars).collect()}
    hit = {o for p in want for o in p if keys[o][2] != "train"}
    every = Counter((s, src) for _, _, _, s, src in data if s in ("dev", "test"))
    assert report == {k: (n, sum(1 for o, _, _, s, src in data if (s, src) == k and o in hit)) for k, n in every.items()}


def test_overlaps_of_nothing(spark):
    chars = spark.createDataFrame([], "simplified string, traditional string")
    one = spark.createDataFrame([(1, "a", "b", "train", None)], PAIRS)
    assert overlap.overlap_pairs(one, chars).count() == 0 and overlap.overlap_pairs(one.limit(0), chars).count() == 0


# 3


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, rows, seed):
    r = random.Random(seed)
    n = 200
    links = [(r.randrange(n), r.randrange(n)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 6000 + i) for i in range(60)] + [(7, 7)]
    data = [(f"n{a:04}", f"n{b:04}") for a, b in links] + [(None, "n0001"), ("n0002", None), ("", "empty"), ("n0001", "n0001")] + [("rep", "rep2")] * 5
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in data:
        if a is not None and b is not None and a != b:
            up[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(up):
        groups[find(x)].add(x)
    want = sorted((x, min(g)) for g in groups.values() if len(g) > 1 for x in g)
    df = spark.createDataFrame(data, "name1 string, name2 string").withColumn("root", F.lit("clash"))
    assert rows(components.name_groups(df)) == want


def test_groups_of_nothing(spark):
    assert components.name_groups(spark.createDataFrame([("a", "a"), (None, "b")], "name1 string, name2 string")).count() == 0
    assert components.component_ids(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    loops = components.component_ids(spark.createDataFrame([(4, 4), (None, 2)], "a bigint, b bigint")).collect()
    assert [tuple(x) for x in loops] == [(4, 4)]


# 4

READINGS = [("张", "zhang1"), ("章", "zhang1"), ("伟", "wei3"), ("明", "ming2"), ("安", "an1"), ("康", "kang1"), ("海", "hai3"), ("清", "qing1"), ("河", "he2"), ("王", "wang2"), ("林", "lin2"), ("子", "zi3"), ("秀", "xiu4"), ("贸", "mao4"), ("易", "yi4"), ("山", "shan1"), ("文", "wen2"), ("涛", "tao1"), ("刚", "gang1"), ("玉", "yu4"), ("东", "dong1")]


def variant_tables(spark):
    return spark.createDataFrame(READINGS, "ch string, mandarin string"), spark.createDataFrame([("张", "張"), ("东", "東")], "simplified string, traditional string")


def test_variants(spark):
    person = [("张伟明（字安康，海清人）", "海清张伟明（安康）"), ("海清人张伟明，字安康", "海清张伟明（安康）"), ("章伟明（字安康，海清人）", "海清张伟明（安康）"), ("老张", "海清张伟明（安康）"), ("張伟明（字安康，海清人）", "海清張伟明[安康"), ("Zhang Wei Ming", "海清张伟明（安康）"), ("海清张伟明（安康）", "伟明哥"), ("张伟明（字安康，海清人）", "海清张伟文（安康）")]
    firm = [("河王林市KORA 子秀山贸易有限公司", "KORA 子秀山贸易（河王林）"), ("《子秀山贸易（河王林）》", "河王林子贸"), ("河王林市KORA 子秀文贸易有限公司第二分部", "KORA 子秀山贸易（河王林）")]
    abroad = [("文涛·刚玉东", "刚玉东，文涛"), ("W. 刚玉东", "刚玉东，文涛"), ("刚玉东 文涛", "文涛刚玉东")]
    decoy = [("张伟明（字安康，海清人）", "山文涛刚玉（东林）")]
    groups = [person, firm, abroad, decoy]
    data, entity = [], {}
    for g, members in enumerate(groups):
        for a, b in members:
            entity[len(data)] = g
            data.append((len(data), a, b, "ed"))
    data += [(100, "不详", None, None), (101, "", "x", None), (102, None, "海清张伟明（安康）", None), (103, "老张", "小张", None)]
    df = spark.createDataFrame(data, "ord bigint, name1 string, name2 string, entity string")
    got = {tuple(x) for x in variants.variant_pairs(df, *variant_tables(spark)).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(entity), 2) if entity[a] == entity[b]}


def test_variants_same_row_twice(spark):
    df = spark.createDataFrame([(1, "Q. Smith", "Sam"), (2, "Q. Smith", "Sam"), (3, "Q. Smith", "Tom"), (4, "长" * 20_000, "x")], "ord bigint, name1 string, name2 string")
    got = {tuple(x) for x in variants.variant_pairs(df, *variant_tables(spark)).collect()}
    assert got == {(1, 2)}
    assert variants.variant_pairs(df.limit(0), *variant_tables(spark)).count() == 0


def test_variants_of_one_sound(spark):
    # many names of one sound under the same keys: links are those of comparing every two
    r = random.Random(3)
    chars = [[chr(0x4E00 + 40 * i + k) for k in range(20)] for i in range(6)]
    names = ["".join(r.choice(c) for c in chars) for _ in range(60)]
    for n in names[:30]:
        i = r.randrange(6)
        names.append(n[:i] + r.choice([c for c in chars[i] if c != n[i]]) + n[i + 1 :])
    names += [names[0][1:], "甲" + names[1][:5], names[2][:3] + "".join(r.choice(c) for c in chars[3:])]
    readings = [(c, f"s{'abcdef'[i]}1") for i, cs in enumerate(chars) for c in cs]
    group = {i: i for i in range(len(names))}
    for a, b in combinations(range(len(names)), 2):
        x, y = ([f"s{'abcdef'[(ord(c) - 0x4E00) // 40]}" if c != "甲" else c for c in names[i]] for i in (a, b))
        near = max(len(x), len(y)) - sum((Counter(x) & Counter(y)).values()) <= 1
        shared = set(names[a]) & set(names[b])
        if near and shared and len(shared) >= max(len(set(names[a])), len(set(names[b]))) - variants.OTHER:
            old, new = group[b], group[a]
            group = {k: new if v == old else v for k, v in group.items()}
    df = spark.createDataFrame([(i, n + "，", n) for i, n in enumerate(names)], "ord bigint, name1 string, name2 string")
    tables = spark.createDataFrame(readings, "ch string, mandarin string"), spark.createDataFrame([], "simplified string, traditional string")
    got = {tuple(x) for x in variants.variant_pairs(df, *tables).collect()}
    assert got == {(a, b) for a, b in combinations(range(len(names)), 2) if group[a] == group[b]}


def test_reader():
    reader = variants.Reader({"張": "张"}, {c: s[:-1] for c, s in READINGS}, "字人老")
    assert reader.spell("zhangweiming") == ["zhang", "wei", "ming"] and reader.spell("kora") is None
    assert reader.tokens("海清人張伟明，字安康") == [("海", "清"), ("张", "伟", "明"), ("安", "康")]
    assert reader.tokens("Zhang-Wei Kora") == [("zhang", "wei", "kora")] and reader.tokens("WeiMing") == [("wei", "ming")]
    assert reader.names("老张", "海清张伟明（安康）") == (False, [[("海", "清", "张", "伟", "明"), ("安", "康")]] * 2)
    assert reader.names("老张", "山文涛刚玉（东林）")[0] and reader.names("。", "，") == (True, [[]])


def test_alignment():
    reader = variants.Reader({}, {c: s[:-1] for c, s in READINGS})
    cut = lambda s: reader.tokens(s)
    for a, b, same in [("明明", "海清张伟明（安康）", True), ("W. 刚玉东", "刚玉东，文涛", True), ("章伟", "张伟明，安康", True), ("Jon Smyth", "Smith, Jon", True), ("文涛刚", "海清张伟明（安康）", False), ("a,b,c,d,e,f", "f,e,d,c,b,a", True), ("Sam", "Tom", False)]:
        assert reader.agree(cut(a), cut(b)) == same == reader.agree(cut(b), cut(a)), (a, b)
    text = lambda *tokens: variants.TOKEN.join(map(variants.UNIT.join, tokens))
    assert variants.alike(text("张伟明", "安康"), text("安", "张伟文")) and variants.alike(text("张伟明", "安康"), text("康安", "明张伟"))
    assert not variants.alike(text("张伟明", "安康"), text("张章文", "安海")) and not variants.alike(text("张"), text("章"))


def test_token_keys(spark):
    # two names share a key exactly where one slip in one token tells them apart at most
    r = random.Random(5)
    names = [[tuple(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 3))] for _ in range(60)]

    def slips(n):
        tokens = [tuple(sorted(t)) for t in n]
        yield tuple(sorted(tokens))
        for i, t in enumerate(tokens):
            for j in range(len(t) if len(t) > 1 else 0):
                yield tuple(sorted([*tokens[:i], t[:j] + t[j + 1 :], *tokens[i + 1 :]]))

    df = spark.createDataFrame([(i, variants.TOKEN.join(variants.UNIT.join(t) for t in n)) for i, n in enumerate(names)], "id bigint, said string")
    keys = {x.id: set(x.k) for x in df.select("id", variants.token_keys(F.col("said")).alias("k")).collect()}
    for a, b in combinations(range(len(names)), 2):
        assert bool(keys[a] & keys[b]) == bool(set(slips(names[a])) & set(slips(names[b])))


def test_form_characters(spark):
    rows = [(f"老{c}", f"{c}{d}") for c, d in zip("张伟明安", "康海清河")] + [("张市", "张"), ("市", "市"), (None, "x"), ("", "")]
    df = spark.createDataFrame(rows, "name1 string, name2 string").where("name1 <> '' and name2 <> ''")
    assert variants.form_characters(df, ({}, {})) == "老"
    assert variants.form_characters(df.limit(0), ({}, {})) == ""


def test_variants_of_short_and_latin_names(spark):
    rows = ["Jon Smith|Smithy", "Smithy|Jon Smith", "Jon Smitth|Smithy", "Jon Smith|Miller", "张|明明", "明明|张", "张|明", "Jonathan|Jonathan", "Jonathan|Jonathon"]
    df = spark.createDataFrame([(i, *x.split("|")) for i, x in enumerate(rows)], "ord bigint, name1 string, name2 string")
    assert {tuple(x) for x in variants.variant_pairs(df, *variant_tables(spark)).collect()} == {(0, 1), (0, 2), (1, 2), (4, 5)}
    groups = {x.ord: (x.entity, x.links) for x in variants.variant_groups(df, *variant_tables(spark)).collect()}
    assert groups[2] == (0, 2) and groups[5] == (4, 1) and groups[3] == (3, 0)


# 5


def test_same_looking(spark):
    data = [
        (1, "Kora 张三", "é·x"), (2, "Ｋｏｒａ　张三", "é‧x"), (3, "Kоra 张​三", "é⋅x"), (4, "kora 张三", "é·x"), (5, "Kora张三", "é·x"), (6, "Kora 张三", "é·x"), (7, "КОТА", "b"), (8, "KOTA", "b"),
        (9, "Москва", "b"), (10, "Mосква", "b"), (11, None, "b"), (12, "", "b"), (13, "⼈", "（a）"), (14, "人", "(a)"), (15, "z️" * 5000, "y"), (16, "z" * 5000, "y"), (17, "DЕ́VA", "c"), (18, "DÉVA", "c"), (19, "張", "c"), (20, "张", "c"),
        (21, "Sοra", "d"), (22, "Sоra", "d"),
    ]
    df = spark.createDataFrame(data, "ord bigint, name1 string, name2 string").withColumn("form", F.lit("clash"))
    got = {tuple(x) for x in visual.same_looking(df).collect()}
    want = set(combinations((1, 2, 3), 2)) | {(2, 6), (3, 6), (7, 8), (9, 10), (13, 14), (15, 16), (17, 18), (21, 22)}
    assert got == want
    assert visual.same_looking(df.limit(0)).count() == 0


def test_same_looking_with_accents(spark):
    words = ["Ε\u0301lan", "Élan", "О\u0308rn", "Örn", "Α\u0301gua", "Água", "Ι\u0301sis", "Ísis", "cο\u0301rp", "córp", "sо\u0308n", "sön", "Ïжак", "Їжак", "й", "ΑΕ\u0301", "AÉ"]
    df = spark.createDataFrame([(i, w, "x") for i, w in enumerate(words)], "ord bigint, name1 string, name2 string")
    got = {tuple(x) for x in visual.same_looking(df).collect()}
    assert got == {(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11), (12, 13), (15, 16)}
    forms = {r.ord: r.name1_form for r in visual.repair(df, ["name1"], "ord").collect()}
    assert [forms[i] for i in (0, 2, 12, 13, 14)] == ["Élan", "Örn", "Їжак", "Їжак", "й"]
    assert visual.skeleton("Ε\u0301") == visual.skeleton("É") == "É" and visual.skeleton("О\u0308") == "Ö" and visual.skeleton("й") == "й"


def test_forms_keep_what_is_right(spark):
    df = spark.createDataFrame([(1, "Сова Kot"), (2, "Kоt"), (3, "Pаul"), (4, None), (5, "")], "id bigint, t string")
    got = {r.id: r.t_form for r in visual.repair(df, ["t"], "id").collect()}
    # Pаul stays: its repair is no word of the corpus
    assert got == {1: "Сова Kot", 2: "Kot", 3: "Pаul", 4: None, 5: ""}


@pytest.mark.parametrize("text", ["ａ́", "·‧⋅", "​", "﹒ﬁ½", "é‍̂", "が", "ᅠ"])
def test_compose_is_stable(text):
    assert visual.compose(visual.compose(text)) == visual.compose(text)


# 6


def test_top(spark, rows):
    r = random.Random(4)
    texts = ["1", " 1.0 ", "0.5", "-2", "nan", "inf", "-inf", "1e400", "", "x", None, "1f", "1_0", "０", "+3.5e-1", ".5", "5."]
    data = [(r.choice(["a", "b", "hot", "hot", "hot", "", None]), i, r.choice(texts)) for i in range(600)] + [("a", 5, "1"), ("n", None, "1"), ("n", 3, "1")]
    df = spark.createDataFrame(data, "name1 string, ord bigint, text string").repartition(7).withColumn("score", topn.number(F.col("text")))
    real = {"1": 1, " 1.0 ": 1, "0.5": 0.5, "-2": -2, "+3.5e-1": 0.35, ".5": 0.5, "5.": 5}
    for n in (1, 3, 50):
        want = []
        for g in {d[0] for d in data} - {None}:
            live = sorted((-real[t], o is None, o or 0, o) for k, o, t in data if k == g and t in real)
            want += [(g, x[3]) for x in live[:n]]
        got = topn.top_n(df, "name1", "score", "ord", n).select("name1", "ord")
        assert sorted(map(str, rows(got))) == sorted(map(str, want))
    assert topn.top_n(df.limit(0), "name1", "score", "ord", 3).count() == 0 and topn.top_n(df, "name1", "score", "ord", 0).count() == 0


# 8


def test_leaks(spark, rows):
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=30)), r.choice(["en", None, "EN"])) for i in range(12)]
    items += [(100 + i, "".join(r.choices("天地玄黄宇宙洪荒日月盈昃", k=60)), "zh") for i in range(6)] + [(200, "too short", "en"), (201, None, "en"), (202, "", "zh")]
    docs = []
    for i in range(150):
        j, text, lang = r.choice(items[:18])
        parts, gap = (list(text), "") if lang == "zh" else (text.split(), " ")
        k = r.randint(5, 40) if lang == "zh" else r.randint(8, 16)
        s = r.randrange(len(parts) - k) if len(parts) > k else 0
        piece = gap.join(parts[s : s + k]).upper().replace("W1", "W1,\n")
        docs.append((i, r.choice(["", "Before it. "]) + piece + r.choice(["", " after"]) if r.random() < 0.8 else r.choice(["none", "", None]), j))
    docs += [(999, "x " * 300_000 + items[0][1], 1), (999, items[0][1], 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id bigint")
    t = spark.createDataFrame(items, "item_id bigint, text string, lang string")
    want = set()
    for j, text, lang in items:
        for w in wumanber.windows(text or "", lang):
            want |= {(i, j) for i, x, _ in docs if x and w in wumanber.stream_of(x)}
    for block in (200_000, 100):
        assert rows(wumanber.leaks(d, t, block_chars=block)) == sorted(want)
    assert wumanber.leaks(d, t.limit(0)).count() == 0 and wumanber.leaks(d.limit(0), t).count() == 0


def test_searcher_skips_nothing():
    r = random.Random(8)
    for _ in range(200):
        patterns = {"".join(r.choices("ab", k=r.randint(1, 7))): {i} for i in range(r.randint(1, 6))}
        text = "".join(r.choices("abc", k=r.randint(0, 40)))
        want = set().union(*(v for p, v in patterns.items() if p in text))
        assert wumanber.Searcher(patterns).find(text) == want


# 9


def test_mix(spark):
    docs = [(i, "word " * (1 + i % 9), ["big", "small", "mid", None, "unused"][0 if i < 3000 else 1 + i % 4]) for i in range(5000)] + [(9000, None, "big"), (9001, "", "big")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit(-1)).withColumn("rate", F.lit(9.0))
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.2, 2), ("absent", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    with scratch.scope():
        m = mixing.mix(d, t).cache()
        rows = {r.source: r for r in mixing.shares(m, t).collect()}
        assert all(abs(rows[s].actual_share - w) < 0.03 for s, w in (("big", 0.5), ("small", 0.3), ("mid", 0.2)))
        per = {(r.source, r.doc_id): r["count"] for r in m.groupBy("source", "doc_id").count().collect()}
        caps = {"big": 1, "small": 3, "mid": 2}
        assert all(n <= caps[s] for (s, _), n in per.items()) and max(n for (s, _), n in per.items() if s == "small") >= 2
        assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mixing.mix(d.repartition(3), t).collect()))
        assert mixing.mix(d.limit(0), t).count() == 0
        half = mixing.mix(d, t, total=rows["big"].tokens / 2)
        assert half.agg(F.sum("n_tokens")).first()[0] == pytest.approx(rows["big"].tokens / 2, rel=0.1)


def test_token_counts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mixing.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "张三丰", "", None, "<|endoftext|>"]
    got = mixing.count_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string"), "text").orderBy("id").collect()
    assert [r.n_tokens for r in got] == [len(enc.encode_ordinary(t or "")) for t in texts]
    # a text longer than a piece has the tokens of the whole
    r = random.Random(5)
    long = "".join(r.choice(["international", " ", "  ", "\n", "don't", "张三丰", "，", ". ", "12,5", "_x", "é\u0301"]) for _ in range(70_000))
    assert all(len(p) <= 40 for p in mixing.pieces(long, 40)) and "".join(mixing.pieces(long, 40)) == long
    assert sum(len(enc.encode_ordinary(p)) for p in mixing.pieces(long, 400)) == len(enc.encode_ordinary(long))
    n = mixing.count_tokens(spark.createDataFrame([(1, long)], "id bigint, text string"), "text").first().n_tokens
    assert len(long) > 2 * mixing.PIECE and n == len(enc.encode_ordinary(long))


# 10


def test_statistics(spark):
    texts = ["The cat was here. It is so!\nYes", "", None, "- apples\n- pears", "我们没有看见他。", "a\tb | c / d"]
    df = spark.createDataFrame([(i, t, 5.0) for i, t in enumerate(texts)], "id bigint, text string, n_words double")
    got = {r.id: r for r in quality.with_stats(df).collect()}
    a = got[0]
    words = re.findall(r"\w+", texts[0])
    assert (a.n_chars, a.n_words, a.n_lines) == (len(texts[0]), len(words), 2)
    assert a.mean_word_len == pytest.approx(sum(map(len, words)) / len(words)) and a.end_punct_share == 0.5
    assert a.common_share == pytest.approx(5 / 8) and a.stop_rate == pytest.approx(2 / 8)
    assert all(got[i][s] == 0 for i in (1, 2) for s in quality.STATS)
    assert got[3].marked_share == 1 and got[4].n_words == 7 and got[4].prose_share == 1 and got[5].separator_ratio > 0.5


def test_rule_induction():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(2000), "b": rng.random(2000), "noise": rng.random(2000)}
    y = (x["a"] > 0.7) & (x["b"] < 0.5) | (x["b"] > 0.9)
    learned = rules.irep(x, y)
    assert (learned.predict(x) == y).mean() > 0.97 and learned.sql().startswith("CASE WHEN")
    assert rules.irep(x, np.zeros(2000, bool)).sql() == "false"
    with pytest.raises(ValueError):
        rules.irep({"a": np.zeros(rules.MAX_LABELLED + 1)}, np.zeros(rules.MAX_LABELLED + 1, bool))


def test_held_out_accuracy(spark):
    fresh = spark.createDataFrame(labelled.examples(1200, seed=4242), "text string, is_list boolean")
    out = prose.flag_junk(fresh)
    wrong = out.where("junk <> is_list").count()
    assert wrong / 1200 < 0.03
    # the SQL says what the rules say
    learned = prose.default_rules(spark)
    p = out.select("junk", "n_chars", *prose.FEATURES).toPandas()
    assert (learned.predict({f: p[f].to_numpy(float) for f in prose.FEATURES}) | (p.n_chars == 0)).tolist() == p.junk.tolist()
    edge = prose.flag_junk(spark.createDataFrame([(None,), ("",), ("| a | b |\n" * 50_000,)], "text string"))
    assert [r.junk for r in edge.collect()] == [True, True, True]


def test_nothing_outside_imports_this():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "nameloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "nameloom.llm" not in f.read_text(), f
