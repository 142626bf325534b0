"""The core queries in SQL for DuckDB, written from the meaning of each query and not from its Spark plan."""

from __future__ import annotations

# Fixed values, stated here once more, so that a wrong one in the code under test shows.
EDGES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
TIED_HITS, TIED_RECIPROCAL = 10, 0.2745
NOISE_ENDINGS = ["列表", "将军", "代表", "运动", "问题"]
NOISE_PARTS = ["维基", "慰安妇"]

_NAMED = "named AS (SELECT ord, name1, name2, label FROM pairs WHERE name1 IS NOT NULL AND name2 IS NOT NULL)"
_NAMES = "names AS (SELECT DISTINCT name FROM (SELECT name1 AS name FROM pairs UNION ALL SELECT name2 FROM pairs) WHERE name IS NOT NULL)"
_EDGES = "[" + ", ".join(f"{e!r}::DOUBLE" for e in EDGES) + "]"
_READ = """chars AS (SELECT ch, coalesce(max(mandarin), '') AS m, coalesce(max(cantonese), '') AS c0 FROM readings WHERE ch <> '' GROUP BY ch),
sound AS (SELECT ch, m, CASE WHEN c0 = '' THEN m ELSE c0 END AS c FROM chars)"""


def _chars(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split({x}, '') END"


def _edits(a: str, b: str) -> str:
    """Edit distance of two lists: one row of the table after the other. Lists of one element stand for scalars."""
    cell = f"least(above[j[1] + 1] + 1, done[j[1]] + 1, above[j[1]] + CASE WHEN {b}[j[1]] = x[1] THEN 0 ELSE 1 END)"
    row = f"list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j]), lambda done, j: list_append(done, {cell}), [above[1] + 1])"
    return f"(list_reduce(list_transform({a}, lambda x: [x]), lambda above, x: {row}, range(0, len({b}) + 1)))[len({b}) + 1]"


def _similar(a: str, b: str) -> str:
    """Edit similarity of two lists."""
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN len({a}) = 0 THEN 1.0::DOUBLE - len({b})::DOUBLE / (len({b}) + 1) WHEN len({b}) = 0 THEN 1.0::DOUBLE - len({a})::DOUBLE / (len({a}) + 1) ELSE 1.0::DOUBLE - ({_edits(a, b)})::DOUBLE / greatest(len({a}), len({b})) END"


def _lists(extra: str = "") -> str:
    return f"WITH {_NAMED}, lists AS (SELECT ord, label, name1, name2, {_chars('name1')} AS a, {_chars('name2')} AS b FROM named)"


def _scored() -> str:
    return f"{_lists()}, s AS (SELECT ord, {_similar('a', 'b')} AS v FROM lists)"


def _grams(x: str, n: int) -> str:
    return f"list_distinct(CASE WHEN len({x}) >= {n} THEN list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i+{n - 1}], ' ')) ELSE CAST([] AS VARCHAR[]) END)"


def _all_grams(x: str) -> str:
    return f"list_distinct(list_concat({_grams(x, 1)}, list_concat({_grams(x, 2)}, {_grams(x, 3)})))"


def _jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def _bins(v: str, begin: int) -> str:
    """Ids as a list of texts."""
    last = f"len(list_filter({_EDGES}, lambda e: e < {v})) - 1"
    return f"(CASE WHEN {v} > 0 THEN [({begin} + {last})::VARCHAR, ({begin} + least({last} + 1, {len(EDGES) - 1}))::VARCHAR] ELSE CAST([] AS VARCHAR[]) END)"


def _cumulative(v: str, begin: int) -> str:
    return f"list_transform(range(0, coalesce(len(list_filter({_EDGES}, lambda e: e < {v})), 0)), lambda i: ({begin} + i)::VARCHAR)"


def _text(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


def _winkler() -> str:
    """Jaro-Winkler over lists a, b of `lists`: the partner of each place, then the counts."""
    free = "list_filter(range(greatest(x[1] - r, 1), least(x[1] + r, len(b)) + 1), lambda j: b[j] = a[x[1]] AND NOT list_contains(used, j))"
    return f"""{_lists()},
reach AS (SELECT *, greatest(least(len(a), len(b)) // 2 - 1, 0) AS r FROM lists),
met AS (SELECT *, list_reduce(list_transform(range(1, len(a) + 1), lambda i: [i]), lambda used, x: list_append(used, coalesce(({free})[1], 0)), CAST([] AS BIGINT[])) AS p FROM reach WHERE len(a) > 0 AND len(b) > 0),
hits AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: p[i] > 0) AS mine, list_sort(list_filter(p, lambda j: j > 0)) AS theirs FROM met),
swaps AS (SELECT *, len(mine) AS m, len(list_filter(range(1, len(mine) + 1), lambda k: a[mine[k]] <> b[theirs[k]])) // 2 AS t FROM hits),
w AS (SELECT ord, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE (m::DOUBLE / len(a) + m::DOUBLE / len(b) + (m - t)::DOUBLE / m) / 3 END AS w,
             len(list_filter(range(1, least(len(a), len(b), 4) + 1), lambda k: a[1:k] = b[1:k])) AS pre FROM swaps)
SELECT ord, round(CASE WHEN w > 0.7 THEN w + pre * 0.1::DOUBLE * (1 - w) ELSE w END, 9) AS score FROM w
UNION ALL SELECT ord, 0.0::DOUBLE FROM lists WHERE len(a) = 0 OR len(b) = 0"""


def _ranked(order: str = "score DESC, ord", where: str = "score IS NOT NULL") -> str:
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name1 ORDER BY {order}) AS rk FROM (SELECT ord, name1, coalesce(label, false) AS label, score, coalesce(prediction, false) AS prediction FROM scored WHERE {where}))"""


def _spelled(columns: dict[str, str], separator: str, table: str = "names") -> str:
    """Each name with, for each column, the joined values of its characters; values that are null are left out."""
    parts = ", ".join(f"coalesce(string_agg({v}, '{separator}' ORDER BY i), '') AS {k}" for k, v in columns.items())
    return f"""WITH {_NAMES}, {_READ},
placed AS (SELECT name, unnest({_chars('name')}) AS ch, unnest(range(1, len({_chars('name')}) + 1)) AS i FROM names),
spelled AS (SELECT p.name, {parts} FROM placed p LEFT JOIN sound s ON p.ch = s.ch GROUP BY p.name)
SELECT n.name, {", ".join(f"coalesce(s.{k}, '') AS {k}" for k in columns)} FROM names n LEFT JOIN spelled s ON n.name = s.name"""


def _syllable(x: str) -> str:
    word = f"regexp_extract({x}, '^[A-Za-z0-9_]+')"
    return f"nullif(left({word}, greatest(length({word}) - 1, 0)), '')"


def _phonemes(x: str, onsets: list[str]) -> str:
    s = _syllable(x)
    two = ", ".join(f"'{o}'" for o in onsets)
    cut = f"CASE WHEN left({s}, 2) IN ({two}) THEN 2 ELSE 1 END"
    return f"trim(left({s}, {cut}) || ' ' || substring({s}, {cut} + 1))"


_ONSETS = {"m": ["zh", "ch", "sh"], "c": ["gw", "ct", "ng", "kw"]}


def _sounded(more: str = "") -> str:
    """sounded: every row of `named` with, for both names, the syllables (s) and phonemes (p) in Mandarin (m) and Cantonese (c), and the name spelled out after conversion (t)."""
    split = lambda l: f"list_filter([left(r.s_{l}, CASE WHEN left(r.s_{l}, 2) IN ({', '.join(repr(o) for o in _ONSETS[l])}) THEN 2 ELSE 1 END), substring(r.s_{l}, CASE WHEN left(r.s_{l}, 2) IN ({', '.join(repr(o) for o in _ONSETS[l])}) THEN 3 ELSE 2 END)], lambda x: x <> '')"  # noqa: E731, E741
    none = "CAST([] AS VARCHAR[])"
    keep = lambda v: f"coalesce(list({v} ORDER BY i) FILTER ({v} IS NOT NULL), {none})"
    return f"""WITH {_NAMED}, {_NAMES}, {_READ},
read AS (SELECT ch, {_syllable('m')} AS s_m, {_syllable('c')} AS s_c FROM sound),
placed AS (SELECT name, unnest({_chars('name')}) AS ch, unnest(range(1, len({_chars('name')}) + 1)) AS i FROM names),
told AS (SELECT p.name, p.i, r.s_m, r.s_c, CASE WHEN r.s_m IS NOT NULL THEN {split('m')} END AS p_m, CASE WHEN r.s_c IS NOT NULL THEN {split('c')} END AS p_c,
                coalesce(coalesce(q.s_m, CASE WHEN q.ch IS NOT NULL THEN '' END), coalesce(v.simplified, p.ch)) AS t
         FROM placed p LEFT JOIN read r ON p.ch = r.ch LEFT JOIN (SELECT traditional, max(simplified) AS simplified FROM variant_chars GROUP BY traditional) v ON p.ch = v.traditional LEFT JOIN read q ON q.ch = coalesce(v.simplified, p.ch)),
said AS (SELECT name, {keep('s_m')} AS s_m, {keep('s_c')} AS s_c, coalesce(flatten(list(p_m ORDER BY i) FILTER (p_m IS NOT NULL)), {none}) AS p_m, coalesce(flatten(list(p_c ORDER BY i) FILTER (p_c IS NOT NULL)), {none}) AS p_c, string_agg(t, '' ORDER BY i) AS t FROM told GROUP BY name
         UNION ALL SELECT '', {none}, {none}, {none}, {none}, ''),
sounded AS (SELECT n.*, x.s_m AS a_s_m, x.p_m AS a_p_m, x.t AS a_t, y.s_m AS b_s_m, y.s_c AS b_s_c, y.p_m AS b_p_m, y.p_c AS b_p_c, y.t AS b_t FROM named n JOIN said x ON n.name1 = x.name JOIN said y ON n.name2 = y.name){more}"""


def _features(simple: str) -> str:
    """All ids of mode 17 (phonemes, no sound grams): overlaps, surname, length, distance, and dictionary ids of gram pairs from 88 on."""
    a, b, x, y = "a", "b", "a_p_m", "b_p_m"
    rates = ", ".join(f"{_jaccard(_grams(p, n), _grams(q, n))} AS {k}{n}" for k, p, q in (("r", a, b), ("q", x, y)) for n in (1, 2, 3))
    bins = lambda k, at: [_bins(f"{k}{n}", at + 11 * (n - 1)) for n in (1, 2, 3)] + [f"CASE WHEN greatest({k}1, {k}2, {k}3) = 0 THEN ['{at + 33}'] ELSE CAST([] AS VARCHAR[]) END"]
    known = "IN (SELECT surname FROM surnames WHERE surname <> '')"
    one, two = "(left(n1, 1) = left(n2, 1) AND n1 <> '')", "(left(n1, 2) = left(n2, 2))"
    rest = [f"CASE WHEN {one} THEN ['69'] ELSE CAST([] AS VARCHAR[]) END", f"CASE WHEN {one} AND left(n1, 1) {known} OR {two} AND left(n1, 2) {known} THEN ['70'] ELSE CAST([] AS VARCHAR[]) END", "[(71 + least(abs(length(n1) - length(n2)), 5))::VARCHAR]", _bins("v", 77)]
    fixed = f"flatten([{', '.join(bins('r', 1) + bins('q', 35) + rest)}])"
    return f"""{_sounded()},
conv AS (SELECT *, {simple.format(x='name1')} AS n1, {simple.format(x='name2')} AS n2 FROM sounded WHERE len(a_p_m) > 0 AND len(b_p_m) > 0),
lists AS (SELECT *, {_chars('n1')} AS a, {_chars('n2')} AS b FROM conv),
g AS (SELECT ord, label, {_all_grams('a')} AS x, {_all_grams('b')} AS y FROM lists),
every AS (SELECT ord, label, u || '--' || w AS pair FROM (SELECT ord, label, u, unnest(y) AS w FROM (SELECT ord, label, unnest(x) AS u, y FROM g))
  UNION ALL SELECT ord, label, unnest(list_filter(x, lambda e: NOT list_contains(y, e))) || '--' FROM g
  UNION ALL SELECT ord, label, '--' || unnest(list_filter(y, lambda e: NOT list_contains(x, e))) FROM g),
dict AS (SELECT pair, 87 + row_number() OVER (ORDER BY pair) AS id FROM every WHERE label IS NULL OR label GROUP BY pair HAVING count(*) >= 2),
shares AS (SELECT ord, n1, n2, {rates}, {_similar(x, y)} AS v FROM lists),
ids AS (SELECT ord, unnest({fixed})::BIGINT AS id FROM shares UNION SELECT e.ord, d.id FROM every e JOIN dict d USING (pair)),
found AS (SELECT ord, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM ids GROUP BY ord)
SELECT n.ord, coalesce(f.ids, '') AS ids FROM named n LEFT JOIN found f USING (ord)"""


def _damerau() -> str:
    """Edits with swaps: one row of the table after the other, the last two carried."""
    cell = "least(above[j[1] + 1] + 1, done[j[1]] + 1, above[j[1]] + CASE WHEN b[j[1]] = a[i + 1] THEN 0 ELSE 1 END, CASE WHEN i > 0 AND j[1] > 1 AND a[i + 1] = b[j[1] - 1] AND a[i] = b[j[1]] THEN before[j[1] - 1] + 1 ELSE 1000000 END)"
    row = f"list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda done, j: list_append(done, {cell}), [above[1] + 1])"
    lists = _lists().replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{lists},
d(ord, i, a, b, above, before) AS (
  SELECT ord, 0, a, b, range(0, len(b) + 1), range(0, len(b) + 1) FROM lists
  UNION ALL SELECT ord, i + 1, a, b, {row}, above FROM d WHERE i < len(a)),
last AS (SELECT ord, a, b, above[len(b) + 1] AS e FROM d WHERE i = len(a))
SELECT ord, round(CASE WHEN a = b THEN 1.0::DOUBLE WHEN len(a) = 0 THEN 1.0::DOUBLE - len(b)::DOUBLE / (len(b) + 1) WHEN len(b) = 0 THEN 1.0::DOUBLE - len(a)::DOUBLE / (len(a) + 1) ELSE 1.0::DOUBLE - e::DOUBLE / greatest(len(a), len(b)) END, 9) AS score FROM last"""


def _sound_bins() -> str:
    """Legacy bins of `sounds:characters`: three orders of the sounds' letters, two of the characters, 56 where no character is shared."""
    some = lambda x, orders: f"list_distinct(flatten([{', '.join(_grams(x, n) for n in orders)}]))"
    share = lambda t, have, n: f"CASE WHEN len({_grams(t, n)}) > 0 THEN len(list_intersect({_grams(t, n)}, {have}))::DOUBLE / sqrt(len({_grams(t, n)})::DOUBLE) END"
    parts = [(f"q{k}", t, h, n) for k, (t, h, n) in enumerate([("tb", "ha", 1), ("tb", "ha", 2), ("tb", "ha", 3), ("cb", "hc", 1), ("cb", "hc", 2)])]
    ids = ", ".join(_cumulative(q, 1 + 11 * k) for k, (q, *_) in enumerate(parts))
    more = f""",
cut AS (SELECT ord, {_chars("array_to_string(a_s_m, '')")} AS ta, {_chars("array_to_string(b_s_m, '')")} AS tb, {_chars("replace(name1, ':', '')")} AS ca, {_chars("replace(name2, ':', '')")} AS cb FROM sounded),
have AS (SELECT *, {some('ta', (1, 2, 3))} AS ha, {some('ca', (1, 2))} AS hc FROM cut),
q AS (SELECT ord, ca, cb, {", ".join(f"{share(t, h, n)} AS {q}" for q, t, h, n in parts)} FROM have)
SELECT ord, {_text(f"flatten([{ids}, CASE WHEN len(list_intersect(ca, cb)) = 0 THEN ['56'] ELSE CAST([] AS VARCHAR[]) END])")} AS ids FROM q"""
    return _sounded(more)


def _modes(simple: str) -> str:
    sides = {
        "original": (_chars("name1"), _chars("name2")),
        "simplified": (_chars(simple.format(x="name1")), _chars(simple.format(x="name2"))),
        "pinyin": (_chars("a_t"), _chars("b_t")),
        "pronun1": ("a_s_m", "b_s_m"),
        "pronun2": ("a_p_m", "b_p_m"),
        "pronun3": (_chars("array_to_string(a_s_m, '')"), _chars("array_to_string(b_s_c, '')")),
        "pronun4": ("a_p_m", "b_p_c"),
    }
    lists = ", ".join(f"{a} AS {m}_a, {b} AS {m}_b" for m, (a, b) in sides.items())
    return _sounded(f", l AS (SELECT ord, {lists} FROM sounded) SELECT ord, " + ", ".join(f"round({_similar(f'{m}_a', f'{m}_b')}, 6) AS {m}" for m in sides) + " FROM l")


_CELLS = r"""parsed AS (
  SELECT line_no, line,
         regexp_full_match(line, '("([^"]|"")*"|[^"\t][^\t]*|)(\t("([^"]|"")*"|[^"\t][^\t]*|))*', 's') AS well,
         regexp_extract_all(E'\t' || line, '\t("(?:[^"]|"")*"|[^"\t][^\t]*|)', 1, 's') AS raw
  FROM raw_lines),
cells AS (SELECT line_no, line, well, list_transform(raw, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END) AS c FROM parsed)"""


_BROKEN = r"""WHERE line IS NULL OR NOT well OR len(c) NOT IN (2, 3)
   OR regexp_matches(c[1], '[\x{0}-\x{8}\x{A}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]') OR regexp_matches(c[2], '[\x{0}-\x{8}\x{A}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]')
   OR regexp_full_match(c[1], '[\s\x{A0}\x{2000}-\x{200A}\x{3000}]*') OR regexp_full_match(c[2], '[\s\x{A0}\x{2000}-\x{200A}\x{3000}]*')
   OR (len(c) = 3 AND lower(regexp_replace(c[3], '^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g')) NOT IN ('true', 'false'))"""


def _bare(x: str) -> str:
    return r"regexp_replace({x}, '^[\s\v\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\v\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g')".replace("{x}", x)


def statements() -> dict[str, str]:
    traditional = "(SELECT coalesce(string_agg(traditional, '' ORDER BY traditional), '') FROM (SELECT DISTINCT traditional FROM variant_chars WHERE traditional NOT IN (SELECT simplified FROM variant_chars)))"
    to_simple = "translate({x}, (SELECT string_agg(traditional, '' ORDER BY traditional) FROM variant_chars), (SELECT string_agg(simplified, '' ORDER BY traditional) FROM variant_chars))"
    to_traditional = "translate({x}, (SELECT string_agg(simplified, '' ORDER BY simplified) FROM variant_chars), (SELECT string_agg(traditional, '' ORDER BY simplified) FROM variant_chars))"

    def noise(x: str) -> str:
        simple = to_simple.format(x=f"coalesce({x}, '')")
        some = [f"ends_with({simple}, '{e}')" for e in NOISE_ENDINGS] + [f"contains({simple}, '{p}')" for p in NOISE_PARTS]
        return f"(regexp_full_match(coalesce({x}, ''), '[A-Za-z0-9_ -]*') OR {' OR '.join(some)})"

    overlap = "list_concat(" + ", list_concat(".join(_bins(f"r{n}", 1 + 11 * (n - 1)) for n in (1, 2)) + f", list_concat({_bins('r3', 23)}, CASE WHEN greatest(r1, r2, r3) = 0 THEN ['34'] ELSE CAST([] AS VARCHAR[]) END)))"
    rates = ", ".join(f"{_jaccard(_grams('a', n), _grams('b', n))} AS r{n}" for n in (1, 2, 3))
    root = lambda n: f"CASE WHEN len({_grams('b', n)}) > 0 THEN len(list_intersect({_grams('b', n)}, {_all_grams('a')}))::DOUBLE / sqrt(len({_grams('b', n)})::DOUBLE) END"
    root_ids = f"list_concat({_cumulative('q1', 1)}, list_concat({_cumulative('q2', 12)}, {_cumulative('q3', 23)}))"
    roots = f"{_lists()}, q AS (SELECT ord, label, {root(1)} AS q1, {root(2)} AS q2, {root(3)} AS q3 FROM lists)"
    tied = "(top = 0 OR top = low)"
    hit = lambda k: f"CASE WHEN {tied} THEN {k}/{TIED_HITS}::DOUBLE WHEN first_true <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    clear = lambda k: f"CASE WHEN NOT {tied} AND first_true <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    rr = f"CASE WHEN {tied} THEN {TIED_RECIPROCAL}::DOUBLE WHEN first_true IS NOT NULL THEN 1.0::DOUBLE / first_true ELSE 0.0::DOUBLE END"
    groups = f"{_ranked()}, g AS (SELECT name1, max(score) AS top, min(score) AS low, min(CASE WHEN label THEN rk END) AS first_true FROM ranked GROUP BY name1)"
    hits_sql = ", ".join(f"round(avg({hit(k)}), 9) AS hits{k}" for k in (1, 2, 3))
    vars_sql = ", ".join(f"round(avg({clear(k)}) - avg({hit(k)}) * avg({hit(k)}), 9) AS hits{k}_var" for k in (1, 2, 3))
    return {
        "pair_parse": """
SELECT line_no AS ord, trim(c[1], ' ') AS name1, CASE WHEN len(c) >= 2 THEN trim(c[2], ' ') END AS name2,
       CASE lower(trim(c[3], ' ')) WHEN 'true' THEN true WHEN 'false' THEN false END AS label
FROM (SELECT line_no, string_split(line, E'\\t') AS c FROM raw_lines)""",
        "raw_parse": r"""
SELECT line_no AS ord, c[1] AS name1, c[2] AS name2
FROM (SELECT line_no, string_split(trim(regexp_replace(line, '[\s\v]+', ' ', 'g'), ' '), ' ') AS c FROM raw_lines) WHERE len(c) = 2""",
        "surname_set": "SELECT DISTINCT surname FROM surnames WHERE surname <> ''",
        "traditional_only": "SELECT DISTINCT traditional AS ch FROM variant_chars WHERE traditional NOT IN (SELECT simplified FROM variant_chars)",
        "prediction_lines": r"""
SELECT name1 || E'\t' || name2 || E'\t' || CASE WHEN prediction THEN 'True' ELSE 'False' END || E'\t' || printf('%.6f', score) AS value
FROM scored WHERE name1 IS NOT NULL AND name2 IS NOT NULL AND score IS NOT NULL""",
        "lev_pairs": f"{_scored()} SELECT ord, round(v, 9) AS score FROM s",
        "match_lev": f"{_scored()} SELECT ord, v > 0.5 AS prediction FROM s",
        "stream_score": f"{_scored()} SELECT ord, v > 0.5 AS prediction FROM s",
        "jaro_winkler_pairs": _winkler(),
        "lcs_ratio": f"""
{_lists()}, runs AS (SELECT ord, name1, name2, list_transform(range(1, length(name1) + 1), lambda i: coalesce(list_max(list_filter(range(1, length(name1) - i + 2), lambda k: contains(name2, substring(name1, i, k)))), 0)) AS k FROM lists)
SELECT ord, CASE WHEN length(name1) = 0 OR length(name2) = 0 THEN 0.0::DOUBLE ELSE round(list_max(k)::DOUBLE / greatest(length(name1), length(name2)), 9) END AS score FROM runs""",
        "ngram_union": f"WITH {_NAMES} SELECT name, array_to_string(list_sort({_all_grams(_chars('name'))}), '|') AS grams FROM names",
        "ngram_by_order": f"WITH {_NAMES} SELECT name, " + ", ".join(f"array_to_string(list_sort({_grams(_chars('name'), n)}), '|') AS grams{n}" for n in (1, 2, 3)) + " FROM names",
        "gram_bag": f"""
WITH {_NAMES}, c AS (SELECT {_chars('name')} AS c FROM names), o AS (SELECT c, unnest([1, 2, 3]) AS n FROM c),
g AS (SELECT unnest(list_transform(range(1, greatest(len(c) - n + 2, 1)), lambda i: array_to_string(c[i:i+n-1], ' '))) AS gram FROM o)
SELECT gram, count(*) AS n FROM g GROUP BY gram""",
        "jaccard_rate": f"{_lists()}, r AS (SELECT ord, {rates} FROM lists) SELECT ord, round(r1, 9) AS rate1, round(r2, 9) AS rate2, round(r3, 9) AS rate3 FROM r",
        "jaccard_bins": f"{_lists()}, r AS (SELECT ord, {rates} FROM lists) SELECT ord, {_text(overlap)} AS ids FROM r",
        "lev_bins": f"{_scored()} SELECT ord, {_text(_bins('v', 77))} AS ids FROM s",
        "dist_bins_cumulative": f"{_scored()} SELECT ord, {_text(_cumulative('v', 34))} AS ids FROM s",
        "length_diff_onehot": f"WITH {_NAMED} SELECT ord, (71 + least(abs(length(name1) - length(name2)), 5))::VARCHAR AS ids FROM named",
        "surname_match": f"""
WITH {_NAMED}, f AS (SELECT ord, left(name1, 1) = left(name2, 1) AND name1 <> '' AS one, left(name1, 2) = left(name2, 2) AS two, left(name1, 1) IN (SELECT surname FROM surnames WHERE surname <> '') AS k1, left(name1, 2) IN (SELECT surname FROM surnames WHERE surname <> '') AS k2 FROM named)
SELECT ord, concat_ws(' ', CASE WHEN one THEN '69' END, CASE WHEN one AND k1 OR two AND k2 THEN '70' END) AS ids FROM f""",
        "gram_idf": f"{_lists()}, g AS (SELECT unnest({_all_grams('a')}) AS gram FROM lists UNION ALL SELECT unnest({_all_grams('b')}) FROM lists) SELECT gram, count(*) + 1 AS idf FROM g GROUP BY gram",
        "tfidf_sim": f"""
{_lists()}, d AS (SELECT gram, count(*) + 1 AS idf FROM (SELECT unnest({_all_grams('a')}) AS gram FROM lists UNION ALL SELECT unnest({_all_grams('b')}) FROM lists) GROUP BY gram),
g AS (SELECT ord, unnest([1, 2]) AS side, unnest([a, b]) AS c FROM lists), o AS (SELECT ord, side, c, unnest([1, 2, 3]) AS n FROM g),
e AS (SELECT ord, side, unnest(list_transform(range(1, greatest(len(c) - n + 2, 1)), lambda i: array_to_string(c[i:i+n-1], ' '))) AS gram FROM o),
f AS (SELECT ord, gram, sum((side = 1)::INT) AS x, sum((side = 2)::INT) AS y FROM e GROUP BY ord, gram),
h AS (SELECT ord, x::DOUBLE / idf AS x, y::DOUBLE / idf AS y FROM f JOIN d USING (gram) WHERE x > 0 AND y > 0)
SELECT ord, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 9) AS tfidf FROM h GROUP BY ord""",
        "pair_feature_dict": f"""
{_lists()}, g AS (SELECT ord, {_all_grams('a')} AS x, {_all_grams('b')} AS y FROM lists WHERE label IS NULL OR label),
every AS (SELECT ord, u || '--' || w AS pair FROM (SELECT ord, u, unnest(y) AS w FROM (SELECT ord, unnest(x) AS u, y FROM g))
  UNION ALL SELECT ord, unnest(list_filter(x, lambda e: NOT list_contains(y, e))) || '--' FROM g
  UNION ALL SELECT ord, '--' || unnest(list_filter(y, lambda e: NOT list_contains(x, e))) FROM g)
SELECT pair, count(*) AS cnt FROM every GROUP BY pair HAVING count(*) >= 2""",
        "sqrt_overlap_bins": f"{roots} SELECT ord, {_text(root_ids)} AS ids FROM q",
        "libsvm_lines": f"{roots} SELECT ord, CASE WHEN label THEN '1' ELSE '0' END || ' ' || array_to_string(list_transform({root_ids}, lambda i: i || ':1'), ' ') AS line FROM q WHERE label IS NOT NULL",
        "script_convert": f"WITH {_NAMES} SELECT name, {to_simple.format(x='name')} AS converted FROM names",
        "script_phrases": f"WITH {_NAMES} SELECT name, {to_traditional.format(x='name')} AS converted FROM names",
        "transliterate": _spelled({"latin": "coalesce(s.m, p.ch)"}, ""),
        "pronounce": _spelled({"latin": "regexp_replace(string_split(s.m, ',')[1], '[0-9]', '', 'g')"}, ""),
        "syllable_split": _spelled({"mandarin": _syllable("s.m"), "cantonese": _syllable("s.c")}, " "),
        "phoneme_split": _spelled({"mandarin": _phonemes("s.m", ["zh", "ch", "sh"]), "cantonese": _phonemes("s.c", ["gw", "ct", "ng", "kw"])}, " "),
        "onset_inventory": "SELECT DISTINCT CASE WHEN substring(cantonese, 2, 1) NOT IN ('', 'a', 'e', 'i', 'o', 'u', 'v', 'y') THEN left(cantonese, 2) ELSE left(cantonese, 1) END AS onset FROM readings WHERE cantonese <> ''",
        "orient_pairs": f"""
SELECT ord, CASE WHEN swap THEN name2 ELSE name1 END AS name1, CASE WHEN swap THEN name1 ELSE name2 END AS name2
FROM (SELECT ord, name1, name2, coalesce(length(translate(name1, {traditional}, '')) < length(name1), false) AS swap FROM matches)""",
        "dedup_consecutive": "SELECT ord, name1, name2 FROM (SELECT ord, name1, name2, lag(name1) OVER (ORDER BY ord) AS before FROM predictions) WHERE before IS NULL OR name1 IS NULL OR before <> name1",
        "noise_filter": f"SELECT ord, name1, name2 FROM aliases WHERE NOT {noise('name1')} AND NOT {noise('name2')}",
        "mod_split": "SELECT ord, CASE WHEN i % 5 < 3 THEN 'train' WHEN i % 5 = 3 THEN 'dev' ELSE 'test' END AS fold_split FROM (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS i FROM matches)",
        "kfold_blocks": "SELECT ord, (i // size)::INT AS fold_id FROM (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS i, count(*) OVER () // 11 // 5 * 11 AS size FROM pairs) WHERE i < size * 5",
        "group_by_marker": "SELECT ord, label, sum(CASE WHEN label THEN 1 ELSE 0 END) OVER (ORDER BY ord)::BIGINT AS group_id FROM scored",
        "neg_all": "SELECT s.n_nationkey AS ord, s.n_name AS name1, t.n_name AS name2, s.n_nationkey = t.n_nationkey AS label, t.n_nationkey AS target_ord FROM nation s, nation t",
        "neg_confuse": """
WITH p AS (SELECT p_partkey AS ord, p_name AS n FROM part), d AS (SELECT DISTINCT n FROM p),
near AS (SELECT a.n AS x, b.n AS y FROM d a JOIN d b ON a.n <> b.n AND levenshtein(a.n, b.n) < greatest(length(a.n), length(b.n))),
firsts AS (SELECT x, ord AS target_ord, p.n AS y, row_number() OVER (PARTITION BY x ORDER BY ord) AS k FROM near JOIN p ON p.n = near.y)
SELECT ord, n AS name1, y AS name2, false AS label, target_ord FROM p JOIN firsts ON p.n = firsts.x AND k <= 10
UNION ALL SELECT ord, n, n, true, ord FROM p""",
        "rank_eval": f"""
WITH {groups} SELECT count(*) AS groups, {hits_sql}, round(avg({rr}), 9) AS mrr, {vars_sql}, round(avg(({rr}) * ({rr})) - avg({rr}) * avg({rr}), 9) AS mrr_var FROM g""",
        "rank_errors": f"WITH {groups} SELECT name1, first_true AS rank, {tied} AS tied FROM g WHERE {tied} OR first_true IS NULL OR first_true > 1",
        "f1_eval": f"""
WITH {_ranked("coalesce(score, '-infinity'::DOUBLE) DESC, ord", "true")},
w AS (SELECT *, min(CASE WHEN NOT prediction THEN rk END) OVER (PARTITION BY name1) AS stop FROM ranked),
t AS (SELECT count(DISTINCT name1) + max((name1 IS NULL)::INT) AS groups, sum((stop IS NULL OR rk < stop)::INT)::BIGINT AS predicted, sum(((stop IS NULL OR rk < stop) AND label)::INT)::BIGINT AS correct FROM w),
r AS (SELECT *, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0 END AS p, correct / groups AS r FROM t)
SELECT groups, predicted, correct, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM r""",
        "threshold_search": """
WITH RECURSIVE top AS (SELECT greatest(0, max(score)) AS m, count(DISTINCT name1) + max((name1 IS NULL)::INT) AS groups FROM scored),
ts(i, t) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT i + 1, t + (SELECT m FROM top) / 100 FROM ts WHERE i < 99),
c AS (SELECT i, t, count(s.ord) AS said, coalesce(sum((s.label)::INT), 0) AS correct FROM ts LEFT JOIN scored s ON s.score > t GROUP BY i, t),
r AS (SELECT i, t, CASE WHEN said > 0 THEN correct / said ELSE 0 END AS p, correct / (SELECT groups FROM top) AS r FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM r)
SELECT round(t, 9) AS threshold, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, i = (SELECT i FROM f ORDER BY f DESC, i LIMIT 1) AS best FROM f""",
        "topk_eval": f"""
WITH {_ranked("coalesce(score, '-infinity'::DOUBLE) DESC, ord", "true")}, g AS (SELECT name1, min(CASE WHEN label THEN rk END) AS f FROM ranked GROUP BY name1)
SELECT count(*) AS groups, round(avg(CASE WHEN f <= 3 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hits, round(avg(coalesce(1.0::DOUBLE / f, 0)), 9) AS mrr, sum(CASE WHEN f <= 3 THEN 0 ELSE 1 END)::BIGINT AS not_in_top FROM g""",
        "threshold_eval": f"""
WITH {_ranked()}, g AS (SELECT name1, count(*) AS n, min(CASE WHEN score < 0.5 THEN rk END) AS cross_at, max((label AND score >= 0.5)::INT) AS hit, sum(CASE WHEN label AND score >= 0.5 THEN 1.0::DOUBLE / rk ELSE 0 END) AS rr, min(CASE WHEN label AND score < 0.5 THEN rk END) AS late FROM ranked GROUP BY name1),
t AS (SELECT count(*) AS groups, avg(hit) AS p, avg(hit / coalesce(cross_at, n)) AS r, avg(CASE WHEN hit > 0 THEN rr ELSE coalesce(1.0::DOUBLE / late, 0) END) AS mrr, sum((hit = 0)::INT)::BIGINT AS not_in_top FROM g)
SELECT groups, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, round(mrr, 9) AS mrr, not_in_top FROM t""",
        "error_diff": """
WITH a AS (SELECT DISTINCT name1 FROM scored WHERE name1 IS NOT NULL AND prediction <> label), b AS (SELECT DISTINCT name1 FROM scored WHERE name1 IS NOT NULL AND (score > 0.5) <> label)
SELECT name1, 'first' AS only_in FROM a WHERE name1 NOT IN (SELECT name1 FROM b) UNION ALL SELECT name1, 'second' FROM b WHERE name1 NOT IN (SELECT name1 FROM a)""",
        "log_runs": r"""
WITH l AS (SELECT ord, ord % 500 = 0 AS mark, 'error term ' || coalesce(name1, '-') AS line FROM scored),
r AS (SELECT *, sum(mark::INT) OVER (ORDER BY ord)::BIGINT AS run FROM l)
SELECT DISTINCT run, list_filter(regexp_split_to_array(trim(line, ' '), '[\s\v]+'), lambda x: true)[3] AS key FROM r WHERE NOT mark AND len(regexp_split_to_array(trim(line, ' '), '[\s\v]+')) >= 3""",
        "p7_found": f"WITH {_CELLS} SELECT line_no, CASE WHEN line IS NULL THEN 'columns' WHEN NOT well THEN 'quoting' WHEN len(c) NOT IN (2, 3) THEN 'columns' ELSE 'value' END AS reason FROM cells {_BROKEN}",
        "p7_clean": f"WITH {_CELLS}, bad AS (SELECT line_no FROM cells {_BROKEN}) SELECT line_no, {_bare('c[1]')} AS name1, {_bare('c[2]')} AS name2, CASE WHEN len(c) = 3 THEN lower({_bare('c[3]')}) = 'true' END AS label FROM cells WHERE line_no NOT IN (SELECT line_no FROM bad)",
        "lev_tokens": _sounded(f" SELECT ord, round({_similar('a_s_m', 'b_s_m')}, 9) AS score FROM sounded"),
        "mode_scores": _modes(to_simple),
        "damerau_pairs": _damerau(),
        "sound_character_bins": _sound_bins(),
        "feature_ids": _features(to_simple),
    }
