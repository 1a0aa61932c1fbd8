"""Fingerprints against plain Python; kept lines against brute force; what the
keys find of all similar pairs; odd rows."""

import random

import regex
import xxhash
from pyspark.sql import functions as F

from lanternrank.llm import line_dedup as d
from lanternrank.llm.queries import op7_line_dedup
from lanternrank.llm.shared import clean_shuffles


def plain(line):
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", line.lower()).strip(" ")


def features(line):
    words = line.split(" ")
    if len(line) > d.LONG_WORD * len(words):
        words = [line[k : k + d.GRAM] for k in range(max(1, len(line) - d.GRAM + 1))]
    return list(dict.fromkeys(words))


def bits(line):
    codes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in features(line)]
    return sum(1 << k for k in range(64) if 2 * sum(c >> k & 1 for c in codes) > len(codes))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def similar(x, y):
    most = max(len(x), len(y)) * (100 - d.PERCENT) // 100
    if abs(len(x) - len(y)) > most or regex.findall(r"\p{N}+", x) != regex.findall(r"\p{N}+", y):
        return False
    return distance(x, y) <= most


def meet(x, y):
    """Two of eight bytes are equal, and few bits differ."""
    same = sum((x ^ y) >> 8 * k & 0xFF == 0 for k in range(8))
    return same >= 2 and (x ^ y).bit_count() <= d.MOST_BITS


def brute(rows, by_keys=True):
    """Texts without repeated lines: of each group of equal or similar ones the
    first stays. ``by_keys``: only of pairs that have a key in common."""
    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    lines = [(i, k, plain(x)) for i, t in sorted(dict(rows).items()) for k, x in enumerate(t.split("\n")) if regex.search(r"\p{L}", x)]
    names = list(dict.fromkeys(x[2] for x in lines))
    hashes, root = [bits(x) for x in names], list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if find(a) != find(b) and (not by_keys or meet(hashes[a], hashes[b])) and similar(names[a], names[b]):
                root[find(a)] = find(b)
    place, seen, gone = {n: k for k, n in enumerate(names)}, set(), set()
    for i, k, n in lines:
        g = find(place[n])
        if g in seen:
            gone.add((i, k))
        seen.add(g)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def edited(draw, line, n):
    x = list(line)
    for _ in range(n if len(line) > 5 else 0):
        at = draw.randrange(len(x))
        x[at : at + 1] = draw.choice([[], [draw.choice("abcdefgh ")], [x[at], draw.choice("abcdefgh ")]])
    return "".join(x)


def corpus(seed, n=40):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(1, 9))) for _ in range(120)]
    pool = [" ".join(draw.choices(words, k=draw.choice([1, 2, 4, 8, 15, 30, 60]))) for _ in range(n)]
    pool += [f"{x} {draw.randrange(3)}" for x in pool[: n // 3]]
    rows = []
    for i in range(2 * n):
        lines = []
        for _ in range(draw.randrange(1, 6)):
            x = draw.choice(pool)
            x = edited(draw, x, draw.choice([0, 0, 1, 2, len(x) // 20, len(x) // 10]))
            lines.append(draw.choice(["", "- ", "  "]) + x + draw.choice(["", ".", "!"]))
        rows.append((i, "\n".join(lines)))
    return rows


def test_fingerprints(spark):
    draw = random.Random(1)
    lines = [" ".join(f"w{draw.randrange(300)}" for _ in range(n)) for n in (1, 2, 5, 64, 400, 33_000)]
    lines += ["短い行です" * 12, "短い行 です", "x" * 25, "x" * 24, "É é e"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines + lines[:3])], "doc_id long, text string").repartition(3)
    got = {(r.length, r.bits & (1 << 64) - 1): (r.first_id, r.times) for r in d.fingerprints(d.lines_of(df, "doc_id", "text")).collect()}
    assert got == {(len(plain(x)), bits(plain(x))): (k, 2 if k < 3 else 1) for k, x in enumerate(lines)}


def test_kept_lines(spark):
    rows = corpus(7)
    got = d.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)
    assert 0 < sum(r.n_dropped for r in got) < sum(r.n_lines for r in got)


def test_keys_find_most_similar_pairs():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(2, 10))) for _ in range(2000)]
    found = {}
    for size in (15, 30, 60):
        hits = []
        while len(hits) < 120:
            x = draw.choices(words, k=size)
            y = list(x)
            # One word in fifteen is another one: near the limit of the similarity.
            for _ in range(size // 15):
                y[draw.randrange(size)] = draw.choice(words)
            x, y = " ".join(x), " ".join(y)
            if similar(x, y):
                hits.append(meet(bits(x), bits(y)))
        found[size] = sum(hits) / len(hits)
    assert sum(found.values()) / 3 >= 0.8, found


def test_lines_that_differ_in_numbers_stay(spark):
    texts = [
        "1. \n12:30\nPrice 5 USD\n2. \n14:45\nPrice 7 USD\n1.\n12:30\n3.14 | 2.72\n---\n---",
        "the committee met in room 101 on 12 May to talk about the budget of the year",
        "the committee met in room 999 on 30 May to talk about the budget of the year",
        "The committee met in room 101 on 12 May, to talk about the budgets of the year!",
        "price 5 usd\n12 May in room 101\n3.14 | 2.72",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in d.dedup(df).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: texts[2], 3: "", 4: "12 May in room 101\n3.14 | 2.72"} == brute(list(enumerate(texts)))


def test_odd_rows(spark):
    line = "one two three four five six seven"
    long = " ".join(f"w{k}" for k in range(3000))
    cjk = "これは空白のない長い行ですから単語には分けられません" * 3
    rows = [
        (5, f"{line}\n\n{line.upper()}!\nshort line\nshort line", "a"), (9, line, "b"), (2, None, "c"), (3, "", "d"),
        (4, "\n \n", "e"), (None, line, "f"), (7, long + "\n" + long, "g"), (8, long + " x", "h"), (9, line, "b"),
        (10, cjk, "i"), (11, cjk[:-1] + "ぬ", "j"), (12, "z" * 4000, "k"), (13, "z" * 3900, "l"), (14, "短い行です\n短い行です", "m"),
    ]
    names = "doc_id long, text string, line string, n_lines int, node int, drop int, id int, row int, `a.b` int"
    df = spark.createDataFrame([(*r, 3, 4, 5, 6, 7, 8) for r in rows], names)
    got = d.dedup(df)
    assert got.columns == ["doc_id", "text", "line", "node", "drop", "id", "row", "a.b", "n_lines", "n_dropped"]
    by = {r.line: (r.text, r.n_lines, r.n_dropped) for r in got.collect()}
    assert got.count() == len(rows)
    assert by == {
        "a": (f"{line}\n\nshort line", 5, 2), "b": ("", 1, 1), "c": (None, 0, 0), "d": ("", 1, 0),
        "e": ("\n \n", 3, 0), "f": (line, 1, 0), "g": (long, 2, 1), "h": ("", 1, 1), "i": (cjk, 1, 0), "j": ("", 1, 1),
        "k": ("z" * 4000, 1, 0), "l": ("", 1, 1), "m": ("短い行です", 2, 1),
    }
    assert all((r.node, r.drop, r.id, r.row, r["a.b"]) == (4, 5, 6, 7, 8) for r in got.collect())


def test_empty_table(spark):
    assert d.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, tmp_path):
    rows = corpus(3, 15) + [(900 + k, "a line that a third of all rows have in common") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)
    assert all(r.n_lines == len(dict(rows)[r.doc_id].split("\n")) for r in got)


def test_columns_of_lines(spark):
    df = spark.createDataFrame([(1, "A b\n\n12\nc")], "doc_id long, text string")
    rows = d.lines_of(df, "doc_id", "text").select("line_no", "line", F.col("raw") == F.xxhash64("line")).collect()
    assert [tuple(r) for r in rows] == [(0, "A b", True), (3, "c", True)]


def test_keys_in_turns_are_all_keys(spark):
    df = spark.createDataFrame([(k, 40 + k, k * 0x9E3779B97F4A7C15 % (1 << 63), k % 5) for k in range(50)], "num long, length int, bits long, group long")
    every = sorted(map(tuple, d._keyed(df, d.CHOSEN).collect()))
    turns = [tuple(r) for k in range(d.TURNS) for r in d._keyed(df, d.CHOSEN, k, d.TURNS).collect()]
    assert sorted(turns) == every and len(every) >= 28 * 50


def test_rows_at_keys_are_shuffled_once(spark, tmp_path):
    rows = [(k, 50, (k // 2) * 0x9E3779B97F4A7C15 % (1 << 63), k) for k in range(400)]
    spark.createDataFrame(rows, "num long, length int, bits long, group long").write.parquet(f"{tmp_path}/nodes")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = d._meeting(spark.read.parquet(f"{tmp_path}/nodes"), 0)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_shuffles_go_with_their_query(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with clean_shuffles(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before


def test_fingerprints_of_any_number_of_words(spark):
    draw = random.Random(8)
    rows = [(n, " ".join(f"w{draw.randrange(10**7)}" for _ in range(n))) for n in (1, 2, 126, 127, 128, 129, 255, 256, 3000, 40_000)]
    rows += [(n + 1, "same words " * n) for n in (2, 300)]
    lines = spark.createDataFrame(rows, "id long, line string").withColumn("raw", F.xxhash64("line"))
    wanted = {i: x - (1 << 64) if (x := bits(plain(t))) >> 63 else x for i, t in rows}
    assert {r["first_id"]: r["bits"] for r in d.fingerprints(lines).collect()} == wanted


def _edited(draw, words):
    """Words with some changed, left out, put in, or in other places."""
    out = list(words)
    for _ in range(draw.randrange(1 + len(words) // 3)):
        at = draw.randrange(len(out))
        kind = draw.randrange(4)
        if kind == 0:
            out[at] = draw.choice(words)
        elif kind == 1 and len(out) > 1:
            del out[at]
        elif kind == 2:
            out.insert(at, draw.choice(["ab", "c", "x" * 40, "\u00e9t\u00e9"]))
        else:
            out[at:at + 2] = out[at:at + 2][::-1]
    return out


def test_bounds_of_the_edit_distance(spark):
    """Neither bound is on the wrong side, and the upper one is close enough to
    spare the distance of two near copies."""
    draw = random.Random(9)
    rows = []
    for k in range(400):
        words = ["".join(draw.choice("abcd") for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(1, 25))]
        rows.append((k, " ".join(words), " ".join(_edited(draw, words if k % 5 else words[::-1]))))
    # A word of many goes, another comes and two change places.
    words = [f"word{k}" for k in range(60)]
    near = words[:10] + words[11:30] + ["new"] + [words[31], words[30]] + words[32:]
    rows.append((1000, " ".join(words), " ".join(near)))
    far = spark.createDataFrame(rows, "k long, x string, y string")
    cases = far.select("k", F.levenshtein("x", "y").alias("e"), d._at_most(F.col("x"), F.col("y"), F.lit(10**6)).alias("most"), d._at_least(F.col("x"), F.col("y")).alias("least"))
    for k, e, most, least in cases.collect():
        assert least <= e <= most, rows[min(k, 400)]
        assert k < 1000 or most < 0.1 * len(rows[400][1])


def test_counts_rule_out_no_similar_pair(spark):
    """What letters have moved is never more than the edits, however many there are."""
    draw = random.Random(11)
    rows = []
    for k in range(300):
        x = "".join(draw.choice("eta oinzq\u00e9\u77ed") for _ in range(draw.randrange(1, 60)))
        rows.append((k, x, edited(draw, x, draw.randrange(12)) if k % 3 else x[::-1]))
    rows += [(300, "e" * 300, "e" * 400), (301, "z" * 300, "e" * 300), (302, "z" * 3, "e" * 4)]
    df = spark.createDataFrame(rows, "k long, x string, y string")
    some = df.select("k", F.levenshtein("x", "y").alias("e"), *[c.alias(f"{n}{k}") for k in (0, 1) for n, c in zip("xy", [d._counts(F.col(c))[k] for c in "xy"])])
    more, less = d._moved([(F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))])
    told = {r.k: (r.e, r.more, r.less) for r in some.select("k", "e", more.alias("more"), less.alias("less")).collect()}
    assert all(max(m, n) <= e for e, m, n in told.values())
    assert told[300][1:] == (0, 0) and told[301][1:] == (255, 255) and told[302][1:] == (3, 4)


def test_a_pair_is_found_at_one_key(spark):
    """Two that differ in few bits share many keys; one turn finds them."""
    base = 0x9E3779B97F4A7C15 % (1 << 63)
    rows = [(k, 50 + k % 2, base ^ (1 << 9 * k % 63), k) for k in range(12)]
    nodes = spark.createDataFrame(rows, "num long, length int, bits long, group long")
    turns = [(r.a, r.b) for k in range(d.TURNS) for r in d._meeting(nodes, k).collect()]
    assert sorted(turns) == [(a, b) for a in range(12) for b in range(a)]
    assert sorted(map(tuple, d._between_groups(nodes).collect())) == sorted(turns)


def test_what_is_connected_is_not_compared(spark, monkeypatch):
    """Near copies of one line: the exact distance is left for what no bound connects."""
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(60)]
    texts = [" ".join(words[:k] + ["newer"] * 5 + words[k + 5:]) for k in range(40)]
    # Rows of a word torn apart: similar, but not by the words' bound.
    texts += [" ".join(words), " ".join(words)[::-1], " ".join(f"{w[:3]} {w[3:]}" if k % 12 == 0 else w for k, w in enumerate(words[::-1]))]
    texts += [" ".join(words[::-1])]
    lines = d.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    nodes = d.fingerprints(lines).withColumn("num", F.col("first_id"))
    pairs = spark.createDataFrame([(a, b) for a in range(len(texts)) for b in range(a)], "a long, b long")
    compared = []

    def exact_of(some, held, old=d._exact):
        compared.append(sorted((r.a, r.b) for r in some.collect()))
        return old(some, held)

    monkeypatch.setattr(d, "_exact", exact_of)
    every = None
    for bound in (10**6, 0):
        monkeypatch.setattr(d, "AT_ONCE", bound)
        links = d._joining(pairs, spark.createDataFrame([], "a long, b long"), nodes, lines)
        groups = sorted((r.node, r.component) for r in d.connected(links).collect())
        every = every or groups
        assert groups == every and len(groups) == 43
    assert len(compared[1]) < len(compared[0])


def test_kept_lines_in_two_rounds(spark, monkeypatch):
    monkeypatch.setattr(d, "AT_ONCE", 0)
    rows = corpus(12)
    got = d.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)


def test_middles_are_as_far_apart(spark):
    draw = random.Random(6)
    rows = [("a b c", "a b c"), ("a b", "a x b"), ("a b", "b"), ("a", "a a"), ("a a a", "a a"), ("b a", "a b"), ("x", "y"), ("\u00e9 b c", "\u00e9 d c")]
    for _ in range(200):
        x = draw.choices(["a", "bb", "c", "dd", "\u77ed\u3044"], k=draw.randrange(1, 12))
        rows.append((" ".join(x), " ".join(_edited(draw, x))))
    df = spark.createDataFrame(rows, "x string, y string").withColumn("m", d._middles(F.col("x"), F.col("y")))
    got = df.select("x", "y", F.levenshtein("x", "y").alias("e"), F.levenshtein("m.x", "m.y").alias("of"), "m").collect()
    assert all(r.e == r.of for r in got), [r for r in got if r.e != r.of]
    assert tuple(got[0].m) == ("", "") and tuple(got[1].m) == ("", " x") and tuple(got[7].m) == (" b", " d")
