"""Fuzzy line deduplication with DataFrame functions only.

Every line is normalised and gets a 64-bit SimHash of its distinct words. The
bits are cut into eight blocks; lines that agree on two of them, which is certain
up to six differing bits, and have nearly the same length meet at a key. Of those,
lines with few differing bits, the same numbers and the edit similarity are
linked. Of each connected group the first line stays.

Equal lines are one node. First, nodes meet the leader of a longer block, which
connects the copies of a line. Then, at the keys of two blocks, only those
outside the group of a key's leader meet the others, and only nodes of different
groups are paired, at the first key they share. Counts of letters rule most pairs
out, and bounds decide most of the others; the exact edit distance is left for what
those have not connected.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternrank.llm.quality import let
from lanternrank.llm.shared import clean_shuffles, connected, part_files, scratch

# Blocks of the fingerprint, and how many of them make a key.
BLOCKS, CHOSEN = 8, 2
# Differing bits of 64 up to which lines of a key are compared in full.
MOST_BITS = 12
# Edit similarity: one less edits over the longer length.
PERCENT = 90
# Lines whose words are longer than this on average are cut into runs of GRAM
# characters, for scripts without spaces.
LONG_WORD, GRAM = 24, 3
# Characters of a piece by which texts are told to be far apart.
PIECE = 5
# Characters that are counted, each for itself, for the same; all others as one.
COUNTED, COUNTS = " etaoinsrhldcum", ("counts", "counts_2")
# Pairs left open by the bounds that are compared whether they are connected or not.
AT_ONCE = 1 << 12
# Width of a band of lengths, in the logarithm; it only cuts the lists of keys.
BAND = 0.6
# Lines that hold more than one in so many rows are told to all tasks.
HOT = 512
# Turns in which the keys of two blocks are shuffled.
TURNS = 7


def normal(line: Column) -> Column:
    """Lower case; runs of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}\p{N}]+", " "))


def numbers(plain: Column) -> Column:
    """The digit runs of a normalised line, in order."""
    return F.regexp_extract_all(plain, F.lit(r"(\p{N}+)"), F.lit(1))


def features(plain: Column) -> Column:
    """Distinct words; of a line of very long ones, distinct runs of characters."""
    words = F.split(plain, " ")
    # A look-ahead takes overlapping runs, in generated code.
    grams = F.regexp_extract_all(plain, F.lit("(?=(.{%d}))" % GRAM), F.lit(1))
    return F.array_distinct(F.when(F.length(plain) > LONG_WORD * F.size(words), grams).otherwise(words))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, line, raw`` of every line with a letter, in order; ``raw``
    is the line's hash."""
    split = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line_no", "line")
    rows = docs.select(F.col(id_col).alias("id"), split).where(F.col("line").rlike(r"\p{L}"))
    return rows.withColumn("raw", F.xxhash64("line"))


def _majority(codes: Column, n: Column, wide: int) -> Column:
    """The bits that are set in more than half of ``n`` hashes, fewer than
    2 ** (wide - 1): counts of ``wide`` bits are added up side by side."""
    lanes = F.lit(sum(1 << k for k in range(0, 64, wide)))
    apart = sum(1 << k for k in range(0, 64, 2 * wide))

    def bits_of(j: int, half: Column) -> Column:
        """Every ``wide``-th bit, from bit ``j``."""

        def tell(total: Column) -> Column:
            told = F.lit(0).cast("long")
            for shift in (0, wide):
                # Every second count, with room for the carry that tells a majority.
                count = F.shiftrightunsigned(total, shift).bitwiseAND(F.lit(apart * ((1 << wide) - 1)))
                more = (count + half).bitwiseAND(F.lit(apart << wide - 1))
                told = told.bitwiseOR(F.shiftleft(F.shiftrightunsigned(more, wide - 1 - j), shift))
            return told

        return F.aggregate(codes, F.lit(0).cast("long"), lambda total, h: total + F.shiftrightunsigned(h, j).bitwiseAND(lanes), tell)

    half = (F.lit((1 << wide - 1) - 1) - F.floor(n / 2)) * F.lit(apart)
    return let(half, lambda each: reduce(Column.bitwiseOR, [bits_of(j, each) for j in range(wide)]))


def _bits(words: Column) -> Column:
    """The majority of each bit of the words' hashes, for any number of them."""

    def told(codes: Column) -> Column:
        n = F.size(codes)
        few = F.when(n < 1 << 7, _majority(codes, n, 8)).when(n < 1 << 15, _majority(codes, n, 16))
        return few.otherwise(_majority(codes, n, 32))

    return let(F.transform(words, lambda w: F.xxhash64(w)), told)


def fingerprints(lines: DataFrame) -> DataFrame:
    """``raw, node, length, bits, first_id, times`` of every distinct line."""
    plain = lines.select("id", "raw", normal(F.col("line")).alias("plain"))
    told = plain.select(
        "id", "raw", F.xxhash64("plain").alias("node"), F.length("plain").alias("length"), let(features(F.col("plain")), _bits).alias("bits")
    )
    return told.groupBy("raw", "node", "length", "bits").agg(F.min("id").alias("first_id"), F.count("*").alias("times"))


def _banded(nodes: DataFrame) -> DataFrame:
    """Rows with the band of lengths; those near the lower end are also in the
    band below, so that similar lines have a band in common."""
    place = F.log(F.col("length").cast("double")) / BAND
    near = math.log(100 / PERCENT) / BAND + 0.01
    band = F.floor(place)
    return nodes.withColumn("band", F.explode(F.when(place - band <= near, F.array(band, band - 1)).otherwise(F.array(band))))


def _keyed(nodes: DataFrame, chosen: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """A row for each key of a node: ``chosen`` of the fingerprint's blocks (or,
    if 1, of its quarters), with the band; of ``turns`` parts of all keys one."""
    count, wide = (4, 16) if chosen == 1 else (BLOCKS, 64 // BLOCKS)
    parts = [F.shiftrightunsigned("bits", wide * k).bitwiseAND(F.lit((1 << wide) - 1)) for k in range(count)]
    keys = []
    for n, some in list(enumerate(combinations(range(count), chosen)))[turn::turns]:
        key = F.lit(n).cast("long")
        for k in some:
            key = F.shiftleft(key, wide).bitwiseOR(parts[k])
        keys.append(key)
    # Never NULL: a join of the rows with themselves then shuffles them once.
    nodes = nodes.select([F.coalesce(c, F.lit(0)).alias(c) for c in nodes.columns])
    rows = _banded(nodes).withColumn("block", F.explode(F.array(*keys)))
    key = F.shiftleft("block", 6).bitwiseOR(F.col("band").cast("long"))
    rows = rows.withColumn("key", F.coalesce(key, F.lit(0))).drop("block", "band")
    return rows.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def _close(other: str) -> Column:
    """Lengths that can be that similar, and few differing bits."""
    length, bits = F.col(f"length{other}"), F.col(f"bits{other}")
    near = 100 * F.least("length", length) >= PERCENT * F.greatest("length", length)
    return near & (F.bit_count(F.col("bits").bitwiseXOR(bits)) <= MOST_BITS)


def _to_leader(nodes: DataFrame) -> DataFrame:
    """Candidates ``a, b``: each node and the leader of each of its quarters."""
    within = Window.partitionBy("key").orderBy("num")
    rows = _keyed(nodes.select("num", "length", "bits"), 1)
    lead = [F.first(c).over(within).alias(f"{c}_b") for c in ("num", "length", "bits")]
    rows = rows.select("num", "length", "bits", *lead).where((F.col("num") != F.col("num_b")) & _close("_b"))
    return rows.select(F.col("num").alias("a"), F.col("num_b").alias("b")).distinct()


def _between_groups(nodes: DataFrame) -> DataFrame:
    """Candidates ``a, b`` of different groups that agree on two blocks.

    The keys come in turns, so that the disk holds the rows of few keys at a time.
    A pair is found in one of them only.
    """
    return reduce(DataFrame.union, [part_files(_meeting(nodes, turn), "meeting") for turn in range(TURNS)])


def _first_key(apart: Column) -> Column:
    """The number of the first two blocks that do not differ, of ``_keyed``."""
    same = [F.shiftrightunsigned(apart, 64 // BLOCKS * k).bitwiseAND(F.lit((1 << 64 // BLOCKS) - 1)) == 0 for k in range(BLOCKS)]
    return F.coalesce(*[F.when(same[i] & same[j], F.lit(n)) for n, (i, j) in enumerate(combinations(range(BLOCKS), CHOSEN))])


def _meeting(nodes: DataFrame, turn: int) -> DataFrame:
    rows = _keyed(nodes.select("num", "length", "bits", "group"), CHOSEN, turn, TURNS)
    main = F.first("group").over(Window.partitionBy("key").orderBy("num"))
    outside = rows.withColumn("main", main).where(F.col("group") != F.col("main"))
    other = rows.select("key", *[F.col(c).alias(f"{c}_b") for c in ("num", "length", "bits", "group")])
    # Two that are outside meet once; one outside and one of the main group, too.
    pairs = outside.join(other, "key").where((F.col("group") != F.col("group_b")) & _close("_b"))
    pairs = pairs.where((F.col("num") < F.col("num_b")) | (F.col("group_b") == F.col("main")))
    apart = F.col("bits").bitwiseXOR(F.col("bits_b"))
    pairs = pairs.where(F.shiftrightunsigned("key", 6 + CHOSEN * 64 // BLOCKS) == _first_key(apart))
    # Only the band may still tell one pair twice.
    return pairs.select(F.greatest("num", "num_b").alias("a"), F.least("num", "num_b").alias("b")).distinct()


def _counts(plain: Column) -> list[Column]:
    """Two numbers that hold how often each of COUNTED, and what else, is in a
    normalised line: eight bits for each, 255 for more."""
    size = F.octet_length(plain)
    each = [size - F.octet_length(F.replace(plain, F.lit(c), F.lit(""))) for c in COUNTED]
    each.append(F.length(plain) - reduce(Column.__add__, each))
    lanes = [F.shiftleft(F.least(n, F.lit(255)).cast("long"), 8 * (k % 8)) for k, n in enumerate(each)]
    return [reduce(Column.bitwiseOR, lanes[:8]), reduce(Column.bitwiseOR, lanes[8:])]


def _moved(some: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """How many characters the first of two lines has beyond the second, by
    ``_counts``, and the second beyond the first: edits that are needed."""
    more, less = [], []
    for x, y in some:
        for k in range(8):
            n = [F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255)) for c in (x, y)]
            more.append(F.greatest(n[0] - n[1], F.lit(0)))
            less.append(F.greatest(n[1] - n[0], F.lit(0)))
    return reduce(Column.__add__, more), reduce(Column.__add__, less)


def _texts_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``num, plain, counts, counts_2`` of the wanted nodes, ``num, raw``.

    A bitmap of fixed size, one bit for each hash, spares the shuffle of most
    other lines; the join is exact.
    """
    bits = 1 << 22
    cell = F.pmod(F.col("raw"), F.lit(bits))
    words = wanted.select(F.shiftright(cell, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(raw, {bits}) % 64 as int))").alias("b"))
    blank = wanted.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = part_files(words.union(blank).groupBy("w").agg(F.bit_or("b").alias("b")), "bitmap")
    table = words.agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("x")).select("x.b").scalar()
    seen = F.getbit(F.element_at(table, (F.shiftright(cell, 6) + 1).cast("int")), F.pmod(cell, F.lit(64)).cast("int")) == 1
    found = lines.select("raw", "line").where(seen).join(wanted, "raw").groupBy("num", "line").agg(F.count("*"))
    found = found.select("num", normal(F.col("line")).alias("plain"))
    return part_files(found.select("num", "plain", *[c.alias(n) for c, n in zip(_counts(F.col("plain")), COUNTS)]), "plain")


def _middles(x: Column, y: Column) -> Column:
    """``x, y`` without the words that both begin and both end with, each word
    left with the space before it: as many edits apart as the whole lines."""

    def equal(a: Column, b: Column) -> Column:
        """Words that are equal up to the first two that are not."""
        at = F.array_position(F.zip_with(a, b, lambda v, w: v.eqNullSafe(w)), False).cast("int")
        return F.when(at > 0, at - 1).otherwise(F.size(a))

    def text(words: Column, n: Column) -> Column:
        return F.array_join(F.transform(F.slice(words, F.lit(1), F.size(words) - n), lambda w: F.concat(F.lit(" "), w)), "")

    def without_head(a: Column, b: Column, n: Column) -> Column:
        return F.array(*[F.slice(c, n + 1, F.size(c) - n) for c in (a, b)])

    def both(words: Column) -> Column:
        a, b = words[0], words[1]
        return let(equal(F.reverse(a), F.reverse(b)), lambda n: F.struct(text(a, n).alias("x"), text(b, n).alias("y")))

    words = F.array(F.split(x, " "), F.split(y, " "))
    return let(words, lambda w: let(let(equal(w[0], w[1]), lambda n: without_head(w[0], w[1], n)), both))


def _at_most(x: Column, y: Column, most: Column) -> Column:
    """Edits by which ``x`` becomes ``y``, word by word: never fewer than the
    edit distance. Words are paired in order; one that stands next in the other
    text is waited for. It ends, with more than ``most``, once there are so many."""

    def edits(a: Column, b: Column) -> Column:
        def state(at: Column, cost: Column) -> Column:
            return F.struct(at.alias("at"), cost.alias("cost"))

        def step(s: Column, k: Column) -> Column:
            at, cost = s["at"], s["cost"]
            w, v = F.get(a, k), F.get(b, at)
            longest = F.greatest(F.length(w), F.length(v))
            other = F.when(longest <= LONG_WORD, F.levenshtein(w, v)).otherwise(longest)
            return (
                F.when(cost > most, s)
                .when(w == v, state(at + 1, cost))
                .when(v.isNull() | (F.get(a, k + 1) == v), state(at, cost + F.length(w) + 1))
                .when(F.get(b, at + 1) == w, state(at + 2, cost + F.length(v) + 1))
                .otherwise(state(at + 1, cost + other))
            )

        def end(s: Column) -> Column:
            rest = F.slice(b, s["at"] + 1, F.greatest(F.size(b) - s["at"], F.lit(0)))
            return F.when(s["cost"] > most, s["cost"]).otherwise(F.aggregate(rest, s["cost"], lambda n, w: n + F.length(w) + 1))

        return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), state(F.lit(0), F.lit(0)), step, end)

    return let(F.split(x, " "), lambda a: let(F.split(y, " "), lambda b: edits(a, b)))


def _at_least(x: Column, y: Column) -> Column:
    """Edits without which ``x`` cannot become ``y``: one for each of its pieces
    side by side that is nowhere in ``y``."""
    pieces = F.regexp_extract_all(x, F.lit("(.{%d})" % PIECE), F.lit(1))
    return F.size(F.filter(pieces, lambda p: ~F.contains(y, p)))


def _most(longer: Column) -> Column:
    """Edits that the longer line may have."""
    return F.floor(longer * (100 - PERCENT) / 100).cast("int")


def _possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs that counts of letters do not rule out."""
    told = texts.select("num", F.length("plain").alias("length"), *COUNTS)
    for end in ("a", "b"):
        pairs = pairs.join(told.select([F.col(c).alias(end if c == "num" else f"{c}_{end}") for c in told.columns]), end)
    more, less = _moved([(F.col(f"{c}_a"), F.col(f"{c}_b")) for c in COUNTS])
    return pairs.where(F.greatest(more, less) <= _most(F.greatest("length_a", "length_b"))).drop(
        *[f"{c}_{end}" for c in ("length", *COUNTS) for end in ("a", "b")]
    )


def _compared(pairs: DataFrame, texts: DataFrame, told: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``a, b, sure``: of pairs of the same numbers what is ``told`` by their
    ``_middles`` and the edits they may have, NULL of others. To be written before
    rows are chosen by it: what chooses rows is told once more."""
    near = pairs.select("a", "b").join(texts.select(F.col("num").alias("a"), F.col("plain").alias("x")), "a")
    near = near.join(texts.select(F.col("num").alias("b"), F.col("plain").alias("y")), "b")
    x, y = F.col("x"), F.col("y")
    pair = F.struct(_middles(x, y).alias("of"), _most(F.greatest(F.length(x), F.length(y))).alias("most"))
    sure = let(pair, lambda p: told(p["of"]["x"], p["of"]["y"], p["most"]))
    return near.select("a", "b", F.when(numbers(x) == numbers(y), sure).alias("sure"))


def _by_bounds(pairs: DataFrame, nodes: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b, sure`` of pairs that may be similar, and those that are for sure;
    and the texts. Two bounds, in time with the length, spare many the exact distance."""
    ends = pairs.select(F.col("a").alias("num")).union(pairs.select("b")).distinct()
    texts = _texts_of(lines, nodes.select("num", "raw").join(ends, "num"))
    told = _compared(_possible(pairs, texts), texts, lambda x, y, most: F.when(_at_least(x, y) <= most, _at_most(x, y, most) <= most))
    return part_files(told, "bounds").where("sure is not null"), texts


def _exact(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` of pairs within the edits they may have."""
    told = _compared(pairs, texts, lambda x, y, most: F.call_function("levenshtein", x, y, most) >= 0)
    return part_files(told, "exact").where("sure").select("a", "b")


def _joining(pairs: DataFrame, known: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Of the similar pairs of ``pairs`` enough, ``a, b``, to connect all that they
    and the links ``known`` connect."""
    told, texts = _by_bounds(pairs, nodes, lines)
    found, rest = told.where("sure").select("a", "b"), told.where("not sure").select("a", "b")
    if rest.count() > AT_ONCE:
        # Whatever is in one group by now needs no comparison.
        group = part_files(connected(known.union(found)), "groups")
        for end in ("a", "b"):
            rest = rest.join(group.select(F.col("node").alias(end), F.col("component").alias(f"group_{end}")), end, "left")
        rest = rest.where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b"))
    return found.union(_exact(rest, texts))


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    groups = part_files(connected(links), "groups").select(F.col("node").alias("num"), "component")
    return nodes.join(groups, "num", "left").withColumn("group", F.coalesce("component", "num")).drop("component")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, drop``: for each document the numbers (from 0) of its lines that
    repeat a line before: one of a smaller id, or an earlier one of its own."""
    lines = lines_of(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    each = part_files(fingerprints(lines), "distinct")
    nodes = each.groupBy("node", "length").agg(F.first("bits").alias("bits"), F.min("raw").alias("raw"))
    nodes = part_files(nodes.withColumn("num", F.monotonically_increasing_id()), "nodes")
    # Shorter lines have no edit to spare.
    some = nodes.where(F.col("length") * (100 - PERCENT) >= 100)
    star = part_files(_to_leader(some), "star")
    # What the bounds leave open meets again below, as a pair of two groups.
    first = _by_bounds(star, nodes, lines)[0].where("sure").select("a", "b")
    pairs = part_files(_between_groups(part_files(_grouped(some, first), "grouped")), "pairs")
    links = first.union(_joining(pairs, first, nodes, lines))

    groups = _grouped(nodes, links).select("node", "length", "group")
    named = part_files(each.join(groups, ["node", "length"]).select("raw", "group", "first_id", "times"), "named")
    twice = named.groupBy("group").agg(F.min("first_id").alias("first_id"), F.sum("times").alias("n")).where("n > 1")
    lost = part_files(named.drop("first_id").join(twice.drop("n"), "group"), "repeated")
    total = named.agg(F.sum("times")).first()[0] or 0
    # At most HOT lines hold more than a HOT-th of all: those are not shuffled.
    hot = F.broadcast(lost.where(F.col("times") * HOT > total).drop("times"))
    every = lines.select("id", "line_no", "raw")
    found = every.join(hot, "raw").unionByName(every.join(hot, "raw", "left_anti").join(lost.drop("times"), "raw"))
    at = F.min("line_no").over(Window.partitionBy("id", "group"))
    away = found.withColumn("at", at).where((F.col("id") != F.col("first_id")) | (F.col("line_no") != F.col("at")))
    return away.groupBy("id").agg(F.collect_set("line_no").alias("drop")).withColumnRenamed("id", id_col)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated lines, with ``n_lines`` and ``n_dropped`` of each row.

    Two lines are the same if they are equal in letters and digits, A-Z or not.
    They are similar if they have the same numbers in the same order and an edit
    similarity of PERCENT: the longer normalised line has at most that share of
    its characters edited; lines of fewer than ten characters have none to spare.
    Of each connected group the first line stays, by id, then by place. Lines
    without a letter (blank ones, rules, list numbers, times, figures) stay, as
    does the order of lines. Similar lines are found at the keys of their
    fingerprints, which misses some: see the README for the share by length.
    Comparing two similar lines takes time with their length times the edits.

    NULL and empty texts, and rows with a NULL id, are left as they are; rows that
    share an id are dropped the same lines. Very long lines are lines like others.
    Other columns stay, whatever their names; columns named ``n_lines`` or
    ``n_dropped`` are replaced. An empty table gives an empty one.
    """
    with scratch(docs.sparkSession), clean_shuffles(docs.sparkSession):
        away = part_files(repeats(docs, id_col, text_col), "repeats", keep=True).select(F.col(id_col).alias("id"), "drop")
    # Columns by number: no name of theirs can clash.
    kept = [k for k, c in enumerate(docs.columns) if c not in ("n_lines", "n_dropped")]
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    held = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).join(away, F.col(f"c{at_id}") == F.col("id"), "left")
    old = F.col(f"c{at_text}")
    lines = F.split(old, "\n", -1)
    left = let(lines, lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("drop")), lambda k: F.get(x, k)), "\n"
    ))
    text = F.when(F.col("drop").isNull(), old).otherwise(left)
    return held.select(
        *[(text if k == at_text else F.col(f"c{k}")).alias(docs.columns[k]) for k in kept],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
