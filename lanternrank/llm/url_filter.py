"""URL filters: exact membership in a key list by a cascade of Bloom filters.

The first level encodes the listed keys. Of all keys of the corpus that are not
listed, those it takes for listed go into the second level; of the listed keys,
those that the second level takes for exceptions go into the third, and so on
until nobody is mistaken. A key is judged by the first level that rejects it:
exact for every key of the universe, with no join of pages with a list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternrank.llm.shared import part_files

HASHES = 2
# Bits for each key of a level: about one key in five passes wrongly.
BITS_PER_KEY = 4
# Words of all filters that one pass over pages carries (8 MB); more segments
# than fit are judged in further passes, each over the rows of its segments.
PASS_WORDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of a path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


# The production rules.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; empty if NULL or without ``://``."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if NULL."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``rule, verdict`` of the longest rule that fits, or NULL.

    Longest: by the length of host and path together; ties by name.
    """
    order = sorted(rules, key=lambda r: (-len(r.name), r.name))
    picked = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(order):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        picked = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(picked)
    return picked


@dataclass(frozen=True)
class Cascade:
    """``words`` (level, word, bits): every 64-bit word of every filter.

    Filters are cut into ``segments`` by a hash of the key, so that a pass over
    pages carries a bounded number of words; ``sizes`` gives the words that each
    level has in a segment.
    """

    words: DataFrame
    segments: int
    sizes: tuple[int, ...]

    def judge(self, pages: DataFrame, key: str, out: str = "listed") -> DataFrame:
        """``pages`` with a boolean for the key of each row; NULL is not listed.

        A key outside the universe may be taken for listed.
        """
        each = max(1, PASS_WORDS // max(1, sum(self.sizes)))
        parts = []
        for first in range(0, self.segments, each):
            last = min(self.segments, first + each)
            here = pages
            if each < self.segments:
                here = pages.where(F.coalesce(_segment(F.col(key), self.segments), F.lit(0)).between(first, last - 1))
            parts.append(here.withColumn(out, self._listed(F.col(key), first, last)))
        return reduce(DataFrame.unionByName, parts)

    def _listed(self, key: Column, first: int, last: int) -> Column:
        verdict = F.lit(len(self.sizes) % 2 == 1)
        for level in range(len(self.sizes), 0, -1):
            inside = _inside(self.words, key, level, self.segments, self.sizes[level - 1], first, last)
            verdict = F.when(inside, verdict).otherwise(F.lit(level % 2 == 0))
        return F.coalesce(key.isNotNull() & verdict, F.lit(False))


def _segment(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("segment"), key), F.lit(segments))


def _bits(key: Column, level: int, segments: int, size: int) -> list[Column]:
    """The places of a key in the bits of a level."""
    start = _segment(key, segments) * (size * 64)
    return [start + F.pmod(F.xxhash64(F.lit(level * HASHES + j), key), F.lit(size * 64)) for j in range(HASHES)]


def _inside(words: DataFrame, key: Column, level: int, segments: int, size: int, first: int, last: int) -> Column:
    """Whether a level takes the key for its own. The words of the segments are
    one value of the plan, of at most PASS_WORDS numbers or one segment."""
    near = words.where((F.col("level") == level) & F.col("word").between(first * size, last * size - 1))
    table = near.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w")).select("w.bits").scalar()
    tests = [
        F.getbit(F.element_at(table, (F.shiftright(bit, 6) - first * size + 1).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1
        for bit in _bits(key, level, segments, size)
    ]
    return reduce(Column.__and__, tests)


def build(universe: DataFrame, listed: DataFrame, key: str, segments: int | None = None) -> Cascade:
    """The cascade that tells the ``listed`` keys from all others of ``universe``.

    Both are columns of keys; repeats and NULLs are ignored, listed keys outside
    the universe are kept. Every level is an aggregate over the keys that the
    level before got wrong, about one in five of them, so the work shrinks from
    level to level and ends when no key is left. Empty lists give no level.
    There are as many segments as the listed keys need for one to fit a pass.
    """
    spark = universe.sparkSession
    own = part_files(listed.select(F.col(key).alias("key")).where("key is not null").distinct(), "listed")
    rest = universe.select(F.col(key).alias("key")).where("key is not null").distinct()
    rest = part_files(rest.join(own, "key", "left_anti"), "unlisted")
    if segments is None:
        segments = max(1, math.ceil(own.count() * BITS_PER_KEY / 64 / PASS_WORDS))
    tables, sizes = [], []
    while (n := own.count()) > 0:
        level, size = len(sizes) + 1, max(1, math.ceil(n * BITS_PER_KEY / 64 / segments))
        bit = F.explode(F.array(*_bits(F.col("key"), level, segments, size)))
        used = own.select(bit.alias("bit")).select(
            F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits")
        )
        blank = spark.range(segments * size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        table = used.union(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        tables.append(part_files(table.select(F.lit(level).alias("level"), "word", "bits"), f"level-{level}"))
        sizes.append(size)
        mistaken = []
        each = max(1, PASS_WORDS // size)
        for first in range(0, segments, each):
            last = min(segments, first + each)
            here = rest.where(_segment(F.col("key"), segments).between(first, last - 1))
            mistaken.append(here.where(_inside(tables[-1], F.col("key"), level, segments, size, first, last)))
        own, rest = part_files(reduce(DataFrame.union, mistaken), "mistaken"), own
    empty = spark.createDataFrame([], "level int, word long, bits long")
    return Cascade(reduce(DataFrame.union, tables, empty), segments, tuple(sizes))


def judge_urls(
    pages: DataFrame, cascade: Cascade, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``id, host, path, rule, verdict, listed`` for every row.

    The longest rule that fits decides; without one, a host of the cascade's
    list is blocked and any other allowed. Repeated rows and NULL ids stay, NULL
    urls and urls without ``://`` have an empty host and path; other columns
    are left out.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = cascade.judge(parts, "host").withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(
        id_col, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", own).alias("verdict"), "listed",
    )


def tracking_hosts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``host``: hosts that tag visitors more often than the whole corpus does.

    The production list: the share of a host's urls with a ``utm_`` parameter
    exceeds that of all urls.
    """
    url = F.col(url_col)
    by = pages.select(host_of(url).alias("host"), F.coalesce(url.rlike("[?&]utm_"), F.lit(False)).cast("long").alias("t"))
    by = by.groupBy("host").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    whole = by.agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    share = whole.select(F.struct("n", "t").alias("all")).scalar()
    return by.withColumn("all", share).where("t * all.n > all.t * n").select("host")
