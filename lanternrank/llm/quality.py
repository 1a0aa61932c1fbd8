"""Quality rules: base counts, and a hashed n-gram likelihood ratio.

Words and word pairs are hashed into buckets. Two multinomials over the buckets,
one of trusted documents and one of the whole corpus, give each n-gram a log
ratio; a document is kept if their mean over its n-grams reaches a threshold.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternrank.llm.shared import part_files

BUCKETS = 1 << 14
# Added to each bucket's count, in both multinomials.
SMOOTHING = 1.0
# Mean log ratio from which a document is kept.
THRESHOLD = -0.2
WINDOW = 8
FEWEST_WORDS = 20
REPEATED_PERCENT = 30


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Runs without ASCII white space; none in NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """Buckets of all words and pairs of neighbours, in lower case."""

    def both(codes: Column) -> Column:
        single = F.transform(codes, lambda c: F.pmod(c, F.lit(BUCKETS)).cast("int"))
        pair = F.zip_with(
            codes, F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
            lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int")),
        )
        return F.concat(single, F.slice(pair, 1, F.greatest(F.size(codes) - 1, F.lit(0))))

    return let(F.transform(words, lambda w: F.xxhash64(F.lower(w))), both)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words in windows of 8 words that occur twice or more, the first included.

    Windows are compared by 64-bit hashes. Only if some are equal, their places
    are sorted by hash, and the spans of those with an equal neighbour counted.
    """
    span = F.lit(WINDOW)

    def windows(codes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(codes) - WINDOW)
        each = F.transform(starts, lambda k: F.xxhash64(*[F.element_at(codes, k + (j + 1)) for j in range(WINDOW)]))
        return let(each, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        places = F.array_sort(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))

        def twice(s: Column) -> Column:
            def equal(x: Column, k: Column) -> Column:
                before = F.get(s, k - 1)["h"]
                after = F.get(s, k + 1)["h"]
                return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

            return F.array_sort(F.transform(F.filter(s, equal), lambda x: x["k"]))

        def total(k: Column) -> Column:
            gaps = F.transform(k, lambda x, j: F.least(span, F.coalesce(F.get(k, j + 1) - x, span)))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return let(let(places, twice), total)

    codes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(codes, windows)).cast("long")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bucket, ratio``: log probability of every bucket in trusted documents
    less that in all documents.

    ``trusted`` is a column of ids. Counts cover every document; words are
    counted in each task before anything is shuffled, one row per bucket.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.explode(grams(words_of(F.col(text_col)))).alias("bucket"))
    raw = rows.groupBy("bucket").agg(F.count("*").alias("raw"))
    chosen = trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    best = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    # One plan at every size: texts meet their labels in one shuffle.
    best = best.join(chosen.hint("shuffle_merge"), "id", "left_semi").select(F.explode(grams(words_of(F.col("text")))).alias("bucket"))
    target = best.groupBy("bucket").agg(F.count("*").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw, "bucket", "left").join(target, "bucket", "left").na.fill(0, ["raw", "target"])
    sums = both.agg((F.sum("raw") + SMOOTHING * BUCKETS).alias("r"), (F.sum("target") + SMOOTHING * BUCKETS).alias("t"))
    total = sums.select(F.struct("r", "t")).scalar()
    ratio = F.log((F.col("target") + SMOOTHING) / total["t"]) - F.log((F.col("raw") + SMOOTHING) / total["r"])
    return both.select("bucket", ratio.cast("float").alias("ratio"))


def judge(
    docs: DataFrame, ratios: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Base counts, ``base_failed``, ``log_ratio`` and ``kept`` for every row.

    ``log_ratio`` is the mean over words and pairs; 0 for a text without words,
    which fails the base rules. Repeated rows and NULL ids stay; NULL texts count
    as empty; other columns are left out. ``ratios`` has a fixed number of
    buckets and becomes one value of the plan: no join, no shuffle.
    """
    table = ratios.agg(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))).alias("x")).select("x.ratio").scalar()
    text = F.col(text_col)
    # Subqueries may not stand inside lambdas, so it is a column within the task.
    rows = docs.select(F.col(id_col), text.alias("_text"), words_of(text).alias("_words"), table.alias("_ratios"))

    def mean(g: Column) -> Column:
        total = F.aggregate(g, F.lit(0.0), lambda a, b: a + F.element_at("_ratios", b + 1).cast("double"))
        return F.when(F.size(g) > 0, total / F.size(g)).otherwise(F.lit(0.0))

    n_words = F.size("_words").cast("long")
    plain = F.coalesce(F.col("_text"), F.lit(""))
    base = rows.select(
        id_col,
        n_words.alias("n_words"),
        F.length(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(plain) - F.length(F.translate(plain, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("_text")).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        let(grams(F.col("_words")), mean).alias("log_ratio"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return base.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("log_ratio") >= threshold))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents that are labelled as good."""
    return labels.where("quality = 1").select("doc_id")


def keep_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The production ratios, written once and read by the scoring pass."""
    return part_files(log_ratios(docs, trusted_ids(labels)), "ratios")
