"""The registered queries: each takes (spark, folder) and reads whole tables.

The given tables hold prose, not code, so code records are built from their
text by fixed templates; the SQL in ``oracle`` builds the same ones.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternrank.functions import text as t
from lanternrank.functions import tokens as tk
from lanternrank.functions import vectors as v
from lanternrank.functions.hashing import HashingModel
from lanternrank.operators import collate as co
from lanternrank.operators import metrics as m
from lanternrank.operators.embed import Encoder, embed, encoder, instructed, register_encoder
from lanternrank.operators.pooling import pick_layer, pool
from lanternrank.operators.precision import average_precision, map_score
from lanternrank.operators.remote import as_remote, embed_by_ledger
from lanternrank.operators.search import first_hit_rank, first_hits, knn_join
from lanternrank.operators.sweep import Limits
from lanternrank.plans import pairs, suites
from lanternrank.registry import templates
from lanternrank.sources import records as r
from lanternrank.sources.session import prepare, read_table
from lanternrank.streaming.embeddings import append_embeddings, read_record_stream

HASHING = register_encoder(Encoder("hashing", HashingModel))
PROMPTED = register_encoder(instructed("prompted-hashing", HashingModel))

# Bounds small enough to force the shuffled layout on the trial tables.
SMALL_TASKS = Limits(broadcast=0, vectors=64 * 8 * 128, state=128 * 16 * 10)


# --- inputs ---------------------------------------------------------------


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled vectors; each is its own item."""
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("index"), "label", "embedding"
    )


def _chat(spark: SparkSession, folder: str, role: str) -> DataFrame:
    """What one side says in a conversation, keyed by the conversation."""
    return read_table(spark, folder, "conversations").where(F.col("role") == role).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").cast("string").alias("key"),
        "text",
    )


def _chat_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """User turns look for assistant turns of the same conversation."""
    asked = suites.embed_side(r.spread(_chat(spark, folder, "user")), HASHING, "query")
    answers = suites.embed_side(r.spread(_chat(spark, folder, "assistant")), HASHING, "passage")
    return asked, answers


def _page_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Page titles look for their pages."""
    pages = r.spread(read_table(spark, folder, "pages"))
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    asked = pages.select(F.col("page_id").alias("id"), F.col("url").alias("key"), title.alias("text"))
    offered = pages.select(F.col("page_id").alias("id"), F.col("url").alias("key"), F.col("html").alias("text"))
    return (
        suites.embed_side(asked, HASHING, "query"),
        suites.embed_side(offered, HASHING, "passage"),
    )


def _c_code() -> Column:
    """A C-like source around a document."""
    return F.concat(
        F.lit("int f() { /* "), F.col("source"), F.lit(" */ return \"a//b\"; } // "),
        F.col("lang"), F.lit("\n\n"), F.col("text"), F.lit("\n  /* end"), F.lit("\n*/ x"),
    )


def _py_code() -> Column:
    """A Python source with a document as comments and as docstring."""
    return F.concat(
        F.lit("# "), F.regexp_replace("text", "\n", "\n# "),
        F.lit("\ndef f(a,\n      b='#no'):  # "), F.col("source"),
        F.lit("\n    '''"), F.regexp_replace("text", "['\\\\]", " "), F.lit("'''\n    s = \""),
        F.col("source"), F.lit("\"  # "), F.col("lang"), F.lit("\n    return s\n"),
    )


def _code_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as labelled code: the label is the number of the source."""
    return r.spread(read_table(spark, folder, "documents")).select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("index"),
        F.substring("source", 4, 9).alias("label"),
        "lang",
        _c_code().alias("func"),
    )


def _code_vectors(spark: SparkSession, folder: str) -> DataFrame:
    clean = co.collate_code(_code_records(spark, folder))
    rows = clean.withColumn("id", F.col("index").cast("bigint")).withColumnRenamed("lang", "domain")
    return r.materialize(embed(rows, "func", HASHING).drop("func"), "code-vectors")


# --- vectors --------------------------------------------------------------


def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    unit = v.l2_normalize(F.col("embedding"))
    return _vectors(spark, folder).select("id", F.posexplode(unit).alias("dim", "x")).select(
        F.col("id").alias("vec_id"), F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("value")
    )


def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector and the one with the next id."""
    rows = _vectors(spark, folder).select("id", "embedding")
    after = rows.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return rows.join(after, "id").select(
        F.col("id").alias("vec_id"),
        F.round(v.dot(a, b), 6).alias("inner_product"),
        F.round(v.cosine(a, b), 6).alias("cosine"),
    )


def sq_l2_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine by way of the distance between unit vectors."""
    rows = _vectors(spark, folder).select("id", v.l2_normalize(F.col("embedding")).alias("unit"))
    after = rows.select((F.col("id") - 1).alias("id"), F.col("unit").alias("other"))
    distance = v.sq_l2(F.col("unit"), F.col("other"))
    return rows.join(after, "id").select(
        F.col("id").alias("vec_id"),
        F.round(distance, 6).alias("sq_l2"),
        F.round(v.cosine_from_l2(distance), 6).alias("cosine"),
    )


def float32_cast(spark: SparkSession, folder: str) -> DataFrame:
    """Unit vectors in single precision, as they are stored."""
    stored = v.to_float32(v.l2_normalize(F.col("embedding")))
    return _vectors(spark, folder).select(
        F.col("id").alias("vec_id"), F.round(v.norm(stored), 5).alias("length")
    )


# --- search ---------------------------------------------------------------


def _rounded(neighbours: DataFrame) -> DataFrame:
    return neighbours.withColumn("score", F.round("score", 6))


def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return _rounded(knn_join(rows, rows, 10))


def knn_topk_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """The same in the shuffled layout, which large query sets take."""
    rows = _vectors(spark, folder)
    return _rounded(knn_join(rows, rows, 10, limits=SMALL_TASKS))


def knn_topk_1000(spark: SparkSession, folder: str) -> DataFrame:
    """At the depth that suites search."""
    rows = _vectors(spark, folder)
    return _rounded(knn_join(rows, rows, 1000)).select("query_id", "passage_id", "rank")


def knn_skewed_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Forty groups of queries; one of them owns all passages. Shuffled layout."""
    rows = _vectors(spark, folder)
    asked = rows.withColumn("part", (F.col("id") % 40).cast("string"))
    offered = rows.withColumn("part", F.lit("7"))
    return _rounded(knn_join(asked, offered, 10, by="part", limits=SMALL_TASKS))


def first_hit_hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Documents look for documents of their source: few keys, many answers each.
    Shuffled layout."""
    texts = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("key"), "text")
    items = read_table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("src"), F.col("conv_id") % 8).alias("key"), "text"
    )
    asked, offered = (suites.embed_side(r.spread(x), HASHING, "passage") for x in (items, texts))
    return first_hit_rank(asked, offered, limits=SMALL_TASKS)


def text_search_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items look for the five nearest documents."""
    items = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    texts = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = suites.embed_side(items, HASHING, "query")
    offered = suites.embed_side(r.spread(texts), HASHING, "passage")
    return _rounded(knn_join(asked, offered))


def first_hit(spark: SparkSession, folder: str) -> DataFrame:
    return first_hit_rank(*_chat_sides(spark, folder))


def first_hit_depth_20(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks beyond the search depth are misses; shuffled layout."""
    return first_hit_rank(*_chat_sides(spark, folder), depth=20, limits=SMALL_TASKS)


def first_hit_searched(spark: SparkSession, folder: str) -> DataFrame:
    """The same ranks from a top-20 search and a lookup of keys."""
    asked, answers = _chat_sides(spark, folder)
    return first_hits(knn_join(asked, answers, 20), asked, answers)


def _chat_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return first_hit(spark, folder)


def mrr_curve(spark: SparkSession, folder: str) -> DataFrame:
    return m.mrr_at_k(_chat_ranks(spark, folder), 1000).withColumn("mrr", F.round("mrr", 6))


def hit_curve(spark: SparkSession, folder: str) -> DataFrame:
    return m.hit_rate_at_k(_chat_ranks(spark, folder), 1000).withColumn("hit_rate", F.round("hit_rate", 6))


def mrr_hard(spark: SparkSession, folder: str) -> DataFrame:
    """Hard cases: conversations that carry a system turn."""
    hard = _chat(spark, folder, "system").select("key")
    asked, answers = _chat_sides(spark, folder)
    ranks = first_hit_rank(m.keep_hard(asked, hard), answers)
    return m.mrr_at_k_hard(ranks, hard, 50).withColumn("mrr", F.round("mrr", 6))


def _round_metrics(report: DataFrame) -> DataFrame:
    metrics = [c for c in report.columns if "_at_" in c]
    return report.withColumns({c: F.round(c, 6) for c in metrics})


def search_report(spark: SparkSession, folder: str) -> DataFrame:
    return _round_metrics(m.retrieval_report(_chat_ranks(spark, folder)))


# --- average precision ----------------------------------------------------


def average_precision_labels(spark: SparkSession, folder: str) -> DataFrame:
    return average_precision(_vectors(spark, folder)).withColumn("ap", F.round("ap", 6))


def map_in_domain(spark: SparkSession, folder: str) -> DataFrame:
    return map_score(_vectors(spark, folder)).select(F.round("map", 6).alias("map"))


def map_cross_domain(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of one language against those of each other language.

    Candidates pass once for their own language; queries carry theirs along.
    """
    vectors = _code_vectors(spark, folder)
    return suites.cross_maps(vectors).withColumn("map", F.round("map", 6))


def map_keep_self(spark: SparkSession, folder: str) -> DataFrame:
    """MAP in which a query's own item counts, for items partly without an index."""
    rows = _vectors(spark, folder)
    some = rows.withColumn("index", F.when(F.col("label") < 5, F.col("index")))
    return map_score(some, exclude_self=False).select(F.round("map", 6).alias("map"))


# --- suites ---------------------------------------------------------------


def _suite(spark: SparkSession, folder: str) -> DataFrame:
    chat, pages = _chat_sides(spark, folder), _page_sides(spark, folder)
    queries, passages = (
        a.withColumn("dataset", F.lit("chat")).unionByName(b.withColumn("dataset", F.lit("pages")))
        for a, b in zip(chat, pages)
    )
    return m.retrieval_report(suites.suite_ranks(queries, passages), by="dataset")


def suite_report(spark: SparkSession, folder: str) -> DataFrame:
    report = suites.long_report(_suite(spark, folder), "search", "dataset")
    return report.withColumn("value", F.round("value", 6))


def suite_display(spark: SparkSession, folder: str) -> DataFrame:
    return suites.display(_suite(spark, folder), "dataset", "mrr_at_1000", ("pages", "chat"))


def code_suite(spark: SparkSession, folder: str) -> DataFrame:
    """MAP within each language, rounded to four places, in display order."""
    scores = map_score(_code_vectors(spark, folder), by="domain")
    return suites.display(scores, "domain", "map", ("en", "de", "fr", "es"))


def _write_arrays(rows: DataFrame, path: str) -> None:
    """Records as files of one JSON array each, a file for each partition."""

    def lines(batches):
        first = True
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [("[" if first else ",") + text]})
                first = False
        if not first:
            yield pa.RecordBatch.from_pydict({"value": ["]"]})

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(lines, "value string").write.text(path)


def _suite_files(spark: SparkSession, folder: str) -> str:
    """The tables as the files of all data sets, in the catalogue's places.

    First lines look for their documents, split over six languages; user turns
    for assistant turns, in array files; and page titles for pages.
    """
    root = _fresh(spark, "suite")
    specs = {s.dataset: s for s in r.catalogue(root)}
    docs = r.spread(read_table(spark, folder, "documents"))
    for k, lang in enumerate(r.CSN_LANGS):
        mine = docs.where(F.col("doc_id") % len(r.CSN_LANGS) == k)
        mine = mine.select(
            F.col("doc_id").cast("string").alias("url"),
            F.split(F.substring_index("text", "\n", 1), " ").alias("docstring_tokens"),
            F.split("text", " ").alias("code_tokens"),
        )
        mine.drop("code_tokens").write.json(specs[lang].query_path)
        mine.drop("docstring_tokens").write.json(specs[lang].passage_path)
    asked, answers = (_chat(spark, folder, role) for role in ("user", "assistant"))
    _write_arrays(asked.select(F.col("key").alias("retrieval_idx"), F.col("text").alias("doc")), specs["cosqa"].query_path)
    _write_arrays(answers.select(F.col("key").alias("url"), F.col("text").alias("code")), specs["cosqa"].passage_path)
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    pages = read_table(spark, folder, "pages")
    pages.select(
        "url", F.split(title, " ").alias("docstring_tokens"), F.split("html", " ").alias("function_tokens")
    ).write.json(specs["adv"].query_path)
    return root


def run_suite_files(spark: SparkSession, folder: str) -> DataFrame:
    """The whole text-to-code suite, from files to one report row for each data set."""
    return _round_metrics(suites.run_suite(spark, _suite_files(spark, folder), "models/hashing-64"))


def run_code_suite_files(spark: SparkSession, folder: str) -> DataFrame:
    """The whole code-to-code suite: documents as functions of nine languages."""
    root = _fresh(spark, "code-suite")
    docs = r.spread(read_table(spark, folder, "documents"))
    for k, lang in enumerate(r.CODE_LANGS):
        mine = docs.where(F.col("doc_id") % len(r.CODE_LANGS) == k)
        code = (_py_code() if lang == "python" else _c_code()).alias("func")
        mine = mine.select(F.col("doc_id").alias("index"), F.substring("source", 4, 9).alias("label"), code)
        mine.write.json(f"{root}/{r.CODE_PATH.format(lang=lang)}")
    scores = suites.run_code_suite(spark, root, "models/hashing-64")
    return suites.show_code_suite(scores)


# --- training pairs -------------------------------------------------------


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("key"), "text")


def structural_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose word shingles are alike, texts of equal shingles once."""
    return pairs.structural_pairs(_texts(spark, folder))


def structural_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of equal shingles that each document belongs to."""
    return pairs.classes(_texts(spark, folder))


def annotated_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with their five nearest assistant turns, texts and both ranks;
    negatives that are like an answer of the conversation are marked, and count
    half; what is below a score goes."""
    asked, answers = (r.spread(_chat(spark, folder, role)) for role in ("user", "assistant"))
    sides = [
        r.materialize(embed(rows, "text", HASHING, role), f"{role}-texts")
        for rows, role in ((asked, "query"), (answers, "passage"))
    ]
    found = pairs.mark_doubtful(pairs.annotated_pairs(*sides, k=5), answers)
    found = pairs.adjust_scores(pairs.select_pairs(found, 0.1), F.col("doubtful"), lambda s: s / 2)
    return found.withColumn("score", F.round("score", 6))


def pair_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Page titles as descriptions of their pages."""
    pages = read_table(spark, folder, "pages")
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    code = pages.select(F.col("page_id").alias("id"), F.col("url").alias("key"), F.col("html").alias("text"))
    return pairs.pair_by_key(code, pages.select(F.col("page_id").alias("id"), F.col("url").alias("key"), title.alias("text")))


# --- text -----------------------------------------------------------------


def _documents(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    return r.spread(read_table(spark, folder, "documents")).select(
        "doc_id", *[c.alias(name) for name, c in columns.items()]
    )


def _words() -> Column:
    return F.split(t.collapse_ws(F.col("text")), " ")


def collapse_ws(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder, text=t.collapse_ws(F.col("text")))


def join_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder, text=t.join_tokens(F.split("text", "[.,\n]+")))


def drop_blank_lines(spark: SparkSession, folder: str) -> DataFrame:
    spaced = F.regexp_replace("text", "\\. ", ".\n \t\n")
    return _documents(spark, folder, text=t.drop_blank_lines(spaced))


def instruct(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark").select("item_id", t.instruct(F.col("text")).alias("text"))


def truncate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(
        spark, folder,
        standard=t.truncate_tokens(F.col("text")),
        short=t.truncate_tokens(F.col("text"), 20),
    )


def strip_c_comments(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder, code=t.strip_c_comments(_c_code()))


def strip_c_comments_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Markup is full of slashes and quotes, paired and not."""
    pages = r.spread(read_table(spark, folder, "pages"))
    return pages.select("page_id", t.strip_c_comments(F.col("html")).alias("code"))


def strip_py_comments(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder, code=t.strip_py_comments(_py_code()))


def strip_py_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of several forms, by id, in which the document's text is code."""
    plain = F.regexp_replace("text", "['\"\\\\{}]", " ")

    def source(template: str) -> Column:
        return F.concat(*[plain if x == "{T}" else F.col("source") if x == "{S}" else F.lit(x) for x in templates.parts(template)])

    kind = F.col("doc_id") % len(templates.PYTHON)
    code = F.coalesce(*[F.when(kind == k, source(x)) for k, (x, _) in enumerate(templates.PYTHON)])
    return _documents(spark, folder, code=t.strip_py_comments(code, on_error="raise"))


def strip_comments(spark: SparkSession, folder: str) -> DataFrame:
    """One pass over a table of mixed languages."""
    lang = (
        F.when(F.col("lang") == "en", "java").when(F.col("lang") == "de", "ruby")
        .when(F.col("lang") == "fr", "python").otherwise("php")
    )
    source = F.when(lang == "python", _py_code()).otherwise(_c_code())
    return _documents(spark, folder, code=t.strip_comments(source, lang))


def fit_tokens(spark: SparkSession, folder: str) -> DataFrame:
    eos, pad = F.lit("<eos>"), F.lit("<pad>")
    return _documents(
        spark, folder,
        query=t.join_tokens(tk.fit_tokens_for(_words(), "query", eos, pad)),
        passage=t.join_tokens(tk.fit_tokens_for(_words(), "passage", eos, pad)),
    )


def attention_mask(spark: SparkSession, folder: str) -> DataFrame:
    pad = F.lit("<pad>")
    ids = tk.fit_tokens_for(_words(), "query", F.lit("<eos>"), pad)
    bits = F.transform(tk.attention_mask(ids, pad), lambda b: b.cast("string"))
    return _documents(spark, folder, mask=F.array_join(bits, ""))


# --- collation ------------------------------------------------------------


def _csn_records(spark: SparkSession, folder: str) -> DataFrame:
    return r.spread(read_table(spark, folder, "documents")).select(
        F.concat_ws("/", "source", "doc_id").alias("url"),
        F.split("text", "\n").alias("docstring_tokens"),
        _words().alias("code_tokens"),
        F.when(F.col("lang") != "en", F.col("text")).alias("code_wo_comment"),
    )


def collate_csn(spark: SparkSession, folder: str) -> DataFrame:
    return co.collate(_csn_records(spark, folder), "csn")


def collate_csn_format(spark: SparkSession, folder: str) -> DataFrame:
    """Format kept; records without that field have empty code."""
    return co.collate(_csn_records(spark, folder), "csn", remain_format=True)


def collate_cosqa_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "benchmark")
    return co.collate(rows.select(F.col("item_id").alias("retrieval_idx"), F.col("text").alias("doc")), "cosqa")


def _cosqa_code(spark: SparkSession, folder: str) -> DataFrame:
    return r.spread(read_table(spark, folder, "documents")).select(
        F.col("doc_id").alias("url"), _c_code().alias("code"), F.col("text").alias("code_wo_comment")
    )


def collate_cosqa_code(spark: SparkSession, folder: str) -> DataFrame:
    return co.collate(_cosqa_code(spark, folder), "cosqa")


def collate_cosqa_code_format(spark: SparkSession, folder: str) -> DataFrame:
    return co.collate(_cosqa_code(spark, folder), "cosqa", remain_format=True)


def _advtest_records(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("url"),
        F.split("text", " ").alias("docstring_tokens"),
        F.split("text", "\n").alias("function_tokens"),
        F.upper("text").alias("function_wo_comment"),
    )


def collate_advtest(spark: SparkSession, folder: str) -> DataFrame:
    return co.collate(_advtest_records(spark, folder), "advtest")


def collate_advtest_format(spark: SparkSession, folder: str) -> DataFrame:
    return co.collate(_advtest_records(spark, folder), "advtest", remain_format=True).select(
        "url", "query", F.lower("passage").alias("passage")
    )


def collate_code(spark: SparkSession, folder: str) -> DataFrame:
    return co.collate_code(_code_records(spark, folder).drop("id"))


# --- embedding and pooling ------------------------------------------------


def _components(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.posexplode("embedding").alias("dim", "x")).select(
        "id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("value")
    )


def embed_local(spark: SparkSession, folder: str) -> DataFrame:
    texts = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return _components(embed(r.spread(texts), "text", encoder("models/hashing-64")))


def embed_query(spark: SparkSession, folder: str) -> DataFrame:
    """Queries carry the instruction, passages do not."""
    texts = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    return _components(embed(texts, "text", PROMPTED, role="query"))


def embed_service(spark: SparkSession, folder: str) -> DataFrame:
    """The trial encoder under a ledger, as a service is asked: in chunks."""
    texts = read_table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    answered = embed_by_ledger(texts, "text", as_remote(HASHING, endpoints=("a", "b")))
    return _components(answered.where(F.col("error").isNull()))


def _states(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as token states: two layers of a sequence per label."""
    rows = read_table(spark, folder, "embeddings")
    layers = F.array(
        F.struct(F.lit(0).alias("layer"), F.reverse("embedding").alias("hidden")),
        F.struct(F.lit(1).alias("layer"), F.col("embedding").alias("hidden")),
    )
    return rows.select(
        F.col("label").alias("seq_id"),
        F.col("vec_id").alias("pos"),
        (F.col("embedding")[0] > 0).cast("int").alias("mask"),
        F.inline(layers),
    )


def _pooled(spark: SparkSession, folder: str, strategy: str, layer: int) -> DataFrame:
    vectors = pool(pick_layer(_states(spark, folder), layer), strategy)
    return _components(vectors.withColumnRenamed("seq_id", "id"))


def pool_last(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, "last", -1)


def pool_first(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, "first", -1)


def pool_mean(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, "mean", -1)


def pick_first_layer(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, "last", 0)


# --- tables on disk -------------------------------------------------------


def _fresh(spark: SparkSession, name: str) -> str:
    prepare(spark)
    return r.fresh_path(spark, name)


def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as JSON lines and read with a declared schema."""
    path = _fresh(spark, "records")
    _csn_records(spark, folder).write.json(path)
    return co.collate(r.read_records(spark, path, "csn"), "csn", remain_format=True)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Records one per line in files that do not say so by their name."""
    rows = read_table(spark, folder, "documents")
    path = _fresh(spark, "records.json")
    rows.select(F.col("doc_id").cast("string").alias("retrieval_idx"), F.col("text").alias("doc")).write.json(path)
    return r.read_records(spark, path, "cosqa_query").select(F.col("retrieval_idx").cast("bigint").alias("doc_id"), "doc")


def read_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Records in files of one JSON array each."""
    path = _fresh(spark, "arrays.json")
    rows = read_table(spark, folder, "documents")
    _write_arrays(rows.select(F.col("doc_id").alias("retrieval_idx"), F.col("text").alias("doc")), path)
    return r.read_records(spark, path, "cosqa_query").select(F.col("retrieval_idx").cast("bigint").alias("doc_id"), "doc")


def read_code_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Code records whose labels are text, quoted as they are written."""
    path = _fresh(spark, "code")
    rows = _code_records(spark, folder)
    rows.select("index", F.col("label").cast("string").alias("label"), "func").write.json(path)
    return co.collate_code(r.read_records(spark, path, "code"), lang="java").select("index", "label")


def embedding_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = _fresh(spark, "vectors")
    r.write_embeddings(_vectors(spark, folder), path, partition_by="label")
    return _components(r.read_embeddings(spark, path))


def report_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = _fresh(spark, "report")
    r.write_report(average_precision_labels(spark, folder), path, "csv")
    return spark.read.csv(path, schema="query_id bigint, ap double, relevant bigint", header=True, sep="\t")


def dataset_counts(spark: SparkSession, folder: str) -> DataFrame:
    names = ("documents", "embeddings", "conversations", "benchmark", "pages")
    return r.row_counts(**{n: read_table(spark, folder, n) for n in names})


def embed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records embedded as a stream of files give the batch job's vectors."""
    arrivals, table, state = (_fresh(spark, n) for n in ("arrivals", "stream", "state"))
    _csn_records(spark, folder).write.json(arrivals)
    records = read_record_stream(spark, arrivals, "csn")
    append_embeddings(records, "csn", HASHING, "passage", table, state).awaitTermination()
    rows = r.read_embeddings(spark, table)
    return _components(rows.withColumn("id", F.substring_index("key", "/", -1).cast("bigint")))
