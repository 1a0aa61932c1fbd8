"""SQL for the registered queries, by window functions over all pairs."""

from __future__ import annotations

from lanternrank.registry import templates

WS = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}]+"
)
LEXEME = (
    r"(?s)''[^''\\]*(?:\\.[^''\\]*)*''"
    r'|"[^"\\]*(?:\\.[^"\\]*)*"'
    r"|//[^\n]*|/\*.*?\*/|[^/''" + '"' + r"]+|."
)
TASK = "Given a code search query, retrieve relevant code snippet that answer the query"
NL = "chr(10)"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'), ' ')"


def _drop_blank(x: str) -> str:
    return (
        f"array_to_string(list_filter(string_split({x}, {NL}), "
        f"lambda ln: {_collapse('ln')} <> ''), {NL})"
    )


def _strip_c(x: str) -> str:
    lexemes = f"regexp_extract_all({x}, '{LEXEME}', 0)"
    kept = (
        f"list_transform({lexemes}, lambda s: "
        "CASE WHEN starts_with(s, '//') OR starts_with(s, '/*') THEN ' ' ELSE s END)"
    )
    return _drop_blank(f"array_to_string({kept}, '')")


C_CODE = (
    "('int f() { /* ' || source || ' */ return \"a//b\"; } // ' || lang || "
    f"{NL} || {NL} || text || {NL} || '  /* end' || {NL} || '*/ x')"
)
PY_CODE = (
    f"('# ' || replace(text, {NL}, {NL} || '# ') || {NL} || 'def f(a,' || {NL} || "
    f"'      b=''#no''):  # ' || source || {NL} || '    ''''''' || "
    "regexp_replace(text, '[''\\\\]', ' ', 'g') || '''''''' || "
    f"{NL} || '    s = \"' || source || '\"  # ' || lang || {NL} || '    return s' || {NL})"
)
# What is left of it: neither the comments nor the docstring.
PY_STRIPPED = (
    f"('def f(a,' || {NL} || '      b=''#no''):  ' || {NL} || '    s = \"' || source || "
    f"'\"  ' || {NL} || '    return s')"
)


def _hashed(name: str, source: str) -> str:
    """CTEs that turn ``source(id, text, ...)`` into ``name(id, e)``."""
    return f"""
    {name}_w AS (
      SELECT id, md5(w) AS h
      FROM (SELECT id, unnest(string_split({_collapse('text')}, ' ')) AS w FROM {source})
      WHERE w <> ''),
    {name}_b AS (
      SELECT id, CAST(('0x' || substr(h, 1, 8)) AS UBIGINT) % 64 AS dim,
             sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x
      FROM {name}_w GROUP BY ALL),
    {name}_l AS (
      SELECT i.id, list(coalesce(b.x, 0.0::DOUBLE) ORDER BY d.dim) AS v
      FROM {source} i CROSS JOIN (SELECT unnest(range(64)) AS dim) d
      LEFT JOIN {name}_b b ON b.id = i.id AND b.dim = d.dim
      GROUP BY i.id),
    {name} AS (
      SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e
      FROM {name}_l WHERE list_dot_product(v, v) > 0)"""


COUNTS = "list_dot_product(q.e, p.e)"
TICKS = f"CAST(round({COUNTS} * 1e9) AS BIGINT)"

UNIT = (
    "SELECT vec_id AS id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e "
    "FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
)


def _neighbours(k: int) -> str:
    return f"""
    SELECT query_id, passage_id, round(ticks / 1e9, 6) AS score, rank FROM (
      SELECT q.id AS query_id, p.id AS passage_id, {TICKS} AS ticks,
             row_number() OVER (PARTITION BY q.id ORDER BY {TICKS} DESC, p.id) AS rank
      FROM q CROSS JOIN p) WHERE rank <= {k}"""


KNN = f"WITH q AS ({UNIT}), p AS ({UNIT}) {_neighbours(10)}"

CHAT = """
    chat_q AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS key, text
               FROM conversations WHERE role = 'user'),
    chat_p AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS key, text
               FROM conversations WHERE role = 'assistant')"""


def _ranks(name: str, queries: str, passages: str, depth: int = 1000) -> str:
    """CTEs ending in ``name(query_id, key, rank)``."""
    return f"""
    {_hashed(name + '_qe', queries)},
    {_hashed(name + '_pe', passages)},
    {name}_s AS (
      SELECT q.id AS qid, qk.key = pk.key AS hit,
             row_number() OVER (PARTITION BY q.id ORDER BY {TICKS} DESC, p.id) AS rank
      FROM {name}_qe q JOIN {queries} qk ON qk.id = q.id
      CROSS JOIN {name}_pe p JOIN {passages} pk ON pk.id = p.id),
    {name} AS (
      SELECT k.id AS query_id, k.key, min(s.rank) AS rank
      FROM {queries} k LEFT JOIN {name}_s s ON s.qid = k.id AND s.hit AND s.rank <= {depth}
      GROUP BY ALL)"""


CHAT_RANKS = f"WITH {CHAT}, {_ranks('r', 'chat_q', 'chat_p')}"

MRR_K = (1, 2, 3, 4, 5, 1000)
HIT_K = (1, 2, 3, 4, 5)


def _report(extra: str = "") -> str:
    mrr = ", ".join(
        f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_at_{k}"
        for k in MRR_K
    )
    hit = ", ".join(
        f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_{k}"
        for k in HIT_K
    )
    return f"SELECT {extra} count(*) AS queries, {mrr}, {hit} FROM r"


SUITE = f"""
    WITH {CHAT},
    page_q AS (SELECT page_id AS id, url AS key,
                      regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS text FROM pages),
    page_p AS (SELECT page_id AS id, url AS key, html AS text FROM pages),
    {_ranks('c', 'chat_q', 'chat_p')}, {_ranks('g', 'page_q', 'page_p')},
    r AS (SELECT 'chat' AS dataset, rank FROM c UNION ALL SELECT 'pages', rank FROM g),
    report AS ({_report('dataset,')} GROUP BY dataset)"""


def _ap(pairs: str) -> str:
    """CTE ``ap(grp, query_id, ap, relevant)`` from ``pairs(grp, qid, pid, ticks, rel)``."""
    return f"""
    ranked AS (
      SELECT grp, qid, rel, row_number() OVER (PARTITION BY grp, qid ORDER BY ticks DESC, pid) AS rank
      FROM ({pairs})),
    hits AS (
      SELECT grp, qid, rank, row_number() OVER (PARTITION BY grp, qid ORDER BY rank) AS n
      FROM ranked WHERE rel),
    ap AS (
      SELECT grp, qid AS query_id, avg(n::DOUBLE / rank) AS ap, count(*) AS relevant
      FROM hits GROUP BY ALL)"""


LABEL_AP = f"""
    WITH u AS ({UNIT}), {_ap(
        f"SELECT 0 AS grp, q.id AS qid, p.id AS pid, q.label = p.label AS rel, {TICKS} AS ticks "
        "FROM u q JOIN u p ON p.id <> q.id"
    )}"""


def _code_ap(grp: str, join: str) -> str:
    return f"""
    WITH code AS (
      SELECT doc_id AS id, CAST(substr(source, 4) AS INT) AS label, lang,
             {_collapse(_strip_c(C_CODE))} AS text FROM documents),
    {_hashed('ce', 'code')},
    u AS (SELECT ce.id, ce.e, code.label, code.lang FROM ce JOIN code ON code.id = ce.id),
    {_ap(
        f"SELECT {grp} AS grp, q.id AS qid, p.id AS pid, q.label = p.label AS rel, {TICKS} AS ticks "
        f"FROM u q JOIN u p ON {join}"
    )}"""


def _curve(value: str, name: str, max_k: int, total: str, where: str = "") -> str:
    return f"""
    SELECT CAST(k AS INT) AS k, round(coalesce(sum(CASE WHEN rank <= k THEN {value} END), 0) / {total}, 6) AS {name}
    FROM (SELECT unnest(range(1, {max_k + 1})) AS k) CROSS JOIN (SELECT * FROM r {where})
    GROUP BY k"""


def _components(vectors: str) -> str:
    """``id, dim, value`` from ``vectors(id, e)``."""
    return (
        f"SELECT id, dim, round(CAST(e[dim + 1] AS DOUBLE), 6) AS value "
        f"FROM {vectors} CROSS JOIN (SELECT unnest(range(64)) AS dim)"
    )


def _counted(name: str, source: str) -> str:
    """The hashed vectors before scaling."""
    return f"{_hashed(name, source)}, {name}_raw AS (SELECT id, v AS e FROM {name}_l)"


WORDS = f"string_split({_collapse('text')}, ' ')"


def _fit(n: int) -> str:
    kept = f"list_slice({WORDS}, 1, {n - 1})"
    return (
        f"list_concat(list_concat({kept}, ['<eos>']), "
        f"list_transform(range({n - 1} - len({kept})), lambda i: '<pad>'))"
    )


STATES = (
    "SELECT label AS id, vec_id AS pos, embedding AS h1, list_reverse(embedding) AS h0 "
    "FROM embeddings WHERE embedding[1] > 0"
)
TEXT_TOP5 = f"""
    WITH items AS (SELECT item_id AS id, text FROM benchmark),
    texts AS (SELECT doc_id AS id, text FROM documents),
    {_hashed('q', 'items')}, {_hashed('p', 'texts')} {_neighbours(5)}"""
EMBEDDED = (
    "WITH texts AS (SELECT doc_id AS id, text FROM documents), "
    + _counted("t", "texts") + " " + _components("t_raw")
)

def _content_id(*columns: str) -> str:
    """The first 60 bits of a digest of the columns, one per line."""
    text = f" || {NL} || ".join(f"coalesce({c}, '')" for c in columns)
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _py_template(n: int) -> str:
    """What is left of a source of the n-th form."""
    plain = "regexp_replace(text, '[''\"\\\\{}]', ' ', 'g')"
    named = {"{T}": plain, "{S}": "source"}
    return _drop_blank("(" + " || ".join(named.get(x, _literal(x)) for x in templates.parts(templates.PYTHON[n][1])) + ")")


def _suite_files() -> str:
    """The report over all data sets of the suite's files."""
    title = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
    sides, ranks = [], []
    langs = ("python", "java", "javascript", "php", "go", "ruby")
    sources = [
        (lang, f"SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS key, string_split(text, {NL})[1] AS text FROM documents WHERE doc_id % 6 = {k}",
         f"SELECT CAST(doc_id AS VARCHAR) AS key, text FROM documents WHERE doc_id % 6 = {k}")
        for k, lang in enumerate(langs)
    ]
    sources.append(("cosqa", f"SELECT id, key, {_collapse('text')} AS text FROM chat_q", f"SELECT key, {_collapse('text')} AS text FROM chat_p"))
    sources.append(("adv", f"SELECT page_id AS id, url AS key, {title} AS text FROM pages", "SELECT url AS key, html AS text FROM pages"))
    for name, asked, offered in sources:
        sides.append(f"{name}_q AS ({asked})")
        sides.append(f"{name}_p AS (SELECT DISTINCT {_content_id(_literal(name), 'key', 'text')} AS id, key, text FROM ({offered}))")
        ranks.append(_ranks(f"{name}_r", f"{name}_q", f"{name}_p"))
    whole = " UNION ALL ".join(f"SELECT '{name}' AS dataset, rank FROM {name}_r" for name, _, _ in sources)
    return f"WITH {CHAT}, {', '.join(sides)}, {', '.join(ranks)}, r AS ({whole}) {_report('dataset,')} GROUP BY dataset"


def _code_files() -> str:
    langs = ("python", "java", "javascript", "typescript", "csharp", "c", "ruby", "php", "go")
    lang = f"[{', '.join(map(_literal, langs))}][1 + doc_id % 9]"
    stripped = f"CASE lang WHEN 'ruby' THEN {C_CODE} WHEN 'python' THEN {PY_STRIPPED} ELSE {_strip_c(C_CODE)} END"
    return f"""
    WITH named AS (SELECT doc_id, source, text, lang AS l, {lang} AS lang FROM documents),
    code AS (
      SELECT {_content_id('lang', 'CAST(doc_id AS VARCHAR)', 'func')} AS id, label, lang, func AS text
      FROM (SELECT doc_id, CAST(substr(source, 4) AS INT) AS label, lang,
                   {_collapse(stripped.replace('|| lang ||', '|| l ||'))} AS func FROM named)),
    {_hashed('ce', 'code')},
    u AS (SELECT ce.id, ce.e, code.label, code.lang FROM ce JOIN code ON code.id = ce.id),
    {_ap(
        f"SELECT q.lang AS grp, q.id AS qid, p.id AS pid, q.label = p.label AS rel, {TICKS} AS ticks "
        "FROM u q JOIN u p ON p.lang = q.lang AND p.id <> q.id"
    )}
    SELECT list_position([{', '.join(map(_literal, langs))}], grp) AS position, grp AS lang, round(avg(ap), 4) AS map
    FROM ap GROUP BY grp"""


def _shingled(source: str) -> str:
    """CTEs ``g(id, g)`` and ``c(id, class_id, n)`` of ``source(id, text)``."""
    return f"""
    w AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {source}),
    s AS (SELECT id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
    c AS (SELECT id, CASE WHEN len(s) > 0 THEN min(id) OVER (PARTITION BY s) END AS class_id, len(s) AS n FROM s),
    g AS (SELECT s.id, unnest(s.s) AS g FROM s JOIN c USING (id) WHERE c.class_id = c.id),
    alike AS (
      SELECT a, b, shared, x.n + y.n - shared AS either
      FROM (SELECT p.id AS a, q.id AS b, count(*) AS shared FROM g p JOIN g q ON p.g = q.g AND p.id < q.id GROUP BY ALL)
      JOIN c x ON x.id = a JOIN c y ON y.id = b
      WHERE 100 * shared >= 80 * (x.n + y.n - shared))"""


TEXTS = "texts AS (SELECT doc_id AS id, text FROM documents)"
ANNOTATED = f"""
    WITH {CHAT}, {_hashed('q', 'chat_q')}, {_hashed('p', 'chat_p')},
    scored AS (SELECT q.id AS query_id, p.id AS passage_id, {TICKS} AS ticks FROM q CROSS JOIN p),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ticks DESC, passage_id) AS rank,
             row_number() OVER (PARTITION BY passage_id ORDER BY ticks DESC, query_id) AS back
      FROM scored),
    {_shingled('chat_p')},
    linked AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike UNION SELECT id, id FROM c WHERE class_id = id),
    reached AS (
      SELECT DISTINCT t.key, l.b AS class_id FROM chat_p t JOIN c ON c.id = t.id JOIN linked l ON l.a = c.class_id),
    told AS (
      SELECT query_id, passage_id, ticks / 1e9 AS score, rank, CASE WHEN back <= 5 THEN back END AS back_rank,
             x.key AS query_key, x.text AS query_text, y.key AS passage_key, y.text AS passage_text, x.key = y.key AS positive,
             x.key <> y.key AND EXISTS (SELECT 1 FROM reached r JOIN c ON c.class_id = r.class_id WHERE c.id = passage_id AND r.key = x.key) AS doubtful
      FROM ranked JOIN chat_q x ON x.id = query_id JOIN chat_p y ON y.id = passage_id WHERE rank <= 5)
    SELECT * REPLACE (round(CASE WHEN doubtful THEN score / 2 ELSE score END, 6) AS score) FROM told WHERE score >= 0.1"""

SQL = {
    "l2_normalize": f"""
        SELECT id AS vec_id, dim, round(e[dim + 1], 6) AS value
        FROM ({UNIT}) CROSS JOIN (SELECT unnest(range(64)) AS dim)""",
    "cosine_pairs": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
        SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS inner_product,
               round(list_cosine_similarity(a.v, b.v), 6) AS cosine
        FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    "sq_l2_cosine": f"""
        WITH u AS ({UNIT})
        SELECT a.id AS vec_id, round(list_distance(a.e, b.e) ** 2, 6) AS sq_l2,
               round(1 - 0.5::DOUBLE * list_distance(a.e, b.e) ** 2, 6) AS cosine
        FROM u a JOIN u b ON b.id = a.id + 1""",
    "float32_cast": f"""
        SELECT id AS vec_id, round(sqrt(list_dot_product(CAST(e AS FLOAT[])::DOUBLE[], CAST(e AS FLOAT[])::DOUBLE[])), 5) AS length
        FROM ({UNIT})""",
    "knn_topk": KNN,
    "knn_topk_blocked": KNN,
    "knn_topk_1000": f"""SELECT query_id, passage_id, rank FROM (
        WITH q AS ({UNIT}), p AS ({UNIT}) {_neighbours(1000)})""",
    "knn_skewed_groups": f"""
        WITH q AS ({UNIT}), p AS ({UNIT})
        SELECT '7' AS part, * FROM ({_neighbours(10)}) WHERE query_id % 40 = 7""",
    "first_hit_hot_keys": f"""
        WITH asked AS (SELECT conv_id * 1000 + turn AS id, 'src' || conv_id % 8 AS key, text FROM conversations),
        offered AS (SELECT doc_id AS id, source AS key, text FROM documents),
        {_ranks('r', 'asked', 'offered')} SELECT * FROM r""",
    "text_search_topk": TEXT_TOP5,
    "run_suite_files": _suite_files(),
    "run_code_suite_files": _code_files(),
    "structural_pairs": f"WITH {TEXTS}, {_shingled('texts')} SELECT a, b, shared, either FROM alike",
    "structural_classes": f"WITH {TEXTS}, {_shingled('texts')} SELECT id, class_id, n FROM c",
    "annotated_pairs": ANNOTATED,
    "pair_by_key": """
        SELECT a.url AS key, a.page_id AS passage_id, a.html AS passage, b.page_id AS query_id,
               regexp_extract(b.html, '(?s)<title>(.*?)</title>', 1) AS query
        FROM pages a JOIN pages b ON a.url = b.url""",
    "strip_py_templates": "SELECT doc_id, CASE doc_id % 4 "
    + " ".join(f"WHEN {k} THEN {_py_template(k)}" for k in range(len(templates.PYTHON)))
    + " END AS code FROM documents",
    "read_arrays": "SELECT doc_id, text AS doc FROM documents",
    "first_hit": f"{CHAT_RANKS} SELECT * FROM r",
    "first_hit_depth_20": f"WITH {CHAT}, {_ranks('r', 'chat_q', 'chat_p', 20)} SELECT * FROM r",
    "first_hit_searched": f"WITH {CHAT}, {_ranks('r', 'chat_q', 'chat_p', 20)} SELECT * FROM r",
    "mrr_curve": CHAT_RANKS + _curve("1.0::DOUBLE / rank", "mrr", 1000, "count(*)"),
    "hit_curve": CHAT_RANKS + _curve("1.0::DOUBLE", "hit_rate", 1000, "count(*)"),
    "mrr_hard": f"""
        {CHAT_RANKS}, hard AS (SELECT CAST(conv_id AS VARCHAR) AS key FROM conversations WHERE role = 'system')
        """ + _curve(
        "1.0::DOUBLE / rank", "mrr", 50, "(SELECT count(*) FROM hard)",
        "WHERE key IN (SELECT key FROM hard)",
    ),
    "search_report": f"{CHAT_RANKS} {_report()}",
    "average_precision_labels": f"{LABEL_AP} SELECT query_id, round(ap, 6) AS ap, relevant FROM ap",
    "map_in_domain": f"{LABEL_AP} SELECT round(avg(ap), 6) AS map FROM ap",
    "map_cross_domain": _code_ap("q.lang || '>' || p.lang", "p.lang <> q.lang")
    + "SELECT grp AS pair, round(avg(ap), 6) AS map FROM ap GROUP BY grp",
    "map_keep_self": f"""
        WITH u AS ({UNIT}), {_ap(
            f"SELECT 0 AS grp, q.id AS qid, p.id AS pid, q.label = p.label AS rel, {TICKS} AS ticks "
            "FROM u q CROSS JOIN u p"
        )} SELECT round(avg(ap), 6) AS map FROM ap""",
    "suite_report": f"""
        {SUITE} SELECT 'search' AS suite, dataset, metric, value FROM (
          UNPIVOT (SELECT * EXCLUDE (queries) FROM report) ON COLUMNS(* EXCLUDE (dataset))
          INTO NAME metric VALUE value)""",
    "suite_display": f"""
        {SUITE} SELECT CASE dataset WHEN 'pages' THEN 1 ELSE 2 END AS position, dataset,
               round(avg(CASE WHEN rank <= 1000 THEN 1.0::DOUBLE / rank ELSE 0 END), 4) AS mrr_at_1000
        FROM r GROUP BY dataset""",
    "code_suite": _code_ap("q.lang", "p.lang = q.lang AND p.id <> q.id")
    + """SELECT list_position(['en', 'de', 'fr', 'es'], grp) AS position, grp AS domain,
                round(avg(ap), 4) AS map FROM ap GROUP BY grp""",
    "collapse_ws": f"SELECT doc_id, {_collapse('text')} AS text FROM documents",
    "join_tokens": f"""
        SELECT doc_id, array_to_string(string_split_regex(text, '[.,' || {NL} || ']+'), ' ') AS text
        FROM documents""",
    "drop_blank_lines": f"""
        SELECT doc_id, {_drop_blank(f"replace(text, '. ', '.' || {NL} || ' ' || chr(9) || {NL})")} AS text
        FROM documents""",
    "instruct": f"SELECT item_id, 'Instruct: {TASK}' || {NL} || 'Query: ' || text AS text FROM benchmark",
    "truncate_tokens": """
        SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 8192), ' ') AS standard,
               array_to_string(list_slice(string_split(text, ' '), 1, 20), ' ') AS short
        FROM documents""",
    "strip_c_comments": f"SELECT doc_id, {_strip_c(C_CODE)} AS code FROM documents",
    "strip_c_comments_pages": f"SELECT page_id, {_strip_c('html')} AS code FROM pages",
    "strip_py_comments": f"SELECT doc_id, {PY_STRIPPED} AS code FROM documents",
    "strip_comments": f"""
        SELECT doc_id, CASE lang WHEN 'fr' THEN {PY_STRIPPED} WHEN 'de' THEN {C_CODE}
               ELSE {_strip_c(C_CODE)} END AS code FROM documents""",
    "fit_tokens": f"""
        SELECT doc_id, array_to_string({_fit(128)}, ' ') AS query,
               array_to_string({_fit(1024)}, ' ') AS passage FROM documents""",
    "attention_mask": f"""
        SELECT doc_id, array_to_string(list_transform({_fit(128)},
               lambda t: CASE WHEN t <> '<pad>' THEN '1' ELSE '0' END), '') AS mask FROM documents""",
    "collate_csn": f"""
        SELECT source || '/' || doc_id AS url, replace(text, {NL}, ' ') AS query,
               {_collapse('text')} AS passage FROM documents""",
    "collate_csn_format": f"""
        SELECT source || '/' || doc_id AS url, replace(text, {NL}, ' ') AS query,
               CASE WHEN lang <> 'en' THEN text ELSE '' END AS passage FROM documents""",
    "collate_cosqa_query": f"""
        SELECT CAST(item_id AS VARCHAR) AS url, {_collapse('text')} AS query FROM benchmark""",
    "collate_cosqa_code": f"""
        SELECT CAST(doc_id AS VARCHAR) AS url, {_collapse(C_CODE)} AS passage FROM documents""",
    "collate_cosqa_code_format": """
        SELECT CAST(doc_id AS VARCHAR) AS url, text AS passage FROM documents""",
    "collate_advtest": f"""
        SELECT conv_id || '/' || turn AS url, text AS query, replace(text, {NL}, ' ') AS passage
        FROM conversations""",
    "collate_advtest_format": """
        SELECT conv_id || '/' || turn AS url, text AS query, lower(upper(text)) AS passage
        FROM conversations""",
    "collate_code": f"""
        SELECT CAST(doc_id AS VARCHAR) AS index, CAST(substr(source, 4) AS INT) AS label, lang,
               {_collapse(_strip_c(C_CODE))} AS func FROM documents""",
    "embed_local": EMBEDDED,
    "embed_query": f"""
        WITH texts AS (SELECT item_id AS id, 'Instruct: {TASK}' || {NL} || 'Query: ' || text AS text
                       FROM benchmark), {_counted('t', 'texts')} {_components('t_raw')}""",
    "embed_service": f"""
        WITH texts AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations),
        {_counted('t', 'texts')} {_components('t_raw')}""",
    "pool_last": f"WITH s AS ({STATES}), p AS (SELECT id, arg_max(h1, pos) AS e FROM s GROUP BY id) {_components('p')}",
    "pool_first": f"WITH s AS ({STATES}), p AS (SELECT id, arg_min(h1, pos) AS e FROM s GROUP BY id) {_components('p')}",
    "pool_mean": f"""
        WITH s AS ({STATES})
        SELECT id, dim, round(avg(CAST(h1[dim + 1] AS DOUBLE)), 6) AS value
        FROM s CROSS JOIN (SELECT unnest(range(64)) AS dim) GROUP BY id, dim""",
    "pick_first_layer": f"WITH s AS ({STATES}), p AS (SELECT id, arg_max(h0, pos) AS e FROM s GROUP BY id) {_components('p')}",
    "json_roundtrip": f"""
        SELECT source || '/' || doc_id AS url, replace(text, {NL}, ' ') AS query,
               CASE WHEN lang <> 'en' THEN text ELSE '' END AS passage FROM documents""",
    "read_documents": "SELECT doc_id, text AS doc FROM documents",
    "read_code_labels": """SELECT CAST(doc_id AS VARCHAR) AS index, CAST(substr(source, 4) AS INT) AS label
        FROM documents""",
    "embedding_roundtrip": "WITH p AS (SELECT vec_id AS id, embedding AS e FROM embeddings) " + _components("p"),
    "report_roundtrip": f"{LABEL_AP} SELECT query_id, round(ap, 6) AS ap, relevant FROM ap",
    "dataset_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS n FROM {n}"
        for n in ("documents", "embeddings", "conversations", "benchmark", "pages")
    ),
    "embed_stream": EMBEDDED,
}
