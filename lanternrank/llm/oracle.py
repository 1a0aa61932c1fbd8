"""SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op3_url_filter"] = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_matches(url, '[?&]utm_'), false)::int AS t
  FROM pages),
h AS (SELECT host, count(*) AS n, sum(t) AS t FROM p GROUP BY host),
l AS (SELECT host FROM h WHERE t * (SELECT sum(n) FROM h) > (SELECT sum(t) FROM h) * n),
j AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
    END AS rule,
    host IN (SELECT host FROM l) AS listed
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
  listed
FROM j
"""

SQL["op6_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def _centroids(rounds: int = 3) -> str:
    """Rounds of assignment and update as one chain of tables."""
    steps = [
        """WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 16))"""
    ]
    near = """a{0} AS (
  SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS n
  FROM (SELECT vec_id, k.v, c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i])))::BIGINT AS d
    FROM kept k, c{0} m) GROUP BY vec_id)"""
    moved = """u{0} AS (
  SELECT c, list(m ORDER BY i) AS v
  FROM (SELECT c, i, floor(sum(x) / count(*))::BIGINT AS m
    FROM (SELECT n.c AS c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{0}) GROUP BY c, i) GROUP BY c),
c{1} AS (SELECT c{0}.c, coalesce(u{0}.v, c{0}.v) AS v FROM c{0} LEFT JOIN u{0} USING (c))"""
    for k in range(rounds):
        steps += [near.format(k), moved.format(k, k + 1)]
    steps.append(near.format(rounds))
    return ",\n".join(steps) + f"""
SELECT vec_id, n.c::INT AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia,
  (sum(n.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} m ON m.c = n.c
"""


SQL["op12_centroids"] = _centroids()
