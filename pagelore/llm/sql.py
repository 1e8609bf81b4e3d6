"""SQL of the queries that SQL can express, over the same tables."""

#: All pairs of texts that share a three-word shingle, and what is reachable over those that share enough.
NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), edges AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u)
SELECT u AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(v) AS component_id, min(v) = u AS kept
FROM reach LEFT JOIN n ON n.doc_id = u GROUP BY u
"""

#: All 100-byte windows, as hexadecimal text; those that are not the first of their kind mark their bytes.
REPEATED_BYTES = r"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, p, hash(substr(h, 2 * p + 1, 200)) AS k
  FROM t, unnest(range(greatest(0, len(h) // 2 - 99))) AS r(p)
), marked AS (
  SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1
), edges AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM marked
), runs AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b
  FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edges) GROUP BY 1, 2
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs
), cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
  FROM gaps JOIN t USING (doc_id) GROUP BY 1
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
"""


def _secret_spans() -> str:
    """Starts from the pieces between matches; the length of a match's deciding group decides whether it counts."""
    kinds = (
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 16),
        ("hex", "[0-9a-f]{32,}", 0, 32),
        ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
        ("github", "gh[opsru]_[A-Za-z0-9]{36,}", 0, 0),
        ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
        ("login", r"://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/:@]{1,100}@", 0, 0),
    )
    one = """SELECT doc_id, '{kind}' AS kind, {rank} AS rank, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a,
      length(m[i]) AS size, length(g[i]) AS least FROM (
      SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m,
        regexp_extract_all(text, '{pattern}', {group}) AS g, unnest(range(1, len(m) + 1)) AS i FROM t) WHERE length(g[i]) >= {least}"""
    return " UNION ALL ".join(
        one.format(kind=kind, rank=rank, pattern=pattern, group=group, least=least) for rank, (kind, pattern, group, least) in enumerate(kinds)
    )


#: Every rule by itself, on every text.
SECRETS = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_secret_spans()}),
named AS (SELECT doc_id, kind, rank, a, kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT AS span FROM spans),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
    string_agg(span, ',' ORDER BY a, rank) AS every FROM named GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM t LEFT JOIN joined USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All occurrences of all terms, counted; no blocks.
RANKED_SEARCH = rf"""WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), q AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2
), c AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS docs, sum(len(ts))::BIGINT AS words FROM d),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // words)))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), c GROUP BY 1, 2
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""

#: All n-grams of all pieces as rows, cut by cut.
COLLOCATIONS = rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, ws[i:i + m - 1] AS ws FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
    FROM pieces, unnest(range(1, 6)) AS r(m) WHERE len(ws) >= m)
), f AS (SELECT lang, ws, count(*) AS f FROM grams GROUP BY 1, 2),
n AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY 1),
c AS (SELECT lang, ws, f AS a FROM f WHERE f >= 100 AND len(ws) >= 2),
cuts AS (
  SELECT c.lang, c.ws, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[k + 1:] JOIN n ON n.lang = c.lang
), worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, ws[i:i + m - 1] AS ws, max(a) AS whole FROM (
    SELECT lang, ws, a, m, unnest(range(1, len(ws) - m + 2)) AS i FROM c, unnest(range(2, 5)) AS r(m) WHERE m < len(ws)) GROUP BY 1, 2
), alone AS (
  SELECT w.lang, array_to_string(w.ws, ' ') AS phrase, a, l, r, n, score FROM worst w
  LEFT JOIN inner_parts p ON p.lang = w.lang AND p.ws = w.ws WHERE whole IS NULL OR 100 * whole < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone
) WHERE rank <= 2000
"""
