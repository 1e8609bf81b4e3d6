"""SQL fragments from which the independent formulations are put together."""

from __future__ import annotations

# Nothing of the engine is imported here: what the formulations share with it is written out once more.
HOST = "kb.example.org"
DIMENSION = 64
_WS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?"
_SPLIT = r"[ \t\n\r\v\f\x1c-\x1f\x{85}\x{a0}\p{Z}]+"


def strip(x: str) -> str:
    return f"trim({x}, '{_WS}')"


def unix(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def clean(x: str) -> str:
    blanks = f"regexp_replace(replace({unix(x)}, chr(160), ' '), '[ \\t]+', ' ', 'g')"
    return strip(f"regexp_replace({blanks}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def spaced(x: str) -> str:
    first = f"regexp_replace({clean(x)}, '([.!?])([A-Za-z])', '\\1 \\2', 'g')"
    return clean(f"regexp_replace({first}, '([,;:])([A-Za-z])', '\\1 \\2', 'g')")


def lines(x: str) -> str:
    """Stripped, non-empty lines as a list."""
    one = strip("regexp_replace(l, '[ \\t]+', ' ', 'g')")
    return (
        f"list_filter(list_transform(string_split({unix(x)}, chr(10)), lambda l: {one}),"
        " lambda l: l <> '')"
    )


def canonical(x: str) -> str:
    return f"array_to_string({lines(x)}, chr(10))"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_SPLIT}'), lambda w: w <> '')"


def lexical(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({lexical(x)}, ' '), lambda w: w <> '')"


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def page_key(x: str) -> str:
    return f"rtrim(lower({x}), '/')"


BLOCKED = (
    r"\.(?:jpg|jpeg|png|gif|webp|svg|ico|css|js|map|mp4|mp3|wav|avi|mov|zip|rar|7z|tar|gz|exe|dmg"
    r"|woff|woff2|ttf|eot|pdf|doc|docx|xls|xlsx|ppt|pptx)"
)

# Fields of a URL by the grammar of RFC 3986.
URL_PARTS = (
    "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,"
    " regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS netloc,"
    " regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,"
    " regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query"
)

# ---------------------------------------------------------------------------
# Common tables. Each entry depends only on entries above it.
# ---------------------------------------------------------------------------

_TITLE = "source || ' ' || lang"

CTE: dict[str, str] = {}

CTE["docs"] = f"""
docs AS (
  SELECT doc_id, lpad(doc_id::VARCHAR, 10, '0') || '.json' AS file,
    'https://{HOST}/' || source AS url,
    'https://{HOST}/' || source || '/' || doc_id AS canonical_url,
    {_TITLE} AS title, lang AS description, text, source, lang,
    trunc(n_chars / 6)::BIGINT AS word_count
  FROM documents
)"""

CTE["lines_of"] = """
lines_of AS (
  SELECT doc_id, file, title, i, string_split(text, chr(10))[i + 1] AS line
  FROM docs, unnest(range(len(string_split(text, chr(10))))) AS u(i)
)"""

# Words of every section: the first one has a heading and its content repeats both.
CTE["sections_of"] = f"""
sections_of AS (
  SELECT doc_id, i, CASE WHEN i = 0 THEN title ELSE '' END AS heading,
    CASE WHEN i = 0 THEN 1 ELSE 0 END AS level,
    CASE WHEN i = 0 AND {clean('line')} <> ''
         THEN list_concat({words("title || ' ' || line")}, {words("title || ' ' || line")})
         WHEN i = 0 THEN {words('title')}
         ELSE {words('line')} END AS ws
  FROM lines_of
)"""

CTE["usable"] = """
usable AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS idx, heading, level, ws, len(ws) AS wc
  FROM sections_of WHERE len(ws) > 0
    AND lower(array_to_string(ws, ' ')) NOT IN ('skip to content', 'menu', 'close menu', 'open menu',
        'cookie settings', 'privacy policy', 'terms of service')
)"""

CTE["fold"] = """
fold AS (
  SELECT doc_id, idx, wc AS total, 1 AS gid FROM usable WHERE idx = 1
  UNION ALL
  SELECT u.doc_id, u.idx,
    CASE WHEN f.total >= 35 THEN u.wc ELSE f.total + u.wc END,
    CASE WHEN f.total >= 35 THEN f.gid + 1 ELSE f.gid END
  FROM fold f JOIN usable u ON u.doc_id = f.doc_id AND u.idx = f.idx + 1
)"""

CTE["merged"] = """
merged AS (
  SELECT u.doc_id, f.gid - 1 AS section_index,
    arg_min(u.heading, u.idx) AS section, arg_min(u.level, u.idx) AS section_level,
    flatten(list(u.ws ORDER BY u.idx)) AS ws
  FROM usable u JOIN fold f ON f.doc_id = u.doc_id AND f.idx = u.idx
  GROUP BY u.doc_id, f.gid HAVING sum(u.wc) >= 20
)"""

CTE["windows"] = """
windows AS (
  SELECT doc_id, section_index, section, section_level, k AS section_chunk_index,
    list_slice(ws, 150 * k + 1, CASE WHEN k = n - 1 THEN len(ws) ELSE 150 * k + 180 END) AS part
  FROM (SELECT *, CASE WHEN len(ws) <= 260 THEN 1 ELSE ceil((len(ws) - 260) / 150.0)::BIGINT + 1 END AS n FROM merged),
    unnest(range(n)) AS r(k)
)"""

CTE["chunks"] = """
chunks AS (
  SELECT d.file AS position, 'doc_' || substr(sha256(d.canonical_url), 1, 24) AS document_id,
    sha256(array_to_string(part, ' ')) AS chunk_hash,
    d.url, d.canonical_url, d.title, section, section_index, section_level,
    row_number() OVER (PARTITION BY w.doc_id ORDER BY section_index, section_chunk_index) - 1 AS chunk_index,
    section_chunk_index, array_to_string(part, ' ') AS text, len(part) AS word_count
  FROM windows w JOIN docs d ON d.doc_id = w.doc_id WHERE len(part) >= 20
)"""

CTE["unique_chunks"] = """
unique_chunks AS (
  SELECT *, document_id || '__' || substr(chunk_hash, 1, 16) AS chunk_id FROM chunks
  QUALIFY row_number() OVER (PARTITION BY chunk_hash ORDER BY position, chunk_index) = 1
)"""

NAMESPACE = "18cdedf057675b31ac7d80cc081446f0"


def uuid5(name: str) -> str:
    h = f"sha1(unhex('{NAMESPACE}') || encode({name}))"
    variant = f"substr('89ab', (('0x' || substr({h}, 17, 1))::INTEGER % 4) + 1, 1)"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' ||"
        f" {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


CTE["points"] = f"""
points AS (
  SELECT {uuid5('chunk_id')} AS id, * FROM unique_chunks
)"""


def vectors(source: str, key: str, text: str, name: str) -> str:
    """Hashed word counts as unit vectors in long form: (key, bucket, v)."""
    return f"""
{name}_counts AS (
  SELECT {key}, (('0x' || substr(md5(w), 1, 8))::BIGINT % {DIMENSION}) AS bucket, count(*)::DOUBLE AS c
  FROM (SELECT {key}, unnest({tokens(text)}) AS w FROM {source}) GROUP BY 1, 2
),
{name}_floats AS (
  SELECT {key}, bucket, (c / sqrt(sum(c * c) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS f FROM {name}_counts
),
{name} AS (
  SELECT {key}, bucket, f / sqrt(sum(f * f) OVER (PARTITION BY {key})) AS v FROM {name}_floats
)"""


CTE["point_vectors"] = vectors("points", "id", "text", "point_vectors")

_TOPIC = "list_has_any(string_split(form, ' '), ['la', 'the', 'der', 'los'])"
_BROAD = "list_has_any(string_split(form, ' '), ['in', 'que', 'und', 'to'])"
_PHRASES = (
    r"\b(?:(?:what|which) services|services (?:do you|does)|(?:what|which) solutions|solutions do you|what do you offer"
    r"|what does .* offer|what can .* help|what capabilities|(?:what )?offerings|(?:services|solutions) offered|service (?:portfolio|offering))\b"
)
BROAD = f"(form <> '' AND (regexp_matches(form, '{_PHRASES}') OR ({_TOPIC} AND {_BROAD})))"

CTE["asked"] = f"""
asked AS (
  SELECT query_id, question, {BROAD} AS broad FROM (
    SELECT conv_id || '-' || turn AS query_id, {strip('text')} AS question, {lexical('text')} AS form
    FROM conversations WHERE role = 'user') WHERE question <> ''
)"""

CTE["question_vectors"] = vectors("asked", "query_id", "question", "question_vectors")

CTE["nearest"] = """
pairs AS (
  SELECT query_id, id, sum(q.v * p.v) AS s FROM question_vectors q JOIN point_vectors p USING (bucket) GROUP BY 1, 2
),
scored AS (
  SELECT a.query_id, p.id, round(coalesce(s, 0), 9) AS score
  FROM asked a CROSS JOIN points p LEFT JOIN pairs x ON x.query_id = a.query_id AND x.id = p.id
),
nearest AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS input_pos
  FROM scored QUALIFY input_pos <= 20
)"""

_COVERED = tuple(f"https://{HOST}/src{i}" for i in (0, 3, 5, 7, 11, 13, 99))
_URLS = ", ".join(f"('{u}', {i})" for i, u in enumerate(_COVERED))
_KEYS = quoted(_COVERED)

CTE["anchors"] = f"""
wanted(url, place) AS (VALUES {_URLS}),
anchors AS (
  SELECT p.id, p.url, place * 3 + row_number() OVER (PARTITION BY p.url ORDER BY p.id) AS anchor_pos
  FROM points p JOIN wanted w ON w.url = p.url
  QUALIFY row_number() OVER (PARTITION BY p.url ORDER BY p.id) <= 3
)"""

CTE["found"] = """
found AS (
  SELECT query_id, id, score, input_pos FROM nearest
  UNION ALL
  SELECT query_id, id, 0.0 AS score, 1000000 + anchor_pos FROM asked CROSS JOIN anchors WHERE broad
)"""

CTE["deduped"] = f"""
once AS (
  SELECT f.*, p.text, p.title, p.section, p.url, p.document_id, {lexical('p.text')} AS form
  FROM found f JOIN points p USING (id)
  QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY input_pos) = 1
),
deduped AS (
  SELECT * FROM once
  QUALIFY row_number() OVER (PARTITION BY query_id, form ORDER BY input_pos) = 1 OR form = ''
)"""

CTE["covered"] = f"""
covered AS (
  SELECT d.*, a.question, a.broad, {page_key('url')} IN ({_KEYS}) AS is_covered
  FROM deduped d JOIN asked a USING (query_id)
),
kept AS (
  SELECT * FROM covered QUALIFY NOT broad OR is_covered OR NOT bool_or(is_covered) OVER (PARTITION BY query_id)
)"""


def overlap(question: str, text: str) -> str:
    q, t = f"list_distinct({tokens(question)})", f"list_distinct({tokens(text)})"
    return f"CASE WHEN len({q}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({q}, {t}))::DOUBLE / len({q}) END"


_SIGNAL = f"contains({lexical('title')}, 'src3') OR contains({lexical('title')}, 'fr')"

CTE["ranked"] = f"""
lexed AS (
  SELECT *, {overlap('question', "title || ' ' || section || ' ' || text")} AS lexical_score FROM kept
),
boosted AS (
  SELECT *, round(score * 0.75::DOUBLE + lexical_score * 0.25::DOUBLE
    + CASE WHEN NOT broad THEN 0.0::DOUBLE WHEN {page_key('url')} = 'https://{HOST}/src0' THEN 0.15::DOUBLE
           WHEN is_covered THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN broad AND ({_SIGNAL}) THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN is_covered THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END, 9) AS rerank_score
  FROM lexed
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, input_pos) AS rerank_pos FROM boosted
)"""

CTE["eligible"] = f"""
capped AS (
  SELECT *, CASE WHEN broad THEN list_position([{_KEYS}], {page_key('url')}) ELSE rerank_pos END AS tie
  FROM ranked WHERE NOT broad OR is_covered
  QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN broad THEN {page_key('url')} ELSE document_id END
    ORDER BY rerank_pos) <= CASE WHEN broad THEN 1 ELSE 2 END
),
eligible AS (
  SELECT * EXCLUDE (rerank_pos), CASE WHEN broad THEN 1 ELSE 2 END AS cap,
    row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, tie) AS pos FROM capped
)"""


def picks(steps: int = 5) -> str:
    """Greedy selection, one step per round, with similarities looked up in a table."""
    parts = [
        """
alike AS (
  SELECT a.query_id, a.pos AS pos, b.pos AS other, round(coalesce(sum(x.v * y.v), 0), 9) AS cosine
  FROM eligible a JOIN eligible b ON a.query_id = b.query_id
  JOIN point_vectors x ON x.id = a.id JOIN point_vectors y ON y.id = b.id AND y.bucket = x.bucket
  GROUP BY 1, 2, 3
),
pick0 AS (SELECT NULL::VARCHAR AS query_id, NULL::BIGINT AS pos, NULL::VARCHAR AS document_id,
  NULL::BIGINT AS pick, NULL::DOUBLE AS mmr_score WHERE false)"""
    ]
    for n in range(1, steps + 1):
        parts.append(f"""
pick{n} AS (
  SELECT * FROM pick{n - 1}
  UNION ALL
  SELECT query_id, pos, document_id, {n}, mmr FROM (
    SELECT e.query_id, e.pos, e.document_id,
      round(0.8::DOUBLE * e.rerank_score - (1.0::DOUBLE - 0.8::DOUBLE) * coalesce(s.penalty, 0.0::DOUBLE), 9) AS mmr
    FROM eligible e
    LEFT JOIN (
      SELECT c.query_id, c.pos, max(coalesce(a.cosine, 0.0::DOUBLE)) AS penalty
      FROM eligible c JOIN pick{n - 1} p ON p.query_id = c.query_id
      LEFT JOIN alike a ON a.query_id = c.query_id AND a.pos = c.pos AND a.other = p.pos
      GROUP BY 1, 2) s ON s.query_id = e.query_id AND s.pos = e.pos
    LEFT JOIN (SELECT query_id, document_id, count(*) AS used FROM pick{n - 1} GROUP BY 1, 2) u
      ON u.query_id = e.query_id AND u.document_id = e.document_id
    WHERE coalesce(u.used, 0) < e.cap
      AND NOT EXISTS (SELECT 1 FROM pick{n - 1} p WHERE p.query_id = e.query_id AND p.pos = e.pos)
    QUALIFY row_number() OVER (PARTITION BY e.query_id ORDER BY mmr DESC, e.pos) = 1)
)""")
    parts.append(f"""
picked AS (
  SELECT e.query_id, p.pick, e.id, e.question, e.score, e.rerank_score, p.mmr_score, e.text, e.url, e.document_id,
    e.title, e.section
  FROM pick{steps} p JOIN eligible e ON e.query_id = p.query_id AND e.pos = p.pos
)""")
    return ",".join(parts)


CTE["picked"] = picks()

_ORDER = list(CTE)


def with_tables(last: str, select: str) -> str:
    """``select`` over all common tables up to ``last`` that it needs."""
    needed = _needed(last)
    return "WITH RECURSIVE " + ",".join(CTE[n] for n in _ORDER if n in needed) + "\n" + select


_USES = {
    "lines_of": ["docs"], "sections_of": ["lines_of"], "usable": ["sections_of"], "fold": ["usable"],
    "merged": ["fold", "usable"], "windows": ["merged"], "chunks": ["windows", "docs"],
    "unique_chunks": ["chunks"], "points": ["unique_chunks"], "point_vectors": ["points"],
    "question_vectors": ["asked"], "nearest": ["question_vectors", "point_vectors", "asked"],
    "anchors": ["points"], "found": ["nearest", "anchors"], "deduped": ["found"],
    "covered": ["deduped"], "ranked": ["covered"], "eligible": ["ranked"], "picked": ["eligible"],
}


def _needed(name: str) -> set[str]:
    found = {name}
    for other in _USES.get(name, []):
        found |= _needed(other)
    return found
