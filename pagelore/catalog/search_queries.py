"""Queries over retrieval and answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelore.catalog import sql as S
from pagelore.catalog.inputs import (
    INTENT,
    SEARCH,
    embedded_questions,
    points,
    prepared_questions,
    questions,
    stored,
    table,
    text_table,
)
from pagelore.catalog.registry import query
from pagelore.config import AnswerConfig
from pagelore.functions.vectors import cosine
from pagelore.operators.answering import (
    ExtractiveGenerator,
    answer_from_results,
    build_context,
    results_report,
    user_prompt,
    valid_question,
)
from pagelore.operators.diversity import select_diverse
from pagelore.operators.nearest import nearest_points
from pagelore.operators.ranking import (
    cap_per_document,
    coverage_anchors,
    coverage_representatives,
    drop_duplicate_results,
    eligible_results,
    is_broad_question,
    keep_coverage_if_any,
)
from pagelore.operators.render import escape_html, render_answer
from pagelore.plans.search import candidates, rerank, search


def _candidates(spark, folder):
    return stored(
        spark, folder, "candidates",
        lambda s, f: candidates(points(s, f), prepared_questions(s, f), SEARCH),
    )


def _deduped(spark, folder):
    return drop_duplicate_results(_candidates(spark, folder))


def _ranked(spark, folder):
    return rerank(keep_coverage_if_any(_deduped(spark, folder), INTENT), SEARCH)


def _results(spark, folder):
    return stored(
        spark, folder, "results",
        lambda s, f: search(points(s, f), embedded_questions(s, f), SEARCH),
    )


@query(
    "intent_flag",
    f"""SELECT conv_id, turn, {S.BROAD} AS broad FROM (
      SELECT conv_id, turn, {S.lexical('text')} AS form FROM conversations)""",
)
def _(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", is_broad_question(F.col("text"), INTENT).alias("broad"))


@query(
    "cosine_to_next",
    """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
      / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    joined = vectors.join(following, "vec_id")
    return joined.select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(
    "nearest_vectors",
    """WITH s AS (
      SELECT q.vec_id::VARCHAR AS query_id, p.vec_id::VARCHAR AS id,
        round(list_dot_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[])
          / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[]))), 9) AS score
      FROM embeddings q CROSS JOIN embeddings p)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM s QUALIFY rank <= 20""",
)
def _(spark, folder):
    """The supplied vectors nearest to each of them, itself included."""
    vectors = table(spark, folder, "embeddings")
    stored_points = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    top = nearest_points(stored_points, asked, 20)
    return top.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "semantic_topk",
    S.with_tables("nearest", "SELECT query_id, id, round(score, 6) AS score, input_pos::BIGINT AS rank FROM nearest"),
)
def _(spark, folder):
    top = nearest_points(points(spark, folder), prepared_questions(spark, folder), 20)
    return top.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "coverage_anchor",
    S.with_tables("anchors", "SELECT id, url, anchor_pos::BIGINT AS anchor_pos FROM anchors"),
)
def _(spark, folder):
    found = coverage_anchors(points(spark, folder), INTENT)
    return found.select("id", "url", F.col("anchor_pos").cast("long").alias("anchor_pos"))


@query(
    "candidate_union",
    S.with_tables("found", "SELECT query_id, id, round(score, 6) AS score, input_pos::BIGINT AS input_pos FROM found"),
)
def _(spark, folder):
    return _candidates(spark, folder).select(
        "query_id", "id", F.round("score", 6).alias("score"), F.col("input_pos").cast("long").alias("input_pos")
    )


@query(
    "result_dedup",
    S.with_tables("deduped", "SELECT query_id, id, input_pos::BIGINT AS input_pos FROM deduped"),
)
def _(spark, folder):
    return _deduped(spark, folder).select("query_id", "id", F.col("input_pos").cast("long").alias("input_pos"))


@query(
    "coverage_filter",
    S.with_tables("covered", "SELECT query_id, id, broad FROM kept"),
)
def _(spark, folder):
    return keep_coverage_if_any(_deduped(spark, folder), INTENT).select("query_id", "id", "broad")


@query(
    "lexical_overlap",
    S.with_tables("ranked", "SELECT query_id, id, round(lexical_score, 6) AS lexical_score FROM ranked"),
)
def _(spark, folder):
    return _ranked(spark, folder).select("query_id", "id", F.round("lexical_score", 6).alias("lexical_score"))


@query(
    "rerank_scores",
    S.with_tables(
        "ranked",
        "SELECT query_id, id, round(rerank_score, 6) AS rerank_score, rerank_pos::BIGINT AS rerank_pos FROM ranked",
    ),
)
def _(spark, folder):
    return _ranked(spark, folder).select(
        "query_id", "id", F.round("rerank_score", 6).alias("rerank_score"),
        F.col("rerank_pos").cast("long").alias("rerank_pos"),
    )


@query(
    "doc_cap",
    S.with_tables(
        "ranked",
        """SELECT query_id, id FROM ranked
    QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY rerank_pos) <= 2""",
    ),
)
def _(spark, folder):
    return cap_per_document(_ranked(spark, folder), SEARCH.max_per_document).select("query_id", "id")


@query(
    "coverage_representatives",
    S.with_tables(
        "ranked",
        f"""SELECT query_id, id, url FROM ranked WHERE is_covered
    QUALIFY row_number() OVER (PARTITION BY query_id, {S.page_key('url')} ORDER BY rerank_pos) = 1""",
    ),
)
def _(spark, folder):
    return coverage_representatives(_ranked(spark, folder), INTENT).select("query_id", "id", "url")


@query(
    "mmr_select",
    S.with_tables("picked", "SELECT query_id, pick::BIGINT AS pick, id, round(mmr_score, 6) AS mmr_score FROM picked"),
)
def _(spark, folder):
    chosen = select_diverse(
        eligible_results(_ranked(spark, folder), SEARCH), SEARCH.top_k, SEARCH.mmr_lambda, SEARCH.score_decimals
    )
    return chosen.select("query_id", F.col("pick").cast("long").alias("pick"), "id", F.round("mmr_score", 6).alias("mmr_score"))


@query(
    "hybrid_search",
    S.with_tables(
        "picked",
        """SELECT query_id, question, pick::BIGINT AS pick, id, document_id, title, section, url, text, round(score, 6) AS score,
      round(rerank_score, 6) AS rerank_score, round(mmr_score, 6) AS mmr_score FROM picked""",
    ),
)
def hybrid_search(spark, folder):
    found = search(points(spark, folder), embedded_questions(spark, folder), SEARCH)
    return found.select(
        "query_id", "question", F.col("pick").cast("long").alias("pick"), "id", "document_id", "title", "section", "url",
        "text", *[F.round(c, 6).alias(c) for c in ("score", "rerank_score", "mmr_score")],
    )


_CONTEXT = f"""
contexts AS (
  SELECT query_id, string_agg({S.strip('text')}, chr(10) || chr(10) ORDER BY pick) AS context, count(*)::BIGINT AS context_chunks
  FROM picked WHERE {S.strip('text')} <> '' GROUP BY query_id
)"""


@query(
    "build_context",
    S.with_tables("picked", "")
    + f""", {_CONTEXT}
    SELECT query_id, context, context_chunks, length(context)::BIGINT AS context_chars, len({S.words('context')})::BIGINT AS context_words
    FROM contexts""",
)
def _(spark, folder):
    built = build_context(_results(spark, folder))
    return built.select(
        "query_id", "context",
        *[F.col(c).cast("long").alias(c) for c in ("context_chunks", "context_chars", "context_words")],
    )


_PROMPT = (
    "'Knowledge base context:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'User question:'"
    " || chr(10) || chr(10) || question"
)


@query(
    "prompt",
    S.with_tables("picked", "") + f""", {_CONTEXT}
    SELECT query_id, {_PROMPT} AS prompt FROM contexts JOIN asked USING (query_id)""",
)
def _(spark, folder):
    contexts = build_context(_results(spark, folder))
    asked = prepared_questions(spark, folder).select("query_id", "question")
    return contexts.join(asked, "query_id").select(
        "query_id", user_prompt(F.col("context"), F.col("question")).alias("prompt")
    )


_SENTENCES = f"""
sentences AS (
  SELECT query_id, question, i, {S.strip('s')} AS sentence FROM (
    SELECT query_id, question, i, string_split(cut, chr(1))[i + 1] AS s FROM (
      SELECT query_id, question, regexp_replace(regexp_replace(context, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g') AS cut
      FROM contexts JOIN asked USING (query_id)), unnest(range(len(string_split(cut, chr(1))))) AS u(i))
),
best AS (
  SELECT query_id, sentence FROM sentences WHERE sentence <> ''
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY
    len(list_intersect(list_distinct({S.tokens('question')}), list_distinct({S.tokens('sentence')}))) DESC, i) = 1
)"""


@query(
    "answers",
    S.with_tables("picked", "") + f""", {_CONTEXT}, {_SENTENCES}
    SELECT a.query_id, a.question, coalesce(b.sentence, 'I couldn''t find that information in the site knowledge base.') AS answer,
      200::BIGINT AS status_code FROM asked a LEFT JOIN best b USING (query_id)""",
)
def _(spark, folder):
    asked = questions(spark, folder)
    answered = answer_from_results(asked, _results(spark, folder), ExtractiveGenerator(), AnswerConfig())
    return answered.select("query_id", "question", "answer", F.col("status_code").cast("long").alias("status_code"))


def _four(x: str) -> str:
    return f"printf('%.4f', {x})"


_ENTRY = f"""'Rank ' || pick || chr(10) || 'Vector score: ' || {_four('score')} || chr(10) || 'Rerank score: ' || {_four('rerank_score')}
  || chr(10) || 'MMR score   : ' || {_four('mmr_score')} || chr(10) || 'Title: ' || title || chr(10) || 'Section: ' || section
  || chr(10) || 'URL: ' || url || chr(10) || 'Text:' || chr(10) || text || chr(10) || chr(10) || repeat('-', 80) || chr(10)"""


@query(
    "results_report",
    S.with_tables("picked", "")
    + f""", entries AS (
      SELECT query_id, string_agg({_ENTRY}, chr(10) ORDER BY pick) AS body, count(*) AS n FROM picked GROUP BY 1)
    SELECT a.query_id, repeat('=', 80) || chr(10) || 'RETRIEVAL RESULTS' || chr(10) || repeat('=', 80) || chr(10) || 'Query       : '
      || a.question || chr(10) || 'Results     : ' || coalesce(n, 0) || chr(10) || chr(10)
      || coalesce(body, 'No relevant results found.' || chr(10) || repeat('=', 80)) AS report
    FROM asked a LEFT JOIN entries e USING (query_id)""",
)
def _(spark, folder):
    return results_report(questions(spark, folder), _results(spark, folder))


_ESCAPED = (
    "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"
)


@query("escape_html", f"SELECT doc_id, {_ESCAPED} AS escaped FROM documents")
def _(spark, folder):
    return text_table(spark, folder).select("doc_id", escape_html(F.col("text")).alias("escaped"))


_BOLD = f"regexp_replace({_ESCAPED}, '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g')"
_BULLETS = (
    f"regexp_replace({_BOLD}, '(?m)^[ \\t]*[-*]\\s+(.+)$', '<div class=\"response-bullet\">• \\1</div>', 'g')"
)
_NUMBERS = (
    f"regexp_replace({_BULLETS}, '(?m)^[ \\t]*(\\d+)\\.\\s+(.+)$', '<div class=\"response-number\">\\1. \\2</div>', 'g')"
)


@query(
    "render_answer",
    f"SELECT conv_id, turn, replace({_NUMBERS}, chr(10), '<br>') AS html FROM conversations WHERE role = 'assistant'",
)
def _(spark, folder):
    turns = text_table(spark, folder, "conversations").filter("role = 'assistant'")
    return turns.select("conv_id", "turn", render_answer(F.col("text")).alias("html"))


# The same rendering over every document written out as a list with bold lead words.
_MARKED = "regexp_replace(text, '(?m)^(\\S+)', '- **\\1**', 'g')"


@query(
    "render_lists",
    "SELECT doc_id, replace("
    + _NUMBERS.replace("replace(text,", f"replace({_MARKED},", 1)
    + ", chr(10), '<br>') AS html FROM documents",
)
def _(spark, folder):
    marked = F.regexp_replace("text", r"(?m)^(\S+)", "- **$1**")
    return text_table(spark, folder).select("doc_id", render_answer(marked).alias("html"))


@query(
    "question_check",
    f"SELECT doc_id, length(text) <= 2000 AND {S.strip('text')} <> '' AS valid FROM documents",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", valid_question(F.col("text"), AnswerConfig()).alias("valid"))


# Every document as one pipe table of its lines; a line gives up its own pipes.
_CELL = S.strip(_BOLD.replace("replace(text,", "replace(replace(line, '|', ' '),", 1))
_ROW = f"'<tr><td>' || (i + 1) || '</td><td>' || {_CELL} || '</td></tr>'"


@query(
    "render_tables",
    f"""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS line
      FROM documents, unnest(range(len(string_split(text, chr(10))))) AS u(i))
    SELECT doc_id, '<div class="response-table-wrapper"><table class="response-table"><thead><tr><th>no</th><th>line</th></tr></thead><tbody>'
      || string_agg({_ROW}, '' ORDER BY i) || '</tbody></table></div>' AS html FROM l GROUP BY doc_id""",
)
def _(spark, folder):
    lines = F.transform(
        F.split("text", "\n"),
        lambda v, i: F.concat(
            F.lit("| "), (i + 1).cast("string"), F.lit(" | "), F.replace(v, F.lit("|"), F.lit(" ")), F.lit(" |")
        ),
    )
    whole = F.concat(F.lit("| no | line |\n|---|---|\n"), F.array_join(lines, "\n"))
    return text_table(spark, folder).select("doc_id", render_answer(whole).alias("html"))
