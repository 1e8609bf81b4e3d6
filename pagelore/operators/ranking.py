"""Intent, lexical overlap, reranking and the selections made per question.

Everything here works on the candidates of a question: at most ``candidate_k`` plus
``rows_per_url`` per coverage page, so windows over ``query_id`` stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.config import IntentConfig, SearchConfig
from pagelore.functions.arrays import any_of, in_list, let
from pagelore.functions.text import lexical_form, lexical_tokens, lexical_words, strip
from pagelore.operators.first_wins import first_per_key


def page_key(url: Column) -> Column:
    """URL as compared with the coverage list: lower case, no slash at the end."""
    return F.rtrim(F.lower(F.coalesce(url, F.lit(""))), F.lit("/"))


def coverage_keys(intent: IntentConfig) -> tuple[str, ...]:
    return tuple(dict.fromkeys(u.lower().rstrip("/") for u in intent.coverage_urls))


def is_broad_question(text: Column, intent: IntentConfig = IntentConfig()) -> Column:
    """True where the question asks for an overview instead of one fact."""

    def test(form: Column) -> Column:
        words = F.split(form, " ")

        def overlaps(terms: tuple[str, ...]) -> Column:
            if not terms:
                return F.lit(False)
            return F.arrays_overlap(words, F.array(*[F.lit(t) for t in terms]))

        by_pattern = form.rlike(any_of(intent.patterns)) if intent.patterns else F.lit(False)
        return (form != "") & (by_pattern | (overlaps(intent.topic_terms) & overlaps(intent.broad_terms)))

    return let(lexical_form(text), test)


def is_coverage_page(url: Column, intent: IntentConfig) -> Column:
    return in_list(page_key(url), coverage_keys(intent))


def _share(question: Column, words: Column) -> Column:
    """Share of the question's distinct words among ``words``."""

    def share(q: Column) -> Column:
        common = F.size(F.array_intersect(q, words))
        return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(common / F.size(q))

    return let(lexical_tokens(question), share)


def _head_words(title: Column, section: Column) -> Column:
    return lexical_words(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, section)]))


def lexical_overlap(question: Column, title: Column, section: Column, text: Column) -> Column:
    """Share of the question's distinct words that occur in title, section or text."""
    return _share(question, F.concat(_head_words(title, section), lexical_words(text)))


def with_lexical(results: DataFrame) -> DataFrame:
    """Adds ``text_form`` and ``lexical_score``, splitting every result text only once.

    ``text_form`` stands for the normalised text: empty for a blank one, else a digest.
    """

    def build(words: Column) -> Column:
        form = F.array_join(words, " ")
        head = _head_words(F.col("title"), F.col("section"))
        return F.struct(
            F.when(F.size(words) == 0, F.lit("")).otherwise(F.md5(form)).alias("text_form"),
            _share(F.col("question"), F.concat(head, words)).alias("lexical_score"),
        )

    return results.withColumn("_lexical", let(lexical_words(F.col("text")), build)).select(
        *results.columns, "_lexical.*"
    )


def rerank_score(
    vector_score: Column, overlap: Column, url: Column, title: Column, broad: Column, cfg: SearchConfig
) -> Column:
    intent = cfg.intent
    base = F.coalesce(vector_score, F.lit(0.0)) * cfg.vector_weight + overlap * cfg.lexical_weight
    covered = is_coverage_page(url, intent)
    form = lexical_form(title)
    signal = F.lit(False)
    for word in intent.title_signals:
        signal = signal | F.contains(form, F.lit(word))
    page_boost = F.when(covered, F.lit(cfg.coverage_boost)).otherwise(F.lit(0.0))
    if intent.overview_url:
        overview = page_key(url) == intent.overview_url.lower().rstrip("/")
        page_boost = F.when(overview, F.lit(cfg.overview_boost)).otherwise(page_boost)
    score = (
        base
        + F.when(broad, page_boost).otherwise(F.lit(0.0))
        + F.when(broad & signal, F.lit(cfg.title_boost)).otherwise(F.lit(0.0))
        + F.when(covered, F.lit(cfg.document_boost)).otherwise(F.lit(0.0))
    )
    return F.round(score, cfg.score_decimals)


def drop_duplicate_results(results: DataFrame) -> DataFrame:
    """Per question: first row of a chunk id, then first row of a normalised text.

    Rows without an id or without text are never duplicates in that respect.
    """
    if "text_form" not in results.columns:
        form = let(lexical_form(F.col("text")), lambda t: F.when(t == "", t).otherwise(F.md5(t)))
        return drop_duplicate_results(results.withColumn("text_form", form)).drop("text_form")
    by_id = Window.partitionBy("query_id", "_id").orderBy("input_pos")
    by_text = Window.partitionBy("query_id", "text_form").orderBy("input_pos")
    return (
        results.withColumn("_id", strip(F.coalesce("chunk_id", F.lit(""))))
        .withColumn("_nth", F.row_number().over(by_id))
        .filter((F.col("_nth") == 1) | (F.col("_id") == ""))
        .withColumn("_nth", F.row_number().over(by_text))
        .filter((F.col("_nth") == 1) | (F.col("text_form") == ""))
        .drop("_id", "_nth")
    )


def keep_coverage_if_any(results: DataFrame, intent: IntentConfig) -> DataFrame:
    """For broad questions with at least one coverage row, keep only coverage rows."""
    covered = is_coverage_page(F.col("url"), intent)
    some = F.max(covered).over(Window.partitionBy("query_id"))
    return (
        results.withColumn("_covered", covered)
        .withColumn("_some", some)
        .filter(~F.col("broad") | F.col("_covered") | ~F.col("_some"))
        .drop("_covered", "_some")
    )


def document_key() -> Column:
    return F.coalesce(F.nullif(F.col("document_id"), F.lit("")), F.col("url"), F.lit(""))


def cap_per_document(results: DataFrame, limit: int, order: str = "rerank_pos") -> DataFrame:
    """The first ``limit`` rows of every document of a question, in rank order."""
    return first_per_key(results, ["query_id", document_key()], [F.col(order)], limit)


def coverage_position(url: Column, intent: IntentConfig) -> Column:
    """Place of a page in the coverage list, from 1; 0 where it is not listed."""
    keys = coverage_keys(intent)
    if not keys:
        return F.lit(0)
    return F.array_position(F.array(*[F.lit(k) for k in keys]), page_key(url)).cast("int")


def coverage_representatives(results: DataFrame, intent: IntentConfig, per_page: int = 1) -> DataFrame:
    """The best rows of every coverage page; rows of other pages are dropped."""
    covered = results.filter(is_coverage_page(F.col("url"), intent))
    return first_per_key(covered, ["query_id", page_key(F.col("url"))], [F.col("rerank_pos")], per_page)


def eligible_results(ranked: DataFrame, cfg: SearchConfig) -> DataFrame:
    """The rows diversity may pick from, with ``doc_key``, ``cap`` and a fresh position.

    A narrow question keeps the best rows of every document. A broad one keeps one
    representative of every coverage page, equals in list order; it has no eligible
    row where no coverage page was found. One window serves both routes.
    """
    broad = F.col("broad")
    place = coverage_position(F.col("url"), cfg.intent)
    group = F.when(broad, page_key(F.col("url"))).otherwise(document_key())
    cap = F.when(broad, F.lit(cfg.broad_max_per_document)).otherwise(F.lit(cfg.max_per_document))
    limit = F.when(broad, F.lit(1)).otherwise(F.lit(cfg.max_per_document))
    nth = F.row_number().over(Window.partitionBy("query_id", "_group").orderBy("rerank_pos"))
    order = Window.partitionBy("query_id").orderBy(
        F.col("rerank_score").desc(),
        F.when(broad, F.col("_place")).otherwise(F.col("rerank_pos")),
    )
    return (
        ranked.withColumns({"_group": group, "_place": place, "cap": cap, "doc_key": document_key()})
        .filter(~broad | (F.col("_place") > 0))
        .withColumn("_nth", nth)
        .filter(F.col("_nth") <= limit)
        .withColumn("rerank_pos", F.row_number().over(order))
        .drop("_group", "_place", "_nth")
    )


def coverage_anchors(points: DataFrame, intent: IntentConfig) -> DataFrame:
    """The first ``rows_per_url`` points (by id) of every coverage URL, exact match.

    Adds ``anchor_pos``, the order in which they follow the semantic rows. The literal
    filter reaches the scan and the row limit runs before the shuffle, so a page that
    owns a large share of the points costs no more than any other.
    """
    urls = tuple(dict.fromkeys(intent.coverage_urls))
    limit = intent.rows_per_url
    nth = F.row_number().over(Window.partitionBy("url").orderBy("id"))
    first = points.filter(in_list(F.col("url"), urls)).withColumn("_nth", nth).filter(F.col("_nth") <= limit)
    place = F.array_position(F.array(*[F.lit(u) for u in urls]).cast("array<string>"), F.col("url"))
    return first.withColumn("anchor_pos", ((place - 1) * limit + F.col("_nth")).cast("int")).drop("_nth")
