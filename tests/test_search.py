"""Search steps against sequential models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.config import IntentConfig, SearchConfig
from pagelore.functions.vectors import cosine, is_finite, unit
from pagelore.operators.diversity import select_diverse
from pagelore.operators.embedding import HashedWords, ModelEncoder, embed_chunks, verify_embeddings
from pagelore.config import EmbedConfig
from pagelore.operators.nearest import nearest_points
from pagelore.operators.points import build_points
from pagelore.operators.ranking import (
    drop_duplicate_results,
    is_broad_question,
    lexical_overlap,
    rerank_score,
)
from pagelore.plans.search import search
from pagelore.session import materialize


def _vectors(n, d, seed):
    """Small integers give many exact ties; some rows are zero, missing or too short."""
    rng = np.random.default_rng(seed)
    rows = [[float(x) for x in rng.integers(-2, 3, d)] for _ in range(n)]
    rows[0], rows[1], rows[2] = [0.0] * d, None, [1.0]
    return rows


def _brute(points, questions, k, d):
    def normal(v):
        a = np.zeros(d) if v is None or len(v) != d else np.asarray(v, dtype=np.float64)
        n = np.linalg.norm(a)
        return a / n if n else a

    out = set()
    for q, qv in questions:
        scored = sorted((-(round(float(normal(v) @ normal(qv)), 9) + 0.0), i) for i, v in points)
        out |= {(q, i, round(-s, 6), r) for r, (s, i) in enumerate(scored[:k], start=1)}
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 3 * 4 * 8])
def test_nearest_is_exact_with_ties_in_one_or_many_passes(spark, block_bytes):
    d, k = 4, 7
    points = [(f"p{i:04d}", v) for i, v in enumerate(_vectors(400, d, 1))]
    asked = [(f"q{i}", v) for i, v in enumerate([v for v in _vectors(12, d, 2) if v and len(v) == d])]
    pdf = spark.createDataFrame(points, "id string, vector array<float>").repartition(5)
    qdf = spark.createDataFrame(asked, "query_id string, vector array<float>")
    got = nearest_points(pdf, qdf, k, block_bytes=block_bytes).collect()
    assert {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in got} == _brute(points, asked, k, d)


def test_nearest_without_questions_or_with_few_points(spark):
    pdf = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<float>")
    none = spark.createDataFrame([], "query_id string, vector array<float>")
    assert nearest_points(pdf, none, 3).count() == 0
    one = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, vector array<float>")
    assert [(r.id, r["rank"]) for r in nearest_points(pdf, one, 3).collect()] == [("a", 1)]


def test_cosine_and_unit(spark):
    rows = [([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [round(r.c, 9) for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1, 0, 0, 0, 0]
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [[round(x, 6) for x in r.u] for r in df.select(unit(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0, 0]]
    df = spark.createDataFrame([([1.0, float("nan")],), ([float("inf")],), ([1.0],)], "v array<float>")
    assert [r.f for r in df.select(is_finite(F.col("v")).alias("f")).collect()] == [False, False, True]


def test_intent(evaluate):
    asked = ["What services do you offer?", "what can we get help", "Our offerings", "which solution is best", "service desk",
             "What time is it", "", "What does it really offer here", "the capabilities it provides", "servicesoffered"]
    assert evaluate(is_broad_question, asked) == [True, True, True, True, False, False, False, True, True, False]


def test_overlap_and_boosts(spark):
    cfg = SearchConfig(intent=IntentConfig(overview_url="https://h/S/", coverage_urls=("https://h/s", "https://h/s/a")))
    rows = [("red fox", "Red", None, "a dog", "https://h/x", 0.5, True), ("red fox", "Our Services", "", "fox red", "https://H/S", 0.5, True),
            ("red fox", "solutionsx", "", "", "https://h/s/a/", 0.5, True), ("red fox", "services", "", "", "https://h/s", 0.5, False),
            ("?!", "x", "", "", "u", None, False)]
    df = spark.createDataFrame(rows, "q string, t string, s string, x string, u string, v double, b boolean")
    lex = lexical_overlap(F.col("q"), F.col("t"), F.col("s"), F.col("x"))
    got = [(r.l, r.r) for r in df.select(lex.alias("l"), rerank_score(
        F.col("v"), lex, F.col("u"), F.col("t"), F.col("b"), cfg).alias("r")).collect()]
    assert got == [(0.5, 0.5), (1.0, 0.825), (0.0, 0.505), (0.0, 0.395), (0.0, 0.0)]


def test_result_dedup_is_sequential(spark):
    rnd = random.Random(11)
    rows, want = [], set()
    for q in range(120):
        ids, texts = set(), set()
        for pos in range(rnd.randint(0, 14)):
            cid, text = rnd.choice(["", " ", "a", "b ", "b", "c", "d"]), rnd.choice(["", "!!", "X y", "x  Y!", "z", "w", "v"])
            rows.append((f"q{q}", pos, cid, text))
            form = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())
            key = cid.strip()
            if key:
                if key in ids:
                    continue
                ids.add(key)
            if form:
                if form in texts:
                    continue
                texts.add(form)
            want.add((f"q{q}", pos))
    df = spark.createDataFrame(rows, "query_id string, input_pos int, chunk_id string, text string")
    assert {(r.query_id, r.input_pos) for r in drop_duplicate_results(df).collect()} == want


def _mmr_model(cands, top_k, lam):
    chosen, used, rest = [], {}, list(cands)

    def cos(a, b):
        if a is None or b is None or len(a) != len(b):
            return 0.0
        a, b = np.float64(a), np.float64(b)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / n), 9) if n else 0.0

    while rest and len(chosen) < top_k:
        best, score = None, float("-inf")
        for c in rest:
            if used.get(c["doc"], 0) >= c["cap"]:
                continue
            penalty = max((cos(c["vec"], o["vec"]) for o, _ in chosen), default=0.0)
            value = round(lam * c["rel"] - (1.0 - lam) * penalty, 9)
            if value > score:
                best, score = c, value
        if best is None:
            break
        used[best["doc"]] = used.get(best["doc"], 0) + 1
        chosen.append((best, score))
        rest.remove(best)
    return [(c["pos"], s) for c, s in chosen]


def test_greedy_selection(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for q in range(40):
        n = rnd.randint(1, 20)
        cands = []
        for pos in range(1, n + 1):
            vec = rnd.choice([None, [0.0, 0.0, 0.0]] + [[float(rnd.randint(-2, 2)) for _ in range(3)] for _ in range(9)])
            cands.append({"pos": pos, "rel": rnd.choice([0.1, 0.25, 0.5, 0.5, 0.9]), "doc": rnd.choice("abc"), "vec": vec,
                          "cap": 1 if q % 2 else 2})
        want[f"q{q}"] = _mmr_model(cands, 5, 0.8)
        rows += [(f"q{q}", c["pos"], c["rel"], c["doc"], c["vec"], c["cap"], f"t{c['pos']}") for c in cands]
    df = spark.createDataFrame(rows, "query_id string, rerank_pos int, rerank_score double, doc_key string,"
                                     " vector array<float>, cap int, text string").repartition(3)
    got = {}
    for r in select_diverse(df, 5, 0.8).orderBy("query_id", "pick").collect():
        got.setdefault(r.query_id, []).append((r.rerank_pos, r.mmr_score))
        assert r.text == f"t{r.rerank_pos}"
    assert got == want


ENC = HashedWords(EmbedConfig(dimension=16))


@pytest.fixture(scope="module")
def points(spark):
    texts = {"overview": ["we list all our services here", "more about every service"], "a": ["claims work flows well", "claims again and again"],
             "b": ["cloud systems move fast", "cloud two"], "other": [f"note number {i} on claims" for i in range(8)]}
    rows = []
    for page, ts in texts.items():
        for i, t in enumerate(ts):
            rows.append((f"doc_{page}", f"doc_{page}__{i}", f"h{page}{i}", f"https://h/{page}", f"{page} services", "", t, i))
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_hash string, url string, title string,"
                                         " section string, text string, chunk_index int")
    return materialize(build_points(embed_chunks(chunks, ENC), 16), "test-points")


def _ask(spark, *questions):
    df = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "query_id string, question string")
    return df.withColumn("vector", ENC.encode(F.col("question")))


COVER = IntentConfig(overview_url="https://h/overview", coverage_urls=("https://h/overview", "https://h/a", "https://h/b", "https://h/none"))


def test_narrow_question_respects_caps_and_order(spark, points):
    rows = search(points, _ask(spark, "claims again", "  "), SearchConfig()).orderBy("pick").collect()
    assert {r.query_id for r in rows} == {"q0"} and [r.pick for r in rows] == [1, 2, 3, 4, 5][: len(rows)]
    assert "vector" not in rows[0].asDict() and rows[0].text == "claims again and again"
    per_doc = [r.document_id for r in rows]
    assert max(per_doc.count(d) for d in per_doc) <= 2


def test_broad_question_covers_each_listed_page_once(spark, points):
    rows = search(points, _ask(spark, "What services do you offer?"), SearchConfig(intent=COVER)).collect()
    assert sorted(r.url for r in rows) == ["https://h/a", "https://h/b", "https://h/overview"]


def test_broad_question_without_coverage_pages_has_no_result(spark, points):
    missing = IntentConfig(coverage_urls=("https://h/none",))
    for intent in (missing, IntentConfig()):
        assert search(points, _ask(spark, "What services do you offer?"), SearchConfig(intent=intent)).count() == 0


def test_search_shuffles_candidates_by_question_only_once(spark, points):
    plan = search(points, _ask(spark, "claims"), SearchConfig(intent=COVER))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("REPARTITION_BY_COL") == 1


def test_parameters_are_checked():
    for bad in ({"top_k": 0}, {"candidate_k": 4}, {"mmr_lambda": 1.5}):
        with pytest.raises(ValueError):
            SearchConfig(**bad)


def test_model_encoder_and_checks(spark):
    class Toy:
        def encode(self, texts):
            return [[float(len(t)), 1.0, 0.0] for t in texts]

    cfg = EmbedConfig(dimension=3, batch_size=2, model="toy", version="2")
    chunks = spark.createDataFrame([(f"c{i}", "d", f"h{i}", "x" * (i + 1)) for i in range(5)],
                                   "chunk_id string, document_id string, chunk_hash string, text string")
    embedded = embed_chunks(chunks, ModelEncoder(Toy, cfg))
    for r in embedded.collect():
        assert abs(np.linalg.norm(r.embedding) - 1) < 1e-6 and (r.embedding_model, r.embedding_dimensions) == ("toy", 3)
    verify_embeddings(embedded, 3, 5)
    with pytest.raises(RuntimeError, match="count"):
        verify_embeddings(embedded, 3, 6)
    with pytest.raises(RuntimeError, match="duplicate"):
        verify_embeddings(embedded.unionByName(embedded), 3)
    with pytest.raises(Exception, match="dimension mismatch"):
        embed_chunks(chunks, ModelEncoder(Toy, EmbedConfig(dimension=4))).collect()
    with pytest.raises(Exception, match="missing required field 'text'"):
        embed_chunks(chunks.withColumn("text", F.lit("")), ENC).collect()


def test_nearest_scan_betters_few_questions_at_a_time(spark):
    """Blocks of 600 questions over one file of 5000 points, with copies of one vector: all cores, exact ties by id."""
    from pagelore.operators import nearest

    rng = np.random.default_rng(5)
    points = [(f"p{i:05d}", [1.0, 2.0, 3.0, 4.0] if i % 7 == 0 else [float(x) for x in rng.integers(-9, 10, 4)]) for i in rng.permutation(5000)]
    asked = [(f"q{i:03d}", [1.0, 2.0, 3.0, 4.0] if i % 9 == 0 else [float(x) for x in rng.integers(-9, 10, 4)]) for i in range(600)]
    asked[1] = ("q001", [0.0] * 4)
    one = spark.createDataFrame(points, "id string, vector array<float>").coalesce(1)
    qdf = spark.createDataFrame(asked, "query_id string, vector array<float>")
    assert nearest._DEALT_PAIRS > 600 * 5000
    unit = lambda v: np.asarray(v) / (np.linalg.norm(v) or 1.0)
    names, matrix = [q for q, _ in asked], np.array([unit(v) for _, v in asked])
    top = nearest._Top(names, matrix, 5, 9)
    by_id = sorted(points)
    merged = []
    merge = top._merge
    top._merge = lambda *a: (merged.append(len(a[4])), merge(*a))[1]
    import pyarrow as pa

    for at in range(0, 5000, 1000):
        part = by_id[at : at + 1000]
        top.add(pa.array([i for i, _ in part]), np.array([unit(v) for _, v in part]))
    got = {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in nearest_points(one, qdf, 5).collect()}
    assert got == _brute(points, asked, 5, 4)
    assert {(q, i) for q, i, _ in zip(*[c.to_pylist() for c in top.columns()])} == {(q, i) for q, i, _, _ in got}
    # Questions that already have k points of score 1, or no direction, are not looked at again.
    assert sum(merged) < 600 * 5000 / 20
    nearest_dealt, nearest._DEALT_PAIRS = nearest._DEALT_PAIRS, 1000
    try:
        found = nearest_points(one, qdf, 5)
        assert "hashpartitioning(id" in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in found.collect()} == got
    finally:
        nearest._DEALT_PAIRS = nearest_dealt


def test_pairs_of_blocks_and_splits_meet_in_many_tasks(spark):
    """With a task for every group, a block of questions still meets every split of the points."""
    points = [(f"p{i:04d}", v) for i, v in enumerate(_vectors(400, 4, 3))]
    asked = [(f"q{i}", v) for i, v in enumerate(_vectors(40, 4, 4)) if v and len(v) == 4]
    pdf = spark.createDataFrame(points, "id string, vector array<float>")
    qdf = spark.createDataFrame(asked, "query_id string, vector array<float>")
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("false", "16")):
            spark.conf.set(name, value)
        got = nearest_points(pdf, qdf, 5, block_bytes=20 * 4 * 8).collect()
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in got} == _brute(points, asked, 5, 4)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150 * 4 * 8])
def test_nearest_starts_from_the_bar_of_a_sample(spark, monkeypatch, block_bytes):
    """A question's bar is no higher than its k-th best score, and only what reaches it is sent on."""
    from pagelore.operators import nearest

    rng = np.random.default_rng(6)
    points = [(f"p{i:05d}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(1000)]
    asked = [(f"q{i:03d}", v) for i, v in enumerate(_vectors(300, 4, 7)) if v and len(v) == 4]
    pdf = spark.createDataFrame(points, "id string, vector array<float>")
    qdf = spark.createDataFrame(asked, "query_id string, vector array<float>")
    want = _brute(points, asked, 5, 4)
    monkeypatch.setattr(nearest, "_DEALT_PAIRS", 1000)
    bars, with_least = [], nearest._with_least
    monkeypatch.setattr(nearest, "_with_least", lambda *a: bars.append(with_least(*a)) or bars[0])
    got = nearest_points(pdf, qdf, 5, block_bytes=block_bytes).collect()
    assert {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in got} == want
    fifth = {q: score for q, _, score, rank in want if rank == 5}
    least = {r.query_id: r.least for r in bars[0].collect()}
    assert least.keys() == fifth.keys() and all(-1.0 < least[q] <= fifth[q] + 1e-6 for q in fifth)


def test_nearest_sends_few_partial_results(spark, monkeypatch):
    """The sample is as large as the work asks for, so little more than the results reaches the shuffle."""
    from pagelore.operators import nearest

    rng = np.random.default_rng(8)
    points = [(f"p{i:05d}", [float(x) for x in rng.normal(size=8)]) for i in range(4000)]
    asked = [(f"q{i:03d}", [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    pdf = spark.createDataFrame(points, "id string, vector array<float>")
    qdf = spark.createDataFrame(asked, "query_id string, vector array<float>")
    monkeypatch.setattr(nearest, "_DEALT_PAIRS", 1000)
    sent, first_per_key = [], nearest.first_per_key
    monkeypatch.setattr(nearest, "first_per_key", lambda found, *a: (sent.append(found.count()), first_per_key(found, *a))[1])
    got = nearest_points(pdf, qdf, 5, tasks=16).collect()
    normal = [(i, [float(np.float32(x)) for x in v]) for i, v in points]
    single = [(i, [float(np.float32(x)) for x in v]) for i, v in asked]
    assert {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in got} == _brute(normal, single, 5, 8)
    assert sent[0] < 2 * 5 * len(asked)


def test_a_bar_is_reached_by_k_points_of_the_sample():
    """Also where some vectors are no numbers, questions have no direction, or there are fewer points than k."""
    from pagelore.operators import nearest

    rng = np.random.default_rng(9)
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    sample, matrix = unit(rng.normal(size=(1500, 8))).astype(np.float32), unit(rng.normal(size=(700, 8)))
    matrix[5], sample[::50] = 0.0, np.nan
    kth = np.sort(np.nan_to_num(matrix @ sample.T.astype(np.float64), nan=-2.0), axis=1)[:, -6]
    least = nearest._least_scores(matrix, sample, 6, 9)
    assert (least < kth).all() and np.mean(kth - least) < 0.01
    assert (nearest._least_scores(matrix, sample[:5], 6, 9) == -np.inf).all()


def test_a_point_that_is_no_number_hides_no_other(spark):
    """One infinite component makes all scores of a point no numbers; a tile's other points are still found."""
    points = [(f"p{i:04d}", v) for i, v in enumerate(_vectors(600, 4, 10))]
    asked = [(f"q{i:03d}", v) for i, v in enumerate(_vectors(60, 4, 11)) if v and len(v) == 4]
    odd = [(f"x{i}", [float("inf"), 1.0, 0.0, 0.0]) for i in range(3)]
    pdf = spark.createDataFrame(points + odd, "id string, vector array<float>")
    got = nearest_points(pdf, spark.createDataFrame(asked, "query_id string, vector array<float>"), 5).collect()
    assert {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in got} == _brute(points, asked, 5, 4)


def test_distinct_words_are_hashed_once_a_batch(monkeypatch):
    """A word that comes often costs one hash, and lies in the bucket of its own digest."""
    import hashlib

    import pyarrow as pa

    from pagelore.operators import embedding

    made = []
    monkeypatch.setattr(embedding.F, "arrow_udf", lambda f, kind: lambda column: made.append(f))
    monkeypatch.setattr(embedding, "lexical_words", lambda text: text)
    HashedWords(EmbedConfig(dimension=8)).encode(None)
    words = [["red", "fox", "red"], None, [], ["dog"] * 1000]
    got = made[0](pa.array(words, pa.list_(pa.string()))).to_pylist()
    for row, vector in zip(words, got, strict=True):
        want = np.zeros(8)
        for w in row or []:
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1
        norm = np.linalg.norm(want) or 1.0
        assert np.allclose(vector, want / norm, atol=1e-7)


def test_whole_points_are_shuffled_only_where_an_id_repeats(spark, tmp_path, monkeypatch):
    from pagelore.operators import points as p

    def rows(*ids):
        kept = [(i, [1.0, float(n)], f"d{i}", "u", n) for n, i in enumerate(ids)]
        return spark.createDataFrame(kept, "id string, vector array<float>, document_id string, url string, place int")

    used, latest = [], p.latest_points
    monkeypatch.setattr(p, "latest_points", lambda *a: (used.append(1), latest(*a))[1])
    p.index_points(rows("a", "b", "c"), f"{tmp_path}/t", 2)
    p.upsert_points(rows("c", "d").drop("place").withColumn("place", F.lit(7)), f"{tmp_path}/t")
    assert not used
    assert sorted((r.id, r.place) for r in p.read_points(spark, f"{tmp_path}/t").collect()) == [("a", 0), ("b", 1), ("c", 7), ("d", 7)]
    p.index_points(rows("a", "b", "a"), f"{tmp_path}/u", 2, order="place")
    assert used and sorted((r.id, r.vector[1]) for r in p.read_points(spark, f"{tmp_path}/u").collect()) == [("a", 2.0), ("b", 1.0)]


def test_blocks_and_splits_are_as_large_as_what_is_sent(spark, monkeypatch):
    """Points go out once for every block and questions once for every split: half as many of both for floats."""
    from pagelore.operators import nearest

    points = [(f"p{i:04d}", v) for i, v in enumerate(_vectors(400, 4, 3))]
    asked = [(f"q{i}", v) for i, v in enumerate(_vectors(160, 4, 4)) if v and len(v) == 4]
    dealt, paired = [], nearest._paired
    monkeypatch.setattr(nearest, "_STEP_POINTS", 16)
    monkeypatch.setattr(nearest, "_paired", lambda *a: dealt.append(a[-2:]) or paired(*a))
    for kind in ("float", "double"):
        pdf = spark.createDataFrame(points, f"id string, vector array<{kind}>")
        qdf = spark.createDataFrame(asked, f"query_id string, vector array<{kind}>")
        got = nearest_points(pdf, qdf, 5, block_bytes=20 * 4 * 8).collect()
        assert {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in got} == _brute(points, asked, 5, 4)
    assert dealt == [(-(-len(asked) // 40), 10), (-(-len(asked) // 20), 20)]


def test_larger_samples_leave_few_partial_results_of_blocks(spark, monkeypatch):
    """The first sample is as large as a block; later ones raise the bar before all points are met."""
    from pagelore.operators import nearest

    rng = np.random.default_rng(9)
    points = [(f"p{i:05d}", [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(3000)]
    asked = [(f"q{i:03d}", [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(60)]
    pdf = spark.createDataFrame(points, "id string, vector array<float>")
    qdf = spark.createDataFrame(asked, "query_id string, vector array<float>")
    monkeypatch.setattr(nearest, "_DEALT_PAIRS", 1000)
    sent, paired = [], nearest._paired
    monkeypatch.setattr(nearest, "_paired", lambda *a: (sent.append(paired(*a)), sent[-1])[1])
    got = nearest_points(pdf, qdf, 5, block_bytes=40 * 8 * 8).collect()
    assert {(r.query_id, r.id, round(r.score, 6), r["rank"]) for r in got} == _brute(points, asked, 5, 8)
    assert sent[-1].count() < 2 * nearest._GROWTH * 5 * len(asked)
