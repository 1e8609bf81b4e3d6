"""What the physical plans have to look like."""

from pyspark.sql import functions as F

from pagelore.config import IntentConfig
from pagelore.operators.extract import extract_pages
from pagelore.operators.nearest import nearest_points
from pagelore.operators.ranking import coverage_anchors
from pagelore.operators.validation import build_manifest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _points(spark, tmp_path):
    rows = [(f"p{i}", [float(i), 1.0], f"u{i % 3}", "text") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, vector array<float>, url string, text string")
    df.write.parquet(str(tmp_path / "points"))
    return spark.read.parquet(str(tmp_path / "points"))


def test_extraction_and_validation_do_not_shuffle(spark):
    pages = spark.createDataFrame([("https://h/a", "<p>x</p>")], "url string, html string")
    docs = extract_pages(pages)
    assert "Exchange" not in _plan(docs)
    assert "Exchange" not in _plan(build_manifest(docs.withColumn("file", F.lit("f"))))


def test_extraction_parses_each_page_once(spark):
    pages = spark.createDataFrame([("https://h/a", "<p>x</p>")], "url string, html string")
    assert _plan(extract_pages(pages)).count("ArrowEvalPython") == 1


def test_similarity_scan_reads_ids_and_vectors_only(spark, tmp_path):
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    plan = _plan(nearest_points(_points(spark, tmp_path), asked, 3))
    assert "ReadSchema: struct<id:string,vector:array<float>>" in plan
    assert plan.count("Exchange") == 1 and plan.count("WindowGroupLimit") == 2


def test_blocks_of_questions_and_splits_of_points_are_one_job(spark, tmp_path):
    points = _points(spark, tmp_path)
    rows = [(f"q{i}", [float(i % 5), 1.0]) for i in range(40)] + [("none", None)]
    asked = spark.createDataFrame(rows, "query_id string, vector array<float>")
    # Blocks of 3 questions and splits of 3 points; neither is collected to be sent out.
    found = nearest_points(points, asked, 4, block_bytes=48)
    plan = _plan(found)
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
    assert "Broadcast" not in plan and "CartesianProduct" not in plan
    assert sorted(found.collect()) == sorted(nearest_points(points, asked, 4).collect()) and found.count() == 160


def test_coverage_filter_reaches_the_scan(spark, tmp_path):
    anchors = coverage_anchors(_points(spark, tmp_path), IntentConfig(coverage_urls=("u1", "u2")))
    plan = _plan(anchors)
    assert "In(url, [u1,u2])" in plan and plan.count("WindowGroupLimit") == 2
    assert [(r.url, r.anchor_pos) for r in anchors.orderBy("anchor_pos").collect()] == [
        ("u1", 1), ("u1", 2), ("u1", 3), ("u2", 4), ("u2", 5), ("u2", 6)]
