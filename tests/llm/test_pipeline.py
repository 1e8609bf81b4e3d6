"""Every stage of the corpus pipeline against a plain statement of what stays."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.helpers import DOCS, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a small corpus: junk and prose with labels, copies, a shared passage, a benchmark item."""
    out = str(tmp_path_factory.mktemp("corpus"))
    item, passage = prose(500, 30, 9000), prose(501, 40, 9000)
    good = [(k, prose(k, 60, 3000)) for k in range(60)]
    junk = [(100 + k, " ".join(f"{'#$%&'[k % 4] * 3}{k}{j}@@" for j in range(40))) for k in range(60)]
    rows = good + junk + [
        (200, prose(3, 60, 3000)), (201, prose(3, 60, 3000) + " end"), (202, prose(70, 50, 3000) + " " + item), (203, prose(71, 50, 3000) + " " + passage),
        (204, passage + " " + prose(72, 50, 3000)), (205, prose(73, 50, 3000)), (205, prose(74, 50, 3000) + " " + item), (None, prose(75, 50, 3000)),
        (None, item), (206, prose(76, 50, 3000)), (206, prose(76, 50, 3000)),
    ]
    docs = [(i, t, "en", f"s{k % 3}", len(t)) for k, (i, t) in enumerate(rows)]
    # The two rows of 206 agree in all columns.
    docs[-1] = docs[-2]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{out}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_quality_keeps_prose_and_drops_junk(spark, folder):
    kept = rows_of(P.quality(spark, read(spark, folder), folder))
    assert kept == Counter({k: n for k, n in rows_of(read(spark, folder)).items() if not (k[0] and 100 <= k[0] < 200)})


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def test_one_of_each_group_of_near_copies_stays(spark, folder):
    docs = read(spark, folder)
    before, kept = sorted(rows_of(docs), key=repr), rows_of(P.near_duplicates(spark, docs, folder))
    sets = {r: shingles(r[1]) for r in before}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    for row in before:
        assert sum(kept[other] for other in before if linked(row, other)) == 1, row[0]
    assert (3, prose(3, 60, 3000)) in kept and {i for i, _ in kept} >= {None, 205, 206}
    # Rows that only share an id, or have none, all stay.
    assert sum(n for (i, _), n in kept.items() if i in (None, 205)) == 4


def test_passages_go_where_an_earlier_document_has_them(spark, folder):
    kept = {r.doc_id: (r.text, r.n_chars) for r in P.repeated_passages(spark, read(spark, folder).where("doc_id BETWEEN 202 AND 204"), folder).collect()}
    passage = prose(501, 40, 9000)
    assert passage in kept[203][0] and passage[60:160] not in kept[204][0] and prose(72, 50, 3000)[60:] in kept[204][0]
    assert all(len(t) == n for t, n in kept.values())
    rows = rows_of(P.repeated_passages(spark, read(spark, folder).where("doc_id = 205"), folder))
    assert rows == rows_of(read(spark, folder).where("doc_id = 205"))


def test_only_contaminated_rows_go(spark, folder):
    item = prose(500, 30, 9000)
    kept = rows_of(P.contamination(spark, read(spark, folder), folder))
    assert kept == Counter({k: n for k, n in rows_of(read(spark, folder)).items() if item not in k[1]})
    assert sum(n for (i, _), n in kept.items() if i == 205) == 1 and sum(n for (i, _), n in kept.items() if i is None) == 1


def test_mix_takes_whole_copies_near_the_targets(spark, folder):
    docs = read(spark, folder)
    out = P.mix(spark, docs, folder)
    assert out.columns == [*P.COLUMNS, "copy"]
    rows, given = out.collect(), Counter((r.doc_id, r.text, r.source) for r in docs.collect())
    copies = Counter((r.doc_id, r.text, r.source) for r in rows)
    assert all(copies[k] <= 2 * n for k, n in given.items()) and set(copies) <= set(given)
    assert sorted(r.copy for r in rows if r.doc_id == 7) == list(range(1, copies[(7, prose(7, 60, 3000), "s1")] + 1))
    words, took = Counter(), Counter()
    for (_, text, source), n in given.items():
        words[source] += n * len(text.split())
    for r in rows:
        took[r.source] += len(r.text.split())
    assert abs(sum(took.values()) / sum(words.values()) - 1.5) < 0.03
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, P.mix(spark, docs, folder).collect()), key=repr)


def test_run_chains_the_stages(spark, folder):
    rows = P.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert not ids & {*range(100, 160), 200, 201, 202} and ids >= {4, 205} and all(prose(500, 30, 9000) not in r.text for r in rows)
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "mixing"]


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_stages_take_empty_and_null_rows(spark, folder, stage):
    assert stage(spark, spark.createDataFrame([], DOCS), folder).collect() == []
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", "en", "s0", 0), (None, " ", None, "s0", 1)]
    found = stage(spark, spark.createDataFrame(rows, DOCS).withColumn("row_key", F.lit("clash")), folder)
    assert set(P.COLUMNS) <= set(found.columns) and found.count() <= 4
