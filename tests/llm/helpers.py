"""Small documents with every awkward case, and plain statements of what operators should give."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def documents(spark, texts: list[tuple], *extra: str):
    """Rows (doc_id, text) as documents; more columns of clashing names on demand."""
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    return df


def awkward() -> list[tuple]:
    long = prose(1, 4000)
    return [
        (1, prose(2, 120)), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "one two"), (7, long),
        (8, prose(2, 120)), (8, prose(2, 120)), (None, prose(2, 120)), (None, None), (9, "ÀÉ ñandú x 日本語 " * 30), (10, "a" * 700),
    ]


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
