"""Secret scans over the versions of files, each distinct text scanned once for each rule.

The ledger is a Parquet folder. A row says that a blob (a text under its SHA-256) was scanned
with some rules, each in its version, and what was found. A batch of file versions is scanned
in three steps:

1.  Versions become blobs; equal texts become one, first within a task and then over all.
2.  Pairs of blob and rule version that the ledger lacks are scanned and appended. A new rule,
    or a new version of one, is run alone over the blobs of the batch; a finished pair is not
    run again.
3.  The findings of the ledger are joined to every version that has the blob. A blob that very
    many versions share is spread over several tasks.

A scan that fails leaves the ledger as it was. Two scans at once may scan a blob twice; the
findings are the same and count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.common import batches, small_batches
from pagelore.operators.joins import join_unique
from pagelore.session import path_exists


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``needles``: a text (lower-cased, if ``folded``) without any of them has no match."""

    kind: str
    version: int
    pattern: str
    needles: tuple[str, ...] = ()
    folded: bool = False
    #: The group that must have ``least`` characters, else the match is dropped.
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three decide the digest of base spans. No pattern can start again inside
#: a run that it has read, so the time is linear in the text.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "api"), True, 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("AKIA",), False, 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    Rule("github", 1, r"gh[opsru]_[A-Za-z0-9]{36,}", ("gho_", "ghp_", "ghs_", "ghr_", "ghu_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("login", 1, r"://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/:@]{1,100}@", ("://",)),
)
BASE_KINDS = ("assign", "access", "hex")

FOUND = "array<struct<kind:string,version:int,start:int,end:int>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def find(text: str, rules: tuple[Rule, ...], compiled: dict[str, re.Pattern]) -> list[dict]:
    """Spans of every rule, leftmost and not overlapping within a rule; positions are code points."""
    found, folded = [], None
    for rule in rules:
        if rule.needles:
            if rule.folded and folded is None:
                folded = text.lower()
            if not any(n in (folded if rule.folded else text) for n in rule.needles):
                continue
        for m in compiled[rule.key].finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append({"kind": rule.kind, "version": rule.version, "start": m.start(), "end": m.end()})
    return found


def compile_rules(rules: tuple[Rule, ...]) -> dict[str, re.Pattern]:
    # ASCII: the long s and the Kelvin sign are not letters of a keyword.
    return {r.key: re.compile(r.pattern, re.A | re.I if r.folded else re.A) for r in rules}


def _scanner(rules: tuple[Rule, ...]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_rules(rules)
        for whole in parts:
            for part in batches(whole, "text"):
                missing = part.column("missing").to_pylist()
                found = [
                    find(text, tuple(r for r in rules if r.key in wanted), compiled)
                    for text, wanted in zip(part.column("text").to_pylist(), map(set, missing))
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("blob").cast(pa.binary()), pa.array(missing, pa.list_(pa.string())), pa.array(found, _FOUND)],
                    names=["blob", "scanned", "found"],
                )

    return run


def blob_id(text: Column) -> Column:
    """The address of a text: the SHA-256 of its bytes. A null text is the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class SecretLedger:
    """What has been scanned so far, in the folder ``path``, which all executors reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        """(blob, scanned, found), or nothing before the first scan."""
        schema = f"blob binary, scanned array<string>, found {FOUND}"
        return self.spark.read.schema(schema).parquet(self.path) if path_exists(self.spark, self.path) else None

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, text, missing): each distinct text of ``versions`` that lacks a rule version, once."""
        wanted = F.array(*[F.lit(r.key) for r in rules])
        texts = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        distinct = texts.dropDuplicates(["blob"])
        rows = self.rows()
        if rows is None:
            return distinct.withColumn("missing", wanted)
        done = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
        missing = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        return distinct.join(done, "blob", "left").withColumn("missing", missing).where(F.size("missing") > 0).drop("done")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, hot_rows: int = 1_000) -> DataFrame:
        """The rows of ``versions`` with ``blob`` and ``findings`` in place of ``text``.

        Findings are sorted by start, then by the order of ``rules``; they are those of ``rules``
        in these versions. An empty or null text has none. Repeated rows, equal paths and
        null paths each keep their row. Other columns stay as they are; columns of the input
        that are named ``blob`` or ``findings`` give way. An empty table gives no rows, and
        an empty ledger. Texts are scanned whole, however long.
        """
        todo = small_batches(self.unseen(versions, rules))
        schema = f"blob binary, scanned array<string>, found {FOUND}"
        todo.mapInArrow(_scanner(rules), schema).write.mode("append").parquet(self.path)
        kept = [c for c in versions.columns if c.lower() not in ("text", "blob", "findings")]
        rows = versions.select(blob_id(F.col("text")).alias("blob"), F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("at"))
        joined = join_unique(rows, self.findings(rules), "blob", "at", "left", hot_rows=hot_rows)
        return joined.select("row.*", "blob", F.coalesce("findings", F.array().cast(FOUND)).alias("findings"))

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, findings) of the blobs in which one of ``rules`` has found something, each once."""
        keys = F.array(*[F.lit(r.key) for r in rules])
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        rows = self.rows().where(F.size("found") > 0)
        every = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
        current = F.filter("found", lambda s: F.array_contains(keys, F.concat(s["kind"], F.lit("@"), s["version"].cast("string"))))
        ranked = F.transform(current, lambda s: F.struct(s["start"].alias("at"), F.array_position(kinds, s["kind"]).alias("rank"), s.alias("span")))
        ordered = F.transform(F.array_sort(ranked), lambda s: s["span"])
        return every.select("blob", ordered.alias("findings")).where(F.size("findings") > 0)


def spans_text(findings: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the findings, of some kinds only, joined by commas."""
    wanted = findings if kinds is None else F.filter(findings, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the findings, a row per version; ``scanned`` has a doc_id."""
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(spans_text(F.col("findings"), BASE_KINDS), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"),
    )
