"""Chat formatting with typed content parts.

A message holds text, or a list of typed parts. A visitor turns every part into text:
text is escaped, an image, audio or document part becomes an ordered placeholder, its
reference is recorded with the number of tokens it expands to. The template

    <|start|>ROLE<|body|>CONTENT<|end|>

puts one message per segment; the segments of a conversation in turn order are its
formatted text. Control strings inside texts and roles get one backslash after their
first character, one more if there are some already, so that escaping can be undone.
"""

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.common import small_batches

START, BODY, END = "<|start|>", "<|body|>", "<|end|>"
#: What a text may not hold unescaped: this template's marks start with ``<|``; the other
#: strings are control strings of common public chat templates.
_CONTROL = re.compile(r"<(?=\\*(?:\||/?s>|</?SYS>>))|\[(?=\\*/?INST\])")
_ESCAPED = re.compile(r"<\\(?=\\*(?:\||/?s>|</?SYS>>))|\[\\(?=\\*/?INST\])")
_SEGMENT = re.compile(r"<\|start\|>(.*?)<\|body\|>(.*?)<\|end\|>", re.S)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document):\d+\|>")

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT_SCHEMA = (
    "conv_id long, turn long, role string, segment string, loss_from int, loss_to int, n_tokens_expanded long, "
    "attachments array<struct<position:int,kind:string,ref:string,tokens:long>>"
)
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_attachments long"
)


@dataclass(frozen=True)
class PartSizes:
    """Tokens that a part stands for."""

    image_patch: int = 28
    audio_tokens_per_second: float = 12.5
    document_tokens_per_page: int = 512


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


class PartVisitor:
    """Visits the parts of one message in order. Unknown kinds count as documents of one page."""

    def __init__(self, sizes: PartSizes) -> None:
        self.sizes, self.out, self.attachments = sizes, [], []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        side = self.sizes.image_patch
        tokens = math.ceil((part.get("width") or side) / side) * math.ceil((part.get("height") or side) / side)
        self._attach("image", part, tokens)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.sizes.audio_tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * self.sizes.document_tokens_per_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        at = len(self.attachments)
        self.attachments.append({"position": at, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.out.append((kind, at))

    def content(self) -> str:
        # Neighbouring texts are escaped as one, as a control string may span them.
        joined, run = [], []
        for piece in [*self.out, None]:
            if isinstance(piece, str):
                run.append(piece)
                continue
            joined.append(escape("".join(run)))
            run = []
            if piece:
                joined.append(f"<|{piece[0]}:{piece[1]}|>")
        return "".join(joined)


def format_messages(messages: DataFrame, sizes: PartSizes = PartSizes()) -> DataFrame:
    """One segment per row of ``messages`` (conv_id, turn, role, and ``parts`` or ``text``).

    Null texts, roles and part lists are empty. A message with a ``parts`` list ignores its
    ``text``. The span ``loss_from``:``loss_to`` (code points of the segment) is an assistant's
    content; it is empty for other roles. Rows are independent of each other: no shuffle.
    Other columns are dropped. Attachments are numbered within their message.
    """
    if "parts" not in messages.columns:
        messages = messages.withColumn("parts", F.lit(None).cast(f"array<{PART}>"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()),
            ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("n_tokens_expanded", pa.int64()),
            ("attachments", pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
        ])
        for batch in stream:
            rows = []
            for r in batch.to_pylist():
                visitor = PartVisitor(sizes)
                for part in r["parts"] if r["parts"] is not None else [{"kind": "text", "text": r["text"]}]:
                    visitor.visit(part or {})
                role, content = r["role"] or "", visitor.content()
                head = f"{START}{escape(role)}{BODY}"
                end = len(head) + (len(content) if role == "assistant" else 0)
                rows.append({
                    "conv_id": r["conv_id"], "turn": r["turn"], "role": role, "segment": head + content + END,
                    "loss_from": len(head), "loss_to": end,
                    "n_tokens_expanded": sum(a["tokens"] for a in visitor.attachments), "attachments": visitor.attachments,
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    return small_batches(messages).select("conv_id", "turn", "role", "text", "parts").mapInArrow(run, SEGMENT_SCHEMA)


def formatted_text(segments: DataFrame) -> DataFrame:
    """The whole formatted text of every conversation. A conversation has to fit into one row."""
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "segment")))
    return segments.groupBy("conv_id").agg(F.concat_ws("", F.transform(order, lambda x: x.segment)).alias("formatted"))


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of every conversation, read from its formatted segments alone.

    Conversations are streamed in turn order (equal turns by role, then segment; null
    turns first); a task keeps the hash states of one conversation, however long it is.
    Placeholders stay in the texts as they are. Null conversation ids make one conversation.
    """
    ordered = (
        segments.select("conv_id", "turn", "role", "segment", "loss_from", "loss_to")
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        current, done = None, []

        def close() -> None:
            if current:
                done.append((current[0], current[1], current[2].hexdigest(), current[3], current[4].hexdigest(), *current[5:]))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [()] * 7, kinds)], names)
            done.clear()
            return out

        for batch in stream:
            for conv, segment, start, stop in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to"))):
                if current is None or current[0] != conv:
                    close()
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                current[5] += len(segment)
                for role, content in _SEGMENT.findall(segment):
                    current[1] += 1
                    current[6] += len(_PLACEHOLDER.findall(content))
                    current[2].update(f"{unescape(role)}\n{unescape(content)}\n".encode())
                masked = unescape(segment[start:stop])
                current[3] += len(masked)
                current[4].update(masked.encode())
            yield flush()
        close()
        yield flush()

    return ordered.mapInArrow(run, DIGEST_SCHEMA)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7: a user and an assistant who both say control strings."""
    spark: SparkSession = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
