"""HTML to flat, pre-ordered nodes: the one place where pages are read in Python.

The helper only finds elements and text pieces and notes which of them sit inside a
removed subtree. What they mean is decided by the column expressions that use them.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelore.config import NOISE_CLASSES, REMOVED_TAGS

# Elements without content, and elements whose text is not page text.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen"
    " link menuitem meta nextid param source spacer track wbr".split()
)
SILENT_TAGS = frozenset(("script", "style", "template", "rt", "rp"))

NODES = (
    "struct<"
    "texts: array<struct<text:string, hidden:boolean>>,"
    "elements: array<struct<tag:string, hidden:boolean, noisy:boolean, last:int,"
    " from:int, upto:int, name:string, rel:string, href:string, content:string>>"
    ">"
)
# Pages, and bytes of them, whose nodes are Python objects at one time.
PART_PAGES = 200
PART_BYTES = 1 << 20
_ATTRIBUTES = ("name", "rel", "href", "content")


class _Reader(HTMLParser):
    """Collects elements in pre-order with the range of elements and texts below them.

    An end tag closes everything up to the nearest open element of that name and is
    ignored where none is open; nothing is closed by implication.
    """

    def __init__(self, removed: frozenset[str], noise: re.Pattern[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.removed, self.noise = removed, noise
        self.texts: list[tuple[str, bool]] = []
        self.elements: list[list] = []
        self.open: list[int] = []
        self.silent = 0
        self.pending: list[str] = []

    def _flush(self) -> None:
        if self.pending:
            text = "".join(self.pending).strip()
            self.pending.clear()
            if text and not self.silent:
                hidden = bool(self.open) and self.elements[self.open[-1]][1]
                self.texts.append((text, hidden))

    def _shut(self, index: int) -> None:
        element = self.elements[index]
        element[3], element[5] = len(self.elements), len(self.texts)
        if element[0] in SILENT_TAGS:
            self.silent -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        found = dict(attrs)
        classes = " ".join((found.get("class") or "").lower().split())
        noisy = bool(classes) and self.noise.search(classes) is not None
        hidden = (
            tag in self.removed
            or (noisy and tag not in ("main", "article"))
            or (bool(self.open) and self.elements[self.open[-1]][1])
        )
        values = [found.get(a, None) if a not in found else (found[a] or "") for a in _ATTRIBUTES]
        self.open.append(len(self.elements))
        self.elements.append([tag, hidden, noisy, 0, len(self.texts), 0, *values])
        if tag in SILENT_TAGS:
            self.silent += 1
        if tag in VOID_TAGS:
            self._shut(self.open.pop())

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if any(self.elements[i][0] == tag for i in self.open):
            while True:
                index = self.open.pop()
                self._shut(index)
                if self.elements[index][0] == tag:
                    return

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data: str) -> None:
        """The text of a CDATA section stands by itself; other declarations only end the text before."""
        self._flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[len("CDATA[") :])
            self._flush()

    def finish(self) -> None:
        self.close()
        self._flush()
        while self.open:
            self._shut(self.open.pop())


def html_nodes(html: Column) -> Column:
    """The ``NODES`` struct of an HTML text; NULL for NULL."""
    removed = frozenset(REMOVED_TAGS)
    noise = re.compile("|".join(rf"\b{re.escape(c)}\b" for c in NOISE_CLASSES))
    kind = pa.struct(
        [
            ("texts", pa.list_(pa.struct([("text", pa.string()), ("hidden", pa.bool_())]))),
            (
                "elements",
                pa.list_(
                    pa.struct(
                        [
                            ("tag", pa.string()), ("hidden", pa.bool_()), ("noisy", pa.bool_()),
                            ("last", pa.int32()), ("from", pa.int32()), ("upto", pa.int32()),
                            ("name", pa.string()), ("rel", pa.string()),
                            ("href", pa.string()), ("content", pa.string()),
                        ]
                    )
                ),
            ),
        ]
    )

    def listed(rows: list[list], item: pa.StructType) -> pa.Array:
        """A list column from one list of tuples per page, built field by field."""
        offsets = [0]
        for row in rows:
            offsets.append(offsets[-1] + len(row))
        flat = [cell for row in rows for cell in row]
        columns = list(zip(*flat)) if flat else [()] * item.num_fields
        fields = [pa.array(c, item.field(i).type) for i, c in enumerate(columns)]
        values = pa.StructArray.from_arrays(fields, fields=list(item))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    def parse(pages: pa.Array) -> pa.Array:
        texts: list[list] = []
        elements: list[list] = []
        missing = []
        for page in pages.to_pylist():
            missing.append(page is None)
            reader = _Reader(removed, noise)
            if page is not None:
                reader.feed(page)
                reader.finish()
            texts.append(reader.texts)
            elements.append(reader.elements)
        return pa.StructArray.from_arrays(
            [listed(texts, kind.field(0).type.value_type), listed(elements, kind.field(1).type.value_type)],
            fields=list(kind),
            mask=pa.array(missing, pa.bool_()),
        )

    def parse_parts(pages: pa.Array) -> pa.Array:
        """A batch part by part: as Python objects, nodes take many times the room of their page."""
        ends, held = [0], 0
        for i, size in enumerate(pc.binary_length(pages).fill_null(0).to_pylist()):
            held += size
            if held > PART_BYTES or i - ends[-1] >= PART_PAGES:
                ends.append(i + 1)
                held = 0
        ends.append(len(pages))
        parts = [parse(pages.slice(at, upto - at)) for at, upto in zip(ends, ends[1:]) if at < upto]
        return pa.concat_arrays(parts) if parts else parse(pages)

    parse_parts.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(parse_parts, NODES)(html)
