"""Web pages as trees of their tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_nodes

#: Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Start tags, the open elements that they end, and the elements around which they don't look further.
ENDS = [
    (("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"), ("p",), ("table", "td", "th", "button")),
    (("li",), ("li",), ("ul", "ol")),
    (("dt", "dd"), ("dt", "dd"), ("dl",)),
    (("td", "th"), ("td", "th"), ("tr", "table")),
    (("tr",), ("tr",), ("table",)),
    (("option",), ("option",), ("select",)),
]
#: What is no markup of the page: comments, and the content of scripts and styles.
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)\b[^>]*?(/?)>")
#: Tags of a page are numbered below this.
TAGS_A_PAGE = 1 << 32
#: Tags that a task holds before it hands them on; a page more.
TAGS_A_BATCH = 1 << 14

_ROW = "page_id long, pos long, parent long, post long, depth int, kind string, tag string"
_RULE = {start: (ends, within) for starts, ends, within in ENDS for start in starts}


def elements(html: str) -> list[list]:
    """``[pos, parent, post, depth, kind, tag]`` of each start tag, in order of the tags' numbers.

    An end tag ends the innermost open element of its name and what is open inside, or
    nothing.  A start tag first ends what :data:`ENDS` says.  Void and self-closed
    elements hold nothing; what is still open ends with the page.
    """
    out, stack, pos = [], [], -1
    for pos, m in enumerate(TAG.finditer(html)):
        kind = m[2].lower()
        if m[1]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][4] == kind), len(stack))
        else:
            ends, within = _RULE.get(kind, ((), ()))
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][4] in ends or stack[i][4] in within), len(stack))
            if at < len(stack) and stack[at][4] in within:
                at = len(stack)
        for closed in stack[at:]:
            closed[2] = pos
        del stack[at:]
        if not m[1]:
            out.append([pos, stack[-1][0] if stack else None, pos, len(stack), kind, m[0]])
            if kind not in VOID and not m[3]:
                stack.append(out[-1])
    for left in stack:
        left[2] = pos + 1
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _ROW.split(", ")])


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nodes`` of every page: an element a start tag, of whatever name and depth.  A page is a row, so no page meets another."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("html", F.lit("")), HIDDEN, "").alias("h"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h in zip(b.column("page_id"), b.column("h")):
                rows += [(i.as_py(), *e) for e in elements(h.as_py())]
                if len(rows) >= TAGS_A_BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    found = pages.mapInArrow(go, _ROW)
    return as_nodes(
        found.select(
            F.concat(F.lit("page"), "page_id").alias("file_id"),
            (F.col("page_id") * TAGS_A_PAGE + F.col("pos")).alias("node_id"),
            (F.col("page_id") * TAGS_A_PAGE + F.col("parent")).alias("parent_id"),
            F.lit("child").alias("role"),
            F.col("pos").alias("pre"),
            "post",
            "depth",
            "kind",
            F.col("tag").alias("text"),
        )
    )
