"""Stored pages: HTML text to an element tree, one row per page.

A page is one input row and stays one row: its elements are an array in
document order, and everything read off a page is an expression over that
array. No page ever needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Elements without content, and elements whose text is not page text.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
HIDDEN_TEXT_TAGS = frozenset("script style template rt rp".split())

_NODE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("scope", T.IntegerType()),
        T.StructField("first_text", T.IntegerType()),
        T.StructField("last_text", T.IntegerType()),
        T.StructField("raw", T.StringType()),
    ]
)
PAGE_TREE = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(_NODE)),
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)
# HTML whose trees are Python objects at one time, in characters.
SLICE_CHARS = 1 << 20


class _Trees:
    """Trees of some pages as columns: the nodes' fields, the texts and where each page's begin."""

    def __init__(self):
        self.end, self.parent, self.depth, self.tag, self.scope = [], [], [], [], []
        self.first_text, self.last_text, self.raw = [], [], []
        self.attrs, self.names, self.values = [0], [], []
        self.texts, self.errors, self.known = [], [], []
        self.node_ends, self.text_ends = [0], [0]

    def add(self, html: str | None) -> None:
        error = None
        try:
            if html is not None:
                _TreeBuilder(self).build(html)
        except Exception as problem:  # one odd page must not end the job; see ``page_errors``
            error = f"{type(problem).__name__}: {problem}"
            nodes, texts = self.node_ends[-1], self.text_ends[-1]
            for column in (self.end, self.parent, self.depth, self.tag, self.scope, self.first_text, self.last_text, self.raw):
                del column[nodes:]
            del self.attrs[nodes + 1 :], self.names[self.attrs[-1] :], self.values[self.attrs[-1] :], self.texts[texts:]
        self.errors.append(error)
        self.known.append(html is not None)
        self.node_ends.append(len(self.end))
        self.text_ends.append(len(self.texts))

    def arrow(self) -> pa.Array:
        starts = np.array(self.node_ends, np.int32)
        ids = np.arange(len(self.end), dtype=np.int32) - np.repeat(starts[:-1], np.diff(starts))
        number, text = pa.int32(), pa.string()
        columns = {
            "id": pa.array(ids),
            "end": pa.array(self.end, number),
            "parent": pa.array(self.parent, number),
            "depth": pa.array(self.depth, number),
            "tag": pa.array(self.tag, text),
            "attrs": pa.MapArray.from_arrays(
                pa.array(self.attrs, number), pa.array(self.names, text), pa.array(self.values, text)
            ),
            "scope": pa.array(self.scope, number),
            "first_text": pa.array(self.first_text, number),
            "last_text": pa.array(self.last_text, number),
            "raw": pa.array(self.raw, text),
        }
        nodes = pa.StructArray.from_arrays([*columns.values()], [*columns])
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(starts), nodes),
                pa.ListArray.from_arrays(pa.array(self.text_ends, number), pa.array(self.texts, text)),
                pa.array(self.errors, text),
            ],
            ["nodes", "texts", "error"],
            mask=pa.array([not k for k in self.known], pa.bool_()),
        )


class _TreeBuilder(HTMLParser):
    """Numbers elements in document order; an end tag closes back to its start tag.

    Unclosed elements stay open until an ancestor closes; a stray end tag is
    ignored. ``end`` is the last element inside, ``scope`` the nearest enclosing
    itemscope, and texts[first_text:last_text] the element's own text pieces.
    """

    def __init__(self, trees: _Trees):
        super().__init__(convert_charrefs=True)
        self.trees, self.node, self.text = trees, len(trees.end), len(trees.texts)
        self.open, self.open_tags, self.pending = [], [], []
        self.scoped = set()
        self.hidden = 0

    def build(self, html: str) -> None:
        self.feed(html)
        self.close()
        self._flush()
        while self.open:
            self._close()

    def _flush(self):
        if self.pending:
            piece = "".join(self.pending)
            self.pending.clear()
            if self.hidden:
                if self.open_tags[-1] == "script":
                    raw, top = self.trees.raw, self.node + self.open[-1]
                    raw[top] = (raw[top] or "") + piece
            elif piece := piece.strip():
                self.trees.texts.append(piece)

    def _close(self) -> str:
        trees, tag = self.trees, self.open_tags.pop()
        place = self.node + self.open.pop()
        trees.end[place] = len(trees.end) - self.node - 1
        trees.last_text[place] = len(trees.texts) - self.text
        self.hidden -= tag in HIDDEN_TEXT_TAGS
        return tag

    def handle_starttag(self, tag, attrs, empty=False):
        self._flush()
        trees = self.trees
        number, texts = len(trees.end) - self.node, len(trees.texts) - self.text
        parent = self.open[-1] if self.open else None
        trees.scope.append(parent if parent in self.scoped else None if parent is None else trees.scope[self.node + parent])
        trees.parent.append(parent)
        trees.end.append(number)
        trees.depth.append(len(self.open))
        trees.tag.append(tag)
        trees.first_text.append(texts)
        trees.last_text.append(texts)
        trees.raw.append(None)
        if attrs:
            named = {name: value or "" for name, value in attrs}
            trees.names.extend(named)
            trees.values.extend(named.values())
            if "itemscope" in named:
                self.scoped.add(number)
        trees.attrs.append(len(trees.names))
        if not empty and tag not in VOID_TAGS:
            self.open.append(number)
            self.open_tags.append(tag)
            self.hidden += tag in HIDDEN_TEXT_TAGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, empty=True)

    def handle_endtag(self, tag):
        self._flush()
        if tag in self.open_tags:
            while self._close() != tag:
                pass

    def handle_data(self, data):
        self.pending.append(data)

    def _break_text(self, _):
        self._flush()

    handle_comment = handle_decl = handle_pi = unknown_decl = _break_text


def _slices(html: pa.Array) -> Iterator[pa.Array]:
    """Trees of the pages as Arrow columns, slice by slice, so the pages of a batch are never all objects."""
    trees, held = _Trees(), 0
    for page in html:
        page = page.as_py()
        trees.add(page)
        held += len(page or "")
        if held >= SLICE_CHARS:
            yield trees.arrow()
            trees, held = _Trees(), 0
    if trees.known:
        yield trees.arrow()


@F.arrow_udf(PAGE_TREE)
def parse_html(html: pa.Array) -> pa.Array:
    """Element tree of every HTML text (null for null), those of a batch at once.

    A page the parser gives up on has no elements and an ``error``.
    """
    return pa.concat_arrays([*_slices(html)] or [_Trees().arrow()])


@F.arrow_udf(PAGE_TREE)
def parse_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The trees of ``parse_html``, sent on slice by slice.

    Trees are many times as large as their pages, so a task holds those of a slice, however
    many pages Spark hands over in a batch.
    """
    for html in batches:
        yield from _slices(html)


# Else Spark puts a filter on the tree before ``spread`` as well, and parses every page twice, first in few tasks.
parse_html, parse_pages = parse_html.asNondeterministic(), parse_pages.asNondeterministic()


def with_tree(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their ``tree`` instead of the HTML text; only ``html`` goes to Python."""
    return pages.withColumn("tree", parse_pages(F.col(html))).drop(html)


def page_errors(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """The pages that could not be parsed, with the parser's message."""
    return parsed.where(F.col("tree.error").isNotNull()).select(
        key, "url", F.col("tree.error").alias("error")
    )


def text_of_html(html: Column) -> Column:
    """Visible text of an HTML fragment, pieces joined by a space."""
    return F.array_join(parse_pages(html)["texts"], " ")


def html_nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per element, for ad-hoc work on page structure."""
    tree = with_tree(pages.select(key, "html"))
    return tree.select(key, F.inline("tree.nodes"))
