"""Markup extraction.

Native regex extractors cover the simple, well-formed shapes. The tolerant
extractor is an Arrow UDF around the standard library ``html.parser``: it
parses each document once and returns every requested field as one struct,
and a malformed document yields NULL fields, never a failed task.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
SKIP = {"script", "style"}


def first_tag_text(html: Column, tag: str) -> Column:
    """S18 (native): raw text of the first ``<tag>``; missing gives NULL."""
    v = F.regexp_extract(html, f"<{tag}(?:\\s[^>]*)?>([^<]*)</{tag}>", 1)
    return F.when(v != "", v)


def first_href(html: Column) -> Column:
    """The first ``a href="..."`` value; missing gives NULL."""
    v = F.regexp_extract(html, r'a href="([^"]*)"', 1)
    return F.when(v != "", v)


def all_hrefs(html: Column) -> Column:
    """S9 (all links)."""
    return F.regexp_extract_all(html, F.lit(r'a href="([^"]*)"'), 1)


def list_items(html: Column) -> Column:
    """``array<struct<pos, href, text>>`` of ``<li><a href>text</a>`` items."""
    pat = r'<li><a href="([^"]*)">([^<]*)</a>'
    hrefs = F.regexp_extract_all(html, F.lit(pat), 1)
    texts = F.regexp_extract_all(html, F.lit(pat), 2)
    return F.arrays_zip(hrefs.alias("href"), texts.alias("text"))


def drop_amp(url: Column) -> Column:
    """Remove the literal ``amp;``."""
    return F.replace(url, F.lit("amp;"), F.lit(""))


class _Extractor(HTMLParser):
    """One pass: first text of each named tag, and the text of ``parent > child``."""

    def __init__(self, fields, parent, child):
        super().__init__(convert_charrefs=True)
        self.fields = set(fields)
        self.parent, self.child = parent, child
        self.first: dict[str, str] = {}
        self.open: dict[str, tuple[int, list]] = {}
        self.stack: list[str] = []
        self.body: list[str] | None = None
        self.body_depth: int | None = None
        self.body_done = False
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if (not self.body_done and self.body_depth is None and tag == self.child
                and self.stack and self.stack[-1] == self.parent):
            self.body_depth = len(self.stack) + 1
            self.body = []
        self.stack.append(tag)
        if tag in self.fields and tag not in self.first and tag not in self.open:
            self.open[tag] = (len(self.stack), [])
        if tag in SKIP:
            self.skip += 1

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            t = self.stack.pop()
            depth = len(self.stack) + 1
            if t in SKIP:
                self.skip = max(0, self.skip - 1)
            if t in self.open and self.open[t][0] == depth:
                self.first[t] = "".join(self.open.pop(t)[1])
            if self.body_depth == depth and not self.body_done:
                self.body_done = True
            if t == tag:
                break

    def handle_data(self, data):
        if self.skip:
            return
        for _, parts in self.open.values():
            parts.append(data)
        if self.body is not None and not self.body_done:
            self.body.append(data)

    def result(self):
        for t, (_, parts) in list(self.open.items()):  # unclosed at end of input
            self.first.setdefault(t, "".join(parts))
        return self.first, ("".join(self.body) if self.body is not None else None)


def parse_one(doc: str | None, fields, parent: str, child: str) -> dict:
    out = {f: None for f in fields}
    out["body"] = None
    if doc is None:
        return out
    try:
        p = _Extractor(fields, parent, child)
        p.feed(doc)
        p.close()
        first, body = p.result()
        out.update({f: first.get(f) for f in fields})
        out["body"] = body
    except Exception:
        pass
    return out


def extract_fields(html: Column, fields=("titulo", "origen_legislativo", "departamento", "rango"),
                   parent: str = "documento", child: str = "texto") -> Column:
    """S18 + S19: struct of first-tag texts plus the ``parent > child`` body text."""
    fields = tuple(fields)
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields]
                          + [T.StructField("body", T.StringType())])

    @F.pandas_udf(schema)
    def _parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_one(x, fields, parent, child) for x in s],
                            columns=list(fields) + ["body"])

    return _parse(html)
