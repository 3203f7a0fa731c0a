"""Prompt templates.

Templates are cut at their placeholders once on the driver; the fill is a
native ``concat`` so braces inside a context or a query are never expanded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our own prompt wording (the model-specific chat markers are the public
# formats of those model families).
DEFAULT_TEMPLATE = ("Use the following context to answer the question.\n"
                    "Context:\n{context}\n\nQuestion: {query}\nAnswer:")
MISTRAL_TEMPLATE = "<s>[INST] Context:\n{context}\n\nQuestion: {query} [/INST]"
GOOGLE_TEMPLATE = ("<start_of_turn>user\nContext:\n{context}\n\nQuestion: {query}<end_of_turn>\n"
                   "<start_of_turn>model\n")

_PLACEHOLDER = re.compile(r"\{(context|query)\}")


def fill(template: str, **values: Column) -> Column:
    """Replace ``{name}`` placeholders by columns (NULL value -> '')."""
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(values[m.group(1)], F.lit("")))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def fill_by_model(model: Column, **values: Column) -> Column:
    """Template chosen by model name, then filled."""
    return (F.when(model.contains("mistral"), fill(MISTRAL_TEMPLATE, **values))
             .when(model.contains("google"), fill(GOOGLE_TEMPLATE, **values))
             .otherwise(fill(DEFAULT_TEMPLATE, **values)))


def field_block(items: Column, fields: list[tuple[str, str]]) -> Column:
    """For each item ``'  \\n  \\n'`` then ``'{label}:  \\t{value}  \\n'`` per field.

    ``items`` is an ordered ``array<struct>``; ``fields`` maps labels to
    struct field names.
    """
    def one(x):
        return F.concat(F.lit("  \n  \n"), *[
            F.concat(F.lit(f"{label}:  \t"), F.coalesce(x[name].cast("string"), F.lit("")),
                     F.lit("  \n")) for label, name in fields])
    return F.array_join(F.transform(items, one), "")
