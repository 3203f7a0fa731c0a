"""String column functions (S1-S17, C20): native expressions only."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace exactly as Python's ``str.split()`` sees it, as a Java regex
# class body (the same text is valid RE2 for the SQL oracle).
PY_WHITESPACE = (r"\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}"
                 r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Accent-fold table generated by rule from the Unicode database.

    Every code point whose canonical decomposition keeps exactly one ASCII
    character maps to that character; every other non-ASCII code point is
    dropped by the regex in :func:`fold`.
    """
    src, dst = [], []
    for cp in range(0x80, 0x3000):
        folded = unicodedata.normalize("NFD", chr(cp)).encode("ascii", "ignore")
        if len(folded) == 1:
            src.append(chr(cp))
            dst.append(folded.decode())
    return "".join(src), "".join(dst)


def fold_py(s: str) -> str:
    """Python definition of the fold (NFD, ASCII-ignore, lower)."""
    return unicodedata.normalize("NFD", s).encode("ascii", "ignore").decode().lower()


def fold(c: Column) -> Column:
    """NFD -> drop non-ASCII -> lower, as one codegen expression."""
    src, dst = _fold_table()
    return F.lower(F.regexp_replace(F.translate(c, src, dst), r"[^\x00-\x7F]", ""))


def contains_any(c: Column, needles) -> Column:
    """OR of literal ``contains``; an empty list matches everything."""
    needles = [n for n in needles]
    if not needles:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [c.contains(F.lit(n)) for n in needles])


def keyword_match(title: Column, keywords) -> Column:
    """Accent- and case-insensitive literal OR over a title.

    A NULL title never matches (it is not turned into the string 'nan').
    """
    kws = [fold_py(k) for k in keywords]
    if not kws:
        return F.lit(True)
    return F.coalesce(contains_any(fold(title), kws), F.lit(False))


def clean_text(c: Column) -> Column:
    """S3: newline and '|' to space, collapse Python whitespace, trim."""
    return F.trim(F.regexp_replace(c, "[" + PY_WHITESPACE + r"|]+", " "))


def split_last(c: Column, sep: str, back: int = 1) -> Column:
    """Element ``-back`` of a split (NULL when too short)."""
    return F.try_element_at(F.split(c, _re_literal(sep)), F.lit(-back))


def _re_literal(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch for ch in s)


def zero_pad(c: Column, width: int) -> Column:
    """``{:0width}`` of an integer column."""
    return F.format_string(f"%0{width}d", c.cast("long"))


def title_prefix(title: Column, text: Column) -> Column:
    """C20: ``"{title}: {text}"``; no prefix at all when the title is NULL."""
    return F.when(title.isNull(), text).otherwise(F.concat(title, F.lit(": "), text))


def strip_newline_suffix(c: Column) -> Column:
    """Remove one trailing newline (``$`` would also match before the last of two)."""
    return F.regexp_replace(c, r"\n\z", "")


def char_count(c: Column) -> Column:
    """Characters (code points)."""
    return F.char_length(c).cast("long")


def byte_count(c: Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(c).cast("long")


def object_bytes(c: Column, overhead: int) -> Column:
    """C13 size: UTF-8 bytes plus the fixed per-object overhead."""
    return (F.octet_length(c) + F.lit(overhead)).cast("long")


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)
