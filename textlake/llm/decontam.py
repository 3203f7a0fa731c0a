"""Benchmark decontamination by spaced seeds. DataFrame functions only.

Words are lower-cased runs of letters and digits. A mask is a fixed pattern of
used and ignored places; a seed is the hash of the used words under the mask.
Seeds of the test items are joined to the seeds of every document position;
each hit fixes a diagonal (document place less item place), on which the item
is laid over the document and compared word by word. Ignored places let seeds
survive substitutions; the comparison then tolerates them on the whole
diagonal. In a stretch that begins in an equal word no two places of ten, three
of fifteen or four of twenty break every seed of ``MASKS``, so each stretch of
ten or more words of which 80 % are equal has one: a longer one has two
substitutions at most in its first ten words, or the rest of it, from its next
equal word on, has the share too.

An overlap is reported when an aligned stretch has at least ``MIN_OVERLAP``
words (or the whole item, if that is shorter) of which ``MIN_SHARE`` are equal;
it begins and ends in an equal word.

Defined cases: NULL or wordless documents and items never match; an item
shorter than the masks must occur whole; repeated items each match; rows
of one id (NULL is an id) come back as one; an empty item table matches nothing.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: used, 0: ignored.
MASKS = ("1001110110", "1010011011", "1010101101", "1100001111", "1101110001", "1110100110", "1111010100", "1111101000")
MIN_OVERLAP = 13
MIN_SHARE = 0.8
#: Item seeds up to this many bytes are broadcast; more are shuffled.
BROADCAST_BYTES = 64 << 20


def word_ids(text: Column) -> Column:
    """64-bit ids of the words of a text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(ids: Column, i: Column, mask: str, number: int) -> Column:
    """Seed at place i from the words there (__0, __1, ...); NULL where the mask does not fit."""
    used = [F.col(f"__{k}") for k, c in enumerate(mask) if c == "1"]
    return F.when(i + len(mask) <= F.size(ids), F.xxhash64(F.lit(number), *used))


def places(ids: Column, masks: dict[int, str]) -> Column:
    """Places where the shortest mask fits; NULL if there is none."""
    least = min(map(len, masks.values()))
    return F.when(F.size(ids) >= least, F.sequence(F.lit(0), F.size(ids) - least))


def with_seeds(df: DataFrame, ids: str, masks: dict[int, str]) -> DataFrame:
    """A row for each place i and mask, with the seed s; s is NULL where the mask does not fit.

    Exploded twice, so that the hashes are made row by row in generated code,
    small enough to be compiled: the words of a place are taken out once. The
    outer kind keeps the optimizer from working the words out once more for a filter.
    """
    columns = df.columns
    df = df.select("*", F.explode_outer(places(F.col(ids), masks)).alias("i"))
    words = [F.get(ids, F.col("i") + k).alias(f"__{k}") for k in range(max(map(len, masks.values())))]
    found = F.array(*[_seed(F.col(ids), F.col("i"), m, n) for n, m in masks.items()])
    return df.select("*", *words).select(*columns, "i", F.explode_outer(found).alias("s"))


def item_seeds(items: DataFrame, masks: tuple[str, ...] = MASKS) -> tuple[DataFrame, dict[int, str]]:
    """Rows (s, item_id, j, iw) and the masks by number: item seeds with the item's words.

    An item shorter than the shortest mask is one seed of all its words; the
    masks for that are added for the lengths that occur, fewer than the
    shortest mask has places.
    """
    short = min(map(len, masks))
    items = items.select("item_id", word_ids(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    lengths = sorted(r[0] for r in items.where(F.size("iw") < short).select(F.size("iw")).distinct().collect())
    numbered = dict(enumerate(masks)) | {1000 + n: "1" * n for n in lengths}
    long = with_seeds(items.where(F.size("iw") >= short), "iw", dict(enumerate(masks)))
    found = [long] + [with_seeds(items.where(F.size("iw") == n), "iw", {1000 + n: "1" * n}) for n in lengths]
    found = reduce(DataFrame.unionByName, found).where(F.col("s").isNotNull())
    return found.select("s", "item_id", F.col("i").alias("j"), "iw"), numbered


def find_overlaps(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, doc_id: str = "doc_id",
                  text: str = "text", min_overlap: int = MIN_OVERLAP, min_share: float = MIN_SHARE) -> DataFrame:
    """Rows (doc_id, item_id, n_words, n_equal, item_words), one per document id and item that overlap.

    n_words is the longest verified stretch and n_equal its equal words.
    """
    probe, numbered = item_seeds(items, masks)
    n, width = probe.agg(F.count("*"), F.coalesce(F.max(F.size("iw")), F.lit(0))).first()
    small = n * (8 * width + 64) <= BROADCAST_BYTES
    d = docs.select(F.col(doc_id).alias("doc_id"), word_ids(F.col(text)).alias("w"))
    d = with_seeds(d, "w", numbered)
    hits = d.join(F.broadcast(probe) if small else probe, "s")
    # the part of the document under the item, and the part of the item over the document
    at = F.col("i") - F.col("j")
    skip = F.greatest(-at, F.lit(0))
    n_item = F.size("iw")
    length = F.least(n_item - skip, F.size("w") - F.greatest(at, F.lit(0)))
    hits = hits.select("doc_id", "item_id", n_item.alias("item_words"), first_on_diagonal(numbered).alias("first"),
                       F.slice("w", F.greatest(at, F.lit(0)) + 1, length).alias("dw"),
                       F.slice("iw", skip + 1, length).alias("iw"))
    eq = F.zip_with("dw", "iw", lambda a, b: a == b)
    best = longest(eq, min_share, F.least(F.lit(min_overlap), F.col("item_words")))
    good = hits.select("doc_id", "item_id", "item_words", F.when(F.col("first"), best).alias("best"))
    # judged after the grouping: a condition before it would search each stretch in the join as well, outside generated code
    good = good.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"), F.max("item_words").alias("item_words"))
    good = good.where(F.col("best.n") > 0)
    return good.select("doc_id", "item_id", F.col("best.n").cast("long").alias("n_words"),
                       F.col("best.eq").cast("long").alias("n_equal"), F.col("item_words").cast("long").alias("item_words"))


def first_on_diagonal(masks: dict[int, str]) -> Column:
    """False for a hit when a mask also hits one place before it: that hit finds the same diagonal."""
    i, j = F.col("i") - 1, F.col("j") - 1

    def hit(mask: str) -> Column:
        fits = (i + len(mask) <= F.size("w")) & (j + len(mask) <= F.size("iw"))
        return reduce(and_, [F.get("w", i + k) == F.get("iw", j + k) for k, c in enumerate(mask) if c == "1"], fits)

    shared = [m for n, m in masks.items() if n < 1000]  # a short item is hit once on a diagonal
    return (i < 0) | (j < 0) | ~F.coalesce(reduce(or_, map(hit, shared)), F.lit(False))


def longest(flags: Column, min_share: float, least: Column) -> Column:
    """Longest stretch from one equal word to another that has the share of equal words and ``least`` words.

    A struct with the stretch's length n and its equal words eq; 0 and 0 if
    there is none. One pass over the places of equal words: a stretch with the
    share begins, at its longest, where fewer words of the share were ahead
    than at any place before, so only those places are kept as beginnings.
    """
    share = Fraction(str(min_share))
    num, den = share.numerator, share.denominator
    at = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("eq"))
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<struct<v:bigint,k:int,x:int>>").alias("begins"), none.alias("best"))

    def step(a: Column, x: Column) -> Column:
        k, begins = a["k"], a["begins"]
        v = k.cast("long") * den - x.cast("long") * num  # equal words ahead less the share of all words ahead
        here = F.struct(v.alias("v"), k.alias("k"), x.alias("x"))
        low = F.when(F.size(begins) == 0, True).otherwise(v < F.element_at(begins, -1)["v"])
        begins = F.when(low, F.concat(begins, F.array(here))).otherwise(begins)
        # one word on: the stretch from a beginning to here has the share if its value did not fall
        first = F.get(F.filter(begins, lambda b: b["v"] <= v + (den - num)), 0)
        got = F.struct((x - first["x"] + 1).alias("n"), (k - first["k"] + 1).alias("eq"))
        best = F.when(first.isNotNull() & (got["n"] >= least), F.greatest(a["best"], got)).otherwise(a["best"])
        return F.struct((k + 1).alias("k"), begins.alias("begins"), best.alias("best"))

    found = F.aggregate(at, start, step, lambda a: a["best"])
    # too few equal words for any stretch: nothing to search
    return F.when(F.size(at) * den >= least * num, found).otherwise(none)


def contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Rows (doc_id, items, n_words): the documents that overlap test items, with the items' ids."""
    found = find_overlaps(docs, items, **how)
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"),
                                       F.max("n_words").alias("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose text is contaminated, whatever ids they share; rows without an id are judged alike."""
    # a row is known by its id and text: 128 bits, and whether there is an id, as hashes pass over NULL
    cols = [F.col(doc_id).isNull(), F.col(doc_id), F.col(text)]
    keyed = docs.withColumn("__key", F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second"), *reversed(cols)).alias("b")))
    bad = contaminated(keyed, items, doc_id="__key", text=text, **how).select(F.col("doc_id").alias("__key"))
    return keyed.join(bad, "__key", "left_anti").select(*docs.columns)
