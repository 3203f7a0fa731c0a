"""Ranked lexical search of many queries at once, with common term sets evaluated once.

Queries ("items") are dealt to blocks of bounded size. For a block, term sets
that items share are mined into a graph: a leaf is a term, an inner node is the
sum of two nodes that at least two items (or nodes) hold together, and what is
left of an item is a list of nodes. Documents are tokenised once; for each run
of documents every leaf's contribution is computed once, every inner node adds
its two parents' partial scores once, and items add up their few nodes. Each
task keeps its best ``k`` documents per item, so only those are shuffled.

Scores are whole numbers: with N documents that hold a term, L terms in them, n
terms of a document, df documents with a term and tf its occurrences,
``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, ``m = 10 + (90 n N) div L`` and a
term adds ``w * ((10^9 tf) div (1000 tf + 8 m))``.

Defined cases: NULL and empty texts have no terms and are no part of N; items
without terms have no rows; rows with one item id (NULL is an id) are one item,
the union of their terms; rows of documents are ranked each on their own, also
repeated ones; equal scores go by ascending doc_id, NULL last. Other columns
are ignored. Terms are known by 64-bit hashes.

Memory: a block holds about ``BLOCK_TERMS`` (item, term) rows (an item is not
split); a task holds ``ACC_BYTES`` of partial scores and the best ``k`` rows of
the block's items. One job over the stored postings is run per block.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import distinct_per_doc, forget, lean, saved, slices, text_buffers, word_hashes

#: (item, term) rows of a block of items.
BLOCK_TERMS = 1 << 18
#: Bytes of partial scores that a task holds.
ACC_BYTES = 16 << 20
TOP_K = 10
_PLAN = ("block long, terms array<long>, left array<int>, right array<int>, "
         "items array<long>, nodes array<int>, sizes array<int>")


def _item_terms(batches):
    """(item, term hash) rows, each once per row of items."""
    for b in batches:
        ids = b.column("item")
        buf, off = text_buffers(b.column("text"))
        for i, j in slices(off):
            h, counts = word_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i], letters=True)
            terms, sizes = distinct_per_doc(h, np.repeat(np.arange(j - i), counts), j - i)
            rows = np.repeat(np.arange(i, j), sizes)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(terms.view(np.int64))], ["item", "term"])


def mine_shared(nodes: np.ndarray, sizes: np.ndarray, n_leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, nodes, sizes): inner nodes for pairs that several lists share, and the shortened lists.

    ``nodes`` are the lists one after the other, ``sizes`` their lengths. Lists
    are first ordered by how many of them hold a node, so terms that go
    together stand together. Each round counts neighbouring pairs, gives every
    list its locally most frequent ones and replaces a pair that two places or
    more agree on by one new node; it ends when no pair occurs twice.
    """
    group = np.repeat(np.arange(len(sizes)), sizes)
    often = np.bincount(nodes, minlength=n_leaves)
    order = np.lexsort((nodes, -often[nodes], group))
    nodes, group = nodes[order].astype(np.int64), group[order]
    left, right, made = [], [], n_leaves
    while len(nodes) > 1:
        pairs = (nodes[:-1] << 32) | nodes[1:]
        inside = group[:-1] == group[1:]
        kinds, inverse, counts = np.unique(pairs[inside], return_inverse=True, return_counts=True)
        if not len(counts) or counts.max() < 2:
            break
        # smaller rank = more frequent; a pair is taken where neither neighbouring pair is more frequent
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((kinds, -counts))] = np.arange(len(kinds))
        never = len(kinds)
        at = np.full(len(nodes) + 1, never)
        at[1:-1][inside] = np.where(counts[inverse] > 1, rank[inverse], never)
        taken = np.flatnonzero((at[1:-1] < never) & (at[1:-1] < at[:-2]) & (at[1:-1] < at[2:]))
        kinds, inverse, counts = np.unique(pairs[taken], return_inverse=True, return_counts=True)
        shared = counts > 1
        taken, which = taken[shared[inverse]], (np.cumsum(shared) - 1)[inverse[shared[inverse]]]
        left.append(kinds[shared] >> 32)
        right.append(kinds[shared] & 0xFFFFFFFF)
        nodes[taken] = made + which
        nodes, group = np.delete(nodes, taken + 1), np.delete(group, taken + 1)
        made += int(shared.sum())
    none = np.zeros(0, np.int64)
    return (np.concatenate([none, *left]).astype(np.int32), np.concatenate([none, *right]).astype(np.int32),
            nodes.astype(np.int32), np.bincount(group, minlength=len(sizes)).astype(np.int32))


def _plan_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row: the graph of a block of items."""
    table = table.sort_by([("item", "ascending"), ("term", "ascending")])
    hashes = table.column("term").to_numpy().view(np.uint64)
    terms, leaf = np.unique(hashes, return_inverse=True)
    runs = pc.run_end_encode(table.column("item").combine_chunks())
    sizes = np.diff(np.concatenate([[0], runs.run_ends.to_numpy()]))
    left, right, nodes, sizes = mine_shared(leaf, sizes, len(terms))
    one = lambda x: pa.array([x])
    return pa.Table.from_arrays(
        [pa.array([key[0].as_py()], pa.int64()), one(terms.view(np.int64)), one(left), one(right),
         pa.array([runs.values.to_pylist()], pa.list_(pa.int64())), one(nodes), one(sizes)],
        ["block", "terms", "left", "right", "items", "nodes", "sizes"])


def share_plans(items: DataFrame, item_id: str, text: str, block_terms: int) -> DataFrame:
    """Stored rows (see ``_PLAN``), one per block of items, mined by Spark tasks."""
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text"))
    terms = saved(rows.mapInArrow(_item_terms, "item long, term long").distinct(), "search-item-terms")
    blocks = terms.count() // block_terms + 1
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    plans = saved(terms.groupBy(block.alias("block")).applyInArrow(_plan_block, _PLAN), "search-plans")
    forget(terms)
    return plans


def _postings(vocabulary):
    """Kernel: rows (doc_id, n, terms, tfs) with the block's terms in each document that has any term at all."""
    def run(batches):
        vocab = vocabulary.value
        for b in batches:
            ids = b.column("doc_id")
            buf, off = text_buffers(b.column("text"))
            for i, j in slices(off):
                h, counts = word_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i], letters=True)
                place = np.searchsorted(vocab, h)
                place[place == len(vocab)] = 0
                hit = vocab[place] == h
                doc = np.repeat(np.arange(j - i, dtype=np.int64), counts)[hit]
                keys, tf = np.unique(doc * len(vocab) + place[hit], return_counts=True)
                per = np.searchsorted(keys // len(vocab), np.arange(j - i + 1))
                lists = [pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(x.astype(np.int32)))
                         for x in (keys % len(vocab), tf)]
                out = pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(counts.astype(np.int64)), *lists],
                                                 ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(counts > 0))
    return run


class _Best:
    """The best ``k`` (score, doc_id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.none = np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, none: np.ndarray) -> None:
        """``scores``: items x documents; a score not above 0 or below an item's k-th is no candidate."""
        item, at = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        item, score = np.append(self.item, item), np.append(self.score, scores[item, at])
        doc, none = np.append(self.doc, docs[at]), np.append(self.none, none[at])
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        place = np.arange(len(item)) - first
        keep = order[place < self.k]
        full = place == self.k - 1
        self.least[item[full]] = score[order[full]]
        self.item, self.score, self.doc, self.none = item[place < self.k], score[keep], doc[keep], none[keep]


def _levels(left: np.ndarray, right: np.ndarray, n_leaves: int) -> list[np.ndarray]:
    """Inner nodes by the length of their longest way to a leaf."""
    depth = np.zeros(n_leaves + len(left), np.int64)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        depth[n_leaves + i] = max(depth[a], depth[b]) + 1
    inner = depth[n_leaves:]
    return [np.flatnonzero(inner == d) for d in range(1, int(inner.max(initial=0)) + 1)]


def _score(plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int, acc_bytes: int):
    """Kernel: the best ``k`` documents per item of a task's documents."""
    def run(batches):
        p = plan.value
        n_leaves, left, right = len(p["terms"]), p["left"], p["right"]
        levels = _levels(left, right, n_leaves)
        starts = np.cumsum(p["sizes"]) - p["sizes"]
        width = max(acc_bytes // (8 * (n_leaves + len(left) + len(p["nodes"]))), 1)
        best = _Best(len(p["sizes"]), k)
        for b in batches:
            ids = b.column("doc_id")
            none = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            m = np.array([10 + (90 * n * n_docs) // n_terms for n in b.column("n").to_pylist()], np.int64)
            terms, tfs = b.column("terms"), b.column("tfs")
            per = terms.offsets.to_numpy()
            term = terms.values.to_numpy()
            tf = tfs.values.to_numpy()[tfs.offsets[0].as_py():][:per[-1] - per[0]].astype(np.int64)
            term, per = term[per[0]:per[-1]], per - per[0]
            for i in range(0, len(ids), width):
                j = min(i + width, len(ids))
                doc = np.repeat(np.arange(i, j), np.diff(per[i:j + 1]))
                t, f = term[per[i]:per[j]], tf[per[i]:per[j]]
                acc = np.zeros((n_leaves + len(left), j - i), np.int64)
                acc[t, doc - i] = weights[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m[doc]))
                for at in levels:
                    acc[n_leaves + at] = acc[left[at]] + acc[right[at]]
                best.add(np.add.reduceat(acc[p["nodes"]], starts, axis=0), ids[i:j], none[i:j])
        if len(best.item):
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.item), pa.array([p["items"][i] for i in best.item.tolist()], pa.int64()),
                 pa.array(best.doc, mask=best.none), pa.array(best.score)], ["at", "item_id", "doc_id", "score"])
    return run


def _search_block(docs: DataFrame, plan: dict, k: int, acc_bytes: int) -> DataFrame:
    """Top rows of one block's items; tokenises the documents once."""
    spark: SparkSession = docs.sparkSession
    sc = spark.sparkContext
    held = saved(docs.mapInArrow(lean(_postings(sc.broadcast(plan["terms"]))), "doc_id long, n long, terms array<int>, tfs array<int>"),
                 "search-postings")
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(plan["terms"]), np.int64)
    for term, n in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    best = held.mapInArrow(lean(_score(sc.broadcast(plan), weights, n_docs, n_terms, k, acc_bytes)),
                           "at long, item_id long, doc_id long, score long")
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP_K, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
                  acc_bytes: int = ACC_BYTES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    plans = share_plans(items, item_id, item_text, block_terms)
    found = []
    for key in [r[0] for r in plans.select("block").collect()]:
        plan = plans.where(F.col("block") == key).first().asDict()
        plan = {name: x if name in ("block", "items") else np.array(x, np.int64) for name, x in plan.items()}
        plan["terms"] = plan["terms"].view(np.uint64)
        found.append(_search_block(rows, plan, k, acc_bytes))
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found) if found else none
