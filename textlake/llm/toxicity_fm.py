"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms -- words (runs of letters and digits, A-Z
lower-cased) and their first PREFIXES bytes, so that inflected forms share a
term -- hashed into 2^BITS places. The machine scores
``b + sum w_i + sum_{i<j} <v_i, v_j>`` over the present terms, so pairs such as
an insult and the mention of a group weigh beyond their sum. It is trained
with AdaGrad on the logistic loss over a bounded sample of labelled rows;
every document is scored in Arrow batches with the broadcast model.

Bounds: the sample has at most ``SAMPLE_DOCS`` documents, the smallest by a
hash of their id, one text an id. The machine has a row for every place whose
share of toxic documents deviates by ``MIN_Z`` standard units, and for both
places of every pair of whole words that is toxic more often than its places' rates explain
(:func:`telling_pairs`), however rare they are and whatever each tells alone.
Neither number is capped but by the 2^BITS places.

Defined cases: NULL and wordless texts get the bias alone; rows of one id with
several labels count as toxic if any is; NULL labels are ignored; without
labels of both classes every score is the share of toxic rows (0 if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct_per_doc, lean, saved, slices, text_buffers, word_hashes

BITS = 20
PREFIXES = (4, 5, 6, 7)
SAMPLE_DOCS = 20_000
#: Terms whose share of toxic documents deviates by fewer standard units are left out.
MIN_Z = 3.0
#: Chance that any pair of a sample without interactions passes as one.
PAIR_RISK = 0.05
#: Entries of documents' rows that the count of pairs handles at once.
PAIR_BLOCK = 1 << 20
FACTORS = 8
EPOCHS = 20
THRESHOLD = 0.3


def term_places(texts: pa.Array, bits: int = BITS, prefixes: tuple[int, ...] = PREFIXES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, distinct places of a slice of documents, how many each has)."""
    buf, off = text_buffers(texts)
    for i, j in slices(off):
        h, c = word_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i], letters=True, prefixes=prefixes)
        places = (h.ravel() >> np.uint64(64 - bits)).astype(np.int64)
        v, m = distinct_per_doc(places, np.repeat(np.arange(j - i), c * (1 + len(prefixes))), j - i)
        yield i, v, m


class Model:
    """Bias, and for each place a row (weight, factors); row 0 is for all places without one."""

    def __init__(self, bias: float, index: np.ndarray, weights: np.ndarray):
        self.bias, self.index, self.weights = bias, index, weights

    def scores(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        rows = self.index[places]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        return _sigmoid(_raw(self.bias, self.weights, rows[rows > 0], doc[rows > 0], len(sizes))[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _raw(bias: float, weights: np.ndarray, rows: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and the sums of factors; ``doc`` ascends."""
    out, sums = np.full(n, bias), np.zeros((n, weights.shape[1] - 1))
    if len(rows):
        seen, first = np.unique(doc, return_index=True)
        own = weights[rows]
        total = np.add.reduceat(own, first, axis=0)
        squares = np.add.reduceat((own[:, 1:] ** 2).sum(axis=1), first)
        sums[seen] = total[:, 1:]
        out[seen] += total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - squares)
    return out, sums


def fit(rows: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, index: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS,
        rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Model:
    """Train on documents given as rows of the model (1, 2, ...), how many each has, and 0/1 labels.

    ``index`` gives the row of each place, 0 for places without one.
    """
    n, p, terms = len(sizes), float(toxic.mean()) if len(toxic) else 0.0, int(index.max(initial=0))
    if not 0 < p < 1:
        return Model(-30.0 if p == 0 else 30.0, np.zeros_like(index), np.zeros((1, 1 + factors)))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rng = np.random.default_rng(seed)
    weights = np.zeros((terms + 1, 1 + factors))
    weights[1:, 1:] = rng.normal(0, 0.01, (terms, factors))
    bias, sq_bias, sq = float(np.log(p / (1 - p))), 1e-6, np.full_like(weights, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            pick = np.sort(order[at:at + 256])
            lens = sizes[pick]
            local = np.repeat(np.arange(len(pick)), lens)
            r = rows[np.repeat(starts[pick] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
            raw, sums = _raw(bias, weights, r, local, len(pick))
            err = (_sigmoid(raw) - toxic[pick]) / len(pick)
            sq_bias += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(sq_bias)
            used, inverse = np.unique(r, return_inverse=True)
            if not len(used):
                continue
            grad = np.empty((len(r), 1 + factors))
            grad[:, 0] = err[local]
            grad[:, 1:] = err[local][:, None] * (sums[local] - weights[r][:, 1:])
            by = np.argsort(inverse, kind="stable")
            first = np.searchsorted(inverse[by], np.arange(len(used)))
            g = np.add.reduceat(grad[by], first, axis=0) + decay * weights[used]
            sq[used] += g ** 2
            weights[used] -= rate * g / np.sqrt(sq[used])
    return Model(bias, index, weights)


def _sample_places(bits: int):
    def run(batches):
        for b in batches:
            kinds = []
            for prefixes in (PREFIXES, ()):
                out = []
                for _, v, m in term_places(b.column("text"), bits, prefixes):
                    ends = np.cumsum(m)
                    out += [v[e - k:e].astype(np.int32) for k, e in zip(m, ends)]
                kinds.append(pa.array(out, pa.list_(pa.int32())))
            if len(kinds[0]):
                yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("order"), *kinds], ["toxic", "order", "places", "words"])
    return run


def _chosen_rows(index):
    """Batches of the sample with the places replaced by the model's rows, those without one left out."""
    def run(batches):
        for b in batches:
            places = b.column("places")
            rows = [index.value[x.values.to_numpy()] for x in places]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("order"), pa.array([x[x > 0].tobytes() for x in rows], pa.binary())],
                                             ["toxic", "order", "rows"])
    return run


def _expected(r1, r2, p: float):
    """Toxic share of two terms' common documents if their log odds add up, no less than the mean."""
    odds = r1 / (1 - r1) * (r2 / (1 - r2)) * ((1 - p) / p)
    return np.maximum(odds / (1 + odds), p)


def _evidence(hit, df, e):
    """Log likelihood ratio of ``hit`` toxic among ``df`` documents against a share of ``e``; 0 where the share is not above it."""
    rest = df - hit
    with np.errstate(divide="ignore", invalid="ignore"):
        g = hit * np.log(hit / (df * e)) + np.where(rest > 0, rest * np.log(rest / (df * (1 - e))), 0.0)
    return np.where(hit > df * e, g, 0.0)


def _pair_counter(shared):
    """For terms of the batch: their pairs with later terms whose evidence reaches the limit."""
    def counts(terms, starts, docs, size):
        """How many of ``docs`` have each term."""
        out, lens = np.zeros(size, np.int64), starts[docs + 1] - starts[docs]
        block = np.cumsum(lens) // PAIR_BLOCK
        for at in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(block)) + 1):
            n = lens[at]
            idx = np.repeat(starts[docs[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out += np.bincount(terms[idx], minlength=size)
        return out

    def run(batches):
        terms, starts, n_toxic, rate, p, limit = shared.value  # documents with toxic ones first
        size = len(rate)
        owner = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        by = np.argsort(terms, kind="stable")
        owner, first = owner[by], np.searchsorted(terms[by], np.arange(size + 1))
        for b in batches:
            out = [np.zeros((0, 2), np.int64)]
            for i in b.column("id").to_numpy():
                docs = owner[first[i]:first[i + 1]]
                cut = np.searchsorted(docs, n_toxic)
                hit = counts(terms, starts, docs[:cut], size)
                hit[:i + 1] = 0
                e = _expected(rate[i], rate, p)
                # the most evidence that so many toxic documents can give
                js = np.flatnonzero(hit * -np.log(e) >= limit)
                if len(js):
                    df = hit + counts(terms, starts, docs[cut:], size)
                    js = js[_evidence(hit[js], df[js], e[js]) >= limit]
                    out.append(np.stack([np.full(len(js), i), js], axis=1))
            got = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])
    return run


def _counted(sample: DataFrame) -> DataFrame:
    """Rows (place, df, hit): documents with the place, and toxic ones among them."""
    places = sample.select("toxic", F.explode("places").alias("place"))
    return places.groupBy("place").agg(F.count("*").alias("df"), F.sum("toxic").alias("hit"))


def telling_pairs(sample: DataFrame, counts: DataFrame, p: float, bits: int = BITS, risk: float = PAIR_RISK) -> set[int]:
    """Places in pairs whose common documents are toxic more often than the places' own rates explain.

    ``sample`` has rows (toxic, order, places), ``counts`` (place, df, hit).
    A pair counts if the log likelihood ratio of its common documents
    reaches ln(pairs of places / risk), so chance seldom makes one. Only
    places with enough toxic documents to get there are looked at. Each task
    takes some of them and counts, in the bounded sample, the documents that
    they share with others; pairs are never written out.
    """
    n_places = counts.count()
    if not 0 < p < 1 or n_places < 2:
        return set()
    limit = float(np.log(n_places * (n_places - 1) / 2 / risk))
    got = counts.where(F.col("hit") >= limit / -np.log(p)).orderBy("place").toPandas()
    if len(got) < 2:
        return set()
    sc, index = sample.sparkSession.sparkContext, np.zeros(1 << bits, np.int32)
    places = got["place"].to_numpy()
    index[places] = np.arange(1, len(places) + 1)
    rows = sample.mapInArrow(_chosen_rows(sc.broadcast(index)), "toxic int, order long, rows binary").collect()
    rows = [(r["toxic"], np.frombuffer(bytes(r["rows"]), np.int32) - 1) for r in sorted(rows, key=lambda r: -r["toxic"])]
    starts = np.cumsum([0, *[len(x) for _, x in rows]])
    rate = ((got["hit"] + p) / (got["df"] + 1)).to_numpy()
    shared = sc.broadcast((np.concatenate([x for _, x in rows]), starts, sum(t for t, _ in rows), rate, p, limit))
    ids = sample.sparkSession.range(0, len(places), 1, 4 * sc.defaultParallelism)
    pairs = ids.mapInArrow(lean(_pair_counter(shared)), "a long, b long")
    return {int(places[r[0]]) for r in pairs.select(F.explode(F.array("a", "b"))).distinct().collect()}


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          sample_docs: int = SAMPLE_DOCS, bits: int = BITS, min_z: float = MIN_Z, **how) -> Model:
    """Fit on at most ``sample_docs`` labelled documents.

    Terms are counted and chosen by Spark: those whose share of toxic
    documents deviates from the mean by ``min_z`` standard units, and those of
    telling pairs. The driver gets these and, of each sampled document, its own.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    picked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic")).dropna()
    picked = picked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("order", order)
    n_labels = picked.count()
    if n_labels > 2 * sample_docs:  # only ids that can be among the smallest meet in one task
        picked = picked.where(F.col("order") < int(-(1 << 63) + (1 << 64) * 1.5 * sample_docs / n_labels))
    picked = picked.orderBy("order", "doc_id").limit(sample_docs)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")
    # one text an id, so repeated ids do not widen the sample
    rows = rows.groupBy("doc_id", "toxic", "order").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = saved(rows.select("toxic", "order", "text").mapInArrow(lean(_sample_places(bits)), "toxic int, order long, places array<int>, words array<int>"), "toxic-sample")
    p = sample.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    z = F.abs(F.col("hit") - F.col("df") * p) / F.sqrt(F.col("df") * (p * (1 - p)) + 1.0)
    best = {r["place"] for r in _counted(sample).where(z >= min_z).select("place").collect()}
    words = sample.select("toxic", "order", F.col("words").alias("places"))
    best = sorted(best.union(telling_pairs(words, saved(_counted(words), "toxic-words"), p, bits)))
    index = np.zeros(1 << bits, np.int32)
    index[best] = np.arange(1, len(best) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    got = sample.mapInArrow(_chosen_rows(shared), "toxic int, order long, rows binary").collect()
    got = sorted((r["order"], bytes(r["rows"]), r["toxic"]) for r in got)
    parts = [np.frombuffer(x, np.int32) for _, x, _ in got]
    return fit(np.concatenate([np.zeros(0, np.int32), *parts]), np.array(list(map(len, parts)), np.int64),
               np.array([float(t) for *_, t in got]), index, **how)


def _scorer(model, at: int, bits: int):
    """Batches with the scores of their documents; ``at`` is the text column's place."""
    def run(batches):
        m = model.value
        for b in batches:
            parts = [m.scores(v, sizes) for _, v, sizes in term_places(b.column(at), bits)]
            yield b, np.concatenate([np.zeros(0), *parts])
    return run


def score(docs: DataFrame, model: Model, text: str = "text", bits: int = BITS, threshold: float = THRESHOLD,
          names: tuple[str, str] = ("toxic_score", "toxic_predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1) and the prediction (0 or 1); every column and row stays."""
    scored = _scorer(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text), bits)
    fields = [*docs.columns, *names]

    def run(batches):
        for b, s in scored(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], fields)

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()),
                                              T.StructField(names[1], T.IntegerType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS,
               threshold: float = THRESHOLD, **how) -> DataFrame:
    """``docs`` without the rows predicted toxic by a model fitted on ``labels``."""
    model = train(docs, labels, doc_id, text, bits=bits, **how)
    scored = _scorer(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text), bits)

    def run(batches):
        for b, s in scored(batches):
            yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
