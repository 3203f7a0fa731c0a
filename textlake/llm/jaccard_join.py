"""N-gram Jaccard join and its connected components.

Documents are sets of word shingles, known by 64-bit hashes. Two link when
``100 * intersection >= percent * union``.

1. One pass over the texts hashes each set to a node (equal sets are one node)
   and counts shingles in a fixed table of 2^RANK_BITS counters. The counters
   order shingles rare-first; being of fixed size they are broadcast.
2. A second pass emits each set's prefix: its ``n - ceil(percent * n / 100) + 1``
   first shingles in that order. Sets that link share a prefix shingle.
   Shingles with one set only are dropped, and so are the rows of a shingle
   that no other set of it fits by length and position.
3. Sets that share a prefix shingle are candidates, subject to the length and
   the positional filter. Instead of all pairs of a shingle's sets, a round
   compares every set with one pivot of the shingle, verifies each pair once
   and merges linked sets to components; the next round takes a pivot outside
   the shingle's largest component, for sets of other components only. A group
   of near copies is thus one star of links, not its square.
4. After the rounds, all remaining pairs of sets in different components that
   share a prefix shingle are compared, one side always outside the shingle's
   largest component. No pair that could join two components is left out.
   Between rounds components are known as far as two steps along the links.
5. Candidates must also have bitmaps that are near enough, and verification asks
   the counts of shingles by hash class (suffix filters: both bound the
   intersection from above); only then are the texts of the pairs' sets fetched
   and the intersection itself is counted from both.

Defined cases: NULL and wordless texts have an empty set, link with nothing
and are their own component; a text of fewer words than the shingle has its
whole sequence as one shingle; repeated rows are one node; a NULL id never
names a component unless all its documents lack one. Equal 64-bit hashes of
different shingles or sets would be needed for a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import distinct_per_doc, forget, lean, mix64, saved, shingle_hashes, slices, text_buffers, word_hashes
from .components import components

RANK_BITS = 24
#: Bits of the filter that keeps unneeded texts out of the shuffle of candidates' texts.
KEY_BITS = 24
ROUNDS = 2
FIRST_PASS = "doc_id long, key long, s long, n int, bits array<long>, at int, counts binary"
#: Counters of the rank table that travel in one row.
_RANK_ROW = 1 << 14
_MOST = (1 << 16) - 1
#: Longs of a set's bitmap: a bit is set where an odd number of shingles hash to it.
_BITS = 16
_CLASSES = (np.arange(1, 16, dtype=np.uint64) << np.uint64(60))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, distinct shingles of a slice of documents, their numbers)."""
    buf, off = text_buffers(texts)
    for i, j in slices(off):
        h, c = word_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i])
        s, d = shingle_hashes(h, c, size)
        v, m = distinct_per_doc(s, d, j - i)
        yield i, v, m


def set_ids(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: a sum over its members, so any order gives the same."""
    ends = np.cumsum(sizes)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values ^ np.uint64(0x5851F42D4C957F2D)))])
    out = mix64(total[ends] - total[ends - sizes] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(values) >> np.uint64(64 - bits)).astype(np.int64)


def set_bitmaps(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bitmaps of sets; two sets differ in at least as many shingles as their bitmaps differ in bits."""
    at = (mix64(values + np.uint64(1)) >> np.uint64(64 - 10)).astype(np.int64)
    times = np.zeros(len(sizes) * 64 * _BITS, np.uint8)
    np.add.at(times, np.repeat(np.arange(len(sizes)), sizes) * (64 * _BITS) + at, np.uint8(1))  # the last bit counts, so they may wrap
    words = np.packbits(times.reshape(-1, 64 * _BITS) & 1, axis=1, bitorder="little").view(np.int64)
    return pa.FixedSizeListArray.from_arrays(pa.array(words.ravel()), _BITS).cast(pa.list_(pa.int64()))


def _first_pass(size: int, bits: int):
    schema = to_arrow_schema(T.StructType.fromDDL(FIRST_PASS))

    def run(batches):
        counts = np.zeros(1 << bits, np.uint16)  # a task's counts stop at 65,535: frequent enough to come last
        for b in batches:
            at = 0
            for _, v, m in shingle_sets(b.column("text"), size):
                bucket, times = np.unique(_bucket(v, bits), return_counts=True)
                counts[bucket] = np.minimum(counts[bucket] + times, _MOST)
                n = len(m)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, n), b.column("key").slice(at, n), pa.array(set_ids(v, m)), pa.array(m.astype(np.int32)),
                     set_bitmaps(v, m), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
                at += n
        at = [k for k in range(0, len(counts), _RANK_ROW) if counts[k:k + _RANK_ROW].any()]
        if at:
            nulls = [pa.nulls(len(at), f.type) for f in schema][:-2]
            yield pa.RecordBatch.from_arrays(
                [*nulls, pa.array(at, pa.int32()), pa.array([_packed(counts[k:k + _RANK_ROW]) for k in at], pa.binary())], schema=schema)
    return run


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _counted(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint16)


def _sum_counts(batches):
    """Rank rows of a task's groups of counters; the counts of all tasks stream through."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for at, blob in zip(b.column("at").to_pylist(), b.column("counts").to_pylist()):
            sums[at] = sums.get(at, 0.0) + _counted(blob)
    ranks = [_packed(np.minimum(255, 10 * np.log2(1.0 + x)).astype(np.uint8)) for x in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], ["at", "ranks"])


def shingle_ranks(parts: DataFrame, bits: int) -> np.ndarray:
    """Rank of each counter, rare first, from the partial counter rows (at, counts): ten ranks for each doubling.

    Groups of counters are summed apart; the driver gets one byte a counter,
    whatever the input.
    """
    rows = parts.repartition(64, "at").mapInArrow(lean(_sum_counts), "at int, ranks binary")
    ranks = np.zeros(1 << bits, np.uint8)
    for r in rows.collect():
        x = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["ranks"]), np.uint8)
        ranks[r["at"]:r["at"] + len(x)] = x
    return ranks


def _prefixes(size: int, bits: int, percent: int, ranks):
    def run(batches):
        rank = ranks.value
        for b in batches:
            out = [[], [], [], []]
            for _, v, m in shingle_sets(b.column("text"), size):
                ids, ends, place = set_ids(v, m), np.cumsum(m), rank[_bucket(v, bits)]
                for k in np.flatnonzero(m):
                    n, e = int(m[k]), int(ends[k])
                    first = n - -(-percent * n // 100) + 1
                    own = v[e - n:e]
                    order = np.lexsort((own, place[e - n:e]))[:first]
                    out[0].append(own[order].view(np.int64))
                    out[1].append(np.full(first, ids[k]))
                    out[2].append(np.full(first, n, np.int32))
                    out[3].append(np.arange(first, dtype=np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["h", "s", "n", "pos"])
    return run


def _verify(size: int, percent: int):
    """Pairs (x, nx, tx, y, ny, ty) to links (x, y): suffix filter, then the exact intersection."""
    def sets(ids: pa.Array, texts: pa.Array) -> dict[int, np.ndarray]:
        ids = ids.to_numpy(zero_copy_only=False)
        _, first = np.unique(ids, return_index=True)
        out = {}
        for i, v, m in shingle_sets(texts.take(pa.array(first)), size):
            e = np.cumsum(m)
            for k, (sid, n) in enumerate(zip(set_ids(v, m), m)):
                out[int(ids[first[i + k]])] = (v[e[k] - n:e[k]], int(sid))
        return out

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                xs, ys, good = sets(b.column("x"), b.column("tx")), sets(b.column("y"), b.column("ty")), []
                for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                    (a, sa), (c, sc) = xs[x], ys[y]
                    total = len(a) + len(c)
                    if sa != x or sc != y:
                        continue
                    ka = np.diff(np.searchsorted(a, _CLASSES), prepend=0, append=len(a))
                    kc = np.diff(np.searchsorted(c, _CLASSES), prepend=0, append=len(c))
                    if (100 + percent) * int(np.minimum(ka, kc).sum()) < percent * total:
                        continue
                    both = len(np.intersect1d(a, c, assume_unique=True))
                    if (100 + percent) * both >= percent * total:
                        good.append((x, y))
                if good:
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())],
                                                     ["u", "v"])
    return run


def _with_keys(df: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """``df`` without most rows whose key ``name`` is not in ``keys``: a bitmap of fixed size, 2^KEY_BITS bits."""
    slot = F.pmod(F.col(name), F.lit(1 << KEY_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = keys.groupBy(F.floor(slot / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (KEY_BITS - 6), np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches):
        for b in batches:
            at = b.column(name).to_numpy() & ((1 << KEY_BITS) - 1)
            yield b.filter(pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
    return df.mapInArrow(lean(run), df.schema)


def with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """Prefix rows (h, s, n, pos), once each, without most of those that no other set of the shingle fits.

    By length and position, x and y fit where ``most`` of each is at least ``percent`` times the
    other's size. In order of size, x has nothing to fit if all smaller sets fall short of its size and
    its own ``most`` falls short of the next larger one; two sets that fit each other thus both stay.
    """
    of = Window.partitionBy("h").orderBy("n", "s")
    # the shingles of one set only are most of all
    rows = rows.withColumn("last", F.lag("s").over(of)).withColumn("next", F.lead("s").over(of))
    rows = rows.where("(last IS NULL OR last != s) AND coalesce(last, next) IS NOT NULL").drop("last", "next")
    n = F.col("n").cast("long")
    most, asked = (100 + percent) * (n - F.col("pos")) - percent * n, percent * n
    for _ in range(2):  # what fitted a dropped row only goes too
        rows = rows.withColumn("smaller", F.max(most).over(of.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.withColumn("larger", F.lead(asked).over(of))
        rows = rows.where((F.col("smaller") >= asked) | (F.col("larger") <= most)).drop("smaller", "larger")
    return rows


class _Join:
    """State of one join: the stored sets, prefixes of shared shingles, texts of candidates."""

    def __init__(self, docs: DataFrame, size: int, percent: int, bits: int):
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        self.docs = docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
        both = saved(docs.select("doc_id", "key", "text").mapInArrow(
            lean(_first_pass(size, bits)), FIRST_PASS), "shingle-sets")
        self.sets = both.where("at IS NULL").select("doc_id", "key", "s", "n", "bits")
        ranks = self.spark.sparkContext.broadcast(shingle_ranks(both.where("at IS NOT NULL").select("at", "counts"), bits))
        rows = docs.select("text").mapInArrow(lean(_prefixes(size, bits, percent, ranks)), "h long, s long, n int, pos int")
        all_rows = rows = saved(rows, "prefixes")
        # a row for each shingle and set, if a link of it may start there. The rows are exchanged once
        self.rows = saved(with_partners(rows, percent), "shared-prefixes")
        forget(all_rows)
        nodes = self.rows.select("s").distinct()
        one = self.sets.join(nodes, "s", "left_semi").groupBy("s").agg(F.min(F.struct("key", "n", "bits")).alias("one"))
        self.nodes = saved(one.select("s", "one.*"), "candidate-sets")

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b, x, y), a < b, of rows (x, nx, px, y, ny, py): length and positional filters.

        x is one of a and b, and y the other: y the pivot where only one is.
        """
        p = self.percent
        # at the first shingle that two linking sets share, both have enough left; later ones may fail this
        most = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
        pairs = pairs.where((100 * F.least("nx", "ny") >= p * F.greatest("nx", "ny"))
                            & ((100 + p) * most >= p * (F.col("nx") + F.col("ny"))))
        pairs = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
            F.max(F.col("x") > F.col("y")).alias("flip"))
        return pairs.select("a", "b", F.when(F.col("flip"), F.col("b")).otherwise(F.col("a")).alias("x"),
                            F.when(F.col("flip"), F.col("a")).otherwise(F.col("b")).alias("y"))

    def side(self, name: str) -> DataFrame:
        """The candidate sets as one side of pairs: its id, size and bitmap."""
        return self.nodes.select(F.col("s").alias(name), F.col("n").alias("n" + name), F.col("bits").alias("b" + name))

    def enough_bits(self):
        """Suffix filter on the bitmaps: the shingles that x and y can share at most are enough to link."""
        apart = sum((F.bit_count(F.col("bx")[i].bitwiseXOR(F.col("by")[i])) for i in range(_BITS)), F.lit(0))
        return (100 + self.percent) * (F.col("nx") + F.col("ny") - apart) >= 2 * self.percent * (F.col("nx") + F.col("ny"))

    def texts(self, pairs: DataFrame) -> DataFrame:
        """(s, text) of the sets in pairs (x, y), from one row of each."""
        asked = pairs.select(F.explode(F.array("x", "y")).alias("s")).distinct()
        keys = saved(self.nodes.select("s", "key").join(asked, "s", "left_semi"), "candidate-keys")
        texts = _with_keys(self.docs.select("key", "text"), "key", keys)
        # one key a set; grouping by it keeps the join's partitioning, so texts are exchanged once
        texts = texts.join(keys, "key").groupBy("key").agg(F.first("s").alias("s"), F.first("text").alias("text")).drop("key")
        return saved(texts, "candidate-texts")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) that link, as (u, v). The texts of x travel; y may be a busy pivot."""
        if pairs.isEmpty():
            return self.spark.createDataFrame([], "u long, v long")
        texts = self.texts(pairs)
        pairs = pairs.join(texts.select(F.col("s").alias("x"), F.col("text").alias("tx")), "x")
        pairs = pairs.join(texts.select(F.col("s").alias("y"), F.col("text").alias("ty")), "y")
        out = saved(pairs.select("x", "tx", "y", "ty").mapInArrow(lean(_verify(self.size, self.percent)), "u long, v long"), "verified")
        forget(texts)
        return out

    def open_rows(self, links: DataFrame) -> DataFrame:
        """The prefix rows of shingles that still have two components, with ``comp`` and the largest, ``main``.

        Components are those that two steps along the links show; sets that
        more steps would join merely stay candidates.
        """
        near = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        one = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        # the smallest that a neighbour sees: all sets around one pivot agree
        step = near.join(one, "v").groupBy("u").agg(F.min("m").alias("root"))
        step = saved(step.select("u", F.least("u", "root").alias("root")), "labels")
        rows = self.rows.join(step, self.rows.s == step.u, "left").withColumn("comp", F.coalesce("root", "s"))
        rows = rows.select("h", "s", "n", "pos", "comp")
        by = rows.groupBy("h", "comp").agg(F.count("*").alias("c"))
        main = by.groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("parts"))
        return saved(rows.join(main.where("parts > 1").select("h", "main"), "h"), "open-prefixes")

    def solve(self, rounds: int) -> DataFrame:
        """(node, root) of all linked nodes."""
        links = done = None
        for turn in range(rounds + 1):
            if turn:
                rows = self.open_rows(links)
                if rows.isEmpty():
                    break
            else:
                rows = self.rows.withColumn("comp", F.col("s")).withColumn("main", F.lit(None).cast("long"))
            side = rows.select("h", F.col("s").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("comp").alias("cx"), "main")
            other = rows.select("h", F.col("s").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("comp").alias("cy"), "main")
            if turn < rounds:
                if turn:  # outside the largest component, so that the pivot is new to the group
                    other = other.where("cy != main")
                order = F.struct("py", F.xxhash64("y", F.lit(turn)))  # few rarer shingles: the middle of a group
                pivots = other.groupBy("h").agg(F.min_by(F.struct("y", "ny", "py", "cy"), order).alias("p")).select("h", "p.*")
                pairs = side.join(pivots, "h").where("cx != cy")
            else:
                side = side.where("main IS NULL OR cx != main").join(self.side("x").drop("nx"), "x")
                other = other.drop("main").join(self.side("y").drop("ny"), "y")
                pairs = side.join(other, "h").where("cx != cy AND (cy <=> main OR x < y)").where(self.enough_bits())
            pairs = self.candidates(pairs)
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            if turn < rounds:  # few of the sets that share a shingle can link: no texts for the others
                pairs = pairs.join(self.side("x"), "x").join(self.side("y"), "y").where(self.enough_bits()).select("a", "b", "x", "y")
            pairs = saved(pairs, "pairs")
            new = self.links(pairs.select("x", "y"))
            done = pairs.select("a", "b") if done is None else done.unionByName(pairs.select("a", "b"))
            links = new if links is None else links.unionByName(new)
        return components(links)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90,
                       rank_bits: int = RANK_BITS, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, key, n_shingles, component_id, keeper), one per input row.

    ``key`` is ``xxhash64(doc_id, text)``; keeper marks the row, or the equal
    rows, of the smallest (doc_id, key) of a component.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    join = _Join(docs, size, percent, rank_bits)
    sets = join.sets
    roots = join.solve(rounds)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    nodes = sets.where("n > 0").groupBy("s").agg(best)
    nodes = nodes.join(roots, nodes.s == roots.node, "left").select("s", F.coalesce("root", "s").alias("root"), "best")
    groups = nodes.groupBy("root").agg(F.min("best").alias("first"))
    nodes = nodes.join(groups, "root").select(F.col("s").alias("node"), "first")
    linked = sets.where("n > 0").join(nodes, F.col("s") == F.col("node")).select(
        "doc_id", "key", F.col("n").cast("long").alias("n_shingles"), F.col("first.doc_id").alias("component_id"),
        (F.col("key") == F.col("first.key")).alias("keeper"))
    alone = sets.where("n = 0").select("doc_id", "key", F.lit(0).cast("long").alias("n_shingles"),
                                       F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper"))
    return linked.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest (doc_id, key); wordless rows all stay."""
    found = jaccard_components(docs, doc_id, text, **how)
    kept = found.where("keeper AND n_shingles > 0").select(F.col("key").alias("__key")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64(F.col(doc_id).cast("long"), F.col(text)))
    empty = found.where("n_shingles = 0").select(F.col("key").alias("__key")).distinct()
    one = keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"])
    return one.unionByName(keyed.join(empty, "__key", "left_semi")).drop("__key")
