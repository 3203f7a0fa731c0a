"""URL filter: blocked Bloom filter in front of an exact hash join. DataFrame functions only.

Every listed rule is a canonical URL key: host followed by path. A URL has one
candidate key for each suffix of its host (whole labels) and each distinct
path length in the list that its path reaches. The filter is a table of blocks
of four 64-bit words: a key's hash chooses one block, further hash bits set one
bit in each word, and a key passes when its block has all its bits. Only
passing keys reach the exact join, which removes false positives.

Defined cases: a NULL URL or one without ``://`` has empty host and path and
takes the default verdict; an empty path starts with no rule path but the
empty one; the longest key (code points) wins, then the longer host, then the
smaller text; rules that repeat a key count once and ``block`` wins between
them; an empty list gives every URL the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

BITS_PER_KEY = 32
WORDS = 4
#: Filters and rule tables up to this size are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _bits(h: Column) -> list[Column]:
    """The bit of each word of a block that a key's hash sets."""
    g = F.xxhash64(h)
    places = [F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """Blocked Bloom filter of a ``key`` column: rows (block, w0..w3), set blocks only."""
    h = F.xxhash64("key")
    rows = keys.select(F.pmod(h, F.lit(n_blocks)).alias("block"),
                       *[b.alias(f"w{i}") for i, b in enumerate(_bits(h))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def _sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def filter_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Judge every row of ``urls``; ``rules`` has columns host, path, action (allow or block).

    Returns the ``keep`` columns with url, host, path, rule, verdict and
    ``possible`` (a candidate key passed the Bloom filter), one row per input row.
    """
    rules = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("r_host"),
                         F.coalesce("path", F.lit("")).alias("r_path"), F.lower("action").alias("r_action"))
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_action").alias("r_action")).withColumn(
        "key", F.concat("r_host", "r_path"))
    # few numbers, whatever the list's size: its rows, longest key and distinct path lengths
    n, widest, lengths = rules.agg(F.count("*"), F.coalesce(F.max(F.octet_length("key")), F.lit(0)),
                                   F.collect_set(F.length("r_path"))).first()
    n_blocks = max(1, -(-n * BITS_PER_KEY // (64 * WORDS)))
    blocks = _sized(bloom_blocks(rules, n_blocks), n_blocks, 8 * (WORDS + 2))
    rules = _sized(rules, n, 2 * widest + 64)

    rows = urls.select(*keep, F.col(url).alias("url"), host_of(F.col(url)).alias("host"),
                       path_of(F.col(url)).alias("path"))
    # decisions are made once per distinct target, so repeated rows and busy hosts cost nothing more
    targets = rows.where("host != ''").groupBy("host", "path").agg(F.count("*").alias("n_rows"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    lens = F.array(*[F.lit(x) for x in sorted(lengths)]) if lengths else F.array().cast("array<int>")
    targets = targets.select("host", "path", F.explode(suffixes).alias("c_host"))
    targets = targets.select("*", F.explode(F.filter(lens, lambda x: x <= F.length("path"))).alias("c_len"))
    targets = targets.withColumn("c_path", F.expr("substring(path, 1, c_len)"))
    targets = targets.withColumn("key", F.concat("c_host", "c_path")).withColumn("h", F.xxhash64("key"))
    passed = targets.join(blocks, F.pmod(targets.h, F.lit(n_blocks)) == blocks.block)
    for i, b in enumerate(_bits(F.col("h"))):
        passed = passed.where(F.col(f"w{i}").bitwiseAND(b) == b)
    exact = passed.join(rules, (F.col("c_host") == F.col("r_host")) & (F.col("c_path") == F.col("r_path")), "left")
    found = exact.groupBy("host", "path").agg(F.max_by(
        F.struct(F.col("r_host"), F.concat("r_host", "r_path").alias("rule"), F.col("r_action")),
        F.struct(F.col("r_host").isNotNull(), F.length(F.concat("c_host", "c_path")), F.length("c_host"))).alias("best"))
    found = found.select(F.col("host").alias("t_host"), F.col("path").alias("t_path"),
                         F.xxhash64("host", "path").alias("t_key"), F.col("best.rule").alias("rule"),
                         F.col("best.r_action").alias("action"))
    # the extra hash key makes both sides exchange, so that a hot target can be split by the skew join
    rows = rows.withColumn("u_key", F.xxhash64("host", "path"))
    out = rows.join(found, (rows.u_key == found.t_key) & (rows.host == found.t_host) & (rows.path == found.t_path), "left")
    return out.select(*keep, "url", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"),
                      F.col("t_key").isNotNull().alias("possible"))
