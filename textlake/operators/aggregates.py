"""Aggregations (E1-E16). All are partial+final (map-side combine)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.params import HIST_BINS
from textlake.session import materialize


def stage_counts(df: DataFrame, **conds: Column) -> DataFrame:
    """Row count of each stage in one scan (``count_if`` per predicate)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(c).alias(f"n_{name}") for name, c in conds.items()]
    return df.agg(*aggs)


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins between min and max, the last bin closed.

    The values alone are stored once, so what computes them runs once; one
    pass over them gives min and max (a scalar subquery), one the binned
    count. Each shuffles at most a row per bin and task, whatever the number
    of distinct values. ``hi == lo`` puts every row into bin 0.
    """
    v = materialize(df.select(F.col(col).alias("v")).where(F.col("v").isNotNull()))
    span = v.select(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    v = v.withColumn("_s", span)
    lo, width = F.col("_s.lo"), F.col("_s.hi") - F.col("_s.lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - lo) * F.lit(bins) / width), F.lit(bins - 1)))
    return v.groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percent_done(df: DataFrame, group: list[str], done: Column) -> DataFrame:
    """Processed / total x 100 per group."""
    return df.groupBy(*group).agg(
        F.count_if(done).alias("done"), F.count(F.lit(1)).alias("total"),
        (F.lit(100.0) * F.count_if(done) / F.count(F.lit(1))).alias("pct"))


def high_water_marks(df: DataFrame, group: list[str], value: str, name: str = "hwm") -> DataFrame:
    """The mark is the maximum, not the last row seen."""
    return df.groupBy(*group).agg(F.max(value).alias(name))


def outcome_counts(df: DataFrame, group: list[str], ok: Column) -> DataFrame:
    """Successes and failures."""
    return df.groupBy(*group).agg(F.count_if(ok).alias("n_success"),
                                  F.count_if(~ok).alias("n_fails"))


def vector_stats(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vector count and dimension range."""
    return df.agg(F.count(F.lit(1)).alias("n_vectors"),
                  F.min(F.size(vec)).cast("long").alias("min_dim"),
                  F.max(F.size(vec)).cast("long").alias("max_dim"))


def per_second(total: Column, seconds: Column) -> Column:
    """NULL when no time elapsed."""
    return F.try_divide(total.cast("double"), seconds.cast("double"))


def ordered_join(sort_key: Column, value: Column, sep: str) -> Column:
    """Values joined in ``sort_key`` order (groups are small: k or turns)."""
    arr = F.array_sort(F.collect_list(F.struct(sort_key.alias("k"), value.alias("v"))))
    return F.array_join(F.transform(arr, lambda x: x["v"]), sep)


def observe_counts(df: DataFrame, name: str, **conds: Column):
    """E1 without an extra job: counts gathered while ``df`` is written or
    collected (``Observation``). Returns ``(observed_df, observation)``;
    ``observation.get`` holds ``n_rows`` and ``n_<cond>`` after the action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [F.count_if(c).alias(f"n_{k}") for k, c in conds.items()]
    return df.observe(obs, *aggs), obs
