"""Problem 5: the N best rows of every group, hot groups split from light ones.

Exact group counts decide.  Light groups go through an ordinary window.  Of a hot group,
ranges of the score are counted and only those are kept that can hold the first N rows;
what is left is salted, ranked within group and salt, and ranked again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import written
from .duplicates import MOST, hot_bound

RANGES, SALTS = 256, 64


def _ranked(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n)


def top_n(df: DataFrame, keys: list[str], score: str, ties: list[str], n: int, hot: int | None = None, ranges: int = RANGES, salts: int = SALTS) -> DataFrame:
    """(keys, score, ties, rank) of the first n rows of each group.

    Order: score descending, null and NaN after all numbers and equal to each other, then
    ``ties`` ascending with null last; the last of ``ties`` should be unique.  Rows with a
    null key are left out; every row counts by itself, repeated ones too.  A NaN score comes out as null.  Columns other than
    those named are dropped; an empty table gives no rows.  Groups of more than ``hot`` rows, by default a quarter of an average task, are split.
    """
    k, t = [f"_k{i}" for i in range(len(keys))], [f"_t{i}" for i in range(len(ties))]
    number = F.col(score).cast("double")
    rows = df.select(
        *[F.col(c).alias(a) for a, c in zip(k, keys)],
        F.when(number.isNull() | F.isnan(number), None).otherwise(number + F.lit(0.0)).alias("_v"),
        *[F.col(c).alias(a) for a, c in zip(t, ties)],
    ).dropna(subset=k)
    order = [F.col("_v").desc_nulls_last(), *[F.col(a).asc_nulls_last() for a in t]]
    groups = written(rows.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "groups")
    if hot is None:
        hot = hot_bound(groups.agg(F.sum("_n")).first()[0] or 0, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = groups.where(F.col("_n") > hot)
    n_heavy = heavy.count()
    if not n_heavy:
        best = _ranked(rows, k, order, n)
    else:
        # At most rows / hot groups are heavy; beyond the bound the join is a plain one.
        heavy = F.broadcast(heavy) if n_heavy <= MOST else heavy
        light = _ranked(rows.join(heavy.select(*k), k, "left_anti"), k, order, n)
        # Range 0 holds the highest scores; null and NaN come after all.  Infinite bounds put every number into one range.
        finite = (F.abs("_hi") < float("inf")) & (F.abs("_lo") < float("inf"))
        share = F.try_divide(F.col("_hi") - F.col("_v"), F.col("_hi") - F.col("_lo"))
        number = F.when(share.isNull(), 0).otherwise(F.least((share * ranges).cast("int"), F.lit(ranges - 1)))
        bucket = F.when(F.col("_v").isNull(), F.lit(ranges)).when(finite, number).otherwise(0)
        in_range = rows.join(heavy, k).withColumn("_range", bucket)
        filled = in_range.groupBy(*k, "_range").agg(F.count(F.lit(1)).alias("_m"))
        above = F.coalesce(F.sum("_m").over(W.partitionBy(*k).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        needed = filled.withColumn("_above", above).where(F.col("_above") < n).select(*k, "_range")
        needed = F.broadcast(needed) if n_heavy * n <= MOST else needed
        left = in_range.join(needed, [*k, "_range"]).withColumn("_salt", F.pmod(F.xxhash64(*t), F.lit(salts)))
        first = _ranked(left, [*k, "_salt"], order, n)
        best = light.unionByName(_ranked(first.select(*light.columns[:-1]), k, order, n))
    out = [*[F.col(a).alias(c) for a, c in zip(k, keys)], F.col("_v").alias(score), *[F.col(a).alias(c) for a, c in zip(t, ties)]]
    return best.select(*out, F.col("_rank").alias("rank"))


def best_matches(matches: DataFrame, n: int = 3, **options: int) -> DataFrame:
    """The n best hits of each sequence and motif."""
    return top_n(matches, ["sequence", "motif"], "score", ["start", "match_id"], n, **options)
