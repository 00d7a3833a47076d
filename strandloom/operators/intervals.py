"""Merging of overlapping intervals into periods, and the gaps between periods.

Spark's ``session_window`` does the merging: a position becomes a timestamp and an
interval a session whose gap duration is its own length.  Positions are cut into
blocks, so that one entity with most of the rows is merged in many tasks; what
crosses a block's border (two sessions a block at most) is merged in a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import written

#: Positions in a block. Rows with the same start are pre-aggregated, so a block never holds more rows than this.
BLOCK = 1 << 17


def _block(pos: Column, block: int) -> Column:
    """Floor division, also of negative positions."""
    return ((pos - F.pmod(pos, F.lit(block))) / block).cast("long")


def _sessions(df: DataFrame, keys: list[str], touching: bool) -> DataFrame:
    """Merge the rows (keys, _s, _e) by session windows on doubled positions.

    A session [2s, 2e-1) ends before one that starts at 2e, so that intervals which only
    touch stay apart; with ``touching`` it ends at 2e and Spark merges both.
    """
    length = 2 * (F.col("_e") - F.col("_s")) - (0 if touching else 1)
    gap = F.make_interval(secs=(length / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)"))
    window = F.session_window(F.timestamp_micros(2 * F.col("_s")), gap)
    return df.groupBy(*keys, window.alias("_w")).agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).drop("_w")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, touching: bool = False, block: int = BLOCK) -> DataFrame:
    """Continuous periods (keys, from_pos, to_pos) of half-open intervals.

    Intervals that share a position belong to one period; those that only touch do so if
    ``touching`` is set.  Rows with a null key, start or end, or whose start is not before
    the end, are ignored; repeated rows change nothing; an empty table gives no rows.
    Further columns of ``df``, whatever their names, are dropped.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(c).alias(a) for a, c in zip(k, keys)], F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    rows = rows.where(F.col("_s") < F.col("_e")).dropna(subset=k)
    once = rows.withColumn("_b", _block(F.col("_s"), block)).groupBy(*k, "_b", "_s").agg(F.max("_e").alias("_e"))
    # Read several times below.
    inside = written(_sessions(once, [*k, "_b"], touching), "sessions")
    # How far the periods of all earlier blocks reach: one row a block.
    before = W.partitionBy(*k).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    reach = inside.groupBy(*k, "_b").agg(F.max("_e").alias("_m")).withColumn("_reach", F.max("_m").over(before)).drop("_m")
    seen = inside.join(reach, [*k, "_b"]).where(F.col("_reach").isNull() | (F.col("_e") > F.col("_reach")))
    border = (F.col("_b") + 1) * block
    if touching:
        crossing = F.coalesce(F.col("_s") <= F.col("_reach"), F.lit(False)) | (F.col("_e") >= border)
    else:
        crossing = F.coalesce(F.col("_s") < F.col("_reach"), F.lit(False)) | (F.col("_e") > border)
    across = _sessions(seen.where(crossing).select(*k, "_s", "_e"), k, touching)
    periods = seen.where(~crossing).select(*k, "_s", "_e").unionByName(across)
    return periods.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], F.col("_s").alias("from_pos"), F.col("_e").alias("to_pos"))


def gaps_between(periods: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Stretches (keys, from_pos, to_pos) of at least one position between consecutive disjoint periods.

    ``lead`` runs within blocks of positions; the last period of a block takes the first start of the next block that has any.
    """
    p = periods.withColumn("_b", _block(F.col("from_pos"), block))
    firsts = p.groupBy(*keys, "_b").agg(F.min("from_pos").alias("_f"))
    firsts = firsts.select(*keys, "_b", F.lead("_f").over(W.partitionBy(*keys).orderBy("_b")).alias("_later"))
    p = p.withColumn("_next", F.lead("from_pos").over(W.partitionBy(*keys, "_b").orderBy("from_pos")))
    p = p.join(firsts, [*keys, "_b"]).withColumn("_next", F.coalesce("_next", "_later"))
    return p.where(F.col("_next") > F.col("to_pos")).select(*keys, F.col("to_pos").alias("from_pos"), F.col("_next").alias("to_pos"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, block: int = BLOCK) -> DataFrame:
    """Periods and gaps in one table (what, keys, from_pos, to_pos); see :func:`merge_intervals`."""
    periods = written(merge_intervals(df, keys, start, end, block=block), "periods")
    gaps = gaps_between(periods, keys, block)
    return periods.select(F.lit("period").alias("what"), "*").unionByName(gaps.select(F.lit("gap").alias("what"), "*"))


def match_periods(matches: DataFrame, block: int = BLOCK) -> DataFrame:
    """Problem 2: covered periods and gaps (what, sequence, strand, from_pos, to_pos) of motif matches.

    Rows count whose sequence, start and end are not null, whose strand is + or - and whose start is before the end.
    """
    used = matches.where(F.col("strand").isin("+", "-")).select("sequence", "strand", "start", "end")
    return periods_and_gaps(used, ["sequence", "strand"], "start", "end", block)


def islands(df: DataFrame, keys: list[str], start: str, end: str, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` with ``island``, the start of the run of overlapping intervals that a row lies in.

    Touching intervals begin a new island; rows with a null key, start or end have a null island.  Running maxima are
    taken within blocks of positions and carried from block to block, so that a hot key is spread over tasks.
    """
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    valid = s.isNotNull() & e.isNotNull()
    for c in keys:
        valid = valid & F.col(c).isNotNull()
    d = df.where(valid).withColumn("_b", _block(s, block))
    by = [*keys, "_b"]
    local = W.partitionBy(*by).orderBy(F.col(start), F.col(end)).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_before", F.max(e).over(local))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    reach = d.groupBy(*by).agg(F.max(e).alias("_m")).withColumn("_reach", F.max("_m").over(earlier)).drop("_m")
    d = d.join(reach, by).withColumn("_before", F.greatest("_before", "_reach"))
    d = d.withColumn("_new", F.when(F.col("_before").isNull() | (s >= F.col("_before")), s))
    # Of rows with one start only the first begins an island; all of them lie in it.
    last = d.groupBy(*by).agg(F.max("_new").alias("_m")).withColumn("_carried", F.max("_m").over(earlier)).drop("_m")
    upto = W.partitionBy(*by).orderBy(s).rangeBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("_own", F.max("_new").over(upto)).join(last, by).withColumn("island", F.coalesce("_own", "_carried"))
    d = d.drop("_b", "_before", "_reach", "_new", "_own", "_carried")
    return d.unionByName(df.where(~valid | valid.isNull()).withColumn("island", F.lit(None).cast("long")))
