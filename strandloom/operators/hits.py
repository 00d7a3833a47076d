"""What is made of hits: collapsing, places, summaries, coverage and the tables to show."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .intervals import islands, merge_intervals


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Go through sorted hits and keep disjoint ones; of two that clash the one of the greater value, of equal ones the earlier.

    Only the last kept hit can clash with the next, so it is all that is held. ``_first`` begins a run of its own.
    """
    held, end, value = None, 0, 0.0
    for batch in batches:
        first, start, stop, worth = (batch.column(c).to_pylist() for c in ("_first", "_s", "_e", "_value"))
        kept, at = [], None  # rows of this batch that stay; the last one may still be replaced
        for i in range(batch.num_rows):
            if not first[i] and start[i] < end:
                if worth[i] <= value:
                    continue
            elif at is not None:
                kept.append(at)
            elif held is not None:
                yield held
            at, held, end, value = i, None, stop[i], worth[i]
        if kept:
            yield batch.take(pa.array(kept, pa.int32()))
        if at is not None:
            held = batch.slice(at, 1)
    if held is not None:
        yield held


def _folded(d: DataFrame, keys: list[str], value: Column, more: list[Column]) -> DataFrame:
    """Distinct hits (keys, _s, _e, more) folded: islands of overlapping hits are spread over tasks, each goes by in order as a stream."""
    d = islands(d.distinct(), keys, "_s", "_e").where(F.col("island").isNotNull())
    order = W.partitionBy(*keys, "island").orderBy("_s", (F.col("_s") - F.col("_e")).asc(), *more)
    d = d.withColumn("_value", value).withColumn("_first", F.row_number().over(order) == 1)
    return d.mapInArrow(_fold, d.schema)


def collapse(hits: DataFrame, by: list[str], key: str = "longest") -> DataFrame:
    """Of overlapping hits of one motif and strand keep one: the longest, or with ``key`` best the one of the highest score (null and NaN are 0).

    ``by`` names the entity (a record or sequence); hits of different entities never meet.  Kept hits stay disjoint and
    sorted, so only the last kept one can clash.  Gives (by, motif, strand, start, end, score), a NaN score as null; rows with null in
    by, motif, strand, start or end are left out.
    """
    keys = [*by, "motif", "strand"]
    score = F.col("score").cast("double")
    d = hits.select(*keys, F.col("start").cast("long").alias("_s"), F.col("end").cast("long").alias("_e"), F.when(~F.isnan(score), score).alias("score"))
    if key == "longest":
        d = d.groupBy(*keys, "_s", "_e").agg(F.max("score").alias("score"))
    value = (F.col("_e") - F.col("_s")).cast("double") if key == "longest" else F.coalesce("score", F.lit(0.0))
    kept = _folded(d, keys, value, [F.col("score").asc_nulls_last()])
    return kept.select(*keys, F.col("_s").alias("start"), F.col("_e").alias("end"), "score")


def non_overlapping(hits: DataFrame, by: list[str]) -> DataFrame:
    """The hits a search finds that goes on behind each hit, per motif and strand in the strand's own direction.

    Gives (by, motif, strand, start, end).
    """
    keys = [*by, "motif", "strand"]
    forward = F.col("strand") != "-"
    # Reverse hits are read from the end: negated and swapped.
    d = hits.select(*keys, F.when(forward, F.col("start")).otherwise(-F.col("end")).cast("long").alias("_s"), F.when(forward, F.col("end")).otherwise(-F.col("start")).cast("long").alias("_e"))
    kept = _folded(d, keys, F.lit(0.0), [])
    return kept.select(*keys, F.when(forward, F.col("_s")).otherwise(-F.col("_e")).alias("start"), F.when(forward, F.col("_e")).otherwise(-F.col("_s")).alias("end"))


def count_places(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, hits, places): overlapping hits of one strand are one place; hits that only touch are two."""
    used = hits.where(F.col("strand").isin("+", "-") & (F.col("start") < F.col("end")))
    places = merge_intervals(used, [*by, "strand"], "start", "end").groupBy(*by).agg(F.count(F.lit(1)).alias("places"))
    return used.dropna(subset=by).groupBy(*by).agg(F.count(F.lit(1)).alias("hits")).join(places, by)


def summary(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, forward, reverse): counts of hits by strand."""
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("strand") == "+").alias("forward"), F.count_if(F.col("strand") == "-").alias("reverse"))


def coverage(hits: DataFrame, by: list[str], width: int = 60) -> DataFrame:
    """(by, block, hits, covered): hits and covered positions of each block of ``width`` positions that has any."""
    used = hits.where(F.col("start") < F.col("end")).dropna(subset=by)
    blocks = lambda d, a, b: d.withColumn("block", F.explode(F.sequence(F.expr(f"{a} div {width}"), F.expr(f"({b} - 1) div {width}"))))
    n = blocks(used.withColumn("_s", F.col("start")).withColumn("_e", F.col("end")), "_s", "_e").groupBy(*by, "block").agg(F.count(F.lit(1)).alias("hits"))
    periods = blocks(merge_intervals(used, by, "start", "end", touching=True), "from_pos", "to_pos")
    inside = F.least("to_pos", (F.col("block") + 1) * width) - F.greatest("from_pos", F.col("block") * width)
    return n.join(periods.groupBy(*by, "block").agg(F.sum(inside).alias("covered")), [*by, "block"])


def elided(text: Column, most: int = 60) -> Column:
    """A long text with its middle left out."""
    head = (most - 1) // 2 + (most - 1) % 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit("…"), F.right(text, F.lit(most - 1 - head)))).otherwise(text)


def band_join(first: DataFrame, second: DataFrame, by: list[str], least: int, most: int) -> DataFrame:
    """(by, start, end, gap): hits with one of the other kind ``least`` to ``most`` positions behind their end, and the widest such gap.

    An equi-join on bins as wide as the band: each end meets the two bins its band can reach into.  Rows with nulls in
    the columns used are left out, repeated rows count once.
    """
    width = max(most - least + 1, 1)
    cell = lambda c: ((c - F.pmod(c, F.lit(width))) / width).cast("long")
    a = first.select(*by, "start", "end").dropna().distinct()
    b = second.select(*by, F.col("start").alias("_s")).dropna().distinct().withColumn("_c", cell(F.col("_s")))
    low = cell(F.col("end") + least)
    a = a.withColumn("_c", F.explode(F.array(low, low + 1)))
    near = a.join(b, [*by, "_c"]).where((F.col("_s") - F.col("end")).between(least, most))
    return near.groupBy(*by, "start", "end").agg(F.max(F.col("_s") - F.col("end")).alias("gap"))


def clusters(hits: DataFrame, by: list[str], width: int = 60) -> DataFrame:
    """(by, strand, block, start, end, motif, more): overlapping hits of one strand within each block of ``width`` positions, as one.

    A cluster is named by its widest hit (of equally wide ones the first, then the first name); ``more`` counts the others.
    Hits are cut at the block's borders before they are compared.
    """
    used = hits.where(F.col("strand").isin("+", "-") & (F.col("start") < F.col("end")) & F.col("motif").isNotNull()).dropna(subset=by)
    d = used.select(*by, "strand", "motif", F.col("start").alias("_a"), F.col("end").alias("_z"), F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))).alias("block"))
    d = d.withColumn("_s", F.greatest("_a", F.col("block") * width)).withColumn("_e", F.least("_z", (F.col("block") + 1) * width))
    keys = [*by, "strand", "block"]
    d = islands(d, keys, "_s", "_e")
    widest = F.min(F.struct((F.col("_a") - F.col("_z")).alias("w"), F.col("_a").alias("a"), F.col("motif").alias("m")))
    found = d.groupBy(*keys, "island").agg(F.max("_e").alias("end"), widest.alias("_x"), (F.count(F.lit(1)) - 1).alias("more"))
    return found.select(*keys, F.col("island").alias("start"), "end", F.col("_x.m").alias("motif"), "more")


def overlapping_any(hits: DataFrame, others: DataFrame, by: list[str], width: int = 256) -> DataFrame:
    """The distinct rows of ``hits`` that share a position with any of ``others`` of the same entity.

    The others are merged into disjoint periods first, so no pairs are formed: a bin of ``width`` positions never holds
    more than ``width`` periods.  Columns of ``hits`` must be of types that can be grouped by.
    """
    bins = lambda a, z: F.explode(F.sequence(F.expr(f"{a} div {width}"), F.expr(f"({z} - 1) div {width}")))
    periods = merge_intervals(others, by, "start", "end").withColumn("_c", bins("from_pos", "to_pos"))
    cut = hits.where(F.col("start") < F.col("end")).distinct().withColumn("_c", bins("start", "end"))
    meet = (F.col("start") < F.col("to_pos")) & (F.col("from_pos") < F.col("end"))
    return cut.join(periods, [*by, "_c"]).where(meet).select(*hits.columns).distinct()
