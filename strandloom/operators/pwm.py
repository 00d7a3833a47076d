"""Weight matrices trained from aligned sites, many motifs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import hinted, written


def aligned_sites(matches: DataFrame) -> DataFrame:
    """(motif, site): matched texts of each motif's most frequent width (the narrowest of equally frequent ones), upper case, U as T."""
    m = matches.where(F.col("motif").isNotNull() & (F.col("match") != "")).select("motif", F.translate(F.upper("match"), "U", "T").alias("site"))
    m = m.withColumn("_w", F.length("site"))
    widths = m.groupBy("motif", "_w").agg(F.count(F.lit(1)).alias("_n"))
    usual = widths.groupBy("motif").agg(F.max_by("_w", F.struct("_n", -F.col("_w"))).alias("_w"))
    return m.join(hinted(written(usual, "widths")), ["motif", "_w"]).select("motif", "site")


def train(sites: DataFrame, pseudocount: float = 0.5) -> DataFrame:
    """(motif, pos, letter, count, weight): log-odds in bits of A, C, G and T at each position, against an even background.

    Letters that aren't bases do not count.  All sites of a motif must have one width (see :func:`aligned_sites`).
    """
    letters = sites.select("motif", F.posexplode(F.split("site", "")).alias("pos", "letter")).where(F.col("letter") != "")
    counts = letters.groupBy("motif", "pos").pivot("letter", ["A", "C", "G", "T"]).agg(F.count(F.lit(1)))
    grid = counts.select("motif", "pos", F.explode(F.array(*[F.struct(F.lit(x).alias("letter"), F.coalesce(x, F.lit(0)).alias("count")) for x in "ACGT"])).alias("_x"), sum((F.coalesce(x, F.lit(0)) for x in "ACGT"), F.lit(0)).alias("_total"))
    weight = F.log2((F.col("_x.count") + pseudocount) / (F.col("_total") + 4 * pseudocount) / 0.25)
    return grid.select("motif", "pos", "_x.letter", "_x.count", weight.alias("weight"))


def consensus(weights: DataFrame) -> DataFrame:
    """(motif, width, consensus): the heaviest letter of each position, of equal ones the first in the alphabet."""
    best = F.row_number().over(W.partitionBy("motif", "pos").orderBy(F.col("weight").desc(), "letter"))
    top = weights.withColumn("_r", best).where(F.col("_r") == 1)
    return top.groupBy("motif").agg(F.count(F.lit(1)).alias("width"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("consensus"))
