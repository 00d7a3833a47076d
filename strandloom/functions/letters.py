"""Letters of raw sequence text, and tiles of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letters(seq: Column) -> Column:
    """The characters A-Z and a-z of raw text in upper case, all others left out; null stays null."""
    return F.upper(F.regexp_replace(seq, "[^A-Za-z]", ""))


def tiles(df: DataFrame, key: str | list[str], text: str, size: int, left: int, right: int) -> DataFrame:
    """Cut texts into tiles (key columns, tile, base, n, text) of ``size`` starts.

    Tile t owns the starts [t*size, (t+1)*size) and also carries ``left`` letters before and
    ``right`` letters after them; ``base`` is the position of its first letter, ``n`` the length
    of the whole text.  Rows with null or empty text give no tile.  Very long texts are cut in two steps, since reaching a position in a
    string costs time in proportion to it.
    """
    big = size * 16
    keys = [key] if isinstance(key, str) else key

    def cut(d: DataFrame, step: int, lo: Column, hi: Column, no: str) -> DataFrame:
        """Explode [lo, hi) by multiples of step; ``_at`` is the position of ``_t``'s first letter."""
        first, last = (lo / step).cast("long"), ((hi - 1) / step).cast("long")
        # An outer explode isn't preceded by a filter, for which the text would be made twice.
        d = d.withColumn(no, F.explode_outer(F.when(hi > lo, F.sequence(first, last)))).where(F.col(no).isNotNull())
        a = F.greatest(F.col(no) * step - left, F.col("_at"))
        return d.withColumn("_cut", F.expr("_t")).withColumn("_a", a).withColumn(
            "_t", F.substring(F.col("_cut"), (F.col("_a") - F.col("_at") + 1).cast("int"), ((F.col(no) + 1) * step + right - F.col("_a")).cast("int"))
        ).withColumn("_at", F.col("_a")).drop("_cut", "_a")

    d = df.select(*keys, F.col(text).alias("_t"), F.length(text).cast("long").alias("_n"), F.lit(0).cast("long").alias("_at"))
    d = cut(d, big, F.lit(0), F.col("_n"), "_big")
    d = cut(d, size, F.col("_big") * big, F.least((F.col("_big") + 1) * big, F.col("_n")), "tile")
    return d.select(*keys, F.col("tile"), F.col("_at").alias("base"), F.col("_n").alias("n"), F.col("_t").alias("text"))
