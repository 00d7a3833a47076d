"""What was found, in numbers and a sentence for each record or sequence: scans, reading frames and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hits import count_places


def _many(n: Column, one: str, several: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(several))


def scan_findings(hits: DataFrame, library: DataFrame, by: str) -> DataFrame:
    """(by, hits, patterns, places, rna, said) of hits on either strand; ``rna`` counts hits of motifs the library has for RNA.

    Rows with a null in ``by``, motif, start or end, or on no strand, are left out.
    """
    used = hits.where(F.col("strand").isin("+", "-") & (F.col("start") < F.col("end"))).dropna(subset=[by, "motif"])
    of_rna = library.where(F.col("alphabet") == "rna").select(F.col("name").alias("motif"), F.lit(1).alias("_rna")).distinct()
    counts = used.join(of_rna, "motif", "left").groupBy(by).agg(F.count_distinct("motif").alias("patterns"), F.count("_rna").alias("rna"))
    d = counts.join(count_places(used, [by]), by)
    where = F.when(F.col("places") < F.col("hits"), F.concat(F.lit(", at "), _many(F.col("places"), "place", "places"))).otherwise("")
    rna = F.when(F.col("rna") > 0, F.concat(F.lit("; "), _many(F.col("rna"), "tells", "tell"), F.lit(" of RNA only"))).otherwise("")
    said = F.concat(_many(F.col("hits"), "match", "matches"), F.lit(" of "), _many(F.col("patterns"), "pattern", "patterns"), where, rna)
    return d.select(by, "hits", "patterns", "places", "rna", said.alias("said"))


def orf_findings(orfs: DataFrame) -> DataFrame:
    """(record_id, frames, longest, said) of records that have a reading frame."""
    d = orfs.groupBy("record_id").agg(F.count(F.lit(1)).alias("frames"), F.max("length").alias("longest"))
    said = F.concat(_many(F.col("frames"), "reading frame", "reading frames"), F.lit(", the longest of "), F.expr("longest div 3").cast("string"), F.lit(" codons"))
    return d.withColumn("said", said)


def digest_findings(fragments: DataFrame) -> DataFrame:
    """(record_id, pieces, largest, smallest, said) of what a digest leaves of each record; pieces of no length don't count."""
    d = fragments.where(F.col("size") > 0).groupBy("record_id").agg(F.count(F.lit(1)).alias("pieces"), F.max("size").alias("largest"), F.min("size").alias("smallest"))
    sizes = F.concat(F.lit(" of "), F.col("smallest").cast("string"), F.lit(" to "), F.col("largest").cast("string"), F.lit(" letters"))
    return d.withColumn("said", F.when(F.col("pieces") == 1, "uncut").otherwise(F.concat(_many(F.col("pieces"), "piece", "pieces"), sizes)))
