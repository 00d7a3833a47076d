"""Restriction digests: cut sites, fragments, the choice of enzymes and gel lanes, for all records at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.letters import letters
from ..functions.sequence import band_opacity, band_thickness, guess_type, migration
from ..session import written
from .intervals import gaps_between
from .search import located_hits

#: The rungs of a common size ladder.
LADDER = [10000, 8000, 6000, 5000, 4000, 3000, 2500, 2000, 1500, 1000, 750, 500, 250, 100]


def nucleic(records: DataFrame) -> DataFrame:
    """Records of nucleic type with letters."""
    kind = F.coalesce(F.col("type"), guess_type(F.col("seq")))
    return records.where(kind.isin("dna", "rna") & (letters(F.col("seq")) != ""))


def site_motifs(enzymes: DataFrame) -> DataFrame:
    """Sites as a table of motifs."""
    named = enzymes.where(F.col("name").isNotNull() & (F.col("site") != ""))
    return named.select("name", F.concat(F.lit('(iupac "'), "site", F.lit('")')).alias("expr"), F.lit("dna").alias("alphabet"))


def cut_sites(records: DataFrame, enzymes: DataFrame, circular: bool = False) -> DataFrame:
    """(record_id, enzyme, start, end, strand, cut_top, cut_bottom, n) of each site of each enzyme on nucleic records.

    Palindromic sites count once.  On linear records a top cut outside of the record drops the site; on circular ones it
    wraps around (the bottom cut doesn't).  Sites across the origin of a circle are not found.  Records without letters give no row.
    """
    hits = located_hits(records, site_motifs(enzymes)).select("record_id", F.col("motif").alias("enzyme"), "start", "end", "strand", "n")
    e = enzymes.select(F.col("name").alias("enzyme"), F.col("cut_top").alias("_t"), F.col("cut_bottom").alias("_b"))
    forward = F.col("strand") == "+"
    sites = hits.join(e, "enzyme").withColumn("cut_top", F.when(forward, F.col("start") + F.col("_t")).otherwise(F.col("end") - F.col("_b")))
    sites = sites.withColumn("cut_bottom", F.when(forward, F.col("start") + F.col("_b")).otherwise(F.col("end") - F.col("_t"))).drop("_t", "_b")
    if circular:
        sites = sites.withColumn("cut_top", F.pmod(F.col("cut_top"), F.col("n")))
    else:
        sites = sites.where((F.col("cut_top") >= 0) & (F.col("cut_top") <= F.col("n")))
    # Of two sites of one enzyme that cut at the same place from the same start the forward one stays.
    one = F.row_number().over(W.partitionBy("record_id", "enzyme", "start", "cut_top").orderBy("strand"))
    return sites.withColumn("_one", one).where(F.col("_one") == 1).drop("_one")


def _cut_up(whole: DataFrame, cuts: DataFrame, keys: list[str], circular: bool) -> DataFrame:
    """(keys, from_pos, to_pos, size) of whole molecules (keys, n) with cuts (keys, cut_top)."""
    point = lambda d, c: d.select(*keys, c.cast("long").alias("from_pos"), c.cast("long").alias("to_pos"))
    size = F.col("to_pos") - F.col("from_pos")
    if not circular:
        points = point(cuts.distinct(), F.col("cut_top")).unionByName(point(whole, F.lit(0))).unionByName(point(whole, F.col("n")))
        return gaps_between(written(points, "cut-points"), keys).withColumn("size", size)
    cuts = written(cuts.distinct(), "cut-points")
    between = gaps_between(point(cuts, F.col("cut_top")), keys).withColumn("size", size)
    ends = cuts.groupBy(*keys).agg(F.min("cut_top").alias("_a"), F.max("cut_top").alias("_z"))
    across = whole.join(ends, keys).select(*keys, F.col("_z").alias("from_pos"), F.col("_a").alias("to_pos"), (F.col("n") - F.col("_z") + F.col("_a")).alias("size"))
    uncut = whole.join(ends, keys, "left_anti").select(*keys, F.lit(0).cast("long").alias("from_pos"), F.col("n").alias("to_pos"), F.col("n").alias("size"))
    return between.unionByName(across).unionByName(uncut)


def _used(sites: DataFrame, circular: bool) -> DataFrame:
    """The sites that part a molecule: on a linear one those strictly inside."""
    return sites if circular else sites.where((F.col("cut_top") > 0) & (F.col("cut_top") < F.col("n")))


def fragments(records: DataFrame, sites: DataFrame, circular: bool = False) -> DataFrame:
    """(record_id, from_pos, to_pos, size): what the cuts leave of each nucleic record.

    Linear: between 0, the cuts strictly inside and the end.  Circular: between consecutive cuts and across the origin; one
    cut opens the circle, none leaves it whole.
    """
    whole = nucleic(records).select("record_id", F.length(letters(F.col("seq"))).cast("long").alias("n"))
    return _cut_up(whole, _used(sites, circular).select("record_id", "cut_top"), ["record_id"], circular)


def chosen_enzymes(sites: DataFrame, enzymes: DataFrame, most: int = 2) -> DataFrame:
    """(record_id, enzyme, cuts, place): for each record the enzymes to digest with.

    Enzymes that cut once come first, in the library's order of names, then those with the fewest cuts.
    """
    counts = sites.groupBy("record_id", "enzyme").agg(F.count(F.lit(1)).alias("cuts"))
    place = F.row_number().over(W.partitionBy("record_id").orderBy(F.col("cuts") != 1, "cuts", "enzyme"))
    return counts.withColumn("place", place).where(F.col("place") <= most)


def digest_lanes(records: DataFrame, enzymes: DataFrame, circular: bool = False) -> DataFrame:
    """(record_id, lane, from_pos, to_pos, size): each record cut with its two chosen enzymes, each alone (lanes 1 and 2) and together (lane 0).

    Records that no enzyme cuts give no row.
    """
    sites = written(cut_sites(records, enzymes, circular), "cut-sites")  # the search is run once
    chosen = chosen_enzymes(sites, enzymes).select("record_id", "enzyme", "place")
    lanes = sites.join(chosen, ["record_id", "enzyme"]).select("record_id", "n", "cut_top", F.explode(F.array(F.lit(0), F.col("place"))).alias("lane"))
    keys = ["record_id", "lane"]
    found = _cut_up(lanes.select(*keys, "n").distinct(), _used(lanes, circular).select(*keys, "cut_top"), keys, circular)
    return found.select("record_id", "lane", "from_pos", "to_pos", "size")


def gel(frags: DataFrame, lane: str = "record_id") -> DataFrame:
    """(lane, size, y, opacity, thickness): where each fragment runs beside the ladder, larger ones brighter and thicker.

    A lane's scale spans the ladder, stretched where one of its fragments is larger or smaller.
    """
    f = frags.where(F.col("size") > 0)
    scale = f.groupBy(lane).agg(F.max("size").alias("_big"), F.greatest(F.max("size"), F.lit(LADDER[0])).alias("_hi"), F.least(F.min("size"), F.lit(LADDER[-1])).alias("_lo"))
    f = f.join(scale, lane)
    size, hi, lo, big = (F.col(c).cast("double") for c in ("size", "_hi", "_lo", "_big"))
    return f.select(lane, "size", migration(size, lo, hi).alias("y"), band_opacity(size, big).alias("opacity"), band_thickness(size, big).alias("thickness"))


def migration_of(size: Column) -> Column:
    """Migration on the plain ladder's scale."""
    return migration(size.cast("double"), F.lit(float(LADDER[-1])), F.lit(float(LADDER[0])))
