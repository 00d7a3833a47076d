"""Problem 4: records longer than a limit, cut at natural boundaries.

For a record the least number of pieces is computed and as many equal targets are set;
each target is snapped to the strongest boundary of its neighbourhood (as near as costs no further piece, else half a
step to either side), and where two cuts end up too far apart, equally spaced cuts are added.
A cut that found no boundary takes the strongest one that keeps both pieces beside it within the limit, wherever it lies.
All of it runs on rows of boundaries and targets; letters are only touched when the
pieces are taken out of tiles.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.letters import letters, tiles
from ..session import hinted

#: A natural boundary is a run of so many filler letters.
RUN = 10
TILE = 1 << 16


def _limited(records: DataFrame, limits: DataFrame) -> DataFrame:
    """(record_id, type, offset, letters, n, max_letters, overlap_letters) of the records over their type's limit."""
    lim = limits.select(F.col("type").alias("_type"), F.col("max_letters").cast("long").alias("_max"), F.col("overlap_letters").cast("long").alias("_overlap"))
    r = records.select("record_id", F.col("type").alias("_type"), F.coalesce(F.col("offset"), F.lit(0)).cast("long").alias("_offset"), letters(F.col("seq")).alias("_letters"))
    r = r.join(hinted(lim), "_type")
    return r.withColumn("_n", F.length("_letters").cast("long")).where(F.col("_n") > F.col("_max"))


def _filler(kind: Column) -> Column:
    return F.when(kind == "protein", f"X{{{RUN},}}").otherwise(f"N{{{RUN},}}")


def stretches(records: DataFrame, limits: DataFrame) -> DataFrame:
    """Stretches between natural boundaries (record_id, piece, from, to, run after, ...) of records over their limit.

    ``_from`` and ``_to`` count the record's letters; ``_run`` is the length of the boundary that follows, null at the end.
    """
    r = _limited(records, limits)
    between = F.transform(F.split("_letters", _filler(F.col("_type")), -1), lambda x: F.length(x).cast("long"))
    runs = F.transform(F.regexp_extract_all("_letters", _filler(F.col("_type")), F.lit(0)), lambda x: F.length(x).cast("long"))
    r = r.select("record_id", "_type", "_offset", "_n", "_max", "_overlap", F.posexplode(F.arrays_zip(between.alias("a"), runs.alias("b"))).alias("_i", "_x"))
    r = r.select("*", F.col("_x.a").alias("_len"), F.col("_x.b").alias("_run")).drop("_x")
    start = F.coalesce(F.sum(F.col("_len") + F.coalesce("_run", F.lit(0))).over(W.partitionBy("record_id").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return r.withColumn("_from", start).withColumn("_to", start + F.col("_len"))


def snapped(cuts: list[tuple[int, bool]], boundaries: list[tuple[int, int]], most: int, overlap: int) -> list[tuple[int, bool]]:
    """Cuts (position, natural) in order, the record's end the last, with artificial ones moved to boundaries (position, run).

    Each takes the strongest boundary (of equal ones the nearest, then the first) that leaves both pieces beside it within the limit, or is
    dropped if they fit without it; a moved cut's artificial neighbours are tried again, so that in the end none has such a boundary.
    """
    boundaries = sorted(b for b in boundaries if overlap < b[0] < cuts[-1][0])
    places = [at for at, _ in boundaries]
    before, after = list(range(-1, len(cuts) - 1)), list(range(1, len(cuts) + 1))
    at, natural, gone = [c for c, _ in cuts], [x for _, x in cuts], set()
    waiting = [i for i in range(len(cuts) - 2, -1, -1) if not natural[i]]
    while waiting:
        i = waiting.pop()
        if natural[i] or i in gone:
            continue
        p, q = before[i], after[i]
        left = at[p] if p >= 0 else 0
        reach = left + most - (overlap if p >= 0 else 0)
        if at[q] <= reach:
            gone.add(i)
            before[q] = p
            if p >= 0:
                after[p] = q
        else:
            near = boundaries[bisect_left(places, max(at[q] - (most - overlap), left + 1)) : bisect_right(places, min(reach, at[q] - 1))]
            if not near:
                continue
            at[i], natural[i] = max(near, key=lambda b: (b[1], -abs(b[0] - at[i]), -b[0]))[0], True
        waiting += [j for j in (q, p) if j >= 0 and not natural[j]]
    return [(at[i], natural[i]) for i in range(len(cuts)) if i not in gone]


def _around(cuts_: list[tuple[int, bool]], boundaries: list[tuple[int, int]], n: int) -> list[tuple[int | None, int | None]]:
    """The stretch without a boundary that each artificial cut lies in; none for natural cuts and for cuts within a boundary."""
    spans = sorted((at - run // 2, at - run // 2 + run) for at, run in boundaries)
    begins, ends = [a for a, _ in spans], [b for _, b in spans]
    out = []
    for at, natural in cuts_:
        before, after = bisect_right(ends, at), bisect_left(begins, at)
        out.append((None, None) if natural or before != after else (ends[before - 1] if before else 0, begins[after] if after < len(begins) else n))
    return out


def _snapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of records with their cuts and boundaries -> their cuts."""
    for batch in batches:
        of, found, around = [], [], []
        for row in range(batch.num_rows):
            n, most, overlap, marks = (batch.column(c)[row].as_py() for c in (1, 2, 3, 5))
            cuts_ = sorted((x["at"], x["natural"]) for x in marks if x["run"] is None)
            boundaries = [(x["at"], x["run"]) for x in marks if x["run"] is not None]
            some = snapped(cuts_, boundaries, most, overlap)
            of += [row] * len(some)
            found += some
            around += _around(some, boundaries, n)
        rows = pa.array(of, pa.int32())
        columns = [*(batch.column(c).take(rows) for c in range(5)), pa.array([c for c, _ in found], pa.int64()), pa.array([x for _, x in found], pa.bool_()), *(pa.array([x[k] for x in around], pa.int64()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["record_id", "_n", "_max", "_overlap", "_offset", "_cut", "natural", "_from", "_to"])


def cuts(records: DataFrame, limits: DataFrame) -> DataFrame:
    """(record_id, _n, _max, _overlap, _offset, _cut, natural, _from, _to) of each cut; pieces end at cuts and begin ``overlap`` letters before.

    ``_from`` and ``_to`` are the ends of the stretch without a boundary in which an artificial cut had to be set.
    """
    s = stretches(records, limits)
    step = F.col("_max") - F.col("_overlap")  # two cuts may lie so far apart
    pieces = F.ceil((F.col("_n") - F.col("_overlap")) / step)
    one = s.where(F.col("_i") == 0).withColumn("_pieces", pieces).withColumn("_d", F.col("_n") / F.col("_pieces"))
    key = ["record_id", "_n", "_max", "_overlap", "_offset"]
    # A boundary is cut in its middle; it belongs to the target nearest to it.
    b = s.where(F.col("_run").isNotNull()).withColumn("_at", F.col("_to") + (F.col("_run") / 2).cast("long"))
    b = b.withColumn("_target", F.floor(F.col("_at") / (F.col("_n") / pieces) + F.lit(0.5)).cast("long"))
    off = F.abs(F.col("_at") - F.col("_target") * F.col("_n") / pieces)
    # Two neighbours moved apart by no more than what a step has to spare need no piece between them.
    free = off * 2 <= step - F.col("_n") / pieces
    best = b.where((F.col("_at") > F.col("_overlap")) & (F.col("_at") < F.col("_n"))).groupBy("record_id", "_target").agg(F.max_by("_at", F.struct(free, "_run", -off, -F.col("_at"))).alias("_snap"))
    t = one.where(F.col("_pieces") > 1).select(*key, "_d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_pieces") - 1)).alias("_target"))
    t = t.join(best, ["record_id", "_target"], "left")
    fallback = F.floor(F.col("_target") * F.col("_d")).cast("long")
    t = t.select(*key, F.coalesce("_snap", fallback).alias("_cut"), F.col("_snap").isNotNull().alias("natural"))
    # Where snapping left two cuts too far apart, further cuts are set between them; the record's end is a cut as well.
    end = one.select(*key, F.col("_n").alias("_cut"), F.lit(True).alias("natural"))
    t = t.unionByName(end).withColumn("_prev", F.lag("_cut").over(W.partitionBy("record_id").orderBy("_cut")))
    room = F.when(F.col("_prev").isNull(), F.col("_max")).otherwise(step)
    gap = F.col("_cut") - F.coalesce("_prev", F.lit(0))
    # The first piece has no overlap before it: count it as if it began at -overlap.
    begin = F.when(F.col("_prev").isNull(), -F.col("_overlap")).otherwise(F.col("_prev"))
    parts = F.greatest(F.ceil((F.col("_cut") - begin) / step), F.lit(1))
    t = t.withColumn("_parts", F.when(gap <= room, F.lit(1)).otherwise(parts)).withColumn("_begin", begin)
    t = t.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_parts").cast("long"))))
    at = F.col("_begin") + F.floor((F.col("_cut") - F.col("_begin")) * F.col("_j") / F.col("_parts")).cast("long")
    last = F.col("_j") == F.col("_parts")
    set_ = t.select(*key, F.when(last, F.col("_cut")).otherwise(at).alias("at"), F.lit(None).cast("long").alias("run"), (F.col("natural") & last).alias("natural"))
    # A record's marks are one row: fewer than its letters, which are one as well.
    marks = set_.unionByName(b.select(*key, F.col("_at").alias("at"), F.col("_run").alias("run"), F.lit(True).alias("natural")))
    marks = marks.groupBy(*key).agg(F.collect_list(F.struct("at", "run", "natural")).alias("_marks"))
    kind = records.schema["record_id"].dataType.simpleString()
    return marks.mapInArrow(_snapping, f"record_id {kind}, _n long, _max long, _overlap long, _offset long, _cut long, natural boolean, _from long, _to long")


def unbroken_stretches(records: DataFrame, limits: DataFrame) -> DataFrame:
    """Stretches (record_id, from_pos, to_pos) longer than the limit without a natural boundary; positions have the offset added.

    They are those in which the splitting had to set an artificial cut: two cuts lie at most a limit apart, so that a longer stretch
    without a boundary holds one.  Records of null or unknown type, without letters or within the limit give no row.
    """
    forced = cuts(records, limits).where(~F.col("natural") & (F.col("_to") - F.col("_from") > F.col("_max")))
    return forced.select("record_id", (F.col("_from") + F.col("_offset")).alias("from_pos"), (F.col("_to") + F.col("_offset")).alias("to_pos")).distinct()


def rejoined(records: DataFrame, limits: DataFrame) -> DataFrame:
    """(record_id, offset, letters, md5, within, joined): each split record put together from its pieces again.

    ``within`` says that no piece exceeds the limit, ``joined`` that consecutive ones share the overlap exactly.
    """
    lim = limits.select(F.col("type").alias("_type"), F.col("max_letters").alias("_max"), F.col("overlap_letters").alias("_overlap"))
    p = split_records(records, limits).join(records.select("record_id", F.col("type").alias("_type")), "record_id").join(hinted(lim), "_type")
    w = W.partitionBy("record_id").orderBy("piece")
    before = F.lag(F.struct((F.col("offset") + F.col("length")).alias("end"), F.right("seq", F.col("_overlap")).alias("tail"))).over(w)
    p = p.withColumn("_before", before)
    shares = F.col("_before").isNull() | (F.col("_before.end") - F.col("offset") == F.col("_overlap")) & (F.left("seq", F.col("_overlap")) == F.col("_before.tail"))
    own = F.when(F.col("_before").isNull(), F.col("seq")).otherwise(F.substring("seq", F.col("_overlap") + 1, F.col("length").cast("int")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", own.alias("x")))), lambda x: x["x"]), "")
    g = p.groupBy("record_id").agg(F.min("offset").alias("offset"), whole.alias("_text"), F.bool_and((F.col("length") == F.length("seq")) & (F.col("length") <= F.col("_max"))).alias("within"), F.bool_and(shares).alias("joined"))
    return g.select("record_id", "offset", F.length("_text").cast("long").alias("letters"), F.md5("_text").alias("md5"), "within", "joined")


def split_records(records: DataFrame, limits: DataFrame, tile: int = TILE) -> DataFrame:
    """Pieces (record_id, piece, offset, length, natural, seq) of the records over their type's limit.

    Each piece has at most ``max_letters`` letters, consecutive pieces share ``overlap_letters``
    letters, and ``offset`` is where the piece begins in the record's parent; ``natural`` says that
    the piece ends at a natural boundary or the record's end.  Records within the limit, without
    letters or of null or unknown type give no row.  ``overlap_letters`` must be less than half of ``max_letters``.
    """
    w = W.partitionBy("record_id").orderBy("_cut")
    p = cuts(records, limits).withColumn("_prev", F.lag("_cut").over(w)).withColumn("piece", F.row_number().over(w))
    p = p.withColumn("_a", F.coalesce(F.col("_prev") - F.col("_overlap"), F.lit(0))).withColumn("length", F.col("_cut") - F.col("_a"))
    p = p.withColumn("tile", (F.col("_a") / tile).cast("long"))
    widest = limits.agg(F.max("max_letters")).first()[0] or 0  # one number of a fixed table
    t = tiles(_limited(records, limits), "record_id", "_letters", tile, 0, int(widest))
    text = F.substring("text", (F.col("_a") - F.col("base") + 1).cast("int"), F.col("length").cast("int"))
    return p.join(t, ["record_id", "tile"]).select("record_id", "piece", (F.col("_a") + F.col("_offset")).alias("offset"), "length", "natural", text.alias("seq"))
