"""Open reading frames of all records on both strands.

An open reading frame runs from the first start codon after a stop to the next stop in its frame.
Each tile gives the frames it holds whole, and for each frame one row that says what hangs over its
borders; those few rows are put together by windows over a record's tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..alphabet import STARTS, codons
from ..functions.letters import letters, tiles
from ..functions.sequence import guess_type, reverse_complement, translate

TILE = 3 << 14  # a multiple of three, so that frames go on from tile to tile
PIECE = 9_000


def strand_texts(records: DataFrame, both: bool = True) -> DataFrame:
    """(record_id, strand, text): upper-case letters of nucleic records, U read as T, and their reverse complement."""
    kind = F.coalesce(F.col("type"), guess_type(F.col("seq")))
    r = records.where(kind.isin("dna", "rna")).select("record_id", F.translate(letters(F.col("seq")), "U", "T").alias("_s"))
    strands = F.array(F.lit("+"), F.lit("-")) if both else F.array(F.lit("+"))
    r = r.withColumn("strand", F.explode(strands))
    return r.select("record_id", "strand", F.when(F.col("strand") == "+", F.col("_s")).otherwise(reverse_complement(F.col("_s"))).alias("text"))


def _frames(table: int, size: int):
    """Tiles -> (key, strand, tile, frame, whole, from, to) for whole frames, and one border row a frame.

    A border row has the first stop's end (null: none) with the first start before it, and the first start behind the last stop.
    """
    code = np.full(256, 64, np.int64)
    for k, letter in enumerate("TCAG"):
        code[ord(letter)] = k
    amino = codons(table)
    order = list(amino)
    is_stop = np.zeros(64 * 25, bool)
    is_start = np.zeros(64 * 25, bool)
    for k, c in enumerate(order):
        is_stop[k], is_start[k] = amino[c] == "*", c in STARTS.get(table, ["ATG"])

    def of_tile(base: int, no: int, text: str):
        x = code[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        n = len(x) - 2
        if n <= 0:
            return
        lettered = np.where((x[:n] < 4) & (x[1 : n + 1] < 4) & (x[2 : n + 2] < 4), 16 * x[:n] + 4 * x[1 : n + 1] + x[2 : n + 2], 64)
        own = min(n, (no + 1) * size - base)
        for frame in range(3):
            at = np.arange(frame, own, 3)
            stops, starts = at[is_stop[lettered[at]]], at[is_start[lettered[at]]]
            place = np.searchsorted(stops, starts)  # the stop that a start runs to
            first = np.ones(len(starts), bool)
            first[1:] = place[1:] != place[:-1]
            head, tail = None, None
            for s, p in zip(starts[first].tolist(), place[first].tolist()):
                if p == len(stops):
                    tail = base + s
                elif p == 0:
                    head = base + s
                else:
                    yield frame, True, base + s, base + int(stops[p]) + 3, None
            yield frame, False, head, base + int(stops[0]) + 3 if len(stops) else None, tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, strands, tile, base, text = (batch.column(c).to_pylist() for c in ("record_id", "strand", "tile", "base", "text"))
            rows = [(i, *row) for i in range(batch.num_rows) for row in of_tile(base[i], tile[i], text[i])]
            column = lambda k, t: pa.array([r[k] for r in rows], t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[r[0]] for r in rows], batch.schema.field("record_id").type), pa.array([strands[r[0]] for r in rows], pa.string()), pa.array([tile[r[0]] for r in rows], pa.int64()), column(1, pa.int32()), column(2, pa.bool_()), column(3, pa.int64()), column(4, pa.int64()), column(5, pa.int64())],
                names=["record_id", "strand", "tile", "frame", "whole", "_from", "_to", "_tail"],
            )

    return run


def orfs(records: DataFrame, min_length: int = 90, table: int = 11, both: bool = True, tile: int = TILE) -> DataFrame:
    """(record_id, start, end, strand, frame, length): frames of at least ``min_length`` letters, the stop included.

    ``start`` and ``end`` are forward positions without the record's offset.  A frame without a stop is none.  Codons with
    other letters than A, C, G, T and U are neither start nor stop.  Records that aren't nucleic or have no letters give no row; extra columns do not matter.
    ``tile`` must be a multiple of three.
    """
    texts = strand_texts(records, both)
    cut = tiles(texts, ["record_id", "strand"], "text", tile, 0, 2)
    rows = cut.select("record_id", "strand", "tile", "base", "text").mapInArrow(_frames(table, tile), f"record_id {records.schema['record_id'].dataType.simpleString()}, strand string, tile long, frame int, whole boolean, _from long, _to long, _tail long")
    key = ["record_id", "strand", "frame"]
    border = rows.where(~F.col("whole"))
    # Tiles since the last one with a stop belong together; the earliest start among what they leave open is the frame's.
    by = W.partitionBy(*key).orderBy("tile")
    border = border.withColumn("_group", F.count("_to").over(by.rowsBetween(W.unboundedPreceding, -1)))
    left = F.when(F.col("_to").isNotNull(), F.col("_tail")).otherwise(F.coalesce(F.col("_tail"), F.col("_from")))
    border = border.withColumn("_left", left).withColumn("_stop_tile", F.lag(F.col("_to").isNotNull()).over(by))
    # What a tile with a stop leaves open belongs to the group that follows it.
    carried = F.when(F.col("_to").isNotNull(), None).otherwise(F.col("_left"))
    border = border.withColumn("_in", F.coalesce(F.min(carried).over(W.partitionBy(*key, "_group").orderBy("tile").rowsBetween(W.unboundedPreceding, -1)), F.lit(None).cast("long")))
    border = border.withColumn("_before", F.last(F.when(F.col("_to").isNotNull(), F.struct(F.col("_tail").alias("t"))), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)))
    begun = F.coalesce(F.col("_before.t"), F.col("_in"), F.col("_from"))
    across = border.where(F.col("_to").isNotNull()).select(*key, begun.alias("_from"), "_to").where(F.col("_from").isNotNull())
    found = rows.where("whole").select(*key, "_from", "_to").unionByName(across).withColumn("length", F.col("_to") - F.col("_from")).where(F.col("length") >= min_length)
    sizes = records.select("record_id", F.length(letters(F.col("seq"))).cast("long").alias("_n"))
    found = found.join(sizes, "record_id")
    forward = F.col("strand") == "+"
    return found.select("record_id", F.when(forward, F.col("_from")).otherwise(F.col("_n") - F.col("_to")).alias("start"), F.when(forward, F.col("_to")).otherwise(F.col("_n") - F.col("_from")).alias("end"), "strand", "frame", "length")


def orf_proteins(records: DataFrame, found: DataFrame, table: int = 11, piece: int = PIECE) -> DataFrame:
    """``found`` with ``protein``: the amino acids before the stop, the start codon read as M.

    Frames are cut into pieces of whole codons, which are translated where their tile is and put together in order.
    """
    texts = strand_texts(records)
    size = 6 * piece
    cut = tiles(texts, ["record_id", "strand"], "text", size, 0, piece).select("record_id", "strand", "tile", "base", "n", "text")
    key = ["record_id", "strand", "frame", "start", "end"]
    sizes = texts.select("record_id", "strand", F.length("text").cast("long").alias("_n"))
    f = found.join(sizes, ["record_id", "strand"])
    local = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("_n") - F.col("end"))
    f = f.select(*key, local.alias("_at"), F.col("length").alias("_len")).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_len - 1) div {piece}"))))
    f = f.withColumn("_a", F.col("_at") + F.col("_k") * piece).withColumn("_m", F.least(F.col("_len") - F.col("_k") * piece, F.lit(piece))).withColumn("tile", F.expr(f"_a div {size}"))
    f = f.join(cut, ["record_id", "strand", "tile"])
    codon_text = F.substring("text", (F.col("_a") - F.col("base") + 1).cast("int"), F.col("_m").cast("int"))
    part = f.select(*key, F.struct("_k", translate(codon_text, table).alias("aa")).alias("_p"))
    joined = part.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["aa"]), "").alias("_aa"))
    return joined.select(*key, F.concat(F.lit("M"), F.substring_index(F.substring("_aa", 2, 2**31 - 1), "*", 1)).alias("protein"))
