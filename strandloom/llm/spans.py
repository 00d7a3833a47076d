"""Problem 3: long exact spans shared between records.

Level-wise doubling.  Level one looks at windows of half the wanted length, of which only local
minima of the hash are kept: any two equal spans of the wanted length keep an equal one.
Those found in one record only are dropped; the others are extended to every window of the
full length around them:

* first to their whole surrounding, all full-length windows that contain them: where that
  occurs in another record too, as within long copies, all its windows are shared at once;
* where it doesn't, at the edges of copies, its windows are hashed one by one, together with one
  representative of every other surrounding of the same half-length window.

Groups of copies are only ever aggregated to their smallest and largest record, never
paired, so that a copy of a third of all records costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import letters, tiles
from ..operators.intervals import merge_intervals
from ..session import written

TILE = 1 << 15
#: Letters of tiles that are gone through end to end.
TOGETHER = 1 << 18
#: Odd multipliers of the two independent hashes, and of the mixing that follows.
_K = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_M = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _M
    x ^= x >> np.uint64(29)
    return x


def _join(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of two words each."""
    return _mixed(a * np.uint64(_K[lane]) + b * np.uint64(_K[1 - lane]))


@lru_cache(maxsize=8)
def _powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each letter, and the powers of a multiplier and of its inverse modulo 2^64."""
    up = np.full(n, np.uint64(_K[lane]))
    down = np.full(n, np.uint64(pow(_K[lane], -1, 1 << 64)))
    up[0] = down[0] = 1
    numbers = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_K[1 - lane]))
    return numbers, np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Hashes:
    """Hashes of any windows of a text: what lies before a position is summed up once."""

    def __init__(self, text: str, lane: int = 0):
        code = np.frombuffer(text.encode("ascii"), np.uint8)
        size = 1 << max(len(code), 1).bit_length()
        numbers, self.up, down = _powers(size, lane)
        self.before = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(numbers[code] * down[: len(code)], out=self.before[1:])

    def all(self, length: int) -> np.ndarray:
        n = max(0, len(self.before) - length)
        return _mixed((self.before[length : length + n] - self.before[:n]) * self.up[:n])

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.before[places + length] - self.before[places]) * self.up[places])


def _minima(h: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """Positions of the leftmost minimum of each valid run of ``width`` values; of equal neighbours the first, the last and every width-th between."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low, w = h, 1
    while 2 * w <= width:
        low, w = np.minimum(low[: len(low) - w], low[w:]), 2 * w
    low = np.where(valid[:n], np.minimum(low[:n], low[width - w : width - w + n]), np.uint64(0))
    # A position is a minimum of some run if it equals the lowest of any run that contains it.
    high, w = np.concatenate([np.zeros(width - 1, h.dtype), low, np.zeros(width - 1, h.dtype)]), 1
    top = high
    while 2 * w <= width:
        top, w = np.maximum(top[: len(top) - w], top[w:]), 2 * w
    m = len(high) - width + 1
    top = np.maximum(top[:m], top[width - w : width - w + m])
    at = np.flatnonzero((h == top) & (top > 0))
    same_left = np.zeros(len(at), bool)
    same_left[1:] = (at[1:] == at[:-1] + 1) & (h[at[1:]] == h[at[:-1]])
    first = np.flatnonzero(~same_left)
    run = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    last = np.append(~same_left[1:], True) if len(at) else same_left
    return at[~same_left | last | (run % width == 0)]


def _wide(h: _Hashes, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows from the first full-length window to the last."""
    return _mixed((h.before[hi + length] - h.before[lo]) * h.up[lo])


def _anchors(length: int, tile: int):
    """Tiles -> anchors: half-length hash, hash of the surrounding, first window and number of windows in it."""
    half = length // 2
    width = length - half + 1

    def of_texts(key: np.ndarray, no: np.ndarray, base: np.ndarray, n: np.ndarray, texts: list[str]) -> pa.RecordBatch:
        """Many tiles end to end; only runs of windows within one of them count."""
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size) - size
        own = no * tile - base  # where a tile's own starts begin in its text
        stop = np.maximum(np.minimum(own + tile, n - length + 1 - base), own)  # behind the last own start of a full window
        joined = "".join(texts)
        edges = np.zeros(len(joined) + 1, np.int32)
        np.add.at(edges, begin + own, 1)
        np.add.at(edges, begin + stop, -1)
        one, two = _Hashes(joined), _Hashes(joined, 1)
        h = one.all(half)
        at = _minima(h, width, np.cumsum(edges) > 0)
        of = np.searchsorted(begin, at, side="right") - 1
        lo, hi = np.maximum(at - (width - 1), begin[of]), np.minimum(at, begin[of] + size[of] - length)
        wide = (hi - lo + 1).astype(np.uint64)
        # All of the surrounding is one window; its width tells how many full-length ones it holds.
        around, again = _join(_wide(one, lo, hi, length), wide), _join(_wide(two, lo, hi, length), wide, 1)
        columns = [key[of], h[at].view(np.int64), around.view(np.int64), again.view(np.int64), lo - begin[of] + base[of], wide.astype(np.int32)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["_id", "_h", "_c", "_c2", "_lo", "_w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, texts = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], batch.column(4).to_pylist()
            part = np.cumsum([len(t) for t in texts]) // TOGETHER if texts else []
            for k in np.unique(part):
                rows = np.flatnonzero(part == k)
                yield of_texts(*(c[rows] for c in numbers), texts[rows[0] : rows[-1] + 1])

    return run


def _unrolled(length: int):
    """Surroundings with their tile's text -> a row for each full-length window: its hash and its place in the surrounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, text, items in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = _Hashes(text), _Hashes(text, 1)
                size = np.array([x["_w"] for x in items], np.int64)
                lo = np.array([x["_lo"] for x in items], np.int64) - base
                rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(lo, size) + rank
                rep = lambda k, t: pa.array(np.repeat(np.array([x[k] for x in items], t), size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.at(at, length).view(np.int64)), pa.array(two.at(at, length).view(np.int64)), pa.array(rank.astype(np.int32)), rep("_c", np.int64), rep("_c2", np.int64), rep("_min", np.int64), rep("_max", np.int64)],
                    names=["_x", "_x2", "_k", "_c", "_c2", "_min", "_max"],
                )

    return run


def shared_spans(records: DataFrame, length: int = 100, tile: int = TILE, block: int = 1 << 17) -> DataFrame:
    """Longest unbroken runs (record_id, from_pos, to_pos) of letters shared with another record.

    A letter is shared if it lies in ``length`` or more consecutive letters that also occur,
    exactly and in the same direction, in a record of another ``record_id`` (bigint, not null).
    Positions count letters.  Records with null, letterless or shorter text give no row; other
    columns, whatever their names, are dropped.
    """
    # A surrounding reaches half a window to the left of a tile's starts and 1.5 windows to the right.
    own = records.where(F.col("record_id").isNotNull()).select(F.col("record_id").cast("long").alias("_id"), letters(F.col("seq")).alias("_s"))
    cut = tiles(own, "_id", "_s", tile, length, 3 * length)
    # Written down once: a twentieth of the letters, used by every level.
    anchors = written(cut.mapInArrow(_anchors(length, tile), "_id long, _h long, _c long, _c2 long, _lo long, _w int"), "span-anchors")
    # Level one: one row for each distinct surrounding of a half-length window.
    rep = F.min(F.struct("_id", "_lo"))
    around = anchors.groupBy("_h", "_c", "_c2", "_w").agg(F.min("_id").alias("_min"), F.max("_id").alias("_max"), rep.alias("_rep"))
    single = F.col("_min") == F.col("_max")
    halves = around.groupBy("_h").agg(F.min("_min").alias("_a"), F.max("_max").alias("_z"), F.bool_or(single).alias("_open"))
    # Whole surroundings that occur in two records: every letter of all their copies is shared.
    whole = around.where(~single).select("_h", "_c", "_c2", "_w")
    done = anchors.join(whole, ["_h", "_c", "_c2", "_w"], "left_semi").select("_id", F.col("_lo").alias("_from"), (F.col("_lo") + F.col("_w") + (length - 1)).alias("_to"))
    # Level two: repeated half-length windows with a surrounding of one record only are extended window by window.
    open_ = halves.where((F.col("_a") < F.col("_z")) & F.col("_open")).select("_h")
    items = around.join(open_, "_h").select(F.col("_rep._id").alias("_id"), F.col("_rep._lo").alias("_lo"), "_w", "_c", "_c2", "_min", "_max")
    items = items.withColumn("tile", F.expr(f"_lo div {tile}")).groupBy("_id", "tile").agg(F.collect_list(F.struct("_lo", "_w", "_c", "_c2", "_min", "_max")).alias("_items"))
    rows = written(items.join(cut, ["_id", "tile"]).select("base", "text", "_items").mapInArrow(_unrolled(length), "_x long, _x2 long, _k int, _c long, _c2 long, _min long, _max long"), "span-windows")
    twice = rows.groupBy("_x", "_x2").agg(F.min("_min").alias("_a"), F.max("_max").alias("_z")).where(F.col("_a") < F.col("_z")).select("_x", "_x2")
    # Shared windows of surroundings that are in one record only; the others are done above.
    edge = rows.where(single).join(twice, ["_x", "_x2"], "left_semi").groupBy("_c", "_c2").agg(F.collect_set("_k").alias("_ks"))
    rest = anchors.join(edge, ["_c", "_c2"]).select("_id", "_lo", F.explode("_ks").alias("_k"))
    rest = rest.select("_id", (F.col("_lo") + F.col("_k")).alias("_from"), (F.col("_lo") + F.col("_k") + length).alias("_to"))
    return merge_intervals(written(done.unionByName(rest), "span-runs"), ["_id"], "_from", "_to", touching=True, block=block).withColumnRenamed("_id", "record_id")


def shared_share(records: DataFrame, **options: int) -> DataFrame:
    """For each record with letters (record_id, letters, shared, share): how many of its letters are shared elsewhere."""
    total = records.where(F.col("record_id").isNotNull()).select("record_id", F.length(letters(F.col("seq"))).cast("long").alias("letters")).where(F.col("letters") > 0)
    found = shared_spans(records, **options).groupBy("record_id").agg(F.sum(F.col("to_pos") - F.col("from_pos")).alias("shared"))
    return total.join(found, "record_id", "left").select("record_id", "letters", F.coalesce("shared", F.lit(0)).alias("shared"), (F.coalesce("shared", F.lit(0)) / F.col("letters")).alias("share"))
