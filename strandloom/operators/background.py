"""How many hits chance alone would give: first-order Markov surrogates of each record, and what the comparison means."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.letters import letters
from ..functions.sequence import guess_type, normalize
from ..lang.motif import motif
from ..session import written
from .search import search

TRIALS = 40
#: Ranges of scores that are counted before any are put in order.
RANGES = 1024
#: Letters of a surrogate that are drawn and searched in one go, and of all surrogates of one row, if it has several.
PIECE, TOGETHER = 1 << 17, 1 << 18


def _model(pieces: Iterable[str]) -> tuple[str, list[int], list[int]]:
    """The letters of a text, how often each occurs, and how often each is followed by each other (row by row)."""
    every, follows, last = np.zeros(256, np.int64), np.zeros((256, 256), np.int64), None
    for piece in pieces:
        code = np.frombuffer(piece.encode("latin-1", "replace"), np.uint8).astype(np.int64)
        every += np.bincount(code, minlength=256)
        if last is not None:
            code = np.concatenate([[last], code])
        follows += np.bincount(code[:-1] * 256 + code[1:], minlength=1 << 16).reshape(256, 256)
        last = code[-1]
    used = np.flatnonzero(every)
    return used.astype(np.uint8).tobytes().decode("latin-1"), every[used].tolist(), follows[np.ix_(used, used)].ravel().tolist()


def _walk(after: np.ndarray, state: np.ndarray) -> np.ndarray:
    """trials x n states: ``after[j]`` has what follows each position's predecessor if that is j, ``state`` the states before.

    The positions are cut into blocks that are walked side by side from every state; which walk holds is read off block by block.
    """
    k, trials, n = after.shape
    width = max(int(np.sqrt(n)), 1)
    blocks = -(-n // width)
    padded = np.zeros((k, trials, blocks * width), np.uint8)
    padded[:, :, :n] = after
    # One flat row of k x trials x blocks for each step.
    steps = np.ascontiguousarray(padded.reshape(k, trials, blocks, width).transpose(3, 0, 1, 2)).reshape(width, -1)
    cell = np.tile(np.arange(trials * blocks), k)
    walks = np.empty((width, k * trials * blocks), np.uint8)
    walks[0] = steps[0]
    for i in range(1, width):
        walks[i] = steps[i][walks[i - 1].astype(np.int64) * (trials * blocks) + cell]
    walks = walks.reshape(width, k, trials, blocks)
    begin, each = np.empty((trials, blocks), np.int64), np.arange(trials)
    for b in range(blocks):
        begin[:, b] = state
        state = walks[-1, state, each, b].astype(np.int64)
    out = walks[:, begin, each[:, None], np.arange(blocks)]
    return out.transpose(1, 2, 0).reshape(trials, -1)[:, :n]


def _drawn(model: tuple[str, list[int], list[int]], n: int, seed: int, first: int, trials: int, piece: int = PIECE) -> Iterator[list[str]]:
    """Surrogates ``first`` and following of a text of n letters, piece by piece: the next letters of each.

    Each surrogate has its own counter-based generator, so that it is the same wherever it is drawn and however it is cut.
    """
    used, every, follows = model
    k = len(used)
    every, follows = np.array(every, float), np.array(follows, float).reshape(k, k)
    follows[follows.sum(1) == 0] = every
    steps = np.cumsum(follows / follows.sum(1, keepdims=True), axis=1)
    steps[steps > 1 - 1e-12] = 1  # rounding must not let a letter follow that never does
    begin = np.cumsum(every / every.sum())
    draws = [np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), 0x5EED + first + t])) for t in range(trials)]
    code, state = np.frombuffer(used.encode("latin-1"), np.uint8), None
    for at in range(0, n, piece):
        u = np.stack([d.random(min(piece, n - at)) for d in draws])
        out = np.empty(u.shape, np.uint8)
        done = 0
        if state is None:
            state = np.minimum(np.searchsorted(begin, u[:, 0], side="right"), k - 1)
            out[:, 0], done = state, 1
        if u.shape[1] > done:
            after = np.zeros((k, trials, u.shape[1] - done), np.uint8)
            for j in range(k):
                for value, many in zip(*np.unique(steps[j], return_counts=True)):
                    if value < 1:
                        after[j] += (u[:, done:] >= value).astype(np.uint8) * np.uint8(many)
            out[:, done:] = _walk(after, state)
            state = out[:, -1].astype(np.int64)
        yield [row.tobytes().decode("latin-1") for row in code[out]]


def surrogates(text: str, trials: int, seed: int) -> list[str]:
    """Random texts of the same length that keep how often a letter follows another.

    The first letter is drawn from the text, each next one from the successors of the last; a letter without one is followed by any letter of the text.
    """
    if len(text) < 2:
        return [text] * trials
    return ["".join(pieces) for pieces in zip(*_drawn(_model([text]), len(text), seed, 0, trials))]


_MODEL = "_row long, _nuc boolean, _seed long, _n long, _used string, _every array<long>, _follows array<long>"


def _models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records -> what their surrogates are drawn from, a small row however long the record."""
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in batches:
        rows = [(number, nuc, seed, len(text), *_model(text[i : i + PIECE] for i in range(0, len(text), PIECE))) for number, nuc, seed, text in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=[x.split()[0] for x in _MODEL.split(", ")])


def _surrogates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of some trials of a record -> a row for each surrogate."""
    for batch in batches:
        for row, nuc, seed, n, used, every, follows, first, trials in zip(*(c.to_pylist() for c in batch.columns)):
            texts = ["".join(pieces) for pieces in zip(*_drawn((used, every, follows), n, seed, first, trials))]
            columns = [pa.array([row] * trials, pa.int64()), pa.array(range(first, first + trials), pa.int32()), pa.array(["dna" if nuc else "protein"] * trials), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_trial", "type", "seq"])


def surrogate_records(models: DataFrame, trials: int) -> DataFrame:
    """(_row, _trial, type, seq): ``trials`` surrogates of each record, those of long records spread over tasks."""
    several = F.least(F.greatest(F.floor(F.lit(TOGETHER) / F.col("_n")), F.lit(1)), F.lit(trials)).cast("int")
    d = models.withColumn("_several", several).withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(trials - 1), F.col("_several"))))
    d = d.select("_row", "_nuc", "_seed", "_n", "_used", "_every", "_follows", "_first", F.least("_several", F.lit(trials) - F.col("_first")).alias("_several"))
    parts = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, "_row", "_first").mapInArrow(_surrogates, "_row long, _trial int, type string, seq string")


def _counts(records: DataFrame, source: str, by: list[str]) -> DataFrame:
    """(by, hits) of the records that have any."""
    as_records = records.select(F.struct(*by).alias("record_id"), F.lit("").alias("name"), F.lit(0).alias("offset"), "type", "seq")
    return search(as_records, source).groupBy("record_id").agg(F.count(F.lit(1)).alias("hits")).select("record_id.*", "hits")


def background(records: DataFrame, source: str, trials: int = TRIALS, longest: int | None = None) -> DataFrame:
    """(record_id, observed, expected, trials, low, high, empirical_p): hits on each record against its surrogates.

    The surrogates are rows like any records and go through the same search. ``low`` and ``high`` are the order statistics at 5 and 95 percent,
    without interpolation.  Records without letters give no row, nor, where ``longest`` is set, do longer ones.
    """
    motif(source)
    kind = F.coalesce(F.col("type"), guess_type(F.col("seq")))
    r = records.select("record_id", F.xxhash64("record_id").alias("_seed"), kind.isin("dna", "rna").alias("_nuc"), normalize(letters(F.col("seq")), kind).alias("seq"))
    # Numbered once, so that all that is made of a record meets again.
    r = written(r.where(F.length("seq").between(1, longest if longest is not None else 2**31 - 1)).withColumn("_row", F.monotonically_increasing_id()), "background")
    models = written(r.repartition(F.col("_row")).select("_row", "_nuc", "_seed", "seq").mapInArrow(_models, _MODEL), "background-models")
    observed = _counts(r.withColumn("type", F.when(F.col("_nuc"), "dna").otherwise("protein")), source, ["_row"]).withColumnRenamed("hits", "observed")
    drawn = _counts(surrogate_records(models, trials), source, ["_row", "_trial"]).groupBy("_row").agg(F.collect_list("hits").alias("_hits"))
    j = r.select("record_id", "_row").join(observed, "_row", "left").join(drawn, "_row", "left")
    # Trials without a hit have no row.
    some = F.coalesce("_hits", F.array().cast("array<long>"))
    j = j.select("record_id", F.coalesce("observed", F.lit(0)).alias("observed"), F.array_sort(F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(trials) - F.size(some)), some)).alias("counts"))
    at = lambda q: int(np.floor((trials - 1) * q)) if q < 0.5 else int(np.ceil((trials - 1) * q))
    return j.select(
        "record_id", "observed", (F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x) / trials).alias("expected"), F.lit(trials).alias("trials"),
        F.element_at("counts", at(0.05) + 1).alias("low"), F.element_at("counts", at(0.95) + 1).alias("high"),
        ((F.size(F.filter("counts", lambda x: x >= F.col("observed"))) + 1) / (trials + 1)).alias("empirical_p"),
    )


def verdict(observed: Column, expected: Column, empirical_p: Column, trials: Column) -> Column:
    """none, strong, some or noise: what the comparison with the background means; null without a background."""
    ratio = F.try_divide(observed, expected)
    return (
        F.when(expected.isNull(), F.lit(None).cast("string")).when(observed == 0, "none").when(empirical_p <= 1 / (trials + 1), "strong")
        .when(ratio >= 5, "strong").when(ratio >= 2, "some").otherwise("noise")
    )


def explanation(observed: Column, expected: Column, low: Column, high: Column, empirical_p: Column, trials: Column) -> Column:
    """The comparison with the background in a sentence; null without a background."""
    number = lambda c: F.format_number(c, 1)
    base = F.concat(trials.cast("string"), F.lit(" simulated sequences gave "), number(expected), F.lit(" on average (90% between "), low.cast("string"), F.lit(" and "), high.cast("string"), F.lit(")"))
    word = verdict(observed, expected, empirical_p, trials)
    said = (
        F.when(word == "none", F.when(expected < 0.5, "none was found, and hardly any was expected: ").otherwise("none was found although chance gives some: "))
        .when(word == "strong", "clearly more than chance gives: ").when(word == "some", "somewhat more than chance gives: ").otherwise("about what chance gives, or less: ")
    )
    return F.concat(observed.cast("string"), F.lit(" found, "), said, base, F.lit("."))


def calibrated_thresholds(scores: DataFrame, rate: float = 1e-4) -> DataFrame:
    """(motif, scores, threshold, achieved): the exact quantile of each motif's scores that lets a share of ``rate`` pass.

    Null and NaN scores are left out.
    """
    s = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("motif").isNotNull())
    n = s.groupBy("motif", F.col("score").cast("double").alias("score")).agg(F.count(F.lit(1)).alias("_n"))
    # Ranges of each motif's scores are counted first; only the range that holds the quantile is put in order.
    bounds = n.groupBy("motif").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.sum("_n").alias("scores"))
    n = n.join(bounds, "motif")
    share = F.when((F.col("_hi") > F.col("_lo")) & (F.col("_hi") - F.col("_lo") < float("inf")), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    n = n.withColumn("_range", F.least((share * RANGES).cast("int"), F.lit(RANGES - 1)))
    upto = W.partitionBy("motif").orderBy("_range")
    filled = n.groupBy("motif", "scores", "_range").agg(F.sum("_n").alias("_m")).withColumn("_upto", F.sum("_m").over(upto))
    wanted = F.ceil(F.col("scores") * (1 - F.lit(rate)))
    held = filled.where((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("_m") < wanted)).select("motif", "_range", (F.col("_upto") - F.col("_m")).alias("_earlier"))
    inside = n.join(held, ["motif", "_range"]).withColumn("_below", F.col("_earlier") + F.sum("_n").over(W.partitionBy("motif").orderBy("score")))
    at = inside.where(F.col("_below") >= wanted).groupBy("motif", "scores").agg(F.min(F.struct("score", "_below", "_n")).alias("_t"))
    return at.select("motif", "scores", F.col("_t.score").alias("threshold"), ((F.col("scores") - F.col("_t._below") + F.col("_t._n")) / F.col("scores")).alias("achieved"))
