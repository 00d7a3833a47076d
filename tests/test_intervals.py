"""Periods, gaps, islands and what is folded from them, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.plans.queries import QUERIES
from strandloom.operators.hits import band_join, collapse, count_places, coverage, elided, non_overlapping
from strandloom.operators.intervals import gaps_between, islands, match_periods, merge_intervals

SCHEMA = "k string, start long, end long, _s long, from_pos long"


def fixture(seed=3, n=300):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        a = draw.randint(-100, 900)
        rows.append((draw.choice("ab"), a, a + draw.choice([0, 1, 2, 3, 5, 8, -1, 90]), 1, 1))
    return rows + [("a", 0, 700, 1, 1), ("a", None, 3, 1, 1), ("a", 5, None, 1, 1), (None, 5, 9, 1, 1)] + rows[:20]


def merged(rows, touching):
    out = []
    for k in {r[0] for r in rows} - {None}:
        kept = []
        for a, b in sorted((r[1], r[2]) for r in rows if r[0] == k and r[1] is not None and r[2] is not None and r[1] < r[2]):
            if kept and (a <= kept[-1][1] if touching else a < kept[-1][1]):
                kept[-1][1] = max(kept[-1][1], b)
            else:
                kept.append([a, b])
        out += [(k, a, b) for a, b in kept]
    return sorted(out)


@pytest.mark.parametrize("touching", [False, True])
@pytest.mark.parametrize("block", [16, 200, 1 << 17])
def test_periods(spark, touching, block):
    rows = fixture()
    found = merge_intervals(spark.createDataFrame(rows, SCHEMA), ["k"], "start", "end", touching, block)
    assert sorted(tuple(r) for r in found.collect()) == merged(rows, touching)


@pytest.mark.parametrize("block", [16, 1 << 17])
def test_gaps(spark, block):
    periods = merged(fixture(5, 60), False)
    found = gaps_between(spark.createDataFrame(periods, "k string, from_pos long, to_pos long"), ["k"], block)
    expected = [(k, b, c) for (k, _, b), (k2, c, _) in zip(periods, periods[1:]) if k == k2 and c > b]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_match_periods_ignores_what_it_must(spark):
    rows = [("s", "+", 1, 5), ("s", "+", 5, 8), ("s", "+", 10, 12), ("s", "-", 1, 9), ("s", ".", 0, 99), ("s", None, 0, 99), (None, "+", 1, 2), ("s", "+", 7, 7), ("S", "+", 1, 2), ("s", "+", 1, 5)]
    found = match_periods(spark.createDataFrame(rows, "sequence string, strand string, start long, end long"))
    assert sorted(tuple(r) for r in found.collect()) == sorted([("period", "s", "+", 1, 5), ("period", "s", "+", 5, 8), ("gap", "s", "+", 8, 10), ("period", "s", "+", 10, 12), ("period", "s", "-", 1, 9), ("period", "S", "+", 1, 2)])


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merge_intervals(empty, ["k"], "start", "end").count() == 0
    assert islands(empty, ["k"], "start", "end").count() == 0


@pytest.mark.parametrize("block", [16, 1 << 17])
def test_islands(spark, block):
    rows = [r for r in fixture(7) if None not in r and r[1] < r[2]]
    df = spark.createDataFrame(rows, SCHEMA)
    periods = merged(rows, False)
    for r in islands(df, ["k"], "start", "end", block).collect():
        assert r.island == next(a for k, a, b in periods if k == r.k and a <= r.start < b)
    odd = spark.createDataFrame(fixture(7)[-24:], SCHEMA)
    assert islands(odd, ["k"], "start", "end").where(F.col("start").isNull() | F.col("k").isNull()).where(F.col("island").isNotNull()).count() == 0


def folded(rows, key):
    out = []
    for group in {r[:3] for r in rows}:
        kept = []
        for r in sorted({r for r in rows if r[:3] == group}, key=lambda r: (r[3], r[3] - r[4], r[4], r[5] is not None, r[5] or 0)):
            clash = next((k for k in kept if k[3] < r[4] and r[3] < k[4]), None)
            if clash is None:
                kept.append(r)
            elif (key == "longest" and r[4] - r[3] > clash[4] - clash[3]) or (key == "best" and (r[5] or 0) > (clash[5] or 0)):
                kept[kept.index(clash)] = r
        out += kept
    return sorted((*r[:5], r[5] if r[5] is not None else -1) for r in out)


@pytest.mark.parametrize("key", ["longest", "best"])
def test_collapse(spark, key):
    draw = random.Random(6)
    rows = []
    for _ in range(250):
        a = draw.randrange(150)
        rows.append((draw.choice(["r", "q"]), draw.choice(["m", "n"]), draw.choice("+-"), a, a + draw.randint(1, 9), draw.choice([None, 1.0, 2.0, 3.5])))
    df = spark.createDataFrame(rows + rows[:30], "record string, motif string, strand string, start long, end long, score double")
    found = sorted((*tuple(r)[:5], r.score if r.score is not None else -1) for r in collapse(df, ["record"], key).collect())
    assert found == folded(rows, key)


def test_non_overlapping_runs_in_each_strands_direction(spark):
    rows = [("r", "m", s, a, a + 4) for s in "+-" for a in (0, 1, 2, 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "record string, motif string, strand string, start long, end long")
    found = sorted((r.strand, r.start) for r in non_overlapping(df, ["record"]).collect())
    assert found == [("+", 0), ("+", 4), ("-", 2), ("-", 6)]


def test_places_and_coverage(spark):
    rows = [("r", "+", 0, 10), ("r", "+", 5, 12), ("r", "+", 12, 15), ("r", "-", 3, 6), ("q", "+", 50, 70), (None, "+", 1, 2)]
    df = spark.createDataFrame(rows, "record string, strand string, start long, end long")
    assert {(r.record, r.hits, r.places) for r in count_places(df, ["record"]).collect()} == {("r", 4, 3), ("q", 1, 1)}
    assert {(r.record, r.block, r.hits, r.covered) for r in coverage(df, ["record"]).collect()} == {("r", 0, 4, 15), ("q", 0, 1, 10), ("q", 1, 1, 10)}


def test_band_join(spark):
    draw = random.Random(2)
    a = [("s", x, x + 5) for x in (draw.randrange(400) for _ in range(60))]
    b = [("s", x) for x in (draw.randrange(400) for _ in range(60))]
    found = band_join(spark.createDataFrame(a, "k string, start long, end long"), spark.createDataFrame(b, "k string, start long"), ["k"], 3, 20)
    expected = {(k, s, e, max(x - e for _, x in b if 3 <= x - e <= 20)) for k, s, e in a if any(3 <= x - e <= 20 for _, x in b)}
    assert {tuple(r) for r in found.collect()} == expected


def test_elided(spark):
    df = spark.createDataFrame([("a" * 100,), ("short",), (None,)], "t string").select(elided(F.col("t")).alias("t"))
    assert [len(r.t) if r.t else r.t for r in df.collect()] == [60, 5, None]


def test_nan_scores_collapse_as_zero(spark):
    nan = float("nan")
    rows = [("a", 0, 10, nan), ("a", 5, 15, 2.0), ("a", 20, 30, -1.0), ("a", 25, 35, nan), ("a", 50, 60, nan), ("b", 0, 10, 1.0), ("b", 5, 15, nan)]
    df = spark.createDataFrame([(r, "m", "+", s, e, x) for r, s, e, x in rows], "record string, motif string, strand string, start long, end long, score double")
    found = {(r.record, r.start, r.end) for r in collapse(df, ["record"], "best").collect()}
    assert found == {("a", 5, 15), ("a", 25, 35), ("a", 50, 60), ("b", 0, 10)}


def test_collapse_best_reads_hits_of_nan_score(spark, tmp_path):
    row = "1L as record_id, 's' as sequence, 'm' as motif, '+' as strand, 3L as start, 9L as end, double('nan') as score"
    spark.sql(f"select {row}").write.parquet(str(tmp_path / "motif_matches.parquet"))
    assert [(r.start, r.end) for r in QUERIES["collapse_best"](spark, str(tmp_path)).collect()] == [(3, 9)]


def test_one_island_of_a_million_hits(spark):
    hits = spark.range(1_000_000).select(F.lit("s").alias("sequence"), F.lit("m").alias("motif"), F.lit("+").alias("strand"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"), (F.col("id") % 7).cast("double").alias("score"))
    kept = non_overlapping(hits, ["sequence"]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("start") % 5).alias("r")).first()
    assert (kept.n, kept.r) == (200_000, 0)
    best = collapse(hits, ["sequence"], "best").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
    assert best.n > 100_000
    assert best.s is not None
