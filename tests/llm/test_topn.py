"""Problem 5 against a sort of every group."""

import math
import random

import pytest

from strandloom.llm.topn import best_matches, top_n

SCHEMA = "match_id long, sequence string, motif string, score double, start long, _v double, rank long"


def data():
    draw = random.Random(1)
    value = lambda: draw.choice([None, float("nan"), 1.0, 1.0, 2.5, -0.0, 0.0, draw.random() * 10])
    out = [(i, draw.choice(["s", "s", "t", None]), draw.choice(["m", "n", None]), value(), draw.choice([None, 1, 2, 3]), 1.0, 1) for i in range(400)]
    return out + [(1000 + i, "hot", "m", 5.0 if i % 3 else float("-inf"), 4, None, None) for i in range(300)] + [(2000 + i, "nulls", "m", None, None, None, None) for i in range(100)]


def brute(rows, n):
    groups = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            groups.setdefault((r[1], r[2]), []).append(r)
    bad = lambda s: s is None or math.isnan(s)
    order = lambda r: (bad(r[3]), 0 if bad(r[3]) else -r[3], r[4] is None, r[4] or 0, r[0])
    return sorted(r[0] for g in groups.values() for r in sorted(g, key=order)[:n])


@pytest.mark.parametrize("options", [{}, {"hot": 30, "ranges": 8, "salts": 3}, {"hot": 0, "ranges": 1, "salts": 1}])
def test_matches_brute_force(spark, options):
    rows = data()
    found = best_matches(spark.createDataFrame(rows, SCHEMA), **options)
    assert sorted(r.match_id for r in found.collect()) == brute(rows, 3)


def test_infinite_scores_and_equal_ranges(spark):
    rows = [(i, "s", "m", float("inf") if i == 7 else float("-inf"), i, None, None) for i in range(50)]
    found = top_n(spark.createDataFrame(rows, SCHEMA), ["sequence", "motif"], "score", ["start", "match_id"], 2, hot=5)
    assert [(r.match_id, r["rank"]) for r in found.orderBy("rank").collect()] == [(7, 1), (0, 2)]


def test_empty_table(spark):
    assert best_matches(spark.createDataFrame([], SCHEMA)).count() == 0
