"""Problem 3 against all windows of a small fixture."""

import random
import re

import pytest

from strandloom.llm.spans import shared_share, shared_spans


def brute(rows, length):
    texts = {i: re.sub("[^A-Za-z]", "", s or "").upper() for i, s, *_ in rows if i is not None}
    owners = {}
    for i, t in texts.items():
        for p in range(len(t) - length + 1):
            owners.setdefault(t[p : p + length], set()).add(i)
    out = []
    for i, t in texts.items():
        marked = [False] * len(t)
        for p in range(len(t) - length + 1):
            if len(owners[t[p : p + length]]) > 1:
                marked[p : p + length] = [True] * length
        out += [(i, m.start(), m.end()) for m in re.finditer("1+", "".join("01"[x] for x in marked))]
    return sorted(out)


def fixture(seed):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    base = text(400)
    rows = []
    for i in range(60):
        kind = draw.randrange(7)
        a = draw.randrange(300)
        piece = base[a : a + draw.randrange(15, 100)]
        rows.append((i, [text(draw.randrange(60)), piece, text(30) + piece + text(20), piece.lower() + "\n12 " + text(10), "N" * draw.randrange(60) + text(25), "CT" * 20 + text(9), "A" * 45][kind], "x", 3))
    rows += [(100, None, None, None), (101, "", None, None), (102, "12 34", None, None), (103, base, None, None), (104, text(20) + base[:200] + base[:200], None, None), (105, base, None, None)]
    return rows


@pytest.mark.parametrize(("seed", "length", "tile"), [(1, 20, 1 << 15), (2, 20, 64), (3, 21, 37), (4, 13, 50)])
def test_matches_brute_force(spark, seed, length, tile):
    rows = fixture(seed)
    df = spark.createDataFrame(rows, "record_id long, seq string, _id string, tile long")
    found = sorted(tuple(r) for r in shared_spans(df, length, tile, block=128).collect())
    assert found == brute(rows, length)


def test_share_counts_every_record_with_letters(spark):
    df = spark.createDataFrame([(1, "ACGTACGTTT"), (2, "CCACGTACGTG"), (3, "GGGG"), (4, "")], "record_id long, seq string")
    assert {r.record_id: (r.letters, r.shared) for r in shared_share(df, length=8).collect()} == {1: (10, 8), 2: (11, 8), 3: (4, 0)}


def test_empty_table(spark):
    assert shared_spans(spark.createDataFrame([], "record_id long, seq string")).count() == 0
