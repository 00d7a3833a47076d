"""Problem 4: every piece within its limit, the overlaps exact, the letters whole."""

import random
import re

from strandloom.llm.splitting import split_records, unbroken_stretches

SCHEMA = "record_id long, type string, offset long, seq string, piece long, _n long"
LIMITS = [("dna", 100, 10), ("protein", 80, 0), ("rna", 90, 40), (None, 5, 1)]


def fixture():
    draw = random.Random(9)
    text = lambda n, letters: "".join(draw.choice(letters) for _ in range(n))
    rows = []
    for i in range(60):
        kind = draw.choice(["dna", "rna", "protein", None, "other"])
        filler = "X" if kind == "protein" else "N"
        seq = "".join(text(draw.randrange(150), "ACGT") + filler * draw.choice([0, 5, 9, 10, 11, 40]) for _ in range(draw.randrange(8)))
        rows.append((i, kind, draw.choice([None, 0, 1000]), seq.lower() if i % 2 else seq, 1, 1))
    rows += [(100, "dna", None, None, 1, 1), (101, "dna", 3, "", 1, 1), (102, "dna", 5, "N" * 500, 1, 1), (103, "dna", 0, "A" * 100, 1, 1), (104, "dna", 0, "A" * 101, 1, 1), (105, "dna", 7, "ACGT\n" * 30_000, 1, 1)]
    return rows


def test_pieces_cover_the_record(spark):
    rows = fixture()
    limits = {k: (a, b) for k, a, b in LIMITS if k}
    found = {}
    for r in split_records(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(LIMITS, "type string, max_letters int, overlap_letters int"), tile=256).collect():
        found.setdefault(r.record_id, []).append(r)
    expected = set()
    for record_id, kind, offset, seq, *_ in rows:
        letters = re.sub("[^A-Za-z]", "", seq or "").upper()
        if kind not in limits or len(letters) <= limits[kind][0]:
            continue
        expected.add(record_id)
        most, overlap = limits[kind]
        pieces = sorted(found[record_id], key=lambda p: p.piece)
        at = 0
        for k, p in enumerate(pieces):
            start = p.offset - (offset or 0)
            assert start == (0 if k == 0 else at - overlap)
            assert 0 < p.length <= most
            assert p.seq == letters[start : start + p.length]
            at = start + p.length
        assert at == len(letters)
        assert len(pieces) >= -(-(len(letters) - overlap) // (most - overlap))
    assert set(found) == expected


def test_cuts_take_natural_boundaries(spark):
    seq = ("A" * 80 + "N" * 12) * 5
    df = spark.createDataFrame([(1, "dna", 0, seq, 1, 1)], SCHEMA)
    pieces = split_records(df, spark.createDataFrame(LIMITS, "type string, max_letters int, overlap_letters int")).collect()
    assert sum(p.natural for p in pieces) >= 4


def test_no_artificial_cut_where_a_boundary_fits(spark):
    draw = random.Random(21)
    rows = fixture()
    # The only boundary lies in the last half step; only an added cut can take one.
    rows += [(200, "dna", 0, "A" * 150 + "N" * 10 + "A" * 20, 1, 1), (201, "protein", 0, "A" * 60 + "X" * 10 + "A" * 45, 1, 1), (202, "dna", 0, "A" * 30 + "N" * 12 + "A" * 70, 1, 1)]
    rows += [(300 + i, "dna", 0, "".join("A" * draw.randrange(20, 160) + "N" * draw.randrange(10, 14) for _ in range(12)), 1, 1) for i in range(20)]
    limits = {k: (a, b) for k, a, b in LIMITS if k}
    found = {}
    for r in split_records(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(LIMITS, "type string, max_letters int, overlap_letters int")).collect():
        found.setdefault(r.record_id, []).append(r)
    inner = 0
    for record_id, kind, offset, seq, *_ in rows:
        if record_id not in found:
            continue
        letters = re.sub("[^A-Za-z]", "", seq or "").upper()
        most, overlap = limits[kind]
        places = [m.start() + len(m[0]) // 2 for m in re.finditer("X{10,}" if kind == "protein" else "N{10,}", letters)]
        pieces = sorted(found[record_id], key=lambda p: p.piece)
        ends = [(p.offset - (offset or 0) + p.length, p.natural) for p in pieces]
        assert all(p.length <= most for p in pieces)
        for k, (at, natural) in enumerate(ends[:-1]):
            inner += 1
            left, right = ends[k - 1][0] if k else 0, ends[k + 1][0]
            if natural:
                assert at in places
            else:
                assert not [x for x in places if max(left, overlap) < x < right and x - left <= most - (overlap if k else 0) and right - x <= most - overlap]
    assert inner > 100
    assert [p.natural for p in found[202]] == [True, True]


def test_stretches_match_brute_force(spark):
    rows = fixture()
    limits = {k: a for k, a, _ in LIMITS if k}
    expected = []
    for record_id, kind, offset, seq, *_ in rows:
        letters = re.sub("[^A-Za-z]", "", seq or "").upper()
        if kind in limits and len(letters) > limits[kind]:
            at = 0
            for m in [*re.finditer("X{10,}" if kind == "protein" else "N{10,}", letters), None]:
                end = m.start() if m else len(letters)
                if end - at > limits[kind]:
                    expected.append((record_id, at + (offset or 0), end + (offset or 0)))
                at = m.end() if m else end
    found = unbroken_stretches(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(LIMITS, "type string, max_letters int, overlap_letters int"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_empty_tables(spark):
    limits = spark.createDataFrame(LIMITS, "type string, max_letters int, overlap_letters int")
    records = spark.createDataFrame([], SCHEMA)
    assert split_records(records, limits).count() == 0
    assert unbroken_stretches(records, limits).count() == 0
    assert split_records(spark.createDataFrame(fixture(), SCHEMA), limits.limit(0)).count() == 0
