"""Problem 1 against a brute-force grouping."""

import random
import re

from strandloom.llm.duplicates import distinct_records, formatting_duplicates

SCHEMA = "record_id long, name string, seq string, type string, _key string, copies long"


def brute(rows):
    groups = {}
    for record_id, name, seq, *_ in rows:
        letters = re.sub("[^A-Za-z]", "", seq or "").upper()
        fields = sorted(f for f in (re.sub("[^A-Za-z0-9]", "", x).lower() for x in re.split("[|;,]", name or "")) if f)
        if letters and fields:
            groups.setdefault((letters, tuple(fields)), []).append(record_id)
    return sorted((r, min(g), len(g)) for g in groups.values() for r in g)


def rows():
    draw = random.Random(5)
    out = [(i, draw.choice(["a|b", "B;a", "a,b,a", " A | b-", "", None, "|;", "x1"]), draw.choice(["AC gt", "acgt", "A-C\nG T", "", None, "123", "ACG", "ÄACGT"]), None, "clash", 7) for i in range(300)]
    return out + [(1000 + i, "hot", "gattaca" * 5, "dna", None, None) for i in range(200)]


def test_groups_match_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for options in ({}, {"hot": 20, "salts": 4}):
        found = sorted(tuple(r) for r in formatting_duplicates(df, **options).select("record_id", "keep_id", "copies").collect())
        assert found == brute(data)


def test_one_row_a_group(spark):
    data = rows()
    kept = {r.keep_id: r.copies for r in distinct_records(spark.createDataFrame(data, SCHEMA), hot=50).collect()}
    assert kept == {k: n for r, k, n in brute(data) if r == k}


def test_long_text_and_empty_table(spark):
    long = "ACGT" * 200_000
    df = spark.createDataFrame([(1, "n", long), (2, "N", long.lower() + "\n")], "record_id long, name string, seq string")
    assert [tuple(r) for r in distinct_records(df).collect()] == [(1, 2)]
    assert formatting_duplicates(df.limit(0)).count() == 0
