"""Searches on tables against the backtracking matcher on whole strands."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandloom.alphabet import reverse_complement
from strandloom.lang.kernels import backtracking, kernel
from strandloom.lang.motif import MotifError, motif
from strandloom.operators.named import motif_view, register_motif
from strandloom.operators.search import absolute, first_hits, scan, search, usable_motifs, whole_matches

from test_motif import random_motif

SCHEMA = "record_id long, name string, type string, offset long, seq string, tile long, _t string"
RECORDS = [
    (1, "a", "dna", 10, "TTACGTTTgaattcTTTGACAttgacaTATAATCCGGGGCCTTTTGGCCCC", 1, "x"), (2, "b", "rna", None, "AUGGCU UAAGAAUUCNNNNACGU", 1, "x"), (3, "c", "protein", 5, "MNGSAANPSAANKTQ", 1, "x"),
    (4, None, None, 0, "acgt\nacgtGAATTC", 1, "x"), (5, "e", "dna", 0, None, 1, "x"), (6, "f", "dna", 0, "", 1, "x"), (7, "g", "dna", 0, "12 34", 1, "x"), (8, "h", "dna", 0, "ACGT" * 300 + "GAATTC" + "TTGACA" * 50, 1, "x"), (8, "h", "dna", 0, "GAATTC", 1, "x"),
]


def brute(source):
    node, out = motif(source), []
    for record_id, _, kind, _, seq, *_ in RECORDS:
        t = re.sub("[^A-Za-z]", "", seq or "").upper()
        nuc = kind != "protein"
        t = t.replace("U", "T") if nuc else t
        f, n = backtracking(node, nuc), len(t)
        found = {(i, j, t[i:j]) for i, j, _, _ in f(t, 0, n)} if t else set()
        out += [(record_id, i, j, "+", x) for i, j, x in found]
        if nuc and t:
            back = reverse_complement(t)
            out += [(record_id, n - j, n - i, "-", back[i:j]) for i, j, _, _ in f(back, 0, n) if (n - j, n - i, back[i:j]) not in found]
    return sorted(out)


@pytest.mark.parametrize("tile", [23, 1 << 15])
@pytest.mark.parametrize("source", ['"GAATTC"', '(iupac "CANNTG")', '(seq "TT" (gap 1 6) "CA")', '(fuzzy 1 "TTGACA")', "(hairpin (stem 4 6) (loop 3 5))", '(edit 1 "GAATTC")', '(n-terminal (iupac "NN"))', '(c-terminal (iupac "NN"))', '(repeat "ACGT" 3)', '(seq (alt (fuzzy 1 "TTG") "CC") (gap 0 3) "A")', '(regex "TT+G")'])
def test_every_hit_once(spark, source, tile):
    hits = search(spark.createDataFrame(RECORDS, SCHEMA), source, tile=tile)
    assert sorted((r.record_id, r.start, r.end, r.strand, r.match) for r in hits.collect()) == brute(source)


@pytest.mark.parametrize("tile", [5, 1 << 10])
def test_a_table_of_random_motifs_equals_backtracking(spark, tile):
    draw = random.Random(17 + tile)
    sources = sorted({random_motif(draw) for _ in range(150)})
    texts = ["".join(draw.choice("ACGTN") for _ in range(draw.randint(1, 30))) for _ in range(12)] + ["ACGT" * 40, "GATC" * 30 + "AAAA"]
    records = spark.createDataFrame([(i, "r", "dna", 0, t) for i, t in enumerate(texts)], "record_id long, name string, type string, offset long, seq string")
    motifs = spark.createDataFrame([(str(k), s, "dna") for k, s in enumerate(sources)] + [("bad", "(seq", None)], "name string, expr string, alphabet string")
    found = {}
    for r in search(records, motifs, tile=tile).collect():
        bound = sorted((b.label, b.start, b.end, b.text) for b in r.bindings)
        found.setdefault((int(r.motif), r.record_id), []).append((r.start, r.end, r.strand, r.match, dict(r.extra), bound))
    for k, source in enumerate(sources):
        for i, text in enumerate(texts):
            n = len(text)
            (a, b, numbers, bounds), ahead, shown = kernel(source, True).of_tile(text, (0, n), 0, n, "both")
            want = []
            for x in range(len(shown)):
                read = lambda p, q, x=x: text[p:q] if ahead[x] else reverse_complement(text[p:q])
                bound = sorted((label, int(p[x]), int(q[x]), read(p[x], q[x])) for label, (p, q) in bounds.items() if p[x] >= 0)
                want.append((int(a[x]), int(b[x]), "+" if ahead[x] else "-", shown[x], {m: v[x] for m, v in numbers.items() if v[x] == v[x]}, bound))
            assert sorted(found.get((k, i), []), key=str) == sorted(want, key=str), (source, text)


def test_regular_motifs_stay_in_the_jvm(spark):
    df = spark.createDataFrame(RECORDS, SCHEMA)
    for source in ('"GAATTC"', '(iupac "TATAWAWR")', '(seq (fuzzy 1 "TTGACA") (gap 15 19) (fuzzy 1 "TATAAT"))', '(seq (named \'x "GG") "AA")', '(regex "TT+G")', '(n-terminal (iupac "NN"))'):
        plan = search(df, source)._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan.replace("ENSURE", "") or "regex" in source
    assert "MapInArrow" in search(df, '(edit 1 "GAATTC")')._jdf.queryExecution().executedPlan().toString()


def test_strands_offsets_and_bindings(spark):
    df = spark.createDataFrame([(1, "a", "dna", 100, "TTTTGGAAC")], "record_id long, name string, type string, offset long, seq string")
    assert [(r.start, r.end, r.strand) for r in search(df, '"AAAA"').collect()] == [(0, 4, "-")]
    assert search(df, '"AAAA"', strand="+").count() == 0
    row = absolute(search(df, "(seq (named 'x \"GG\") \"AA\")")).first()
    assert (row.start, row.end) == (104, 108)
    assert [tuple(b) for b in row.bindings] == [("x", 104, 106, "GG")]
    row = absolute(search(df, "(seq \"GT\" (named 'y \"TC\"))")).first()
    assert (row.start, row.end, row.strand, [tuple(b) for b in row.bindings]) == (105, 109, "-", [("y", 105, 107, "TC")])


def test_limit_keeps_one_at_least(spark):
    df = spark.createDataFrame([(1, "a", "dna", 0, "AAAAA")], "record_id long, name string, type string, offset long, seq string")
    hits = search(df, '"A"')
    assert sorted(r.start for r in first_hits(hits, 2).collect()) == [0, 1]
    assert first_hits(hits, 0).count() == 1


def test_library_scan(spark):
    library = spark.createDataFrame(
        [("site", '"GAATTC"', "dna", "x", True), ("glyc", '(prosite "N-{P}-[ST]-{P}")', "protein", "x", None), ("off", '"A"', "dna", "x", False), ("cut", '"A"', "dna", "Restriction", True), ("bad", "(seq", "dna", "x", True), (None, '"A"', "dna", "x", True), ("none", None, "dna", "x", True)],
        "name string, expr string, alphabet string, category string, scan boolean",
    )
    good, bad = usable_motifs(library)
    assert [g[0] for g in good] == ["glyc", "site"]
    assert [b[0] for b in bad] == ["bad"]
    counts = {r.motif: r["count"] for r in scan(spark.createDataFrame(RECORDS, SCHEMA), library).groupBy("motif").count().collect()}
    assert counts == {"site": 5, "glyc": 2}
    assert scan(spark.createDataFrame(RECORDS, SCHEMA), library.limit(0)).count() == 0


def test_errors_come_before_the_job_and_empty_tables_work(spark):
    df = spark.createDataFrame(RECORDS, SCHEMA)
    with pytest.raises(MotifError):
        search(df, '(fuzzy 1 (run "A" 2))')
    assert search(df.limit(0), '"A"').count() == 0
    assert search(df.where(F.col("record_id") == 5), '"A"').count() == 0


def test_whole_matches_of_every_motif(spark):
    library = [("gap", '(seq "ATC" (gap 2 7) "TGAC")', "dna"), ("near", '(fuzzy 1 "ACGTAC")', "dna"), ("codes", '(iupac "ATWN")', None), ("site", '(prosite "N-{P}-[ST]")', "protein"), ("edit", '(edit 1 "GATTC")', "dna"), ("pin", "(hairpin (stem 2 3) (loop 1 2))", "dna"), ("bad", "(seq", "dna")]
    texts = ["ATCAATGAC", "ATCATGAC", "atcaauugac", "ACGTAC", "ACGTAA", "ACGAAA", "ATAN", "ATAC", "ATCC", "NAS", "NPS", "GATTC", "GATC", "GATTTC", "GTTC", "GTC", "GCAGC", "GCATGC", "GCATTGC", "", None]

    def distance(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(distance(a[1:], b) + 1, distance(a, b[1:]) + 1, distance(a[1:], b[1:]) + (a[0] != b[0]))

    def pinned(t):
        pairs = {"AT", "TA", "GC", "CG"}
        return any(len(t) == 2 * s + g and all(t[k] + t[-1 - k] in pairs for k in range(s)) for s in (2, 3) for g in (1, 2))

    brute = {
        "gap": lambda t: t[:3] == "ATC" and t[-4:] == "TGAC" and 9 <= len(t) <= 14,
        "near": lambda t: len(t) == 6 and sum(a != b for a, b in zip(t, "ACGTAC")) <= 1,
        "codes": lambda t: len(t) == 4 and t[:2] == "AT" and t[2] in "AT" and t[3] in "ACGT",
        "site": lambda t: len(t) == 3 and t[0] == "N" and t[1] != "P" and t[2] in "ST",
        "edit": lambda t: t != "" and distance(t, "GATTC") <= 1,
        "pin": pinned,
    }
    names = [*brute, "bad", "unknown", None]
    rows = [(i, n, t) for i, (n, t) in enumerate((n, t) for n in names for t in texts)]
    found = {r.match_id: r.whole for r in whole_matches(spark.createDataFrame(rows, "match_id long, motif string, match string"), spark.createDataFrame(library, "name string, expr string, alphabet string")).collect()}
    ready = lambda n, t: t.upper() if n == "site" else t.upper().replace("U", "T")
    assert found == {i: brute[n](ready(n, t)) if n in brute and t is not None else None for i, n, t in rows}
    assert sum(x is True for x in found.values()) >= 12


def test_motifs_by_name_in_sql(spark):
    assert register_motif(spark, "ebox", '(iupac "CANNTG")') == ["ebox_whole", "ebox_in", "ebox_starts"]
    register_motif(spark, "early", '(n-terminal "AC")')
    texts = ["cacgtg", "TTCAcg\nUGCAAATG", "ACAC", "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").createOrReplaceTempView("some_texts")
    rows = spark.sql("select ebox_whole(t) w, ebox_in(t) b, ebox_starts(t) s, early_starts(t) e from some_texts order by i").collect()
    assert [tuple(r) for r in rows] == [(True, True, [0], []), (False, True, [2, 8], []), (False, False, [], [0]), (False, False, [], []), (None, None, None, None)]
    for bad in ('(edit 1 "ACGT")', '(regex "A+")'):
        with pytest.raises(MotifError):
            register_motif(spark, "x", bad)
    with pytest.raises(MotifError):
        register_motif(spark, "x y", '"A"')
    motif_view("hits", spark.createDataFrame(RECORDS, SCHEMA), '"GAATTC"')
    assert spark.sql("select count(*) n from hits").first().n == 5
