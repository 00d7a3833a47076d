"""Digests, reading frames, chance, the library, sources, sinks and streams on small tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.alphabet import STARTS, codons, reverse_complement
from strandloom.lang.kernels import kernel
from strandloom.operators import background as chance
from strandloom.operators.search import search
from strandloom.operators import digest as dig
from strandloom.operators import library as lib
from strandloom.operators import orfs as frames
from strandloom.operators import pwm
from strandloom.sources import export, remote, text
from strandloom.streaming.hits import run_to_table, windowed_counts

RECORD = "record_id long, name string, type string, offset long, seq string"
ENZYME = "name string, spec string, site string, cut_top int, cut_bottom int, kind string"
ENZYMES = [("EcoRI", "G^AATTC", "GAATTC", 1, 5, "II"), ("BsaI", "GGTCTC(1/5)", "GGTCTC", 7, 11, "IIS")]


def records(spark, *seqs, kind="dna"):
    return spark.createDataFrame([(i, f"r{i}", kind, 0, s) for i, s in enumerate(seqs, 1)], RECORD)


def test_linear_and_circular_digests(spark):
    r = records(spark, "AAAAGAATTCTTTTGAATTCCCCC", "ACGT", "", None, "AAGAGACCTTTTTTTTTTTT", "GAGACC")
    e = spark.createDataFrame(ENZYMES, ENZYME)
    sites = dig.cut_sites(r, e)
    assert sorted((s.record_id, s.enzyme, s.start, s.strand, s.cut_top) for s in sites.collect()) == [(1, "EcoRI", 4, "+", 5), (1, "EcoRI", 14, "+", 15)]
    found = {}
    for f in dig.fragments(r, sites).collect():
        found.setdefault(f.record_id, []).append((f.from_pos, f.size))
    assert {k: sorted(v) for k, v in found.items()} == {1: [(0, 5), (5, 10), (15, 9)], 2: [(0, 4)], 5: [(0, 20)], 6: [(0, 6)]}
    around = dig.cut_sites(r, e, circular=True)
    assert {(s.record_id, s.strand, s.cut_top) for s in around.where("enzyme = 'BsaI'").collect()} == {(5, "-", 17), (6, "-", 1)}
    sizes = {}
    for f in dig.fragments(r, around, circular=True).collect():
        sizes.setdefault(f.record_id, []).append(f["size"])
    assert {k: sorted(v) for k, v in sizes.items()} == {1: [10, 14], 2: [4], 5: [20], 6: [6]}
    chosen = dig.chosen_enzymes(sites, e).collect()
    assert [(c.enzyme, c.cuts, c.place) for c in chosen] == [("EcoRI", 2, 1)]
    assert dig.gel(dig.fragments(r, sites)).count() == 6
    assert dig.fragments(r.limit(0), dig.cut_sites(r.limit(0), e)).count() == 0


def test_lanes_of_the_chosen_enzymes(spark):
    r = records(spark, "AAAAGAATTCTTTTGAATTCCCCCGGTCTCAAAAAAAAAA", "ACGT")
    found = {}
    for f in dig.digest_lanes(r, spark.createDataFrame(ENZYMES, ENZYME)).collect():
        found.setdefault(f.lane, []).append(f["size"])
    assert {k: sorted(v) for k, v in found.items()} == {0: [5, 9, 10, 16], 1: [9, 31], 2: [5, 10, 25]}


def plain_orfs(seq, least, table=11):
    amino, out = codons(table), set()
    for strand, t in (("+", seq), ("-", reverse_complement(seq))):
        for frame in range(3):
            start = None
            for i in range(frame, len(t) - 2, 3):
                codon = t[i : i + 3]
                if amino.get(codon) == "*":
                    if start is not None and i + 3 - start >= least:
                        a, b = (start, i + 3) if strand == "+" else (len(t) - i - 3, len(t) - start)
                        out.add((a, b, strand, frame))
                    start = None
                elif start is None and codon in STARTS[table]:
                    start = i
    return out


@pytest.mark.parametrize("tile", [9, 60, 3 << 14])
def test_reading_frames(spark, tile):
    draw = random.Random(4)
    seqs = ["".join(draw.choice("ACGTACGTACGTN") for _ in range(n)) for n in (0, 2, 3, 50, 400, 700)] + ["ATG" + "GCT" * 40 + "TAA"]
    found = frames.orfs(records(spark, *seqs), min_length=12, tile=tile)
    assert sorted((r.record_id, r.start, r.end, r.strand, r.frame) for r in found.collect()) == sorted((i, *o) for i, s in enumerate(seqs, 1) for o in plain_orfs(s, 12))


def test_proteins_of_reading_frames(spark):
    r = records(spark, "CC" + "GTG" + "GCT" * 40 + "TAA", "CAT")
    found = frames.orf_proteins(r, frames.orfs(r, min_length=90), piece=30).collect()
    assert [(x.start, x.protein) for x in found if x.strand == "+"] == [(2, "M" + "A" * 40)]


def test_background_and_verdicts(spark):
    r = records(spark, "CACGTG" * 30, "ACGT" * 40, "A", None, "C" * 30)
    rows = {x.record_id: x for x in chance.background(r, '"CACGTG"', trials=20).collect()}
    assert set(rows) == {1, 2, 3, 5}
    assert rows[1].observed == 30
    assert rows[2].observed == 0
    assert rows[1].low <= rows[1].expected <= rows[1].high
    again = {x.record_id: x.expected for x in chance.background(r.repartition(3), '"CACGTG"', trials=20).collect()}
    assert again == {k: x.expected for k, x in rows.items()}
    cases = [(0, 0.1, 1.0, "none"), (9, 1.0, 1 / 41, "strong"), (10, 2.0, 0.1, "strong"), (4, 2.0, 0.2, "some"), (2, 2.0, 0.6, "noise"), (1, 2.0, 0.9, "noise"), (1, None, None, None)]
    df = spark.createDataFrame([c[:3] for c in cases], "o long, e double, p double")
    assert [v.v for v in df.select(chance.verdict(F.col("o"), F.col("e"), F.col("p"), F.lit(40)).alias("v")).collect()] == [c[3] for c in cases]


def test_surrogates_keep_letters_and_successors():
    out = chance.surrogates("ABABABAB", 5, 7)
    assert out == chance.surrogates("ABABABAB", 5, 7)
    assert all(len(s) == 8 and re.fullmatch("B?(AB)*A?", s) for s in out)


def test_background_of_long_records(spark):
    draw = random.Random(3)
    seq = "".join(draw.choice("ACGT") for _ in range(250_000))
    (row,) = chance.background(records(spark, seq), '"CACGTG"', trials=6).collect()
    assert row.observed == seq.count("CACGTG")
    counts = sorted(s.count("CACGTG") for s in chance.surrogates(seq, 6, spark.range(1, 2).select(F.xxhash64("id")).first()[0]))
    assert (row.expected, row.low, row.high) == (sum(counts) / 6, counts[0], counts[-1])
    assert 30 < row.expected < 100
    (pins,) = chance.background(records(spark, seq[:21_000]), "(hairpin (stem 6 7) (loop 3 5))", trials=2).collect()
    assert pins.observed > 0


def test_surrogates_step_by_step():
    text = "ACGTTGCANNACGGTC" * 5 + "B"
    model = chance._model([text[:7], text[7:]])
    assert model == chance._model([text])
    whole = ["".join(x) for x in zip(*chance._drawn(model, 500, 11, 0, 3))]
    assert whole == ["".join(x) for x in zip(*chance._drawn(model, 500, 11, 0, 3, piece=7))]
    assert whole[2] == "".join(x for x, in chance._drawn(model, 500, 11, 2, 1, piece=64))
    follows = {}
    for a, b in zip(text, text[1:]):
        follows.setdefault(a, []).append(b)
    for t, found in enumerate(whole):
        u = np.random.Generator(np.random.Philox(key=[11, 0x5EED + t])).random(500)
        pick = lambda some, x: sorted(some)[min(int(x * len(some) + 1e-9), len(some) - 1)]
        want = pick(text, u[0])
        for x in u[1:]:
            want += pick(follows.get(want[-1], text), x)
        assert found == want


@pytest.mark.parametrize("source", ['"CACGTG"', '(seq "GGA" (gap 2 10) "GGGC")', '(n-terminal (iupac "ANN"))', '(c-terminal (iupac "NNT"))', "(hairpin (stem 4 5) (loop 3 4))", '(fuzzy 1 "CACGTG")'])
def test_counts_in_pieces(spark, source):
    draw = random.Random(5)
    text = "".join(draw.choice("ACGGT") for _ in range(3000))
    _, ahead, _ = kernel(source, True).of_tile(text, (0, 3000), 0, 3000, "both")
    for size in (50, 700):
        assert search(records(spark, text), source, tile=size).count() == len(ahead)


def test_thresholds(spark):
    df = spark.createDataFrame([("m", float(i)) for i in range(100)] + [("m", None), ("m", float("nan")), (None, 1.0), ("n", 5.0), ("n", 5.0)], "motif string, score double")
    rows = {r.motif: r for r in chance.calibrated_thresholds(df, 0.1).collect()}
    assert (rows["m"].scores, rows["m"].threshold) == (100, 89.0)
    assert rows["m"].achieved == pytest.approx(0.11)
    assert rows["n"].achieved == 1.0


def test_library_text(spark):
    source = """
    ; a comment
    (defmotif e-box "An
       E box." (iupac "CANNTG") :category promoter :ref "PubMed 123" :example "CACGTG")
    (defmotif pair (seq e-box (gap 1 2) e-box) :category mirna :scan #f)
    (defmotif early (seq later "A"))
    (defmotif later "ACGT")
    (defmotif later "ACG")
    (defenzyme EcoRI "G^AATTC") (defenzyme Bad "GAATTC") (other 1) (defmotif none "doc")
    """
    entries, errors = lib.load_library(spark, [("own.mtf", source)])
    rows = {r.name: r for r in entries.collect()}
    assert set(rows) == {"e-box", "pair", "later", "EcoRI", "none"}
    assert rows["e-box"].doc == "An E box."
    assert rows["pair"].alphabet == "rna"
    assert not rows["pair"].scan
    assert rows["later"].expr == '"ACG"'
    assert rows["EcoRI"].example == "GAATTC"
    assert {r.name for r in errors.collect()} == {"early", "Bad"}
    assert {(r.name, r.matched) for r in lib.check_examples(entries).collect()} == {("e-box", True), ("EcoRI", True)}
    draft = lib.verify_draft(spark, '(iupac "CANNTG")', ["TTCACGTGTT", "GGGG"], ["AAAA", "CAGCTG"]).collect()
    assert sorted((d.example, d.ok) for d in draft) == [("AAAA", True), ("CAGCTG", False), ("GGGG", False), ("TTCACGTGTT", True)]


def test_natural_order_and_finding(spark):
    names = ["mir155", "mir21", "Mir3", "minus-10", "minus-35"]
    df = spark.createDataFrame([(n, "x", "c", None, "dna") for n in names], "name string, doc string, category string, ref string, alphabet string")
    found = lib.find_entries(df, "MI").orderBy("place").collect()
    assert [r.name for r in found] == ["minus-10", "minus-35", "Mir3", "mir21", "mir155"]
    assert lib.find_entries(df, "nothing").count() == 0


def test_species(spark):
    species = spark.createDataFrame([("homo_sapiens", "Human", "human", "G", ["man"]), ("mus_musculus", "Mouse", None, "M", None)], "name string, display string, common string, assembly string, aliases array<string>")
    typed = spark.createDataFrame([("homo_sapein",), ("Homo sapiens",), ("MAN",), ("mouse",), ("mus_m",), ("zebra",), ("",), (None,)], "typed string")
    assert {r.typed: r.suggestion for r in lib.suggest_species(typed, species).collect()} == {"homo_sapein": "homo_sapiens", "MAN": "homo_sapiens", "mouse": "mus_musculus", "mus_m": "mus_musculus", "zebra": None}


def test_weights(spark):
    df = spark.createDataFrame([("m", s) for s in ["TATAAA"] * 9 + ["TATAAT", "TAT", None, ""]] + [(None, "A")], "motif string, match string")
    trained = pwm.train(pwm.aligned_sites(df))
    assert trained.count() == 24
    assert [tuple(r) for r in pwm.consensus(trained).collect()] == [("m", 6, "TATAAA")]
    from strandloom.lang.motif import pwm_from_sites

    rows = dict(pwm_from_sites(["TATAAA"] * 9 + ["TATAAT"]).rows)
    assert all(r.weight == pytest.approx(rows[r.letter][r.pos]) for r in trained.collect())


def test_fasta_and_genbank(spark):
    texts = [
        (1, ";c\njunk\n>a first one\r\nAC GT\n\n;x\nacgt\n>b\n>c \nMKV"), (2, "ACGT 12\nacg*-"), (3, ""), (4, None),
        (5, "LOCUS       X1 9 bp\nDEFINITION  Some\n            thing.\nORIGIN\n        1 acgta cgt\n//\nLOCUS       P 3 aa\nORIGIN\n 1 mkv\n//\nLOCUS only\n"),
    ]
    found = text.parse_sequences(spark.createDataFrame(texts, "id long, text string"))
    assert sorted((r.id, r.name, r.description, r.type, r.seq) for r in found.where("id < 5").collect()) == [(1, "a", "first one", None, "ACGTacgt"), (1, "b", "", None, ""), (1, "c", "", None, "MKV"), (2, "sequence", "", None, "ACGTacg*-")]
    assert sorted((r.name, r.description, r.type, r.seq) for r in found.where("id = 5").collect()) == [("P", "", "protein", "mkv"), ("X1", "Some thing", None, "acgtacgt")]


def test_fasta_files(spark, tmp_path):
    rows = [(f"r{i}", f"number {i}" if i % 2 else "", "ACGT" * i) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "name string, description string, seq string")
    text.write_fasta(df.repartition(3), str(tmp_path / "out"))
    for read in (text.read_fasta, text.read_sequences):
        assert sorted((r.name, r.description, r.seq) for r in read(spark, str(tmp_path / "out")).collect()) == sorted(rows)


def test_matrices(spark):
    found = text.matrices(spark.createDataFrame([(">MA1.1 NAME\nA [ 1 2 ]\nC [ 0 0 ]\nG [ 3 0 ]\nT [ 0 2 ]\n",)], "text string"))
    assert found.count() == 8
    assert found.where("letter = 'G' and pos = 0").first()["count"] == 3.0


def test_exports(spark, tmp_path):
    rows = [("s", "m;1", 102, 106, "+", "ACGT", 2.5, {"mismatches": 1.0}, [("box", 102, 104, "AC")]), (None, "n", 5, 9, "-", "AAAA", None, {}, []), ("t", "x", None, 3, "+", "A", 1.0, {}, [])]
    df = spark.createDataFrame(rows, "sequence string, motif string, start long, end long, strand string, match string, score double, extra map<string,double>, bindings array<struct<label:string,start:long,end:long,text:string>>")
    kinds = {k: [r.value for r in export.lines(df, k).collect()] for k in ("tsv", "bed", "gff3", "json")}
    assert kinds["tsv"] == ["s\tm;1\t103\t106\t4\t+\tACGT\tscore=2.5;mismatches=1;box=AC", "\tn\t6\t9\t4\t-\tAAAA\t"]
    assert kinds["bed"] == ["s\t102\t106\tm;1\t2.5\t+", "sequence\t5\t9\tn\t0\t-"]
    assert kinds["gff3"][0] == "s\tstrandloom\tsequence_motif\t103\t106\t2.5\t+\t.\tName=m%3B1;matched_sequence=ACGT"
    assert '"start":103' in kinds["json"][0]
    export.write_hits(df.coalesce(1), str(tmp_path / "bed"), "bed")
    assert spark.read.text(str(tmp_path / "bed")).first().value.startswith("track name=")


def answer(url):
    if "NM_1" in url:
        return 200, ">NM_1 first\nACGT\n"
    return {"HBB": (404, "")}.get(url.rsplit("/", 1)[-1].split("?")[0], (429, "7"))


def test_remote_source(spark):
    assert remote.route("NM_000518") == "ncbi"
    assert remote.route("two words") is None
    assert "region/homo_sapiens/11:5..9:1" in remote.url_of("ensembl", "chr11:5-9")
    with pytest.raises(remote.SourceError, match="7 s"):
        remote.checked(*answer("x"), "NCBI", "x")
    with pytest.raises(remote.SourceError, match="no record"):
        remote.checked(*answer("/HBB?"), "Ensembl", "HBB")
    for status in (0, 500, 302):
        with pytest.raises(remote.SourceError):
            remote.checked(status, "", "ENA", "x")
    reader = remote.SequenceSource({"ids": "NM_1; ", "opener": f"{__name__}:answer"}).reader(None)
    assert [list(reader.read(p)) for p in reader.partitions()] == [[("NM_1", "ncbi", ">NM_1 first\nACGT\n")]]


def test_stream_counts(spark, tmp_path):
    rows = [("2025-01-01 05:00:00", "+"), ("2025-01-01 06:00:00", "+"), ("2025-01-02 06:00:00", None), (None, "+")]
    df = spark.createDataFrame(rows, "t string, strand string").select(F.col("t").cast("timestamp").alias("scanned_at"), "strand")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = run_to_table(windowed_counts(stream), ["window_start", "strand"])
    assert sorted((r.window_start.day, r.strand, r.hits) for r in found.collect()) == [(1, "+", 2), (2, ".", 1)]
