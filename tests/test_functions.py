"""Scalar functions on hand-made values."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.alphabet import IUPAC, codons
from strandloom.functions import identifiers as ids
from strandloom.functions import sequence as seqs
from strandloom.functions.letters import letters, tiles
from strandloom.plans.queries import QUERIES


def values(spark, column, texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("column", "given", "expected"),
    [
        (seqs.complement, ["ACGTacgt-RYN", "AUGC", "AUT", "Z!", "", None], ["TGCAtgca-YRN", "UACG", "TAA", "NN", "", None]),
        (seqs.reverse_complement, ["GAATTC", "AAC", "acg", "", None], ["GAATTC", "GTT", "cgt", "", None]),
        (seqs.transcribe, ["ATt", None], ["AUu", None]),
        (seqs.guess_type, ["ACGT", "ACGU", "ACGTU", "MKV", "", " -*", "ACGTACGTACGTACGTACGX", None], ["dna", "rna", "dna", "protein", "dna", "dna", "dna", None]),
        (seqs.gc_content, ["ACGT", "GGSS", "nnn", "SSG", "", None], [0.5, 2.0, 0.0, 3.0, 0.0, None]),
        (seqs.melting_temp, ["", "ACGT", "ACGTN", "ACGTACGTACGTAC", None], [0.0, 12.0, 12.0, 64.9 + 41 * (7 - 16.4) / 14, None]),
        (lambda c: seqs.translate(c), ["ATGGCTTAA", "AGA", "CTN", "ATN", "ATGAA", "AUG", "", None, "NNN", "ATG?GG"], ["MA*", "R", "L", "X", "M", "M", "", None, "X", "MX"]),
        (lambda c: seqs.translate(c, table=2), ["AGA", "ATA"], ["*", "M"]),
        (lambda c: seqs.translate(c, frame=1), ["AATGGCT"], ["MA"]),
        (lambda c: seqs.translate(c, table=11, to_stop=True, start_as_met=True), ["GTGGTGTAAGTG", "TAA", "ACGGTG"], ["MV", "", "TV"]),
        (seqs.to_iupac, ["AG", "gu", "ACGT", "AXG", "", None, "TTT"], ["R", "K", "N", "N", "N", None, "T"]),
        (seqs.concrete_site, ["GRNTC", None], ["GAATC", None]),
        (ids.detect_source, ["NM_000518.5", "HBB", "P69905", "AB123456", "ENSG00000244734", "11:5225464-5229395", "two words", "", None], ["ncbi", "ensembl", "uniprot", "ncbi", "ensembl", "ensembl", None, None, None]),
        (ids.ensembl_description, ["beta [Source:HGNC Symbol;Acc:1]", None], ["beta", ""]),
        (ids.ensembl_coordinates, ["chromosome:GRCh38:11:5225464:5229395:-1", "x", None], ["chromosome 11:5,225,464-5,229,395 on the minus strand of GRCh38", "", ""]),
        (ids.ensembl_assembly, ["chromosome:GRCh38:11:1:2:1", "x"], ["GRCh38", ""]),
        (ids.escape_html, ['<a & "b">'], ["&lt;a &amp; &quot;b&quot;&gt;"]),
        (ids.prose, ["a **b** <c>"], ["a <strong>b</strong> &lt;c&gt;"]),
        (ids.uri_component, ["a b!'()*~é"], ["a%20b!'()*~%C3%A9"]),
    ],
)
def test_values(spark, column, given, expected):
    found = values(spark, column, given)
    assert found == [pytest.approx(e) if isinstance(e, float) else e for e in expected]


def test_translation_of_all_codons(spark):
    draw = random.Random(1)
    for table in (1, 2, 11):
        plain = codons(table)
        texts = ["".join(draw.choice(list(IUPAC)) for _ in range(30)) for _ in range(20)] + list(plain)

        def brute(text, plain=plain):
            out = ""
            for i in range(0, len(text) - 2, 3):
                options = [""]
                for c in text[i : i + 3].replace("U", "T"):
                    options = [o + b for o in options for b in IUPAC[c]]
                found = {plain[o] for o in options}
                out += found.pop() if len(found) == 1 else "X"
            return out

        assert values(spark, lambda c, table=table: seqs.translate(c, table), texts) == [brute(t) for t in texts]


def test_expansion_stops_at_its_bound(spark):
    assert values(spark, seqs.expand_iupac, ["AR", "A", "", "Z"]) == [["AA", "AG"], ["A"], [""], ["Z"]]
    (many,) = values(spark, lambda c: seqs.expand_iupac(c, 16), ["NNNNN"])
    assert len(many) == 64


def test_sites(spark):
    specs = ["G^AATTC", "GGTAC^C", "CCC^GGG", "GGTCTC(1/5)", "GTGCAG(16/14)", "G_AAT^TC", "GAATTC", None]
    found = values(spark, seqs.parse_site, specs)
    assert [tuple(x) if x else None for x in found] == [("GAATTC", 1, 5, "II"), ("GGTACC", 5, 1, "II"), ("CCCGGG", 3, 3, "II"), ("GGTCTC", 7, 11, "IIS"), ("GTGCAG", 22, 20, "IIS"), ("GAATTC", 5, 1, "II"), None, None]
    hang = values(spark, lambda c: seqs.overhang(seqs.parse_site(c)["cut_top"], seqs.parse_site(c)["cut_bottom"]), specs[:5])
    assert hang == ["5' overhang of 4", "3' overhang of 4", "blunt", "5' overhang of 4", "3' overhang of 2"]


def test_rounding_is_half_up(spark):
    assert values(spark, lambda c: seqs.js_round(c), [0.0005, -0.0005, -1.2345, None], "double") == [0.001, 0.0, -1.234, None]


def test_gel(spark):
    size = lambda c: seqs.migration(c, F.lit(100.0), F.lit(10000.0))
    assert values(spark, size, [10000.0, 100.0, 1000.0, 5.0], "double") == pytest.approx([42.0, 342.0, 192.0, 342.0])
    assert values(spark, lambda c: seqs.band_opacity(c, F.lit(100.0)), [100.0, 25.0], "double") == pytest.approx([1.0, 0.675])


def test_deflines(spark):
    (x,) = values(spark, ids.uniprot_defline, ["Hemoglobin subunit beta OS=Homo sapiens OX=9606 GN=HBB PE=1 SV=2"])
    assert tuple(x) == ("Hemoglobin subunit beta", "Homo sapiens", "HBB")
    (x,) = values(spark, ids.uniprot_defline, ["plain"])
    assert tuple(x) == ("plain", "", "")


def test_links(spark):
    decode = lambda texts: values(spark, ids.decode_link, texts)
    assert decode(["#motif=%22AC+GT%22&upstream=999999&circular=1&bad=2&fetch=x&demo=y"]) == [{"motif": '"AC GT"', "upstream": "100000", "circular": "true", "demo": "y"}]
    assert decode(["motif=" + "A" * 4001, "upstream=-5", "circular=no", ""]) == [{}, {}, {}, {}]
    encode = lambda c: ids.encode_link(c, F.lit(None).cast("string"), F.lit(5), F.lit(True))
    assert values(spark, encode, ['(iupac "CAN")', ""]) == ['motif=(iupac+"CAN")&circular=true', "circular=true"]


def test_salvaged_replies(spark):
    found = values(spark, ids.salvaged_reply, ['Sure! {"motif": " x ", "name": null, "assumptions": [" a ", "", "b"]} bye', "no", None])
    assert tuple(found[0]) == ("x", "", "", ["a", "b"])
    assert found[2] is None


@pytest.mark.parametrize(("size", "left", "right"), [(7, 0, 0), (7, 3, 5), (16, 20, 40), (1000, 1, 1)])
def test_tiles_hold_what_they_should(spark, size, left, right):
    text = "".join(random.Random(2).choice("ACGT") for _ in range(530))
    df = spark.createDataFrame([(1, text, "x"), (2, "", "x"), (3, None, "x"), (4, "A", "x")], "k long, s string, tile string")
    found = tiles(df, "k", "s", size, left, right).collect()
    mine = sorted((r for r in found if r.k == 1), key=lambda r: r.tile)
    assert [r.tile for r in mine] == list(range((530 + size - 1) // size))
    for r in mine:
        assert r.base <= max(0, r.tile * size - left) or r.base == max(0, r.tile * size - left)
        assert r.base == max(0, r.tile * size - left)
        assert r.text == text[r.base : (r.tile + 1) * size + right]
        assert r.n == 530
    assert [(r.tile, r.text) for r in found if r.k == 4] == [(0, "A")]
    assert {r.k for r in found} == {1, 4}


def test_letters(spark):
    assert values(spark, letters, ["a1-C\n ü*", "", None]) == ["AC", "", None]


def test_annotation_of_first_appearances(spark):
    terms = ["frame", "open reading frame", "motif"]
    given = ["A motif and a Motif in an open reading frame of a frame.", '<i title="motif">x</i> motifs motif', "", None]
    expected = ["A <dfn>motif</dfn> and a Motif in an <dfn>open reading frame</dfn> of a <dfn>frame</dfn>.", '<i title="motif">x</i> motifs <dfn>motif</dfn>', "", None]
    assert values(spark, lambda c: ids.annotate(c, terms), given) == expected


def test_edit_distance_of_every_record(spark, tmp_path):
    rows = [(1, "café", "cafe"), (2, "列車", "列"), (3, "abc", "abd"), (4, None, "x"), (5, "", "né")]
    spark.createDataFrame(rows, "record_id long, name string, description string").write.parquet(str(tmp_path / "seq_records.parquet"))
    assert {r.record_id: r.distance for r in QUERIES["edit_distance_all"](spark, str(tmp_path)).collect()} == {1: 1, 2: 1, 3: 1, 4: None, 5: 2}


def test_codes_of_all_positions(spark, tmp_path):
    rows = [("m", "ACGTAC"), ("m", "acgtgu"), ("m", "ACGTA"), ("n", "TTTTTTTTA"), ("n", None), (None, "A")]
    spark.createDataFrame(rows, "motif string, match string").write.parquet(str(tmp_path / "motif_matches.parquet"))
    found = {(r.motif, r.pos): r.code for r in QUERIES["to_iupac_positions"](spark, str(tmp_path)).collect()}
    assert "".join(found["m", k] for k in range(6)) == "ACGTRY"
    assert "".join(found["n", k] for k in range(9)) == "TTTTTTTTA"
    assert len(found) == 15
