"""The motif language: reading, building, widths, and the three ways of matching against each other."""

import random

import pytest

from strandloom.alphabet import reverse_complement
from strandloom.lang.kernels import kernel
from strandloom.lang.motif import Edge, Lit, MotifError, Pwm, balanced, check, first_letters, motif, read, read_all, show, span


def rows(found):
    """Arrays of hits as rows (start, end, numbers, sorted bindings)."""
    i, j, numbers, bounds = found
    return [
        (int(i[k]), int(j[k]), {n: float(v[k]) for n, v in numbers.items() if v[k] == v[k]}, sorted((x, int(a[k]), int(b[k])) for x, (a, b) in bounds.items() if a[k] >= 0)) for k in range(len(i))
    ]


def hits(source, text, nuc=True):
    return [h[:2] for h in rows(kernel(source, nuc).general(text, 0, len(text)))]


def test_reader():
    assert read('(a 1 -2.5 #t "x\\n\\"y" b) ; comment') == ["a", 1, -2.5, True, 'x\n"y', "b"]
    assert read("'x") == ["quote", "x"]
    assert len(read_all("(a) (b) ; c\n(d)")) == 3
    assert balanced("(a (b))")
    assert not balanced("(a")
    for bad in ("", "(a", ")", "(a) (b)", "'"):
        with pytest.raises(MotifError):
            read(bad)
    with pytest.raises(MotifError, match="line 2"):
        read("\n(a (b)")


@pytest.mark.parametrize(
    "bad",
    ["(seq", "(nothing 1)", "unknown", '(iupac "XQ")', '(literal 5)', '(fuzzy 1 (gap 0 3))', '(fuzzy "x" "ACG")', "(hairpin (loop 3) 4)", '(prosite "A-B-?")', '(pwm-from-sites ("AC" "A"))', "()", '("A")', '(repeat "AC" 3 2)', '(regex "(")', "5"],
)
def test_errors_before_any_job(bad):
    with pytest.raises(MotifError):
        motif(bad)


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ('"ACGT"', (4, 4)), ('(iupac "NN")', (2, 2)), ("(gap 2 5)", (2, 5)), ('(run "A" 15)', (15, None)), ('(repeat "CAG" 3 4)', (9, 12)), ('(opt "AC")', (0, 2)),
        ("(hairpin (stem 5 10) (loop 3 8))", (13, 28)), ('(edit 1 "GAATTC")', (5, 7)), ('(alt "A" "CCC")', (1, 3)), ('(seq at-start "AC" at-end)', (2, 2)),
        ('(prosite "N-{P}-[ST]-{P}")', (4, 4)), ('(regex "A+")', (0, None)), ("(named 'x \"AC\")", (2, 2)),
    ],
)
def test_spans(source, expected):
    assert span(motif(source)) == expected


@pytest.mark.parametrize(
    ("source", "text", "expected"),
    [
        ('(seq "ATG" (gap 3 5) "TAG")', "ATGCCCCCTAG", [(0, 11)]), ('(seq "ATG" (gap 3 5) "TAG")', "ATGCCCCCCTAG", []), ('(seq "A" (gap 0 10) "TTT")', "ACGTTTGG", [(0, 6)]),
        ('(repeat "CAG" 3 4)', "CAGCAGCAGCAGCAG", [(0, 12), (3, 15), (6, 15)]), ('(fuzzy 1 "AGGAGG")', "CCAGGAGGTTAGGTGG", [(2, 8), (10, 16)]), ('(edit 1 "GAATTC")', "GAATC", [(0, 5)]),
        ("(hairpin (stem 4 6) (loop 4))", "GGCCTTTTGGCC", [(0, 12)]), ("(hairpin (stem 4 6) (loop 4))", "AAAATTTTGGGG", []), ("(hairpin (stem 4) (loop 4))", "GGGGTTTTTCCC", []),
        ("(hairpin (stem 4) (loop 4) :wobble #t)", "GGGGTTTTTCCC", [(0, 12)]), ('"AA"', "AAAA", [(0, 2), (1, 3), (2, 4)]), ('(iupac "N")', "N", []), ("(gap 1 1)", "N", [(0, 1)]),
        ("(gap 3 2)", "ACGT", []), ('(seq at-start "A")', "AAA", [(0, 1)]), ('(seq "A" at-end)', "AAA", [(2, 3)]), ('(literal "acgu")', "ACGT", [(0, 4)]),
    ],
)
def test_first_match_at_each_start(source, text, expected):
    assert hits(source, text) == expected


def test_protein_motifs():
    assert hits('(prosite "N-{P}-[ST]-{P}")', "AANGSAA", nuc=False) == [(2, 6)]
    assert hits('(prosite "N-{P}-[ST]-{P}")', "AANPSAA", nuc=False) == []
    assert hits('(c-terminal (prosite "[SAC]-[KRH]-[LM]"))', "MAAAASKL", nuc=False) == [(5, 8)]
    assert hits('(c-terminal (prosite "[SAC]-[KRH]-[LM]"))', "MSKLAAAA", nuc=False) == []


def test_weight_matrix():
    node = motif("(pwm-from-sites (" + '"TATAAA" ' * 9 + '"TATAAT"))')
    assert isinstance(node, Pwm)
    assert node.consensus() == "TATAAA"
    quoted = motif("(pwm-from-sites '(\"TATAAA\" \"TATAAT\"))")
    assert quoted.width == 6
    (hit,) = rows(kernel('(pwm-from-sites ("TATAAA" "TATAAT") :threshold 0.95)', True).hits("GGTATAAAGG"))
    assert hit[:2] == (2, 8)
    assert set(hit[2]) == {"score", "relative"}


def test_captures_and_names():
    named = {"box": motif('"TTGAC"')}
    node = motif("(seq (named 'a \"AC\") (gap 1 2) (named 'b (iupac \"NN\")))")
    assert show(node) == "(seq (named 'a \"AC\") (gap 1 2) (named 'b (iupac \"NN\")))"
    assert [b for *_, b in rows(kernel(show(node), True).hits("ACGTTA"))] == [[("a", 0, 2), ("b", 4, 6)]]
    assert motif("box", named) == Lit("TTGAC")
    assert motif("at-end") == Edge(True)


def test_canonical_text_reads_back():
    for source in ('(seq "A" (alt "C" (iupac "RY")) (gap 1 3))', '(fuzzy 2 (iupac "ACGTN"))', '(repeat (alt "A" "CC") 2 5)', "(hairpin (stem 3 5) (gap 2 4) :wobble #t :mismatches 1)", '(prosite "<M-x(2,3)-[KR]>")', '(edit 1 "ACGT")'):
        assert show(motif(show(motif(source)))) == show(motif(source))


def random_motif(draw, depth=0):
    text = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    if depth > 2 or draw.random() < 0.25:
        return draw.choice([f'"{text(draw.randint(1, 3))}"', f'(iupac "{draw.choice("ARNYW")}{text(1)}")', "any", f'(any-of "{text(2)}")', f'(none-of "{text(1)}")', "(gap 0 2)", "(gap 1 3)", f'(run "{text(2)}" 1 3)', "at-start", "at-end", '(run "A" 1)'])
    kind = draw.choice(["seq", "seq", "alt", "repeat", "opt", "named", "fuzzy", "edit", "hairpin"])
    inner = lambda: random_motif(draw, depth + 1)
    return {
        "seq": lambda: f"(seq {inner()} {inner()} {inner()})", "alt": lambda: f"(alt {inner()} {inner()})", "repeat": lambda: f"(repeat {inner()} {draw.randint(0, 2)} {draw.randint(2, 3)})",
        "opt": lambda: f"(opt {inner()})", "named": lambda: f"(named '{draw.choice('xy')} {inner()})", "fuzzy": lambda: f'(fuzzy 1 "{text(4)}")', "edit": lambda: f'(edit 1 "{text(4)}")', "hairpin": lambda: "(hairpin (stem 2 3) (loop 1 3))",
    }[kind]()


def test_fast_ways_equal_backtracking():
    draw = random.Random(11)
    for _ in range(3000):
        m = kernel(random_motif(draw), True)
        text = "".join(draw.choice("ACGTN") for _ in range(draw.randint(0, 25)))
        assert rows(m.hits(text)) == rows(m.general(text, 0, len(text)))


def test_reverse_complement():
    assert reverse_complement("AACGTN-R") == "Y-NACGTT"
    assert reverse_complement("AAUU") == "AAUU"


def test_first_letters():
    say = lambda source, nuc=True: first_letters(motif(source), nuc)
    assert say('(seq at-start (alt "AC" (iupac "RY")) "T")') == "AG"
    assert say('(opt "A")') is None
    assert say('(seq (opt "A") "C")') is None
    assert say("any") is None
    assert say('(seq (run "CT" 2 5) "G")') == "CT"
    draw = random.Random(13)
    for _ in range(1500):
        source = random_motif(draw)
        allowed = first_letters(motif(source), True)
        text = "".join(draw.choice("ACGT") for _ in range(20))
        assert allowed is None or all(text[i] in allowed for i, _ in hits(source, text))


def test_checks_for_editors():
    assert check('(iupac "RY")', "dna") is None
    assert "missing" in check('(seq "A"', "dna")
    assert "nucleic" in check('(iupac "RY")', "protein")
    assert "no base" in check('"AXC"', "dna")
    assert check('"AXC"', "protein") is None
    assert "no letters" in check("at-start", "dna")
