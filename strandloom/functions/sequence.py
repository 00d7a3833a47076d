"""Scalar functions on sequences as Spark columns; null gives null, an empty text the neutral value named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..alphabet import CODE_OF, COMPLEMENT, IUPAC, STARTS, codons, codons_with_codes


def _count(text: Column, letters: str) -> Column:
    """How many characters of the text are among the letters."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def complement(seq: Column) -> Column:
    """Complement of each letter incl. ambiguity codes, case kept; RNA (U and no T) stays RNA; unknown letters become N."""
    lower = {k.lower(): v.lower() for k, v in COMPLEMENT.items() if k.isalpha()}
    known = F.regexp_replace(seq, r"[^ACGTURYSWKMBVDHNacgturyswkmbvdhn\-]", "N")
    both = COMPLEMENT | lower
    as_dna = F.translate(known, "".join(both), "".join(both.values()))
    rna = both | {"A": "U", "a": "u"}
    as_rna = F.translate(known, "".join(rna), "".join(rna.values()))
    upper = F.upper(seq)
    return F.when(upper.contains("U") & ~upper.contains("T"), as_rna).otherwise(as_dna)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def transcribe(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def is_nucleic(kind: Column) -> Column:
    return F.coalesce(kind.isin("dna", "rna"), F.lit(False))


def normalize(seq: Column, kind: Column) -> Column:
    """Upper case; U as T in nucleic acids."""
    return F.when(is_nucleic(kind), F.replace(F.upper(seq), F.lit("U"), F.lit("T"))).otherwise(F.upper(seq))


def guess_type(seq: Column) -> Column:
    """dna, rna or protein by the share of nucleotide letters; an empty text is dna."""
    s = F.upper(F.regexp_replace(seq, r"[\s\-*.]", ""))
    share = F.try_divide(_count(s, "ACGTUN"), F.length(s))
    rna = s.contains("U") & ~s.contains("T")
    return F.when(F.length(s) == 0, "dna").when(share > 0.9, F.when(rna, "rna").otherwise("dna")).when(s.isNotNull(), "protein")


def gc_content(seq: Column) -> Column:
    """G, C and S among the letters A, C, G, T and U; 0 without any of these. S isn't counted below, so the share can exceed 1."""
    s = F.upper(seq)
    n = _count(s, "ACGTU")
    return F.when(n > 0, _count(s, "GCS") / n).when(s.isNotNull(), 0.0)


def melting_temp(seq: Column) -> Column:
    """Wallace's rule below 14 letters, else the GC formula on the whole length; 0 for an empty text."""
    s = F.translate(F.upper(seq), "U", "T")
    n, at, gc = F.length(s), _count(s, "AT"), _count(s, "GC")
    formula = 64.9 + 41 * (gc - F.lit(16.4)) / F.when(n > 0, n)
    return F.when(n == 0, 0.0).when(n < 14, (2 * at + 4 * gc).cast("double")).otherwise(formula)


def _codon_map(table: int) -> Column:
    """Codons of plain and of ambiguous letters that stand for one amino acid."""
    return F.create_map(*[F.lit(x) for pair in codons_with_codes(table).items() for x in pair])


def translate(seq: Column, table: int = 1, frame: int = 0, to_stop: bool = False, start_as_met: bool = False) -> Column:
    """Amino acids of the codons from ``frame`` on; a partial codon is dropped, an ambiguous or unknown one is X.

    ``to_stop`` ends before the first stop; ``start_as_met`` reads a start codon at the beginning as M.
    """
    s = F.substring(F.translate(F.upper(seq), "U", "T"), frame + 1, 2**31 - 1)
    triplets = F.regexp_extract_all(s, F.lit("(?s)..."), F.lit(0))
    table_of = codons(table)
    # Codons of plain letters, nearly all there are, are looked up by place in a string; the others in the map.
    place = lambda c, p: F.instr(F.lit("TCAG"), F.substring(c, p, 1)) - 1
    plain = lambda c: F.substring(F.lit("".join(table_of.values())), (16 * place(c, F.lit(1)) + 4 * place(c, F.lit(2)) + place(c, F.lit(3)) + 1), F.lit(1))
    other = lambda c: F.coalesce(F.try_element_at(_codon_map(table), c), F.lit("X"))
    amino = F.array_join(F.transform(triplets, lambda c: F.when(F.translate(c, "ACGT", "") == "", plain(c)).otherwise(other(c))), "")
    if start_as_met:
        begins = F.substring(s, 1, 3).isin(*STARTS.get(table, ["ATG"]))
        amino = F.when(begins & (F.length(amino) > 0), F.concat(F.lit("M"), F.substring(amino, 2, 2**31 - 1))).otherwise(amino)
    return F.substring_index(amino, "*", 1) if to_stop else amino


def expand_iupac(pattern: Column, most: int | None = None) -> Column:
    """All plain sequences a degenerate pattern stands for, first position slowest; letters that aren't codes stay.

    With ``most`` the positions that follow more than so many sequences are left out, which gives beginnings only.
    """
    bases = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (k, v)])
    letters = F.filter(F.split(F.upper(pattern), ""), lambda c: c != "")
    return F.aggregate(
        letters,
        F.array(F.lit("")),
        lambda acc, c: F.when(F.size(acc) > (most if most is not None else 2**31 - 1), acc).otherwise(
            F.flatten(F.transform(acc, lambda head: F.transform(F.filter(F.split(F.coalesce(F.try_element_at(bases, c), c), ""), lambda b: b != ""), lambda b: F.concat(head, b))))
        ),
    )


def to_iupac(bases: Column) -> Column:
    """The code of a set of bases given as text, U read as T; N for what has no code."""
    sorted_set = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.translate(F.upper(bases), "U", "T"), ""), lambda c: c != ""))), "")
    codes = F.create_map(*[F.lit(x) for pair in CODE_OF.items() for x in pair])
    return F.when(bases.isNotNull(), F.coalesce(F.try_element_at(codes, sorted_set), F.lit("N")))


def sub_record(seq: Column, offset: Column, start: Column, end: Column) -> Column:
    """A slice of a record and where it lies in the parent: struct(seq, offset)."""
    return F.struct(F.substring(seq, start.cast("int") + 1, (end - start).cast("int")).alias("seq"), (F.coalesce(offset, F.lit(0)) + start).alias("offset"))


def js_round(x: Column, digits: int = 3) -> Column:
    """Half up towards positive infinity."""
    return F.floor(x * 10**digits + F.lit(0.5)) / F.lit(10**digits)


# ------------------------------------------------------------- enzyme sites


def parse_site(spec: Column) -> Column:
    """A restriction site's notation as struct(site, cut_top, cut_bottom, kind); null without a cut mark.

    SITE(a/b) cuts a and b letters behind the site (kind IIS); otherwise ^ marks the cut of the top and _ that of the
    bottom strand, which by default mirrors it (kind II).
    """
    s = F.upper(F.trim(spec))
    iis = r"^([ACGTRYSWKMBDHVN]+)\((-?\d+)/(-?\d+)\)$"
    behind, site = F.regexp_extract(s, iis, 1), F.translate(s, "^_", "")
    top = F.instr(s, "^") - 1
    bottom = F.when(s.contains("_"), F.instr(F.regexp_replace(s, r"\^", ""), "_") - 1).otherwise(F.length(site) - top)
    two = F.struct(behind.alias("site"), (F.length(behind) + F.regexp_extract(s, iis, 2).try_cast("int")).alias("cut_top"), (F.length(behind) + F.regexp_extract(s, iis, 3).try_cast("int")).alias("cut_bottom"), F.lit("IIS").alias("kind"))
    one = F.struct(site.alias("site"), top.alias("cut_top"), bottom.alias("cut_bottom"), F.lit("II").alias("kind"))
    return F.when(s.rlike(iis), two).when(s.contains("^"), one)


def overhang(cut_top: Column, cut_bottom: Column) -> Column:
    d = cut_bottom - cut_top
    side = F.when(d > 0, "5' overhang of ").otherwise("3' overhang of ")
    return F.when(d == 0, "blunt").when(d.isNotNull(), F.concat(side, F.abs(d).cast("string")))


def concrete_site(site: Column) -> Column:
    """One plain sequence the enzyme cuts: the first base of each code."""
    return F.translate(site, "".join(IUPAC), "".join(v[0] for v in IUPAC.values()))


# ---------------------------------------------------------------- gel lanes


def migration(size: Column, lo: Column, hi: Column, top: float = 34.0, well: float = 8.0, run: float = 300.0) -> Column:
    """How far a fragment runs: by the logarithm of its size between the largest and the smallest."""
    held = F.least(F.greatest(size, lo), hi)
    return top + well + run * (F.ln(hi) - F.ln(held)) / (F.ln(hi) - F.ln(lo))


def band_opacity(size: Column, biggest: Column) -> Column:
    return 0.35 + 0.65 * F.sqrt(size / biggest)


def band_thickness(size: Column, biggest: Column) -> Column:
    return 3 + 3 * F.sqrt(size / biggest)
