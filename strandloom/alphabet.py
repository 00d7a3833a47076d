"""Letters, codes and codons as plain tables.

Fixed values: the IUPAC nucleotide codes, the complement of each code, the amino acids of
the genetic codes in TCAG order and their start codons are published tables.
"""

from __future__ import annotations

from itertools import product

IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT",
    "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT = {
    "A": "T", "C": "G", "G": "C", "T": "A", "U": "A", "R": "Y", "Y": "R", "S": "S", "W": "W", "K": "M",
    "M": "K", "B": "V", "V": "B", "D": "H", "H": "D", "N": "N", "-": "-",
}
AMINO = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}
STARTS = {1: ["ATG"], 2: ["ATT", "ATC", "ATA", "ATG", "GTG"], 11: ["ATG", "GTG", "TTG"]}
PAIRS = {"AT", "TA", "GC", "CG"}
WOBBLE = {"GT", "TG"}

#: Codes without U, most specific first, by the sorted set of their bases.
CODE_OF = {"".join(sorted(v)): k for k, v in IUPAC.items() if k != "U"}


def codons(table: int) -> dict[str, str]:
    """Amino acid of each of the 64 codons; an unknown table is read as table 1."""
    return {"".join(c): aa for c, aa in zip(product("TCAG", repeat=3), AMINO.get(table, AMINO[1]))}


def codons_with_codes(table: int) -> dict[str, str]:
    """Amino acid of every codon of IUPAC codes whose expansions agree on one."""
    plain = codons(table)
    codes = [c for c in IUPAC if c != "U"]
    found = {}
    for codon in product(codes, repeat=3):
        amino = {plain["".join(x)] for x in product(*(IUPAC[c] for c in codon))}
        if len(amino) == 1:
            found["".join(codon)] = amino.pop()
    return found


class _Table(dict):
    """A table for str.translate that gives N for whatever it lacks."""

    def __missing__(self, key: int) -> str:
        return "N"


_DNA = _Table({ord(k): v for k, v in COMPLEMENT.items()})
_RNA = _Table({**_DNA, ord("A"): "U"})


def reverse_complement(text: str) -> str:
    """Of upper-case text; letters without a complement become N. RNA (U and no T) keeps U."""
    return text[::-1].translate(_RNA if "U" in text and "T" not in text else _DNA)
