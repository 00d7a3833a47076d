"""Pieces of the DuckDB queries that check the searches."""

from __future__ import annotations

from string import ascii_uppercase

from ..alphabet import COMPLEMENT, codons_with_codes

_FROM = ascii_uppercase
_TO = "".join(COMPLEMENT.get(c, "N") for c in ascii_uppercase)

#: Records with letters: guessed type, letters (t: U read as T in nucleic acids).
RECORDS = r"""
    l0 as (select record_id, name, coalesce("offset", 0) o, type, upper(regexp_replace(seq, '[^A-Za-z]', '', 'g')) s,
                  regexp_replace(upper(seq), '[\s\-*.]', '', 'g') g from seq_records where seq is not null),
    l1 as (select record_id, name, o, s, coalesce(type, case when g = '' then 'dna' when length(regexp_replace(g, '[^ACGTUN]', '', 'g')) / length(g) > 0.9
                  then case when contains(g, 'U') and not contains(g, 'T') then 'rna' else 'dna' end else 'protein' end) kind from l0),
    n as (select record_id, name, o, kind, s, case when kind in ('dna', 'rna') then replace(s, 'U', 'T') else s end t from l1 where s <> '')
"""
#: Both strands.
STRANDS = RECORDS + f""",
    st as (select record_id, kind, '+' strand, t q, length(t)::bigint n from n
           union all select record_id, kind, '-', reverse(translate(t, '{_FROM}', '{_TO}')), length(t)::bigint from n where kind in ('dna', 'rna'))
"""


def placed(found: str) -> str:
    """From rows (record_id, strand, n, i, x) of strand-local hits to forward ones, a reverse hit that repeats a forward one left out."""
    return f"""
    f as ({found}),
    h as (select distinct record_id, case strand when '+' then i else n - i - length(x) end s, case strand when '+' then i + length(x) else n - i end e, strand, x from f),
    hits as (select record_id, s as "start", e as "end", strand, x as "match" from h
             where strand = '+' or not exists (select 1 from h k where k.strand = '+' and k.record_id = h.record_id and k.s = h.s and k.e = h.e and k.x = h.x))
"""


def regular(pattern: str, width: int, only: str = "true") -> str:
    """Hits of a regular expression of at most ``width`` letters at each position of both strands."""
    found = f"""select * from (select record_id, strand, n, i, regexp_extract(substring(q, i + 1, {width}), '^(?:{pattern})', 0) x
                from (select *, unnest(range(0, n)) i from st where {only})) where x <> ''"""
    return "with " + STRANDS + "," + placed(found)


def mismatches(text: str, at: str = "i", of: str = "q") -> str:
    """How many letters differ from a text."""
    return " + ".join(f"(substring({of}, {at} + {k + 1}, 1) <> '{c}')::int" for k, c in enumerate(text))


def codon_values(table: int) -> str:
    return ", ".join(f"('{c}', '{a}')" for c, a in codons_with_codes(table).items())


def texts(values: list[str]) -> str:
    """Texts as a list of literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
