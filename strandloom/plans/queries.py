"""Registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..alphabet import IUPAC, STARTS
from ..functions import identifiers as ids
from ..functions import sequence as seqs
from ..functions.letters import letters
from ..lang.motif import motif
from ..operators import background as chance
from ..operators import digest as dig
from ..operators import findings as told
from ..operators import library as lib
from ..operators import orfs as frames
from ..operators import pwm
from ..operators.background import calibrated_thresholds
from ..operators.hits import band_join, clusters, collapse, count_places, coverage, elided, non_overlapping, overlapping_any, summary
from ..operators.intervals import match_periods
from ..operators.search import absolute, first_hits, full_match, scan, search, whole_matches
from ..sources import export, text
from ..streaming.hits import run_to_table, stream_of, windowed_counts
from ..tables import table
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``, with its DuckDB equivalent."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


@query(
    "p2_found",
    """
    with u as (select distinct sequence, strand, "start" s, "end" e from motif_matches
               where sequence is not null and strand in ('+', '-') and "start" < "end"),
    m as (select *, max(e) over (partition by sequence, strand order by s, e rows between unbounded preceding and 1 preceding) reach from u),
    g as (select *, sum(case when reach is null or s >= reach then 1 else 0 end)
                 over (partition by sequence, strand order by s, e rows unbounded preceding) n from m),
    p as (select sequence, strand, min(s) f, max(e) t from g group by sequence, strand, n),
    q as (select *, lead(f) over (partition by sequence, strand order by f) nxt from p)
    select 'period' as what, sequence, strand, f as from_pos, t as to_pos from p
    union all select 'gap', sequence, strand, t, nxt from q where nxt > t
    """,
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return match_periods(table(spark, d, "motif_matches"))


# ------------------------------------------------------------------- scalars

_SEQ = "select record_id, seq from seq_records"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "seq_records")


@query(
    "revcomp",
    "with c as (select record_id, regexp_replace(seq, '[^ACGTURYSWKMBDHVNacgturyswkmbdhvn\\-]', 'N', 'g') k, contains(upper(seq), 'U') and not contains(upper(seq), 'T') rna from seq_records) "
    "select record_id, reverse(translate(k, 'ACGTURYSWKMBDHVN-acgturyswkmbdhvn', case when rna then 'UGCAAYRSWMKVHDBN-ugcaayrswmkvhdbn' else 'TGCAAYRSWMKVHDBN-tgcaayrswmkvhdbn' end)) as revcomp from c",
)
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", seqs.reverse_complement(F.col("seq")).alias("revcomp"))


@query("transcribe", "select record_id, translate(seq, 'Tt', 'Uu') as rna from seq_records")
def transcribe(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", seqs.transcribe(F.col("seq")).alias("rna"))


@query("normalize", "select record_id, case when type in ('dna', 'rna') then replace(upper(seq), 'U', 'T') else upper(seq) end as normal from seq_records")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", seqs.normalize(F.col("seq"), F.col("type")).alias("normal"))


@query("guess_type", "with " + sql.RECORDS + ", z as (select record_id, seq, regexp_replace(upper(seq), '[\\s\\-*.]', '', 'g') g from seq_records) select record_id, case when seq is null then null when g = '' then 'dna' when length(regexp_replace(g, '[^ACGTUN]', '', 'g')) / length(g) > 0.9 then case when contains(g, 'U') and not contains(g, 'T') then 'rna' else 'dna' end else 'protein' end as guessed from z")
def guess_type(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", seqs.guess_type(F.col("seq")).alias("guessed"))


@query("gc_content", "with c as (select record_id, upper(seq) s from seq_records), n as (select record_id, s, length(regexp_replace(s, '[^ACGTU]', '', 'g')) n, length(regexp_replace(s, '[^GCS]', '', 'g')) gc from c) select record_id, case when s is null then null when n = 0 then 0.0::double else gc / n end as gc from n")
def gc_content(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", seqs.gc_content(F.col("seq")).alias("gc"))


@query("melting_temp", "with c as (select record_id, replace(upper(seq), 'U', 'T') s from seq_records), n as (select record_id, length(s) n, length(regexp_replace(s, '[^AT]', '', 'g')) a, length(regexp_replace(s, '[^GC]', '', 'g')) g from c) select record_id, case when n is null then null when n = 0 then 0.0::double when n < 14 then (2 * a + 4 * g)::double else 64.9::double + 41 * (g - 16.4::double) / n end as tm from n")
def melting_temp(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", seqs.melting_temp(F.col("seq")).alias("tm"))


def _translation(code: int, stop: bool, met: bool) -> str:
    amino = "coalesce(a, 'X')"
    if met:
        starts = ", ".join(f"'{c}'" for c in STARTS[code])
        amino = f"case when k = 0 and c in ({starts}) then 'M' else coalesce(a, 'X') end"
    text = f"coalesce(string_agg({amino}, '' order by k), '')"
    return (
        "with " + sql.RECORDS + f", t as (select record_id, replace(s, 'U', 'T') s from n), v(c, a) as (values {sql.codon_values(code)}), "
        "p as (select record_id, k, substring(s, 3 * k + 1, 3) c from (select record_id, s, unnest(range(0, length(s) // 3)) k from t)), "
        f"j as (select record_id, {text} x from p left join v using (c) group by record_id) "
        f"select t.record_id, {'split_part(' if stop else ''}coalesce(x, ''){', chr(42), 1)' if stop else ''} as protein from t left join j using (record_id)"
    )


def _translated(spark: SparkSession, d: str, **options) -> DataFrame:
    r = _records(spark, d).select("record_id", letters(F.col("seq")).alias("s")).where(F.col("s") != "")
    return r.select("record_id", seqs.translate(F.col("s"), **options).alias("protein"))


@query("translate_t1", _translation(1, False, False))
def translate_t1(spark: SparkSession, d: str) -> DataFrame:
    return _translated(spark, d)


@query("translate_t2", _translation(2, False, False))
def translate_t2(spark: SparkSession, d: str) -> DataFrame:
    return _translated(spark, d, table=2)


@query("translate_t11_orf", _translation(11, True, True))
def translate_t11_orf(spark: SparkSession, d: str) -> DataFrame:
    return _translated(spark, d, table=11, to_stop=True, start_as_met=True)


_CODES = ", ".join(f"('{code}', '{base}')" for code, bases in IUPAC.items() for base in bases)


@query(
    "expand_iupac",
    "with recursive p as (select name, regexp_extract(expr, '^\\(iupac \"([A-Z]+)\"\\)$', 1) pat from motif_library), b(code, base) as (values " + _CODES + "), "
    "e(name, pat, k, seq) as (select name, pat, 0, '' from p where pat <> '' union all select e.name, e.pat, e.k + 1, e.seq || base from e join b on b.code = substring(e.pat, e.k + 1, 1) where e.k < length(e.pat)) "
    "select name, seq as sequence from e where k = length(pat)",
)
def expand_iupac(spark: SparkSession, d: str) -> DataFrame:
    pattern = F.regexp_extract("expr", r'^\(iupac "([A-Z]+)"\)$', 1)
    lib = table(spark, d, "motif_library").where(pattern != "").select("name", pattern.alias("pattern"))
    return lib.select("name", F.explode(seqs.expand_iupac(F.col("pattern"))).alias("sequence"))


@query("sub_record", 'select record_id, substring(seq, 11, 40) as seq, coalesce("offset", 0) + 10 as "offset" from seq_records')
def sub_record(spark: SparkSession, d: str) -> DataFrame:
    s = seqs.sub_record(F.col("seq"), F.col("offset"), F.lit(10), F.lit(50))
    return _records(spark, d).select("record_id", s["seq"].alias("seq"), s["offset"].alias("offset"))


@query(
    "to_iupac",
    "with c as (select record_id, substring(regexp_replace(seq, '[^A-Za-z]', '', 'g'), 1, 4) b from seq_records), k as (select record_id, b, array_to_string(list_sort(list_distinct(string_split(replace(upper(b), 'U', 'T'), ''))), '') z from c), "
    "v(z, code) as (values ('A','A'),('C','C'),('G','G'),('T','T'),('AG','R'),('CT','Y'),('CG','S'),('AT','W'),('GT','K'),('AC','M'),('CGT','B'),('AGT','D'),('ACT','H'),('ACG','V'),('ACGT','N')) "
    "select record_id, case when b is not null then coalesce(code, 'N') end as code from k left join v using (z)",
)
def to_iupac(spark: SparkSession, d: str) -> DataFrame:
    head = F.substring(F.regexp_replace("seq", "[^A-Za-z]", ""), 1, 4)
    return _records(spark, d).select("record_id", seqs.to_iupac(head).alias("code"))


@query(
    "to_iupac_positions",
    "with m as (select distinct motif, regexp_replace(replace(upper(\"match\"), 'U', 'T'), '[^A-Z]', '', 'g') s from motif_matches where motif is not null and \"match\" is not null), p as (select motif, pos, substring(s, pos::int + 1, 1) b from (select motif, s, unnest(range(0, length(s))) pos from m)), "
    "k as (select motif, pos, string_agg(b, '' order by b) z from (select distinct motif, pos, b from p) group by 1, 2), "
    "v(z, code) as (values ('A','A'),('C','C'),('G','G'),('T','T'),('AG','R'),('CT','Y'),('CG','S'),('AT','W'),('GT','K'),('AC','M'),('CGT','B'),('AGT','D'),('ACT','H'),('ACG','V'),('ACGT','N')) "
    "select motif, pos::int as pos, coalesce(code, 'N') as code from k left join v using (z)",
)
def to_iupac_positions(spark: SparkSession, d: str) -> DataFrame:
    """The code of the letters seen at each position of each motif, over all letters of all matches."""
    m = table(spark, d, "motif_matches").where(F.col("motif").isNotNull()).select("motif", F.translate(letters(F.col("match")), "U", "T").alias("s")).distinct()
    seen = m.select("motif", F.posexplode(F.split("s", "")).alias("pos", "b")).where(F.col("b") != "").groupBy("motif", "pos").agg(F.array_sort(F.collect_set("b")).alias("z"))
    return seen.select("motif", "pos", seqs.to_iupac(F.array_join("z", "")).alias("code"))


@query("parse_site", "select name, site, cut_top, cut_bottom, kind from enzymes")
def parse_site(spark: SparkSession, d: str) -> DataFrame:
    x = seqs.parse_site(F.col("spec"))
    return table(spark, d, "enzymes").select("name", *[x[c].alias(c) for c in ("site", "cut_top", "cut_bottom", "kind")])


@query("overhang", "select name, case when cut_bottom = cut_top then 'blunt' when cut_bottom > cut_top then '5'' overhang of ' || (cut_bottom - cut_top) else '3'' overhang of ' || (cut_top - cut_bottom) end as overhang, translate(site, 'URYSWKMBDHVN', 'TACCAGACAAAA') as example from enzymes")
def overhang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enzymes").select("name", seqs.overhang(F.col("cut_top"), F.col("cut_bottom")).alias("overhang"), seqs.concrete_site(F.col("site")).alias("example"))


@query(
    "detect_source",
    # Shapes: letters as A, digits as 9; what a form's letters may be is looked up by prefix.
    r"""with q as (select record_id, trim(name, ' ') q from seq_records), s as (select *, regexp_replace(regexp_replace(q, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') z, split_part(q, '.', 1) h, split_part(q, '.', 2) v, len(string_split(q, '.')) d from q),
        t as (select *, upper(h) u, regexp_replace(regexp_replace(h, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') y, d = 1 or (d = 2 and v <> '' and ltrim(v, '0123456789') = '') plain from s),
        p as (select *, string_split(replace(replace(replace(replace(q, '..', '-'), '–', '-'), ',', ''), ' ', ':'), ':') w from t)
        select record_id, case when q = '' or q is null then null
            when len(w) between 2 and 3 and ltrim(lower(w[1]), 'abcdefghijklmnopqrstuvwxyz0123456789_.') = '' and w[1] <> '' and len(string_split(w[2], '-')) = 2 and ltrim(split_part(w[2], '-', 1), '0123456789') = '' and split_part(w[2], '-', 1) <> ''
                 and ltrim(split_part(w[2], '-', 2), '0123456789') = '' and split_part(w[2], '-', 2) <> '' and coalesce(w[3], '1') in ('1', '+1', '-1') then 'ensembl'
            when plain and starts_with(u, 'ENS') and length(y) - length(rtrim(y, '9')) >= 6 and ltrim(rtrim(y, '9'), 'A') = '' and length(rtrim(y, '9')) between 4 and 8 and right(rtrim(u, '0123456789'), 1) in ('G', 'T', 'P') then 'ensembl'
            when plain and left(u, 3) in ('NC_', 'NG_', 'NM_', 'NR_', 'NT_', 'NW_', 'NZ_', 'XM_', 'XR_', 'XP_', 'AP_', 'NP_', 'YP_', 'ZP_', 'ZG_') and length(u) > 3 and ltrim(substring(u, 4), '0123456789') = '' then 'ncbi'
            when d = 1 and (length(u) = 6 and ((left(u, 1) in ('O', 'P', 'Q') and z[2] = '9' and ltrim(z[3:5], 'A9') = '' and z[6] = '9') or (z[1:3] = 'A9A' and left(u, 1) not in ('O', 'P', 'Q') and ltrim(z[4:5], 'A9') = '' and z[6] = '9'))
                 or length(u) = 10 and z[1:3] = 'A9A' and left(u, 1) not in ('O', 'P', 'Q') and ltrim(z[4:5], 'A9') = '' and z[6:7] = '9A' and ltrim(z[8:9], 'A9') = '' and z[10] = '9') then 'uniprot'
            when plain and length(rtrim(y, '9')) between 1 and 3 and ltrim(rtrim(y, '9'), 'A') = '' and length(y) - length(rtrim(y, '9')) between 5 and 8 then 'ncbi'
            when z[1] = 'A' and length(q) <= 21 and ltrim(z, 'A9._-') = '' then 'ensembl' end as source from p""",
)
def detect_source(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", ids.detect_source(F.col("name")).alias("source"))


@query(
    "descriptions",
    r"""select record_id, trim(regexp_replace(coalesce(description, ''), '\s*\[Source:[^\]]*\]\s*$', '')) as said,
        replace(replace(replace(replace(coalesce(description, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as escaped from seq_records""",
)
def descriptions(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("description", F.lit(""))
    return _records(spark, d).select("record_id", ids.ensembl_description(F.col("description")).alias("said"), ids.escape_html(text).alias("escaped"))


@query(
    "region_coordinates",
    "select record_id, 'chromosome ' || name || ':' || format('{:,}', coalesce(\"offset\", 0)) || '-' || format('{:,}', coalesce(\"offset\", 0) + length(seq)) || ' on the plus strand of ASM1' as place, 'ASM1' as assembly from seq_records where regexp_matches(name, '^[A-Z0-9.]+$') and seq is not null",
)
def region_coordinates(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).where(F.col("name").rlike("^[A-Z0-9.]+$") & F.col("seq").isNotNull())
    o = F.coalesce("offset", F.lit(0))
    text = F.concat(F.lit("chromosome:ASM1:"), "name", F.lit(":"), o.cast("string"), F.lit(":"), (o + F.length("seq")).cast("string"), F.lit(":1"))
    return r.select("record_id", ids.ensembl_coordinates(text).alias("place"), ids.ensembl_assembly(text).alias("assembly"))


@query(
    "uniprot_defline",
    "select name, display as description, common as organism, assembly as gene from species_list where common is not null",
)
def uniprot_defline(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "species_list").where(F.col("common").isNotNull())
    x = ids.uniprot_defline(F.concat("display", F.lit(" OS="), "common", F.lit(" OX=9 GN="), "assembly", F.lit(" PE=1")))
    return s.select("name", *[x[c].alias(c) for c in ("description", "organism", "gene")])


@query(
    "share_links",
    "select name, 'motif=' || trim(expr) as motif, scan as circular, 'motif=' || replace(replace(replace(replace(replace(replace(url_encode(trim(expr)), '%20', '+'), '%28', '('), '%29', ')'), '%27', chr(39)), '%22', chr(34)), '%2F', '/') "
    "|| case when scan then '&circular=true' else '' end as link from motif_library where expr is not null",
)
def share_links(spark: SparkSession, d: str) -> DataFrame:
    """The link, and what is read from it again."""
    lib = table(spark, d, "motif_library").where(F.col("expr").isNotNull())
    link = ids.encode_link(F.col("expr"), F.lit(None).cast("string"), F.lit(0), F.col("scan"))
    back = ids.decode_link(F.concat(F.lit("#"), link))
    circular = F.when(F.col("scan").isNotNull(), F.coalesce(F.try_element_at(back, F.lit("circular")) == "true", F.lit(False)))
    return lib.select("name", F.concat(F.lit("motif="), back["motif"]).alias("motif"), circular.alias("circular"), link.alias("link"))


@query("fasta_text", "select record_id, '>' || coalesce(name, '') || case when coalesce(description, '') <> '' then ' ' || description else '' end || case when s <> '' then chr(10) || regexp_replace(regexp_replace(s, '(.{70})', '\\1\n', 'g'), '\\n$', '') else '' end as fasta from (select *, coalesce(regexp_replace(seq, '[^A-Za-z]', '', 'g'), '') s from seq_records)")
def fasta_text(spark: SparkSession, d: str) -> DataFrame:
    s = F.coalesce(F.regexp_replace("seq", "[^A-Za-z]", ""), F.lit(""))
    return _records(spark, d).select("record_id", text.fasta(F.col("name"), F.col("description"), s).alias("fasta"))


@query(
    "fasta_roundtrip",
    "select record_id, 'r' || record_id as name, trim(coalesce(description, '')) as description, coalesce(regexp_replace(seq, '[^A-Za-z]', '', 'g'), '') as seq from seq_records",
)
def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as FASTA texts and parsed again."""
    s = F.coalesce(F.regexp_replace("seq", "[^A-Za-z]", ""), F.lit(""))
    as_text = text.fasta(F.concat(F.lit("r"), F.col("record_id").cast("string")), F.col("description"), s)
    return text.parse_sequences(_records(spark, d).select("record_id", as_text.alias("text"))).select("record_id", "name", "description", "seq")


@query(
    "genbank_parse",
    "select record_id, 'R' || record_id as name, coalesce(type = 'protein', false) as protein, regexp_replace(seq, '[^A-Za-z]', '', 'g') as seq from seq_records where regexp_replace(seq, '[^A-Za-z]', '', 'g') <> ''",
)
def genbank_parse(spark: SparkSession, d: str) -> DataFrame:
    """Records as GenBank entries, parsed again."""
    kind = F.when(F.col("type") == "protein", " 1 aa").otherwise(" 1 bp")
    s = F.regexp_replace(F.regexp_replace("seq", "[^A-Za-z]", ""), "(.{60})", "$1\n  ")
    entry = F.concat(F.lit("LOCUS       R"), F.col("record_id").cast("string"), kind, F.lit("\nDEFINITION  Made of\n            two lines.\nORIGIN\n"), s, F.lit("\n//\n"))
    parsed = text.parse_sequences(_records(spark, d).where(F.col("seq").isNotNull()).select("record_id", entry.alias("text")))
    return parsed.select("record_id", "name", F.coalesce(F.col("type") == "protein", F.lit(False)).alias("protein"), "seq")


# -------------------------------------------------------------------- search


def _search(name: str, source: str, oracle: str | None, strand: str = "both", more: list[str] = []) -> None:  # noqa: B006
    """Register a search on all records, both strands."""

    @query(name, oracle)
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = search(_records(spark, d), source, strand)
        extra = [F.col("extra")[c].cast("int").alias(c) if c != "relative" else F.col("extra")[c].alias(c) for c in more]
        return hits.select("record_id", "start", "end", "strand", "match", *extra)


_HITS = ' select record_id, "start", "end", strand, "match" from hits'
_search("search_literal", '"GAATTC"', sql.regular("GAATTC", 6) + _HITS)
_search("search_iupac", '(iupac "TATAWAWR")', sql.regular("TATA[AT]A[AT][AG]", 8) + _HITS)
_search("search_classes", '(seq (any-of "GC") (none-of "A") "TATA" any)', sql.regular("[GC][^A]TATA[A-Z]", 7) + _HITS)
_search("search_gap", '(seq "ATC" (gap 2 7) "TGAC")', sql.regular("ATC[A-Z]{2,7}TGAC", 14) + _HITS)
_search("search_alt", '(seq (alt "TTGACA" "TTGCCA" (iupac "TTNACA")) "T")', sql.regular("(?:TTGACA|TTGCCA|TT[ACGT]ACA)T", 7) + _HITS)
_search("search_repeat", '(seq (repeat "CAG" 2 4) (opt "CAA"))', sql.regular("(?:CAG){2,4}(?:CAA){0,1}", 15) + _HITS)
_search("search_run", '(seq (run "CT" 8 20) "G")', sql.regular("[CT]{8,20}G", 21) + _HITS)
_search("search_forward_only", '(iupac "CANNTG")', sql.regular("CA[ACGT][ACGT]TG", 6, "strand = '+'") + _HITS, strand="+")
_search("search_prosite", '(prosite "N-{P}-[ST]-{P}")', sql.regular("N[^P][ST][^P]", 4) + _HITS)
_search("search_anchored", '(n-terminal (iupac "ATG"))', sql.regular("ATG", 3, "true").replace("where x <> ''", "where x <> '' and i = 0") + _HITS)
_search("search_c_terminal", '(c-terminal (prosite "[KR]-x(2)"))', sql.regular("[KR][A-Z]{2}", 3, "true").replace("where x <> ''", "where x <> '' and i + 3 = n") + _HITS)
_search("search_revcomp_motif", '(revcomp-motif "GGTCTC")', sql.regular("GAGACC", 6) + _HITS)
_search("search_regex", '(regex "TA{3,5}T")', sql.regular("TA{3,5}T", 7) + _HITS)

_FUZZY = "with " + sql.STRANDS + "," + sql.placed(f"select record_id, strand, n, i, substring(q, i + 1, 8) x from (select *, unnest(range(0, n - 7)) i from st) where ({sql.mismatches('AGGAAGCC')}) <= 1")
_search("search_fuzzy", '(fuzzy 1 "AGGAAGCC")', _FUZZY + f""" select record_id, "start", "end", strand, "match", {sql.mismatches("AGGAAGCC", "0", '"match"')} as mismatches from hits""", more=["mismatches"])
_search(
    "search_promoter",
    '(seq (fuzzy 1 "TTGACA") (gap 15 19) (fuzzy 1 "TATAAT"))',
    "with " + sql.STRANDS + ", a as (select record_id, strand, n, i, q from (select *, unnest(range(0, n - 5)) i from st) where (" + sql.mismatches("TTGACA") + ") <= 1),"
    + sql.placed("select record_id, strand, n, i, substring(q, i + 1, 12 + max(g)) x from (select *, unnest(range(15, 20)) g from a) where i + g + 12 <= n and (" + sql.mismatches("TATAAT", "(i + 6 + g)") + ") <= 1 group by record_id, strand, n, i, q")
    + _HITS,
)
_search(
    "search_edit",
    '(edit 1 "GAATTCC")',
    "with " + sql.STRANDS + ", o as (select record_id, strand, n, i, substring(q, i + 1, 8) w from (select *, unnest(range(0, n)) i from st)), c as (select *, unnest([6, 7, 8]) c from o), "
    "z as (select *, levenshtein(substring(w, 1, c), 'GAATTCC') dist from c where i + c <= n), b as (select *, row_number() over (partition by record_id, strand, i order by dist, c desc) r from z where dist <= 1),"
    + sql.placed("select record_id, strand, n, i, substring(w, 1, c) x from b where r = 1")
    + """ select record_id, "start", "end", strand, "match", levenshtein("match", 'GAATTCC')::int as edits from hits""",
    more=["edits"],
)
_search("search_nested", '(seq (alt (fuzzy 1 "GGAGG") "AAGGAG") (gap 4 9) "ATG")', sql.regular("(?:[A-Z]GAGG|G[A-Z]AGG|GG[A-Z]GG|GGA[A-Z]G|GGAG[A-Z]|AAGGAG)[A-Z]{4,9}ATG", 18) + _HITS)
_PWM = motif('(pwm-from-sites ("TATAAA" "TATATA" "TATAAT" "TTTAAA" "TATAAG") :threshold 0.9)')
_LOW, _HIGH = _PWM.bounds()


def _score(text: str) -> str:
    """The sum of weights in the order of positions."""
    return "(" + " + ".join(f"case {text}[{p + 1}] " + " ".join(f"when '{x}' then {w[p]!r}::double" for x, w in _PWM.rows) + f" else {_LOW / _PWM.width!r}::double end" for p in range(_PWM.width)) + ")"


_search(
    "search_pwm",
    '(pwm-from-sites ("TATAAA" "TATATA" "TATAAT" "TTTAAA" "TATAAG") :threshold 0.9)',
    "with " + sql.STRANDS + ", o as (select record_id, strand, n, i, substring(q, i + 1, 6) w from (select *, unnest(range(0, n - 5)) i from st)),"
    + sql.placed(f"select record_id, strand, n, i, w x from o where ({_score('w')} - {_LOW!r}::double) / {_HIGH - _LOW!r}::double >= 0.9")
    + f""" select record_id, "start", "end", strand, "match", floor(({_score('"match"')} - {_LOW!r}::double) / {_HIGH - _LOW!r}::double * 1000 + 0.5) / 1000 as relative from hits""",
    more=["relative"],
)
_PAIRED = " + ".join(f"(w[{k + 1}] || w[2 * l + g - {k}] not in ('AT', 'TA', 'GC', 'CG') and {k} < l)::int" for k in range(7))
_search(
    "search_hairpin",
    "(hairpin (stem 6 7) (loop 3 5))",
    "with " + sql.STRANDS + ", o as (select record_id, strand, n, i, substring(q, i + 1, 19) w from (select *, unnest(range(0, n - 14)) i from st)), "
    "p as (select *, unnest(range(3, 6)) g from (select *, unnest([6, 7]) l from o)), "
    f"k as (select * from p where i + 2 * l + g <= n and ({_PAIRED}) = 0), b as (select *, row_number() over (partition by record_id, strand, i order by l desc, g desc) r from k),"
    + sql.placed("select record_id, strand, n, i, substring(w, 1, 2 * l + g) x from b where r = 1")
    + _HITS,
)


@query(
    "search_captures",
    sql.regular("TTGAC[A-Z]{3,6}TA[AT]", 14) + """, l as (select h.*, o from hits h join (select distinct record_id, coalesce("offset", 0) o from seq_records) using (record_id)),
       b as (select *, 'box' label, case strand when '+' then "start" else "end" - 5 end f, 5 w from l union all select *, 'tail', case strand when '+' then "end" - 3 else "start" end, 3 from l)
       select record_id, "start" + o as "start", strand, label, f + o as from_pos, f + w + o as to_pos, case label when 'box' then left("match", 5) else right("match", 3) end as text from b""",
)
def search_captures(spark: SparkSession, d: str) -> DataFrame:
    """Bound texts with absolute positions."""
    hits = absolute(search(_records(spark, d), "(seq (named 'box \"TTGAC\") (gap 3 6) (named 'tail (iupac \"TAW\")))"))
    return hits.select("record_id", "start", "strand", F.explode("bindings").alias("_b")).select("record_id", "start", "strand", "_b.label", F.col("_b.start").alias("from_pos"), F.col("_b.end").alias("to_pos"), "_b.text")


@query("search_limit", sql.regular("CA[ACGT][ACGT]TG", 6) + " , z as (select *, row_number() over (partition by record_id order by strand, case strand when '+' then \"start\" else -\"end\" end) r from hits) select record_id, \"start\", \"end\", strand, \"match\" from z where r <= 2")
def search_limit(spark: SparkSession, d: str) -> DataFrame:
    hits = search(_records(spark, d), '(iupac "CANNTG")')
    return first_hits(hits, 2).select("record_id", "start", "end", "strand", "match")


@query(
    "search_nonoverlap",
    sql.regular("[CT]{4,20}", 20).replace("with ", "with recursive ", 1)
    + """, d as (select record_id, strand, case strand when '+' then "start" else -"end" end s, case strand when '+' then "end" else -"start" end e from hits),
       r as (select *, row_number() over (partition by record_id, strand order by s, e desc) n from (select distinct * from d)),
       fo as (select record_id, strand, n, s a, e z, true k from r where n = 1 union all select r.record_id, r.strand, r.n, case when r.s >= f.z then r.s else f.a end, case when r.s >= f.z then r.e else f.z end, r.s >= f.z
             from fo f join r on r.record_id = f.record_id and r.strand = f.strand and r.n = f.n + 1)
       select record_id, strand, case strand when '+' then a else -z end as "start", case strand when '+' then z else -a end as "end" from fo where k""",
)
def search_nonoverlap(spark: SparkSession, d: str) -> DataFrame:
    return non_overlapping(search(_records(spark, d), '(run "CT" 4 20)'), ["record_id"]).drop("motif")


@query("library_scan")
def library_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan(_records(spark, d), table(spark, d, "motif_library")).select("record_id", "motif", "start", "end", "strand", "match")


_WORDS = r"""^("[A-Za-z]+"|\(iupac "[A-Z]+"\))$"""


@query(
    "library_scan_words",
    "with recursive " + sql.STRANDS + ", "
    r"""lb as (select name, alphabet, upper(regexp_extract(expr, '"([A-Za-z]+)"', 1)) pat, starts_with(expr, '(') codes from motif_library
            where coalesce(scan, true) and lower(coalesce(category, '')) <> 'restriction' and regexp_matches(expr, '^("[A-Za-z]+"|\(iupac "[A-Z]+"\))$') and name is not null),
        bs(code, base) as (values """ + _CODES + r"""),
        ex as (select name, alphabet, pat, 0 k, '' w from lb where codes union all select ex.name, ex.alphabet, ex.pat, ex.k + 1, ex.w || base from ex join bs on bs.code = substring(ex.pat, ex.k + 1, 1) where ex.k < length(ex.pat)),
        wd as (select name, alphabet, w from ex where k = length(pat) union all select name, alphabet, pat from lb where not codes),
        wn as (select distinct name, nuc, case when nuc then replace(w, 'U', 'T') else w end w from wd, (values (true), (false)) c(nuc) where alphabet is null or (alphabet <> 'protein') = nuc),
        ln as (select distinct nuc, length(w) l from wn),
        ps as (select record_id, strand, kind in ('dna', 'rna') nuc, n, l, i, substring(q, i + 1, l) x from (select *, unnest(range(0, n)) i from st join ln on ln.nuc = (kind in ('dna', 'rna')))),
        ft as (select record_id, strand, n, i, name motif, x from ps join wn on ps.x = wn.w and ps.nuc = wn.nuc and ps.l = length(wn.w)),
        ht as (select record_id, motif, case strand when '+' then i else n - i - length(x) end s, strand, x from ft)
        select record_id, motif, s as "start", s + length(x) as "end", strand, x as "match" from ht
        where strand = '+' or not exists (select 1 from ht g where g.strand = '+' and g.record_id = ht.record_id and g.motif = ht.motif and g.s = ht.s and g.x = ht.x)""",
)
def library_scan_words(spark: SparkSession, d: str) -> DataFrame:
    """The scan with all usable entries that are plain letters or codes, which SQL can check; library_scan has the others too."""
    library = table(spark, d, "motif_library").where(F.col("expr").rlike(_WORDS))
    return scan(_records(spark, d), library).select("record_id", "motif", "start", "end", "strand", "match")


@query("library_scan_collapsed")
def library_scan_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapse(scan(_records(spark, d), table(spark, d, "motif_library")), ["record_id"]).drop("score")


@query("unreadable_motifs")
def unreadable_motifs(spark: SparkSession, d: str) -> DataFrame:
    """How each motif of the library reads: its canonical text, the bounds of its width, or the error."""
    return lib.readings(table(spark, d, "motif_library"))


# ---------------------------------------------------------------- match tables

_MATCHES = """ok as (select sequence, motif, strand, "start" s, "end" e, score from motif_matches where sequence is not null and motif is not null and strand in ('+', '-') and "start" < "end")"""


def _good_matches(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "motif_matches")
    return m.where(F.col("sequence").isNotNull() & F.col("motif").isNotNull() & F.col("strand").isin("+", "-") & (F.col("start") < F.col("end")))


@query(
    "collapse_longest",
    f"""with recursive {_MATCHES}, r as (select *, row_number() over (partition by sequence, motif, strand order by s, e desc) n from (select distinct sequence, motif, strand, s, e from ok)),
        f as (select sequence, motif, strand, n, s a, e z, 1 k from r where n = 1
              union all select r.sequence, r.motif, r.strand, r.n, case when r.s >= f.z or r.e - r.s > f.z - f.a then r.s else f.a end, case when r.s >= f.z or r.e - r.s > f.z - f.a then r.e else f.z end, f.k + (r.s >= f.z)::int
              from f join r on r.sequence = f.sequence and r.motif = f.motif and r.strand = f.strand and r.n = f.n + 1)
        select sequence, motif, strand, arg_max(a, n) as "start", arg_max(z, n) as "end" from f group by sequence, motif, strand, k""",
)
def collapse_longest(spark: SparkSession, d: str) -> DataFrame:
    return collapse(_good_matches(spark, d), ["sequence"]).drop("score")


@query(
    "collapse_best",
    f"""with recursive {_MATCHES}, v as (select distinct sequence, motif, strand, s, e, case when isnan(score) then null else score end v from ok),
        r as (select *, row_number() over (partition by sequence, motif, strand order by s, e desc, v asc nulls last) n from v),
        f as (select sequence, motif, strand, n, s a, e z, v, 1 k from r where n = 1
              union all select r.sequence, r.motif, r.strand, r.n, case when b then r.s else f.a end, case when b then r.e else f.z end, case when b then r.v else f.v end, f.k + (r.s >= f.z)::int
              from f join r on r.sequence = f.sequence and r.motif = f.motif and r.strand = f.strand and r.n = f.n + 1, lateral (select r.s >= f.z or coalesce(r.v, 0) > coalesce(f.v, 0) b) x)
        select sequence, motif, strand, a as "start", z as "end", v as score from f qualify row_number() over (partition by sequence, motif, strand, k order by n desc) = 1""",
)
def collapse_best(spark: SparkSession, d: str) -> DataFrame:
    return collapse(_good_matches(spark, d), ["sequence"], "best")


@query(
    "count_places",
    f"""with {_MATCHES}, m as (select sequence, strand, s, max(e) over (partition by sequence, strand order by s, e rows between unbounded preceding and 1 preceding) b from ok)
        select sequence, count(*) as hits, count(*) filter (where b is null or s >= b) as places from m group by sequence""",
)
def places(spark: SparkSession, d: str) -> DataFrame:
    return count_places(_good_matches(spark, d), ["sequence"])


@query("match_summary", "select motif, count(*) as total, count(*) filter (where strand = '+') as forward, count(*) filter (where strand = '-') as reverse from motif_matches group by motif")
def match_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(table(spark, d, "motif_matches"), ["motif"])


@query(
    "hit_density",
    """with l as (select record_id, length(regexp_replace(seq, '[^A-Za-z]', '', 'g')) n from seq_records), h as (select record_id, count(*) k from motif_matches group by 1)
       select record_id, k as hits, k / n * 1000 as per_kb from h join l using (record_id) where n > 0""",
)
def hit_density(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "motif_matches").groupBy("record_id").agg(F.count(F.lit(1)).alias("hits"))
    sizes = _records(spark, d).select("record_id", F.length(letters(F.col("seq"))).alias("n")).where(F.col("n") > 0)
    return hits.join(sizes, "record_id").select("record_id", "hits", (F.col("hits") / F.col("n") * 1000).alias("per_kb"))


@query(
    "coverage_blocks",
    f"""with {_MATCHES}, m as (select *, max(e) over (partition by sequence order by s, e rows between unbounded preceding and 1 preceding) b from ok),
        g as (select *, sum(case when b is null or s > b then 1 else 0 end) over (partition by sequence order by s, e rows unbounded preceding) n from m),
        p as (select sequence, min(s) f, max(e) t from g group by sequence, n), c as (select sequence, f, t, unnest(range(f // 60, (t - 1) // 60 + 1)) block from p),
        v as (select sequence, block, sum(least(t, (block + 1) * 60) - greatest(f, block * 60))::bigint covered from c group by 1, 2),
        h as (select sequence, block, count(*) hits from (select sequence, unnest(range(s // 60, (e - 1) // 60 + 1)) block from ok) group by 1, 2)
        select sequence, block, hits, covered from h join v using (sequence, block)""",
)
def coverage_blocks(spark: SparkSession, d: str) -> DataFrame:
    return coverage(_good_matches(spark, d), ["sequence"])


@query(
    "band_join",
    f"""with {_MATCHES}, a as (select distinct sequence, strand, s, e from ok where motif like '%-box'), b as (select distinct sequence, strand, s, e from ok where motif like '%-site')
        select a.sequence, a.strand, a.s as "start", a.e as "end", max(b.s - a.e) as gap from a join b on a.sequence = b.sequence and a.strand = b.strand and b.s - a.e between 5 and 40 group by all""",
)
def band(spark: SparkSession, d: str) -> DataFrame:
    """Hits of one kind with a hit of another 5 to 40 positions behind, the widest gap taken."""
    m = _good_matches(spark, d)
    return band_join(m.where(F.col("motif").endswith("-box")), m.where(F.col("motif").endswith("-site")), ["sequence", "strand"], 5, 40)


@query("distinct_motifs", "select sequence, count(distinct motif) as motifs from motif_matches where sequence is not null group by 1")
def distinct_motifs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "motif_matches").where(F.col("sequence").isNotNull()).groupBy("sequence").agg(F.count_distinct("motif").alias("motifs"))


@query("rna_hits", "select match_id, motif from motif_matches where motif in (select name from motif_library where alphabet = 'rna')")
def rna_hits(spark: SparkSession, d: str) -> DataFrame:
    rna = table(spark, d, "motif_library").where(F.col("alphabet") == "rna").select(F.col("name").alias("motif"))
    return table(spark, d, "motif_matches").join(rna, "motif", "left_semi").select("match_id", "motif")


@query("hits_with_entries", "select m.match_id, m.motif, l.category, l.evidence from motif_matches m left join motif_library l on m.motif = l.name")
def hits_with_entries(spark: SparkSession, d: str) -> DataFrame:
    lib = table(spark, d, "motif_library").select(F.col("name").alias("motif"), "category", "evidence")
    return table(spark, d, "motif_matches").join(lib, "motif", "left").select("match_id", "motif", "category", "evidence")


_NUMBER = "case when {0} = floor({0}) and abs({0}) < 1e15 then {0}::bigint::varchar else {0}::varchar end"
_LINES = f"""with h as (select *, case when isnan(score) then null else score end v from motif_matches where "start" is not null and "end" is not null),
    d as (select match_id, 0 kind, 1 k, 'score' key, {_NUMBER.format("v")} value from h where v is not null
          union all select match_id, 1, generate_subscripts(e, 1), unnest(e).key, {_NUMBER.format("unnest(e).value")} from (select match_id, list_sort(map_entries(extra)) e from h where extra is not null)
          union all select match_id, 2, generate_subscripts(bindings, 1), unnest(bindings).label, unnest(bindings).text from h where bindings is not null),
    o as (select *, row_number() over (partition by match_id order by kind, k) n from d),
    g as (select match_id, key, min(n) n, arg_max(coalesce(value, ''), n) value from o group by 1, 2),
    t as (select match_id, string_agg(key || '=' || value, ';' order by n) detail from g group by 1) """


def _lined(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "motif_matches").where(F.col("start").isNotNull() & F.col("end").isNotNull())


@query(
    "export_tsv",
    _LINES + """select match_id, coalesce(sequence, '') || chr(9) || coalesce(motif, '') || chr(9) || ("start" + 1) || chr(9) || "end" || chr(9) || ("end" - "start") || chr(9) || coalesce(strand, '') || chr(9)
        || coalesce("match", '') || chr(9) || coalesce(detail, '') as line from h left join t using (match_id)""",
)
def export_tsv(spark: SparkSession, d: str) -> DataFrame:
    return _lined(spark, d).select("match_id", export.line("tsv").alias("line"))


@query(
    "export_bed",
    _LINES + f"""select match_id, case when coalesce(sequence, '') = '' then 'sequence' else sequence end || chr(9) || "start" || chr(9) || "end" || chr(9) || coalesce(motif, '') || chr(9)
        || coalesce({_NUMBER.format("v")}, '0') || chr(9) || coalesce(strand, '') as line from h""",
)
def export_bed(spark: SparkSession, d: str) -> DataFrame:
    return _lined(spark, d).select("match_id", export.line("bed").alias("line"))


@query(
    "export_gff3",
    _LINES + f"""select match_id, case when coalesce(sequence, '') = '' then 'sequence' else sequence end || chr(9) || 'strandloom' || chr(9) || 'sequence_motif' || chr(9) || ("start" + 1) || chr(9) || "end" || chr(9)
        || coalesce({_NUMBER.format("v")}, '.') || chr(9) || coalesce(strand, '') || chr(9) || '.' || chr(9)
        || coalesce('Name=' || replace(url_encode(motif), '%20', '+') || ';matched_sequence=' || replace(url_encode("match"), '%20', '+'), '') as line from h""",
)
def export_gff3(spark: SparkSession, d: str) -> DataFrame:
    return _lined(spark, d).select("match_id", export.line("gff3").alias("line"))


@query("export_json", _LINES + """select match_id, coalesce(sequence, '') as sequence, motif, "start" + 1 as "start", "end", "end" - "start" as length, strand, "match", v as score, coalesce(detail, '') as detail from h left join t using (match_id)""")
def export_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines, each field read back."""
    back = F.from_json(export.line("json"), "sequence string, motif string, start long, end long, length long, strand string, match string, score double, detail map<string,string>")
    detail = F.array_join(F.transform(F.map_entries(back["detail"]), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
    return _lined(spark, d).select("match_id", back.alias("b"), detail.alias("detail")).select("match_id", "b.sequence", "b.motif", "b.start", "b.end", "b.length", "b.strand", "b.match", "b.score", "detail")


@query(
    "pwm_train",
    """with m as (select motif, replace(upper("match"), 'U', 'T') site from motif_matches where motif is not null and "match" <> ''),
       w as (select motif, length(site) w, count(*) n from m group by 1, 2), u as (select motif, w from (select *, row_number() over (partition by motif order by n desc, w) r from w) where r = 1),
       p as (select motif, pos, substring(site, pos::int + 1, 1) letter from (select m.motif, site, unnest(range(0, length(site))) pos from m join u on m.motif = u.motif and length(site) = w)),
       c as (select motif, pos, letter, count(*) n from p group by all), g as (select motif, pos, unnest(['A', 'C', 'G', 'T']) letter from (select distinct motif, pos from p)),
       t as (select g.motif, g.pos, g.letter, coalesce(n, 0) n, sum(coalesce(n, 0)) over (partition by g.motif, g.pos) total from g left join c using (motif, pos, letter))
       select motif, pos::int as pos, letter, n as count, round(log2((n + 0.5::double) / (total + 2) / 0.25::double), 6) as weight from t""",
)
def pwm_train(spark: SparkSession, d: str) -> DataFrame:
    return pwm.train(pwm.aligned_sites(table(spark, d, "motif_matches"))).withColumn("weight", F.round("weight", 6))


@query(
    "pwm_consensus",
    """with m as (select motif, replace(upper("match"), 'U', 'T') site from motif_matches where motif is not null and "match" <> ''),
       w as (select motif, length(site) w, count(*) n from m group by 1, 2), u as (select motif, w from (select *, row_number() over (partition by motif order by n desc, w) r from w) where r = 1),
       p as (select motif, pos, substring(site, pos::int + 1, 1) letter from (select m.motif, site, unnest(range(0, length(site))) pos from m join u on m.motif = u.motif and length(site) = w)),
       c as (select motif, pos, letter, count(*) n from p group by all), g as (select motif, pos, unnest(['A', 'C', 'G', 'T']) letter from (select distinct motif, pos from p)),
       t as (select g.motif, g.pos, g.letter, row_number() over (partition by g.motif, g.pos order by coalesce(n, 0) desc, g.letter) r from g left join c using (motif, pos, letter))
       select motif, count(*) as width, string_agg(letter, '' order by pos) as consensus from t where r = 1 group by motif""",
)
def pwm_consensus(spark: SparkSession, d: str) -> DataFrame:
    return pwm.consensus(pwm.train(pwm.aligned_sites(table(spark, d, "motif_matches"))))


@query(
    "score_thresholds",
    """with s as (select motif, score from motif_matches where score is not null and not isnan(score) and motif is not null),
       n as (select motif, count(*) scores from s group by 1), o as (select motif, score, row_number() over (partition by motif order by score) r from s),
       t as (select o.motif, scores, min(score) threshold from o join n using (motif) where r >= ceil(scores * (1 - 0.01::double)) group by 1, 2)
       select t.motif, scores, threshold, count(*) filter (where score >= threshold) / scores as achieved from t join s using (motif) group by 1, 2, 3""",
)
def score_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return calibrated_thresholds(table(spark, d, "motif_matches"), 0.01)


@query("stream_hit_counts", """select strftime(make_timestamp(epoch_us(scanned_at)), '%Y-%m-%d') as day, coalesce(strand, '.') as strand, count(*) as hits from motif_matches where scanned_at is not null group by all""")
def stream_hit_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = run_to_table(windowed_counts(stream_of(spark, d, "motif_matches")), ["window_start", "strand"])
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "strand", "hits")


# ------------------------------------------------------- digests, frames, chance

_CUTS = (
    "with " + sql.STRANDS + ", w as (select distinct length(site) l from enzymes), p as (select record_id, strand, n, l, i, substring(q, i + 1, l) x from (select *, unnest(range(0, n)) i from st join w on true where kind in ('dna', 'rna'))), "
    "f as (select p.*, e.name enzyme, cut_top, cut_bottom from p join enzymes e on p.x = e.site and p.l = length(e.site)), "
    "h as (select record_id, n, enzyme, strand, x, case strand when '+' then i else n - i - l end s, case strand when '+' then i + l else n - i end e, cut_top, cut_bottom from f), "
    "k as (select * from h where strand = '+' or not exists (select 1 from h g where g.strand = '+' and g.record_id = h.record_id and g.enzyme = h.enzyme and g.s = h.s and g.x = h.x)), "
    "sites as (select distinct on (record_id, enzyme, s, t) * from (select record_id, n, enzyme, s, e, strand, case strand when '+' then s + cut_top else e - cut_bottom end t, case strand when '+' then s + cut_bottom else e - cut_top end b from k) order by record_id, enzyme, s, t, strand)"
)


def _cut(spark: SparkSession, d: str, circular: bool = False) -> DataFrame:
    return dig.cut_sites(_records(spark, d), table(spark, d, "enzymes"), circular)


@query("digest_sites", _CUTS + ' select record_id, enzyme, s as "start", e as "end", strand, t as cut_top, b as cut_bottom from sites where t between 0 and n')
def digest_sites(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).drop("n")


@query(
    "digest_linear",
    _CUTS + ", c as (select distinct record_id, t from sites where t > 0 and t < n union select record_id, 0 from n where kind in ('dna', 'rna') union select record_id, length(t) from n where kind in ('dna', 'rna')), "
    "g as (select record_id, t f, lead(t) over (partition by record_id order by t) z from c) select record_id, f as from_pos, z as to_pos, z - f as size from g where z is not null",
)
def digest_linear(spark: SparkSession, d: str) -> DataFrame:
    return dig.fragments(_records(spark, d), _cut(spark, d))


@query(
    "digest_circular",
    _CUTS + ", c as (select distinct record_id, n, ((t % n) + n) % n t from sites), g as (select record_id, n, t f, coalesce(lead(t) over (partition by record_id order by t), first_value(t) over (partition by record_id order by t)) z, "
    "lead(t) over (partition by record_id order by t) is null last from c) select record_id, f as from_pos, z as to_pos, case when last then n - f + z else z - f end as size from g "
    "union all select record_id, 0, length(t), length(t) from n where kind in ('dna', 'rna') and record_id not in (select record_id from c)",
)
def digest_circular(spark: SparkSession, d: str) -> DataFrame:
    return dig.fragments(_records(spark, d), _cut(spark, d, True), True)


@query(
    "enzyme_choice",
    _CUTS + ", c as (select record_id, enzyme, count(*) cuts from sites where t between 0 and n group by 1, 2), r as (select *, row_number() over (partition by record_id order by cuts <> 1, cuts, enzyme) place from c) select record_id, enzyme, cuts, place::int as place from r where place <= 2",
)
def enzyme_choice(spark: SparkSession, d: str) -> DataFrame:
    return dig.chosen_enzymes(_cut(spark, d), table(spark, d, "enzymes"))


@query(
    "gel_migration",
    "with n0 as (" + "with " + sql.RECORDS + " select record_id, length(t)::double size from n where kind in ('dna', 'rna')) select record_id, size::bigint as size, round(42 + 300 * (ln(10000) - ln(least(greatest(size, 100), 10000))) / (ln(10000) - ln(100)), 6) as y from n0",
)
def gel_migration(spark: SparkSession, d: str) -> DataFrame:
    r = dig.nucleic(_records(spark, d)).select("record_id", F.length(letters(F.col("seq"))).cast("long").alias("size"))
    return r.withColumn("y", F.round(dig.migration_of(F.col("size")), 6))


@query(
    "gel_lanes",
    SQL["digest_linear"].replace("select record_id, f as from_pos, z as to_pos, z - f as size from g where z is not null", "")
    + ", z as (select record_id, z - f size from g where z > f), b as (select record_id, max(size) big, greatest(max(size), 10000) hi, least(min(size), 100) lo from z group by 1) "
    "select record_id, size, round(42 + 300 * (ln(hi) - ln(size)) / (ln(hi) - ln(lo)), 6) as y, round(0.35::double + 0.65::double * sqrt(size / big), 6) as opacity, round(3 + 3 * sqrt(size / big), 6) as thickness from z join b using (record_id)",
)
def gel_lanes(spark: SparkSession, d: str) -> DataFrame:
    return dig.gel(dig.fragments(_records(spark, d), _cut(spark, d))).withColumns({c: F.round(c, 6) for c in ("y", "opacity", "thickness")})


_ORFS = (
    "with " + sql.STRANDS + ", c as (select record_id, strand, n, i, (i % 3)::int frame, substring(q, i + 1, 3) c from (select *, unnest(range(0, n - 2)) i from st where kind in ('dna', 'rna'))), "
    "k as (select *, c in ('TAA', 'TAG', 'TGA') stop, c in ('ATG', 'GTG', 'TTG') begin_ from c), "
    "g as (select *, coalesce(sum(stop::int) over (partition by record_id, strand, frame order by i rows between unbounded preceding and 1 preceding), 0) grp from k where stop or begin_), "
    "o as (select record_id, strand, n, frame, min(i) filter (where begin_) a, max(i) filter (where stop) z from g group by record_id, strand, n, frame, grp), "
    "v as (select record_id, strand, n, frame, a, z + 3 z from o where a is not null and z is not null and z + 3 - a >= 90) "
)


@query("orfs", _ORFS + "select record_id, case strand when '+' then a else n - z end as \"start\", case strand when '+' then z else n - a end as \"end\", strand, frame, z - a as length from v")
def orfs(spark: SparkSession, d: str) -> DataFrame:
    return frames.orfs(_records(spark, d))


@query(
    "orf_proteins",
    _ORFS + f""", t(c, aa) as (values {sql.codon_values(11)}), w as (select v.record_id, v.strand, v.n, frame, a, z, q from v join st using (record_id, strand) where z - a >= 150 and st.n = v.n),
        x as (select record_id, strand, n, frame, a, z, k, coalesce(aa, 'X') aa from (select *, unnest(range(1, (z - a) // 3)) k from w) left join t on t.c = substring(q, a + 3 * k + 1, 3)),
        y as (select record_id, strand, n, frame, a, z, string_agg(aa, '' order by k) aa from x group by all)
        select record_id, strand, frame, case strand when '+' then a else n - z end as "start", case strand when '+' then z else n - a end as "end", 'M' || split_part(aa, '*', 1) as protein from y""",
)
def orf_proteins(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return frames.orf_proteins(r, frames.orfs(r, min_length=150))


@query("background_test")
def background_test(spark: SparkSession, d: str) -> DataFrame:
    """One motif on every nucleic record against forty surrogates of it, with the verdict."""
    r = dig.nucleic(_records(spark, d))
    b = chance.background(r, '(iupac "CANNTG")')
    return b.withColumn("verdict", chance.verdict(F.col("observed"), F.col("expected"), F.col("empirical_p"), F.col("trials")))


# ----------------------------------------------------------------- the library


@query("category_counts", "select lower(coalesce(category, 'misc')) as category, count(*) as motifs from motif_library group by 1")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return lib.category_counts(table(spark, d, "motif_library"))


@query(
    "library_audit",
    "select coalesce(evidence, 'uncited') as evidence, count(*) as entries, count(*) filter (where coalesce(ref, '') <> '') as attributable, count(*) filter (where coalesce(example, '') <> '') as with_example, count(*) filter (where coalesce(reviewed, '') <> '') as reviewed, count(*) filter (where doc is null or category is null or alphabet is null) as incomplete from motif_library group by 1",
)
def library_audit(spark: SparkSession, d: str) -> DataFrame:
    return lib.audit(table(spark, d, "motif_library"))


@query("library_catalogue", "select coalesce(source_file, '') as source_file, lower(coalesce(category, 'misc')) as category, string_agg(name, ', ' order by name) as motifs from motif_library group by 1, 2")
def library_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return lib.catalogue(table(spark, d, "motif_library"))


@query("find_entries", "select name, row_number() over (order by lower(name), name)::int as place from motif_library where alphabet = 'dna' and (contains(lower(name), 'signal') or contains(lower(doc), 'signal') or contains(lower(category), 'signal') or contains(lower(ref), 'signal'))")
def find_entries(spark: SparkSession, d: str) -> DataFrame:
    return lib.find_entries(table(spark, d, "motif_library"), "Signal", alphabet="dna").select("name", "place")


@query(
    "rank_entries",
    """with a(w) as (values ('operator'), ('invented'), ('width'), ('box')), t as (select name, alphabet, list_distinct(regexp_extract_all(lower(concat_ws(' ', name, category, doc)), '[a-z0-9]{3,}')) h from motif_library),
       s as (select name, (select count(*) from a where list_contains(h, w)) + case when coalesce(alphabet, 'dna') <> 'protein' then 0.25::double else 0 end score from t)
       select name, score from s where score >= 1 order by score desc, name limit 12""",
)
def rank_entries(spark: SparkSession, d: str) -> DataFrame:
    return lib.rank_entries(table(spark, d, "motif_library"), "The invented operator, a box of any width")


@query(
    "newest_versions",
    "select stem, name, version from (select upper(split_part(name, '-', 1)) stem, name, version, row_number() over (partition by upper(split_part(name, '-', 1)) order by coalesce(try_cast(regexp_extract(version, '(\\d+)', 1) as int), 0) desc, name desc) r from motif_library) where r = 1",
)
def newest_versions(spark: SparkSession, d: str) -> DataFrame:
    return lib.newest_versions(table(spark, d, "motif_library"))


@query(
    "provenance",
    """select name, coalesce(evidence, case when regexp_matches(coalesce(ref, ''), '(?i)JASPAR\\s+\\S+') or regexp_matches(coalesce(source_file, ''), '(?i)jaspar') then 'measured'
       when regexp_matches(coalesce(source_file, ''), '(?i)restriction') then 'catalogue' when coalesce(ref, '') <> '' then 'literature-backed' else 'uncited' end) as evidence,
       regexp_extract(coalesce(ref, ''), '(?i)PubMed\\s+(\\d+)', 1) as pubmed, case when lower(category) in ("""
    + sql.texts(lib.PROTEIN_CATEGORIES) + ") then 'protein' when lower(category) in (" + sql.texts(lib.RNA_CATEGORIES) + ") then 'rna' else 'dna' end as implied from motif_library",
)
def provenance(spark: SparkSession, d: str) -> DataFrame:
    p = lib.provenance(F.col("source_file"), F.col("ref"), F.col("evidence"), F.lit(False))
    return table(spark, d, "motif_library").select("name", p["evidence"].alias("evidence"), p["pubmed"].alias("pubmed"), lib.default_alphabet(F.lower("category")).alias("implied"))


@query("check_examples")
def check_examples(spark: SparkSession, d: str) -> DataFrame:
    return lib.check_examples(table(spark, d, "motif_library"))


_TYPED = """typed as (select distinct typed from (select display typed from species_list union all select common from species_list union all select unnest(aliases) from species_list
    union all select substring(name, 2) from species_list union all select replace(name, 'o', 'a') from species_list union all select substring(name, 1, 5) from species_list union all select taxon from motif_library) where typed is not null)"""


@query(
    "species_suggest",
    f"""with {_TYPED}, k as (select typed, regexp_replace(lower(trim(typed)), '[\\s-]+', '_', 'g') key from typed), p as (select typed, key, s.*, lower(display) d, lower(common) c, list_transform(aliases, lambda x: lower(x)) al from k cross join species_list s where key <> ''),
        b as (select typed, key, bool_or(name = key) own, min(case when replace(key, '_', ' ') in (d, c) or key in (d, c) or list_contains(al, replace(key, '_', ' ')) or list_contains(al, key) then name end) exact,
              min(struct_pack(x := levenshtein(key, name), y := name)) near, min(case when starts_with(name, key) and length(key) >= 4 then name end) pre from p group by 1, 2)
        select typed, coalesce(exact, case when near.x <= case when length(key) >= 10 then 3 else 2 end then near.y end, pre) as suggestion from b where not own""",
)
def species_suggest(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "species_list")
    forms = [F.col("display"), F.col("common"), F.explode("aliases"), F.substring("name", 2, 1000), F.translate("name", "o", "a"), F.substring("name", 1, 5)]
    typed = table(spark, d, "motif_library").select(F.col("taxon").alias("typed"))
    for form in forms:
        typed = typed.unionByName(s.select(form.alias("typed")))
    return lib.suggest_species(typed.where(F.col("typed").isNotNull()), s)


@query("edit_distance", "select record_id, levenshtein(name, description) as distance from seq_records where regexp_matches(name, '^[ -~]*$') and regexp_matches(description, '^[ -~]*$')")
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    """Between name and description, where both are ASCII."""
    plain = F.col("name").rlike("^[ -~]*$") & F.col("description").rlike("^[ -~]*$")
    return _records(spark, d).where(plain).select("record_id", F.levenshtein("name", "description").cast("long").alias("distance"))


@query("edit_distance_all")
def edit_distance_all(spark: SparkSession, d: str) -> DataFrame:
    """Between name and description of every record, in characters; null where either is. edit_distance has the ASCII ones, which DuckDB's distance in bytes can check."""
    return _records(spark, d).select("record_id", F.levenshtein("name", "description").cast("long").alias("distance"))


@query("record_totals", "with " + sql.RECORDS + " select kind as type, count(*) as records, sum(length(s))::bigint as letters from n group by 1")
def record_totals(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.col("type"), seqs.guess_type(F.col("seq")))
    r = _records(spark, d).select(kind.alias("type"), F.length(letters(F.col("seq"))).alias("n")).where(F.col("n") > 0)
    return r.groupBy("type").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("letters"))


# ---------------------------------------------------------------- further views


@query("full_match", """select match_id, regexp_full_match(replace(upper("match"), 'U', 'T'), 'ATC[\\s\\S]{2,7}TGAC') as whole from motif_matches where motif = 'loba-element'""")
def whole_match(spark: SparkSession, d: str) -> DataFrame:
    """Which reported texts their motif takes up as a whole."""
    m = table(spark, d, "motif_matches").where(F.col("motif") == "loba-element")
    return m.select("match_id", full_match(F.col("match"), '(seq "ATC" (gap 2 7) "TGAC")').alias("whole"))


@query("full_match_all")
def all_whole_matches(spark: SparkSession, d: str) -> DataFrame:
    """Which reported texts their own motif takes up as a whole: all matches and motifs, of which full_match has one."""
    return whole_matches(table(spark, d, "motif_matches"), table(spark, d, "motif_library"))


@query(
    "hit_clusters",
    f"""with {_MATCHES}, b as (select *, unnest(range(s // 60, (e - 1) // 60 + 1)) block from ok), c as (select *, greatest(s, block * 60) a, least(e, (block + 1) * 60) z from b),
        m as (select *, max(z) over (partition by sequence, strand, block order by a, z, s, e, motif rows between unbounded preceding and 1 preceding) p from c),
        g as (select *, sum(case when p is null or a >= p then 1 else 0 end) over (partition by sequence, strand, block order by a, z, s, e, motif rows unbounded preceding) n from m)
        select sequence, strand, block, min(a) as "start", max(z) as "end", min(struct_pack(w := s - e, s := s, m := motif)).m as motif, count(*) - 1 as more from g group by sequence, strand, block, n""",
)
def hit_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters(_good_matches(spark, d), ["sequence"])


@query(
    "overlapping_hits",
    f"""with {_MATCHES}, a as (select distinct sequence, motif, strand, s, e from ok where motif like '%-box'), b as (select distinct sequence, s, e from ok where motif like '%-site')
        select sequence, motif, strand, s as "start", e as "end" from a where exists (select 1 from b where b.sequence = a.sequence and b.s < a.e and a.s < b.e)""",
)
def overlapping_hits(spark: SparkSession, d: str) -> DataFrame:
    m = _good_matches(spark, d).select("sequence", "motif", "strand", "start", "end")
    return overlapping_any(m.where(F.col("motif").endswith("-box")), m.where(F.col("motif").endswith("-site")), ["sequence"])


@query("elided_matches", """select match_id, case when length("match") > 60 then left("match", 30) || '…' || right("match", 29) else "match" end as shown from motif_matches""")
def elided_matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "motif_matches").select("match_id", elided(F.col("match")).alias("shown"))


@query("salvaged_replies", "select name, trim(expr) as motif, coalesce(trim(doc), '') as explanation from motif_library where expr is not null")
def salvaged_replies(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects found in the middle of other text."""
    lib_ = table(spark, d, "motif_library").where(F.col("expr").isNotNull())
    reply = F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.col("expr").alias("motif"), F.col("doc").alias("explanation"), F.array("category", F.lit(" ")).alias("assumptions"))), F.lit(" Done."))
    x = ids.salvaged_reply(reply)
    return lib_.select("name", x["motif"].alias("motif"), x["explanation"].alias("explanation"))


@query("explained_background")
def explained_background(spark: SparkSession, d: str) -> DataFrame:
    b = chance.background(dig.nucleic(_records(spark, d)), '(seq "GGA" (gap 2 10) "GGGC")')
    return b.select("record_id", chance.explanation(*[F.col(c) for c in ("observed", "expected", "low", "high", "empirical_p", "trials")]).alias("said"))


@query(
    "digest_lanes",
    _CUTS + ", li as (select * from sites where t between 0 and n), lc as (select record_id, enzyme, count(*) cuts from li group by 1, 2), "
    "lr as (select *, row_number() over (partition by record_id order by cuts <> 1, cuts, enzyme)::int place from lc), lp as (select * from lr where place <= 2), "
    "lu as (select li.record_id, n, t, place from li join lp using (record_id, enzyme)), ll as (select record_id, n, t, unnest([0, place]) lane from lu), "
    "le as (select distinct record_id, lane, t from ll where t > 0 and t < n union select record_id, lane, 0 from ll union select record_id, lane, n from ll), "
    "lf as (select record_id, lane, t a, lead(t) over (partition by record_id, lane order by t) z from le) select record_id, lane, a as from_pos, z as to_pos, z - a as size from lf where z is not null",
)
def digest_lanes(spark: SparkSession, d: str) -> DataFrame:
    return dig.digest_lanes(_records(spark, d), table(spark, d, "enzymes"))


@query("annotated_docs")
def annotated_docs(spark: SparkSession, d: str) -> DataFrame:
    doc = F.concat(F.lit("<b>pattern</b> "), F.coalesce("doc", F.lit("")))
    return table(spark, d, "motif_library").select("name", ids.annotate(doc, ["pattern", "invented operator", "operator", "width"]).alias("annotated"))


def _many(n: str, one: str, several: str) -> str:
    return f"{n} || ' ' || case when {n} = 1 then '{one}' else '{several}' end"


@query(
    "scan_findings",
    f"""with {_MATCHES}, m as (select *, max(e) over (partition by sequence, strand order by s, e rows between unbounded preceding and 1 preceding) b from ok),
        c as (select sequence, count(*) hits, count(distinct motif) patterns, count(*) filter (where b is null or s >= b) places, count(*) filter (where motif in (select name from motif_library where alphabet = 'rna')) rna from m group by 1)
        select *, {_many("hits", "match", "matches")} || ' of ' || {_many("patterns", "pattern", "patterns")} || case when places < hits then ', at ' || {_many("places", "place", "places")} else '' end
        || case when rna > 0 then '; ' || {_many("rna", "tells", "tell")} || ' of RNA only' else '' end as said from c""",
)
def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    return told.scan_findings(table(spark, d, "motif_matches"), table(spark, d, "motif_library"), "sequence")


@query("orf_findings", _ORFS + f"select record_id, frames, longest, {_many('frames', 'reading frame', 'reading frames')} || ', the longest of ' || (longest // 3) || ' codons' as said from (select record_id, count(*) frames, max(z - a) longest from v group by 1)")
def orf_findings(spark: SparkSession, d: str) -> DataFrame:
    return told.orf_findings(frames.orfs(_records(spark, d)))


@query(
    "digest_findings",
    SQL["digest_linear"].replace("select record_id, f as from_pos, z as to_pos, z - f as size from g where z is not null", "")
    + f", y as (select record_id, count(*) pieces, max(z - f) largest, min(z - f) smallest from g where z > f group by 1) select *, case when pieces = 1 then 'uncut' else {_many('pieces', 'piece', 'pieces')} || ' of ' || smallest || ' to ' || largest || ' letters' end as said from y",
)
def digest_findings(spark: SparkSession, d: str) -> DataFrame:
    return told.digest_findings(dig.fragments(_records(spark, d), _cut(spark, d)))
