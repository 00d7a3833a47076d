"""Columns about identifiers, deflines, links and texts around sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published forms of accession numbers.
ENSEMBL = r"(?i)^ENS[A-Z]{0,4}[GTP]\d{6,}(?:\.\d+)?$"
REFSEQ = r"(?i)^(?:N[CGMRTWZ]|X[MRP]|[ANY]P|Z[PG])_\d+(?:\.\d+)?$"
UNIPROT = r"(?i)^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})$"
GENBANK = r"(?i)^[A-Z]{1,3}\d{5,8}(?:\.\d+)?$"
#: A gene's symbol is at most so long.
LONGEST_SYMBOL = 21
#: Keys of a share link.
LINK_KEYS = ["motif", "demo", "fetch", "source", "species", "upstream", "circular", "lesson"]


def region(query: Column) -> Column:
    """struct(name, start, end, strand) of a place such as chr1:1,000-2,000:-1, texts as they are; null for anything else.

    The name ends at a colon or blank; .. and both dashes stand between the ends; a strand may follow behind another colon.
    """
    plain = F.regexp_replace(F.translate(F.replace(F.trim(query), F.lit(".."), F.lit("-")), "–,", "-"), r"\s*-\s*(?=\d+(\s*:|\s*$))", "-")
    parts = F.split(plain, r"\s*:|\s")
    ends = F.split(F.get(parts, F.lit(1)), "-")
    strand = F.coalesce(F.get(parts, F.lit(2)), F.lit("1"))
    named = F.get(parts, F.lit(0)).rlike(r"^[\w.]+$")
    numbers = (F.size(ends) == 2) & F.forall(ends, lambda e: e.rlike(r"^\d+$"))
    found = (F.size(parts) <= 3) & named & numbers & F.abs(strand.try_cast("int")).eqNullSafe(1)
    return F.when(found, F.struct(F.get(parts, F.lit(0)).alias("name"), F.get(ends, F.lit(0)).alias("start"), F.get(ends, F.lit(1)).alias("end"), strand.alias("strand")))


def is_symbol(query: Column) -> Column:
    """Whether a text could be a gene's symbol: a letter first, then letters, digits, dots, dashes and underscores."""
    return query.rlike(r"^[A-Za-z][\w.-]*$") & (F.length(query) <= LONGEST_SYMBOL)


def detect_source(query: Column) -> Column:
    """ensembl, ncbi or uniprot by the form of an identifier; null for what looks like a search."""
    q = F.trim(query)
    forms = [(region(q).isNotNull(), "ensembl"), (q.rlike(ENSEMBL), "ensembl"), (q.rlike(REFSEQ), "ncbi"), (q.rlike(UNIPROT), "uniprot"), (q.rlike(GENBANK), "ncbi"), (is_symbol(q), "ensembl")]
    return F.coalesce(*[F.when(told, source) for told, source in forms])


def uniprot_defline(text: Column) -> Column:
    """struct(description, organism, gene) of a defline whose fields follow as KEY=value; what is missing is empty."""
    parts = F.split(text, r"\s+(?=[A-Z]{2}=)")
    fields = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.struct(F.left(x, F.lit(2)).alias("key"), F.trim(F.substring(x, 4, 2**31 - 1)).alias("value")))
    of = lambda key: F.coalesce(F.try_element_at(F.filter(fields, lambda x: x["key"] == key), F.lit(1))["value"], F.lit(""))
    return F.when(text.isNotNull(), F.struct(F.trim(F.get(parts, F.lit(0))).alias("description"), of("OS").alias("organism"), F.substring_index(of("GN"), " ", 1).alias("gene")))


def ensembl_description(text: Column) -> Column:
    """Without the credit in brackets at its end that names the source; null gives an empty text."""
    t = F.rtrim(F.coalesce(text, F.lit("")))
    credit = F.substring_index(t, "[Source:", -1)
    ends = t.contains("[Source:") & (F.instr(credit, "]") == F.length(credit))
    return F.trim(F.when(ends, F.left(t, F.length(t) - F.length(credit) - len("[Source:"))).otherwise(t))


def _placed(text: Column) -> Column:
    """The six fields of kind:assembly:name:from:to:strand, or null."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), ":", -1)
    at = lambda k: F.get(parts, F.lit(k))
    numbers = at(3).rlike(r"^\d+$") & at(4).rlike(r"^\d+$") & at(5).isin("1", "-1")
    words = at(0).rlike(r"^\w+$") & at(1).rlike(r"^\S+$") & at(2).rlike(r"^\S+$")
    return F.when((F.size(parts) == 6) & words & numbers, parts)


def ensembl_coordinates(text: Column) -> Column:
    """A region's coordinates as a sentence; an empty text for anything else."""
    x = _placed(text)
    number = lambda k: F.format_number(F.get(x, F.lit(k)).try_cast("decimal(30,0)"), 0)
    side = F.element_at(F.create_map(F.lit("1"), F.lit("plus"), F.lit("-1"), F.lit("minus")), F.get(x, F.lit(5)))
    return F.coalesce(F.format_string("%s %s:%s-%s on the %s strand of %s", F.get(x, F.lit(0)), F.get(x, F.lit(2)), number(3), number(4), side, F.get(x, F.lit(1))).substr(F.lit(1), F.when(x.isNotNull(), 2**31 - 1)), F.lit(""))


def ensembl_assembly(text: Column) -> Column:
    return F.coalesce(F.get(_placed(text), F.lit(1)), F.lit(""))


def escape_html(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def prose(text: Column) -> Column:
    """Escaped text with **bold** marked up."""
    return F.regexp_replace(escape_html(text), r"\*\*(.+?)\*\*", "<strong>$1</strong>")


def annotate(text: Column, terms: list[str]) -> Column:
    """The first appearance of each term outside of tags wrapped in <dfn>, longer terms first, so that none is wrapped within another."""
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        literal = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", term)
        outside = r"(?is)\A((?:[^<]|<dfn>[^<]*</dfn>|<[^>]*>)*?)(?<!\w)(" + literal + r")(?!\w)(?![^<]*(?:>|</dfn>))"
        text = F.regexp_replace(text, outside, "$1<dfn>$2</dfn>")
    return text


def uri_component(text: Column) -> Column:
    """Percent encoding that leaves letters, digits and - _ . ! ~ * ' ( ) alone."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def encode_link(motif: Column, fetch: Column, upstream: Column, circular: Column) -> Column:
    """The fragment of a share link; what is null, empty, 0 or false is left out."""
    form = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(F.url_encode(x), F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")")), F.lit("%27"), F.lit("'")), F.lit("%22"), F.lit('"')), F.lit("%2F"), F.lit("/"))
    said = lambda key, x: F.when(F.trim(x) != "", F.concat(F.lit(f"{key}="), form(F.trim(x))))
    far = F.when(F.coalesce(fetch, F.lit("")) != "", F.when(upstream != 0, F.concat(F.lit("upstream="), upstream.cast("string"))))
    return F.concat_ws("&", said("motif", motif), said("fetch", fetch), far, F.when(circular, "circular=true"))


def decode_link(fragment: Column, longest: int | None = 4000) -> Column:
    """map of a link's known keys; values over ``longest`` characters are dropped (None: never), upstream is held between 0 and 100,000, an example beats a fetch."""
    # The first value of a repeated key counts, and + stands for a space.
    parts = F.filter(F.split(F.regexp_replace(fragment, "^#", ""), "&"), lambda p: p.contains("="))
    key, value = (lambda p: F.substring_index(p, "=", 1)), (lambda p: F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, 2**31 - 1)))
    known = F.filter(parts, lambda p: key(p).isin(LINK_KEYS) & value(p).isNotNull() & (F.lit(longest is None) | (F.length(value(p)) <= (longest or 0))))
    pairs = F.transform(known, lambda p: F.struct(key(p).alias("key"), F.when(key(p) == "upstream", F.least(F.greatest(F.coalesce(F.round(value(p).try_cast("double")).try_cast("long"), F.lit(0)), F.lit(0)), F.lit(100000)).cast("string")).when(key(p) == "circular", F.when(value(p).isin("true", "1"), "true")).otherwise(value(p)).alias("value")))
    kept = F.filter(pairs, lambda x: x["value"].isNotNull() & ~((x["key"] == "upstream") & (x["value"] == "0")))
    demo = F.exists(kept, lambda x: x["key"] == "demo")
    kept = F.filter(kept, lambda x: ~((x["key"] == "fetch") & demo))
    once = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(once)


def salvaged_reply(text: Column) -> Column:
    """The JSON object within a reply as struct(motif, name, explanation, assumptions); strings trimmed, empty assumptions dropped."""
    json = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    x = F.from_json(json, "motif string, name string, explanation string, assumptions array<string>")
    kept = F.filter(F.transform(F.coalesce(x["assumptions"], F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    return F.when(x.isNotNull(), F.struct(*[F.trim(F.coalesce(x[c], F.lit(""))).alias(c) for c in ("motif", "name", "explanation")], kept.alias("assumptions")))
