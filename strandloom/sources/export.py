"""Hits as TSV, BED, GFF3 and JSON lines; positions come with the record's offset added (see ``search.absolute``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import uri_component

HEADERS = {
    "tsv": "sequence\tmotif\tstart\tend\tlength\tstrand\tmatch\tdetail",
    "bed": 'track name=strandloom description="Motif hits; BED coordinates are 0-based, end-exclusive"',
    "gff3": "##gff-version 3",
}


def number(x: Column) -> Column:
    """A number as short as it reads: without a fraction of zero."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, F.when(whole, x).cast("long").cast("string")).otherwise(x.cast("string"))


def detail(score: Column, extra: Column, bindings: Column) -> Column:
    """score, extra numbers and bound texts as array of struct(key, value) in that order; a later value of a key takes the place of an earlier one."""
    first = F.when(score.isNotNull() & ~F.isnan(score), F.array(F.struct(F.lit("score").alias("key"), number(score).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    numbers = F.transform(F.array_sort(F.map_entries(extra)), lambda e: F.struct(e["key"].alias("key"), number(e["value"]).alias("value")))
    texts = F.transform(bindings, lambda b: F.struct(b["label"].alias("key"), b["text"].alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    rows = F.concat(first, F.coalesce(numbers, none), F.coalesce(texts, none))
    keys = F.array_distinct(F.transform(rows, lambda x: x["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(rows, lambda x: x["key"] == k), -1)["value"].alias("value")))


def detail_text(score: Column, extra: Column, bindings: Column) -> Column:
    return F.array_join(F.transform(detail(score, extra, bindings), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("")))), ";")


def line(kind: str) -> Column:
    """One hit as a line of tsv, bed, gff3 or json; TSV, GFF3 and JSON count from 1 and include the end, BED counts from 0 and doesn't."""
    name = F.coalesce(F.col("sequence"), F.lit(""))
    start, end = F.col("start"), F.col("end")
    shown = F.when(name == "", "sequence").otherwise(name)
    valid_score = F.when(F.col("score").isNotNull() & ~F.isnan("score"), number(F.col("score")))
    tab = lambda *c: F.concat_ws("\t", *[F.coalesce(x.cast("string"), F.lit("")) for x in c])
    if kind == "bed":
        return tab(shown, start, end, F.col("motif"), F.coalesce(valid_score, F.lit("0")), F.col("strand"))
    if kind == "gff3":
        attr = lambda c: F.replace(uri_component(F.col(c)), F.lit("%20"), F.lit("+"))
        attributes = F.concat(F.lit("Name="), attr("motif"), F.lit(";matched_sequence="), attr("match"))
        return tab(shown, F.lit("strandloom"), F.lit("sequence_motif"), start + 1, end, F.coalesce(valid_score, F.lit(".")), F.col("strand"), F.lit("."), attributes)
    if kind == "json":
        fields = detail(F.col("score"), F.col("extra"), F.col("bindings"))
        return F.to_json(F.struct(name.alias("sequence"), "motif", (start + 1).alias("start"), end.alias("end"), (end - start).alias("length"), "strand", "match", F.when(~F.isnan("score"), F.col("score")).alias("score"), F.map_from_entries(fields).alias("detail")))
    return tab(name, F.col("motif"), start + 1, end, end - start, F.col("strand"), F.col("match"), detail_text(F.col("score"), F.col("extra"), F.col("bindings")))


def lines(hits: DataFrame, kind: str = "tsv") -> DataFrame:
    """(value) of all hits with a start and an end, one line each, without header."""
    return hits.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select(line(kind).alias("value"))


def write_hits(hits: DataFrame, path: str, kind: str = "tsv") -> None:
    """Write hits as text files, each of which begins with the format's header."""
    out = lines(hits, kind)
    if kind in HEADERS:
        # The first row of each task carries the header.
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        out = out.select(F.when(first, F.concat(F.lit(HEADERS[kind] + "\n"), F.col("value"))).otherwise(F.col("value")).alias("value"))
    out.write.text(path)
