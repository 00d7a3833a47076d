"""The motif library as a table: reading, finding, ranking, auditing and checking entries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.letters import letters
from ..lang.motif import MotifError, Pwm, Symbol, build, label_of, motif, nodes, options, read_all, show, span
from .search import located_hits, search

# The categories that imply an alphabet, and the words a request is not ranked by.
PROTEIN_CATEGORIES = ["protein", "targeting", "modification", "protease", "tag", "domain", "binding-site", "catalytic", "degradation", "linker"]
RNA_CATEGORIES = ["rna", "rna-structure", "utr", "splicing-rna", "mirna", "riboswitch", "trna", "recoding", "stability", "localisation", "ires", "small-rna", "viral"]
STOP_WORDS = ["the", "and", "with", "that", "this", "from", "into", "within", "then", "than", "motif", "pattern", "sequence", "bases", "base", "residues", "protein", "dna", "rna"]

ENTRY = "name string, source_file string, expr string, doc string, ref string, category string, alphabet string, example string, scan boolean, evidence string, taxon string, reviewed string, version string"


def default_alphabet(category: Column) -> Column:
    """protein, rna or dna by the category alone."""
    return F.when(category.isin(PROTEIN_CATEGORIES), "protein").when(category.isin(RNA_CATEGORIES), "rna").otherwise("dna")


def provenance(source: Column, ref: Column, evidence: Column, is_enzyme: Column) -> Column:
    """struct(evidence, pubmed, doi, source_id) of an entry: what it states, else what its source and reference tell."""
    r = F.coalesce(ref, F.lit(""))
    matrix = r.rlike(r"(?i)JASPAR\s+\S+") | F.coalesce(source, F.lit("")).rlike("(?i)jaspar")
    catalogue = is_enzyme | F.coalesce(source, F.lit("")).rlike("(?i)restriction")
    level = F.when(matrix, "measured").when(catalogue, "catalogue").when(r != "", "literature-backed").otherwise("uncited")
    return F.struct(
        F.coalesce(evidence, level).alias("evidence"), F.regexp_extract(r, r"(?i)PubMed\s+(\d+)", 1).alias("pubmed"),
        F.regexp_extract(r, r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b", 1).alias("doi"), F.regexp_extract(r, r"(?i)JASPAR\s+(\S+)", 1).alias("source_id"),
    )


def load_library(spark: SparkSession, files: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Entries and errors (source_file, name, message) of library texts with (defmotif ...) and (defenzyme ...) forms.

    Other forms are ignored, a form with an error is left out and the rest is read; a later definition replaces an
    earlier one in its place; a name can be used by the forms behind it.  A library is a dimension, read on the driver.
    """
    entries: dict[str, tuple] = {}
    named: dict[str, object] = {}
    errors: list[tuple[str, str, str]] = []
    for source, text in files:
        for form in read_all(text):
            if not (isinstance(form, list) and form and isinstance(form[0], Symbol) and form[0] in ("defmotif", "defenzyme")):
                continue
            name = str(form[1]) if len(form) > 1 else ""
            try:
                name = label_of(form[1])
                if form[0] == "defenzyme":
                    from ..alphabet import IUPAC

                    site = form[2].upper().split("(")[0].replace("^", "").replace("_", "")
                    if "^" not in form[2] and "(" not in form[2]:
                        raise MotifError(f"restriction site {form[2]} has no cut mark (^)")
                    expr = f'(iupac "{site}")'
                    named[name] = build(read_all(expr)[0])
                    example = "".join(IUPAC[c][0] for c in site)
                    entries[name] = (name, source, expr, f"Recognition site {form[2]}.", "", "restriction", "dna", example, True, "catalogue", "", "", "")
                    continue
                rest = list(form[2:])
                doc = rest.pop(0) if len(rest) > 1 and isinstance(rest[0], str) and not isinstance(rest[0], Symbol) else ""
                args, key = options(rest)
                if not args:
                    raise MotifError("no motif given")
                node = named[name] = build(args[0], named)
                category = label_of(key["category"]) if "category" in key else "misc"
                fallback = "protein" if category in PROTEIN_CATEGORIES else "rna" if category in RNA_CATEGORIES else "dna"
                alphabet = label_of(key["alphabet"]) if "alphabet" in key else fallback
                evidence = label_of(key["evidence"]) if "evidence" in key else None
                entries[name] = (name, source, show(node), " ".join(doc.split()), key.get("ref", ""), category, alphabet, key.get("example"), key.get("scan") is not False, evidence, key.get("taxon", ""), key.get("reviewed", ""), key.get("version", ""))
            except (MotifError, IndexError, KeyError, TypeError, AttributeError) as e:
                errors.append((source, name, str(e)))
    return spark.createDataFrame(list(entries.values()), ENTRY), spark.createDataFrame(errors, "source_file string, name string, message string")


def natural_key(name: Column) -> Column:
    """A sort key in which numbers count by value: every run of digits without leading zeros behind its own length."""
    marked = F.regexp_replace(F.lower(name), r"(\d+)", "\u0001$1\u0001")
    parts = F.transform(F.split(marked, "\u0001"), lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lpad(F.length(F.ltrim(p, F.lit("0"))).cast("string"), 10, "0"), F.ltrim(p, F.lit("0")))).otherwise(p))
    return F.array_join(parts, "")


def category_counts(library: DataFrame) -> DataFrame:
    """(category, motifs) in lower case; a null category is misc."""
    return library.groupBy(F.lower(F.coalesce("category", F.lit("misc"))).alias("category")).agg(F.count(F.lit(1)).alias("motifs"))


def audit(library: DataFrame) -> DataFrame:
    """(evidence, entries, attributable, with_example, reviewed, incomplete) by evidence level, a null one being uncited."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    incomplete = F.col("doc").isNull() | F.col("category").isNull() | F.col("alphabet").isNull()
    level = F.coalesce("evidence", F.lit("uncited"))
    return library.groupBy(level.alias("evidence")).agg(F.count(F.lit(1)).alias("entries"), has("ref").alias("attributable"), has("example").alias("with_example"), has("reviewed").alias("reviewed"), F.count_if(incomplete).alias("incomplete"))


def catalogue(library: DataFrame) -> DataFrame:
    """(source_file, category, motifs): the names of each source and category in natural order, as one text."""
    names = F.array_sort(F.collect_list(F.struct(natural_key(F.col("name")).alias("k"), F.col("name").alias("n"))))
    by = [F.coalesce("source_file", F.lit("")).alias("source_file"), F.lower(F.coalesce("category", F.lit("misc"))).alias("category")]
    return library.groupBy(*by).agg(F.array_join(F.transform(names, lambda x: x["n"]), ", ").alias("motifs"))


def find_entries(library: DataFrame, text: str | None = None, category: str | None = None, alphabet: str | None = None) -> DataFrame:
    """Entries with all properties asked for; the text may stand in name, doc, category or ref, in any case. ``place`` counts them in natural order."""
    found = library
    if category:
        found = found.where(F.col("category") == category)
    if alphabet:
        found = found.where(F.col("alphabet") == alphabet)
    if text:
        anywhere = F.lower(F.concat_ws("\u0001", "name", "doc", "category", "ref"))
        found = found.where(F.contains(anywhere, F.lit(text.lower())))
    # The library is a dimension, so one task may number it.
    return found.withColumn("place", F.row_number().over(W.orderBy(natural_key(F.col("name")), "name")))


def rank_entries(library: DataFrame, request: str, protein: bool = False, most: int = 12) -> DataFrame:
    """(name, score) of the entries that fit a request best: words in common, and a quarter for the alphabet; at least 1, at most ``most`` entries."""
    words = lambda text: F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    asked = F.array_except(words(F.lit(request)), F.array(*map(F.lit, STOP_WORDS)))
    hay = words(F.concat_ws(" ", "name", "category", "doc"))
    bonus = F.when((F.coalesce("alphabet", F.lit("dna")) == "protein") == F.lit(protein), 0.25).otherwise(0.0)
    scored = library.select("name", (F.size(F.array_intersect(asked, hay)) + bonus).alias("score")).where(F.col("score") >= 1)
    return scored.orderBy(F.col("score").desc(), "name").limit(most)  # a top-k report


def newest_versions(library: DataFrame) -> DataFrame:
    """(stem, name, version) of the newest entry of each stem (the name up to its first dash, in upper case): the highest version number, then the last name."""
    number = F.coalesce(F.regexp_extract("version", r"(\d+)", 1).try_cast("int"), F.lit(0))
    stem = F.upper(F.substring_index("name", "-", 1))
    first = F.row_number().over(W.partitionBy(stem).orderBy(number.desc(), F.col("name").desc()))
    return library.withColumn("_first", first).where(F.col("_first") == 1).select(stem.alias("stem"), "name", "version")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for source in batch.column(1).to_pylist():
            try:
                node = motif(source)
                again = motif(show(node)) if not any(isinstance(x, Pwm) for x in nodes(node)) else node
                rows.append((show(node), *span(node), show(again) == show(node), None))
            except MotifError as e:
                rows.append((None, None, None, None, str(e)))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds))], names=["name", "canonical", "least", "greatest", "reads_back", "error"])


def readings(library: DataFrame) -> DataFrame:
    """(name, canonical, least, greatest, reads_back, error): how each motif reads, and whether its canonical text reads back the same.

    Entries without a name or text are left out; a matrix shows as a summary, which isn't read back.
    """
    m = library.where(F.col("name").isNotNull() & F.col("expr").isNotNull()).select("name", "expr")
    return m.mapInArrow(_read, "name string, canonical string, least int, greatest int, reads_back boolean, error string")


def check_examples(library: DataFrame) -> DataFrame:
    """(name, hits, matched) of every readable motif with an example: whether its own example contains it. Each example only meets its own motif."""
    good = readings(library).where(F.col("error").isNull()).select("name")
    shown = library.where((F.coalesce("example", F.lit("")) != "") & F.col("name").isNotNull()).join(good, "name", "left_semi")
    kind = F.when(F.lower("alphabet") == "protein", "protein").otherwise(F.coalesce(F.lower("alphabet"), F.lit("dna")))
    as_records = shown.select(F.col("name").alias("record_id"), "name", kind.alias("type"), F.lit(0).alias("offset"), F.col("example").alias("seq"))
    hits = located_hits(as_records, library, own=True).groupBy("record_id").agg(F.count(F.lit(1)).alias("_h"))
    counted = shown.join(hits, shown["name"] == hits["record_id"], "left")
    return counted.select("name", F.coalesce("_h", F.lit(0)).alias("hits"), F.coalesce(F.col("_h") > 0, F.lit(False)).alias("matched"))


def verify_draft(spark: SparkSession, source: str, positives: list[str], negatives: list[str], kind: str = "dna") -> DataFrame:
    """(example, expected, hits, ok) of a drafted motif: positive examples need a hit, negative ones must have none. A motif that can't be read raises MotifError."""
    rows = [(i, x, True) for i, x in enumerate(positives)] + [(i, x, False) for i, x in enumerate(negatives, len(positives))]
    e = spark.createDataFrame(rows, "record_id long, example string, expected boolean")
    as_records = e.select("record_id", F.lit("").alias("name"), F.lit(kind).alias("type"), F.lit(0).alias("offset"), F.col("example").alias("seq"))
    hits = search(as_records, source).groupBy("record_id").agg(F.count(F.lit(1)).alias("_h"))
    e = e.join(hits, "record_id", "left").withColumn("hits", F.coalesce("_h", F.lit(0)))
    return e.select("example", "expected", "hits", ((F.col("hits") > 0) == F.col("expected")).alias("ok"))


def species_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s-]+", "_")


def suggest_species(typed: DataFrame, species: DataFrame, most: int = 10_000) -> DataFrame:
    """(typed, suggestion) of names that aren't a species' own: an exact display, common or alias name, else the
    nearest name within three letters (two below ten letters), else the first that begins so.

    ``species`` is a dimension of at most ``most`` rows; the suggestion is null where nothing is near. Null and blank names are left out.
    """
    t = typed.select("typed", species_key(F.col("typed")).alias("_key")).where(F.col("_key") != "").distinct()
    rows = species.select("name", "display", "common", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).limit(most + 1).collect()
    if len(rows) > most:
        raise MotifError(f"more than {most} species")
    text = lambda x: F.lit(x).cast("string")
    # The list travels as a constant of the plan; each name is held against all of it in its row.
    known = F.array(*[F.struct(F.lit(r.name).alias("n"), F.array(*[text(x.lower()) for x in (r.display, r.common, *r.aliases) if x is not None]).cast("array<string>").alias("names")) for r in sorted(rows, key=lambda r: r.name)])
    words = F.translate("_key", "_", " ")
    first = lambda test: F.try_element_at(F.filter(known, test), F.lit(1))["n"]
    exact = first(lambda s: F.array_contains(s["names"], words) | F.array_contains(s["names"], F.col("_key")))
    near = F.array_min(F.transform(known, lambda s: F.struct(F.levenshtein(F.col("_key"), s["n"]).alias("d"), s["n"].alias("n"))))
    close = F.when(near["d"] <= F.when(F.length("_key") >= 10, 3).otherwise(2), near["n"])
    begins = F.when(F.length("_key") >= 4, first(lambda s: F.startswith(s["n"], F.col("_key"))))
    own = F.exists(known, lambda s: s["n"] == F.col("_key"))
    return t.where(~own).select("typed", F.coalesce(exact, close, begins).alias("suggestion"))


def letters_of(records: DataFrame) -> DataFrame:
    """(record_id, letters): counts of letters."""
    return records.select("record_id", F.length(letters(F.col("seq"))).alias("letters"))
