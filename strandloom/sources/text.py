"""FASTA and GenBank texts as records, and records as FASTA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "name string, description string, type string, offset long, seq string"


def _fasta(text: Column) -> Column:
    """Array of struct(name, description, type, seq) of a FASTA text; what stands before the first header is left out."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)^[ \t]*;.*$", "")
    chunks = F.split(clean, r"(?m)^[ \t]*>", -1)
    behind = F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0)))

    def record(chunk: Column) -> Column:
        header = F.trim(F.substring_index(chunk, "\n", 1))
        space = F.instr(header, " ")
        rest = F.when(F.instr(chunk, "\n") > 0, F.substring(chunk, F.instr(chunk, "\n"), 2**31 - 1)).otherwise("")
        return F.struct(
            F.when(space > 0, F.substring(header, F.lit(1), space - 1)).otherwise(header).alias("name"),
            F.when(space > 0, F.substring(header, space + 1, F.length(header))).otherwise("").alias("description"),
            F.lit(None).cast("string").alias("type"), F.regexp_replace(rest, r"\s", "").alias("seq"),
        )

    bare = F.regexp_replace(text, r"[^A-Za-z*\-]", "")
    alone = F.array(F.struct(F.lit("sequence").alias("name"), F.lit("").alias("description"), F.lit(None).cast("string").alias("type"), bare.alias("seq")))
    return F.when(F.size(behind) > 0, F.transform(behind, record)).when(bare != "", alone)


def _genbank(text: Column) -> Column:
    """Array of struct(name, description, type, seq) of a GenBank flat file's entries that have a LOCUS and an ORIGIN."""
    entries = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)^//[ \t]*$")
    used = F.filter(entries, lambda e: e.rlike(r"(?m)^LOCUS\s+\S") & e.rlike(r"(?m)^ORIGIN[ \t]*$"))

    def record(e: Column) -> Column:
        locus = F.regexp_extract(e, r"(?m)^LOCUS\s+\S+(.*)$", 1)
        definition = F.regexp_extract(e, r"(?m)^DEFINITION\s+(.+(?:\n\s{12}.+)*)", 1)
        seq = F.regexp_replace(F.regexp_extract(e, r"(?ms)^ORIGIN[ \t]*$(.*)", 1), r"[^A-Za-z*\-]", "")
        return F.struct(
            F.regexp_extract(e, r"(?m)^LOCUS\s+(\S+)", 1).alias("name"), F.regexp_replace(F.trim(F.regexp_replace(definition, r"\n\s+", " ")), r"\.$", "").alias("description"),
            F.when(locus.rlike(r"(?i)\baa\b|PROTEIN"), "protein").alias("type"), seq.alias("seq"),
        )

    return F.filter(F.transform(used, record), lambda r: r["seq"] != "")


def parse_sequences(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with name, description, type, offset and seq of each record in the column ``text``.

    A text with a LOCUS and an ORIGIN line is GenBank, any other FASTA or, without a header, one bare sequence.
    Null and empty texts give no row.  The type is null unless the text states it.  Columns of these names in ``texts`` are replaced.
    """
    t = F.col(text)
    is_genbank = t.rlike(r"(?m)^\s*LOCUS\s+") & t.rlike(r"(?m)^ORIGIN\s*$")
    kept = [c for c in texts.columns if c not in ("name", "description", "type", "offset", "seq", text)]
    rows = texts.select(*kept, F.explode(F.when(is_genbank, _genbank(t)).otherwise(_fasta(t))).alias("_r"))
    return rows.select(*kept, "_r.name", "_r.description", "_r.type", F.lit(0).cast("long").alias("offset"), "_r.seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files that begin with a header, cut at the headers by the reader, so that one large file is read in many tasks."""
    chunks = spark.read.option("lineSep", "\n>").text(path).select(F.concat(F.lit(">"), F.regexp_replace("value", "^>", "")).alias("text"))
    return parse_sequences(chunks)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Records of files of any of the formats, a file being read as a whole."""
    return parse_sequences(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def fasta(name: Column, description: Column, seq: Column, width: int = 70) -> Column:
    """A record as FASTA text, the sequence in lines of ``width`` letters."""
    more = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(" "), description)).otherwise("")
    lines = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    body = F.when(F.coalesce(seq, F.lit("")) != "", F.concat(F.lit("\n"), lines)).otherwise("")
    return F.concat(F.lit(">"), F.coalesce(name, F.lit("")), more, body)


def write_fasta(records: DataFrame, path: str, width: int = 70) -> None:
    records.select(fasta(F.col("name"), F.col("description"), F.col("seq"), width).alias("value")).write.text(path)


def matrices(texts: DataFrame, text: str = "text") -> DataFrame:
    """(id, name, letter, pos, count) of position frequency matrices: a header >id name and a row A [ ... ] for each letter."""
    chunks = F.split(F.col(text), r"(?m)^>", -1)
    one = texts.select(F.explode(F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0)))).alias("_m"))
    head = F.trim(F.substring_index("_m", "\n", 1))
    rows = one.select(F.substring_index(head, "\t", 1).alias("_h"), F.regexp_extract(head, r"^(\S+)", 1).alias("id"), F.regexp_extract(head, r"^\S+\s+(.*)$", 1).alias("name"), F.explode(F.regexp_extract_all("_m", F.lit(r"(?m)^\s*([ACGT]\s*\[[^\]]*\])"), F.lit(1))).alias("_r"))
    counts = F.filter(F.split(F.trim(F.regexp_extract("_r", r"\[([^\]]*)\]", 1)), r"\s+"), lambda x: x != "")
    return rows.select("id", "name", F.left("_r", F.lit(1)).alias("letter"), F.posexplode(counts).alias("pos", "_c")).select("id", "name", "letter", "pos", F.col("_c").cast("double").alias("count"))
