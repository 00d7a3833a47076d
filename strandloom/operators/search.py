"""Motif search on both strands, and motif x record scans.

Records are cut into tiles with a margin as wide as the widest match, so that a match belongs to exactly one tile, no
matter how long the record is.  Regular motifs, mismatch budgets included, run as expressions of the JVM: a tile is split
where a match begins, and lengths add up to positions.  Weights, edits and hairpins run as array kernels on wider tiles.
Motifs are rows: a library is parsed where its rows are and joined with the tiles of its alphabet class.  Hits are not
shuffled: a reverse hit that repeats a palindrome's forward hit is recognised inside the tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..alphabet import COMPLEMENT, reverse_complement
from ..functions.letters import letters
from ..functions.sequence import guess_type, normalize
from ..lang.kernels import kernel, taken_up
from ..lang.motif import Edge, MotifError, first_letters, motif, nodes, normal, show, span
from ..lang.patterns import FIRST, INNER, LAST, OPEN, mirrored, patterns, whole
from ..session import hinted, written

#: Starts in a tile of the JVM's expressions and of the array kernels.
TILE, WIDE_TILE = 1 << 10, 1 << 15
_MOTIF = ["motif", "look", "back", "taken", "taken_back", "again", "located", "groups", "fixed", "widest", "free"]
_OUT = ["record_id", "_name", "_offset", "n", "motif", "start", "end", "strand", "match", "score", "extra", "bindings"]
#: Letters of tiles that a kernel goes through end to end.
TOGETHER = 1 << 18
#: Motifs of a library that are joined with the tiles at once; a larger one is scanned in several parts.
MOST = 10_000
_COMPLEMENTS = "".join(COMPLEMENT.get(c, "N") for c in ascii_uppercase)

HITS = ["record_id", "sequence", "offset", "motif", "start", "end", "strand", "match", "score", "extra", "bindings"]
_COMPILED = (
    "motif string, source string, nuc boolean, tier string, look string, back string, taken string, taken_back string, again string, located string, "
    "groups array<struct<kind:string,label:string,at:int,allowed:array<string>>>, fixed int, widest int, free boolean, letters string, error string"
)
_BIND = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))


# ------------------------------------------------------------------- motifs as rows


def compiled_rows(name: str, source: str, alphabet: str | None) -> list[tuple]:
    """A motif compiled for each alphabet class it can meet; one row with ``error`` if it cannot be read."""
    try:
        node = motif(source)
    except MotifError as e:
        return [(name, source, None, "error", *[None] * 11, str(e))]
    rows = []
    for nuc in (True, False) if alphabet is None else (alphabet != "protein",):
        least, most = span(node)
        p = patterns(node, nuc)
        bounded = most is not None
        tier = ("tile" if bounded and not p["free"] else "whole") if p else ("kernel" if bounded else "kernel-whole")
        look = back = taken = taken_back = again = located = fixed = None
        groups: list = []
        if p:
            forward, reverse = p["forward"], p["backward"] or p["forward"]
            look, back, taken, taken_back = f"(?={forward})", f"(?={reverse})", f"(?=({forward}))", f"(?=({reverse}))"
            again, located, groups = rf"(?s)\A.({forward})", p["located"], p["groups"]
            if least == most and not any(isinstance(x, Edge) for x in nodes(node)):
                fixed = int(most)
        first = None if p else first_letters(node, nuc)
        first = f"[{''.join(sorted(set(first + mirrored(first) if nuc else first)))}]" if first else None
        rows.append((name, source, nuc, tier, look, back, taken, taken_back, again, located, groups, fixed, int(most) if bounded else None, bool(p and p["free"]), first, None))
    return rows


def _compile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.bool_(), *[pa.string()] * 7, pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("at", pa.int32()), ("allowed", pa.list_(pa.string()))])), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
    names = [c.split()[0] for c in _COMPILED.replace("array<struct<kind:string,label:string,at:int,allowed:array<string>>>", "x").split(", ")]
    for batch in batches:
        rows = [row for some in zip(*(c.to_pylist() for c in batch.columns)) for row in compiled_rows(*some)]
        named = [[dict(zip(("kind", "label", "at", "allowed"), g)) for g in r[10] or []] for r in rows]
        columns = [named if c == 10 else [r[c] for r in rows] for c in range(len(kinds))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def compiled(motifs: DataFrame) -> DataFrame:
    """Rows (name, expr, alphabet) of motifs compiled where they are; those that cannot be read have ``error``. Null names and expressions are left out."""
    m = motifs.where(F.col("name").isNotNull() & F.col("expr").isNotNull()).select("name", "expr", F.lower("alphabet").alias("alphabet"))
    return m.mapInArrow(_compile, _COMPILED)


def usable(library: DataFrame, enzymes: bool = False) -> DataFrame:
    """The entries of a library that take part in scans: not those with scan false nor, unless ``enzymes`` is set, those of category restriction."""
    kept = F.lit(enzymes) | (F.lower(F.coalesce("category", F.lit(""))) != "restriction")
    return library.where(F.coalesce("scan", F.lit(True)) & kept)


# ------------------------------------------------------------------- tiles


def _windows(r: DataFrame, size: int, margin: int) -> DataFrame:
    """Tiles (record columns, n, base, left, own, right) of ``size`` own letters with ``margin`` letters around them."""
    size = max(size, margin, 1)
    keys = [c for c in r.columns if c != "_t"]
    d = r.select(*keys, F.length("_t").cast("long").alias("n"), F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_c"))
    beside = lambda i: F.coalesce(F.get("_c", i), F.lit(""))
    one = F.transform("_c", lambda x, i: F.struct((i * size).cast("long").alias("base"), F.when(i > 0, F.right(beside(i - 1), F.lit(margin))).otherwise("").alias("left"), x.alias("own"), F.left(beside(i + 1), F.lit(margin)).alias("right")))
    # An outer explode isn't preceded by a filter that would cut the tiles twice.
    return d.select(*keys, "n", F.explode_outer(one).alias("_w")).where(F.col("_w").isNotNull()).select(*keys, "n", "_w.*")


def _strands(d: DataFrame, strand: str, plus: Column, minus: Column, more: list[str]) -> DataFrame:
    """A row for each strand to be read: (more, strand, q)."""
    pick = lambda s, q: F.struct(F.lit(s).alias("strand"), q.alias("q"))
    forward, reverse = pick("+", plus), pick("-", F.when(F.col("_nuc"), minus))
    kinds = {"+": [forward], "-": [reverse, pick("+", F.when(~F.col("_nuc"), plus))]}.get(strand, [forward, reverse])
    return d.select(*more, F.explode(F.array(*kinds)).alias("_s")).select(*more, "_s.*").where(F.col("q").isNotNull())


def _running(segments: Column, block: int = 32):
    """Sums of lengths in blocks, each with 0 before it, without the last segment; and f(sums) -> what all blocks before each add up to, less one."""
    k = F.size(segments) - 1
    add = lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))
    sums = F.transform(F.sequence(F.lit(0), ((k - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(segments, b * block + 1, F.least(F.lit(block), k - b * block)), F.array(F.lit(0)), lambda a, x: add(a, F.length(x))))
    return F.when(k > 0, sums), lambda blocks: F.aggregate(blocks, F.array(F.lit(-1)), lambda a, x: add(a, F.element_at(x, -1)))


def _complement(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, _COMPLEMENTS)


# ------------------------------------------------------------------- regular motifs


def _regular(tiles: DataFrame, joined, strand: str, all_fixed: bool) -> DataFrame:
    """Hits of bounded regular motifs on tiles, before their bindings: (record columns, n, motif columns, start, end, strand, match)."""
    keys = ["record_id", "_name", "_offset", "n", "_nuc", "base", "_m", "_window", "_wbase"]
    # Window and margins are only carried where a palindrome's other strand may match otherwise.
    window = F.lit(None).cast("string") if all_fixed or strand != "both" else F.concat("left", "own", "right")
    d = tiles.withColumns({"_m": F.length("own"), "_window": window, "_wbase": F.col("base") - F.length("left")})
    begins, ends = F.col("base") == 0, F.col("base") + F.col("_m") == F.col("n")
    mark = lambda c: F.when(c, FIRST).otherwise(INNER)
    closing = lambda c: F.when(c, LAST).otherwise("")
    plus = F.concat(mark(begins), "own", "right", closing(F.col("base") + F.col("_m") + F.length("right") == F.col("n")))
    minus = F.concat(mark(ends), F.reverse(F.concat("left", "own")), closing(F.col("base") == F.length("left")))
    d = joined(_strands(d, strand, plus, minus, keys))
    forward = F.col("strand") == "+"
    keys = [*keys, "strand", *_MOTIF]
    d = d.select(*keys, "q", F.split("q", F.when(forward, F.col("look")).otherwise(F.col("back")), -1).alias("_g"))
    sums, bases = _running(F.col("_g"))
    # Matches of one width are cut out at their start; others are asked for where there are any.
    found = F.when(F.size("_g") > 1, F.regexp_extract_all("q", F.when(forward, F.col("taken")).otherwise(F.col("taken_back")), F.lit(1)))
    texts = F.when(F.col("fixed").isNull(), found)
    d = d.select(*keys, "q", sums.alias("_sums"), (F.lit(None).cast("array<string>") if all_fixed else texts).alias("_texts"))
    at = F.flatten(F.zip_with("_sums", F.slice(bases(F.col("_sums")), F.lit(1), F.size("_sums")), lambda x, b: F.transform(F.slice(x, F.lit(2), F.size(x) - 1), lambda y: y + b)))
    d = d.select(*keys, "q", at.alias("_at"), "_texts")
    text = lambda p, i: F.coalesce(F.get("_texts", i), F.substring("q", p + 2, F.col("fixed")))
    own = F.filter(F.transform("_at", lambda p, i: F.when(p < F.col("_m"), F.struct(p.alias("p"), text(p, i).alias("x")))), lambda h: h.isNotNull())
    d = d.select(*keys, F.explode_outer(own).alias("_h")).where(F.col("_h").isNotNull())
    x, p = F.when(forward, F.col("_h.x")).otherwise(_complement(F.col("_h.x"))), F.col("_h.p")
    d = d.select(*keys, p.alias("_p"), x.alias("match"))
    w = F.length("match")
    d = d.withColumn("start", F.when(forward, F.col("base") + F.col("_p")).otherwise(F.col("base") + F.col("_m") - F.col("_p") - w))
    d = d.withColumn("end", F.col("start") + w)
    if strand == "both":
        palindrome = F.col("match") == F.reverse(_complement(F.col("match")))
        if all_fixed:
            same = F.lit(True)
        else:
            here = F.concat(mark(F.col("start") == 0), F.substring("_window", (F.col("start") - F.col("_wbase") + 1).cast("int"), F.col("widest")), closing(F.col("start") + F.col("widest") >= F.col("n")))
            same = F.col("fixed").isNotNull() | (F.length(F.call_function("regexp_extract", here, F.col("again"), F.lit(1))) == w)
        d = d.where(forward | ~F.when(palindrome, same).otherwise(False))
    return d


def _whole(r: DataFrame, joined, strand: str) -> DataFrame:
    """Hits of regular motifs without a bound of width, or that look anywhere: each strand is read as a whole."""
    d = joined(r.select(*[c for c in r.columns if c != "_t"], F.length("_t").cast("long").alias("n"), F.col("_t"), F.monotonically_increasing_id().alias("_row"), F.xxhash64("_t").alias("_same")).where(F.col("n") > 0))
    free = F.col("free")
    plus = F.when(free, F.col("_t")).otherwise(F.concat(F.lit(FIRST), "_t", F.lit(LAST)))
    minus = F.when(free, F.reverse(_complement(F.col("_t")))).otherwise(F.concat(F.lit(FIRST), F.reverse("_t"), F.lit(LAST)))
    keys = ["record_id", "_name", "_offset", "n", "_nuc", "_row", "_same", *_MOTIF]
    d = _strands(d, strand, plus, minus, keys)
    forward, keys = F.col("strand") == "+", [*keys, "strand"]
    look, taken = F.when(forward, F.col("look")).otherwise(F.col("back")), F.when(forward, F.col("taken")).otherwise(F.col("taken_back"))
    # Splitting never cuts off an empty first part, so a match at the very start is asked for.
    at_once = free & F.regexp_like("q", F.concat(F.lit(r"\A"), look))
    d = d.select(*keys, F.split("q", look, -1).alias("_g"), at_once.alias("_0"), F.regexp_extract_all("q", taken, F.lit(1)).alias("_x"))
    parts = F.when(F.col("_0"), F.concat(F.array(F.lit("")), "_g")).otherwise(F.col("_g"))
    d = d.select(*keys, F.posexplode_outer(F.arrays_zip(F.transform(parts, lambda g: F.length(g)).alias("g"), F.col("_x").alias("x"))).alias("_i", "_h"))
    # One strand's parts in order: the sum of their lengths is where a match begins.
    at = F.sum("_h.g").over(W.partitionBy("_row", "motif", "strand").orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_p", at - F.when(free, 0).otherwise(1)).where(F.length("_h.x") > 0)
    x = F.when(forward | free, F.col("_h.x")).otherwise(_complement(F.col("_h.x")))
    d = d.select(*keys, "_p", x.alias("match"))
    w = F.length("match")
    d = d.withColumn("start", F.when(forward, F.col("_p")).otherwise(F.col("n") - F.col("_p") - w)).withColumn("end", F.col("start") + w)
    if strand != "both":
        return d
    palindrome = F.col("match") == F.reverse(_complement(F.col("match")))
    # Rows with one id and one text have the same hits, so they need not be told apart here.
    on = ["record_id", "_same", "motif", "strand", "start", "end", "match"]
    return d.join(d.where(forward & palindrome).withColumn("strand", F.lit("-")).select(*on), on, "left_anti")


def _bound(d: DataFrame, plain: bool) -> DataFrame:
    """Regular hits with what their motif captures and how many letters differ."""
    nothing = {"score": F.lit(None).cast("double"), "extra": F.create_map().cast("map<string,double>"), "bindings": F.array().cast("array<struct<label:string,start:bigint,end:bigint,text:string>>")}
    if plain:
        return d.withColumns(nothing).select(*_OUT)
    forward, w = F.col("strand") == "+", F.length("match")
    first = F.when(forward, F.col("start") == 0).otherwise(F.col("end") == F.col("n"))
    last = F.when(forward, F.col("end") == F.col("n")).otherwise(F.col("start") == 0)
    marked = F.concat(F.when(first, FIRST).otherwise(INNER), "match", F.when(last, LAST).otherwise(OPEN))
    d = d.withColumn("_marked", marked)
    got = lambda k: F.call_function("regexp_extract", F.col("_marked"), F.col("located"), k)
    # What follows a group's start is captured with the closing mark, so that a group that takes no part has none.
    parts = F.transform("groups", lambda g: F.struct(g["kind"].alias("kind"), g["label"].alias("label"), g["allowed"].alias("allowed"), (w + 1 - F.length(got(g["at"]))).alias("p"), got(g["at"] + 1).alias("text")))
    d = d.withColumn("_parts", F.filter(parts, lambda g: g["p"] <= w))

    def placed(g: Column) -> Column:
        n = F.length(g["text"])
        a = F.when(forward, F.col("start") + g["p"]).otherwise(F.col("end") - g["p"] - n)
        return F.struct(g["label"].alias("label"), a.cast("long").alias("start"), (a + n).cast("long").alias("end"), g["text"].alias("text"))

    wrong = lambda g: F.size(F.filter(F.sequence(F.lit(1), F.length(g["text"])), lambda i: ~F.contains(F.element_at(g["allowed"], i), F.substring(g["text"], i, F.lit(1)))))
    near = F.filter("_parts", lambda g: (g["kind"] == "fuzzy") & (F.length(g["text"]) > 0))
    missed = F.aggregate(near, F.lit(0), lambda a, g: a + wrong(g))
    extra = F.when(F.size(near) > 0, F.create_map(F.lit("mismatches"), missed.cast("double"))).otherwise(nothing["extra"])
    bindings = F.transform(F.filter("_parts", lambda g: g["kind"] == "label"), placed)
    return d.withColumns({"score": nothing["score"], "extra": extra, "bindings": bindings}).select(*_OUT)


# ------------------------------------------------------------------- irregular motifs


def _kernels(strand: str):
    """Tiles with a motif each -> hits, a batch of arrays for each motif of a batch of tiles."""

    def packed(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        rows = np.concatenate([np.full(len(hits[0]), row, np.int32) for row, hits, _, _ in found])
        base = np.concatenate([np.full(len(hits[0]), batch.column("_wbase")[row].as_py(), np.int64) for row, hits, _, _ in found])
        names = dict.fromkeys(k for _, hits, _, _ in found for k in hits[2])
        labels = dict.fromkeys(k for _, hits, _, _ in found for k in hits[3])
        number = lambda k: np.concatenate([hits[2].get(k, np.full(len(hits[0]), np.nan)) for _, hits, _, _ in found])
        bound = lambda k, e: np.concatenate([hits[3][k][e] if k in hits[3] else np.full(len(hits[0]), -1, np.int64) for _, hits, _, _ in found])
        n = len(rows)
        score = number("score") if "score" in names else np.full(n, np.nan)
        extra = {k: number(k) for k in names if k != "score"}
        there = np.stack([~np.isnan(v) for v in extra.values()], 1) if extra else np.zeros((n, 0), bool)
        items = np.stack(list(extra.values()), 1)[there] if extra else np.empty(0)
        keys = np.tile(np.array(list(extra), object), (n, 1))[there] if extra else np.empty(0, object)
        offsets = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
        a, b = (np.stack([bound(k, e) for k in labels], 1) if labels else np.zeros((n, 0), np.int64) for e in (0, 1))
        has = a >= 0
        a, b = a + base[:, None], b + base[:, None]
        struct = pa.StructArray.from_arrays([pa.array(np.tile(np.array(list(labels), object), (n, 1))[has] if labels else [], pa.string()), pa.array(a[has]), pa.array(b[has])], names=["label", "start", "end"])
        begins = np.concatenate([[0], np.cumsum(has.sum(1))]).astype(np.int32)
        take = pa.array(rows)
        column = lambda k: np.concatenate([hits[k] for _, hits, _, _ in found])
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(take) for c in ("record_id", "_name", "_offset", "n", "motif")), pa.array(column(0) + base), pa.array(column(1) + base),
                pa.array(np.where(np.concatenate([ahead for _, _, ahead, _ in found]), "+", "-")), pa.array([x for *_, texts in found for x in texts], pa.string()), pa.array(score, from_pandas=True),
                pa.MapArray.from_arrays(pa.array(offsets), pa.array(keys, pa.string()), pa.array(items, pa.float64())), pa.ListArray.from_arrays(pa.array(begins), struct),
            ],
            names=["record_id", "_name", "_offset", "n", "motif", "start", "end", "strand", "match", "score", "extra", "_bound"],
        )

    def ready(rows: list[tuple]) -> Iterator[tuple]:
        """(both strands' hits or none) of each row; neighbours with one motif are searched end to end where that is the same."""
        at = 0
        while at < len(rows):
            source, nuc = rows[at][:2]
            m, upto, letters_ = kernel(source, nuc), at + 1, len(rows[at][2])
            while m.joinable and upto < len(rows) and rows[upto][:2] == (source, nuc) and letters_ < TOGETHER:
                letters_ += len(rows[upto][2])
                upto += 1
            if upto - at > 1:
                texts = [r[2] for r in rows[at:upto]]
                yield from zip(m.of_many(texts), m.of_many([reverse_complement(t) for t in texts]) if nuc and strand != "+" else [None] * len(texts))
            else:
                yield None, None
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = []
            count = 0
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("source", "_nuc", "_window", "_wbase", "_own", "_upto", "n"))))
            for row, ((source, nuc, text, base, own, upto, n), known) in enumerate(zip(rows, ready(rows))):
                hits, ahead, texts = kernel(source, nuc).of_tile(text, (own, upto), base, n, strand, known)
                if texts:
                    found.append((row, hits, ahead, texts))
                    count += len(texts)
                if count > 20_000:
                    yield packed(batch, found)
                    found, count = [], 0
            if found:
                yield packed(batch, found)

    return run


def _irregular(tiles: DataFrame, joined, strand: str) -> DataFrame:
    """Hits of motifs that no expression stands for."""
    window, own = F.concat("left", "own", "right"), F.length("left")
    d = tiles.select("record_id", "_name", "_offset", "n", "_nuc", window.alias("_window"), (F.col("base") - own).alias("_wbase"), own.alias("_own"), (own + F.length("own")).alias("_upto"))
    d = joined(d).select(*d.columns, "motif", "source", "letters")
    # Tiles without a letter that a match can begin with never reach the kernels.
    d = d.where(F.col("letters").isNull() | F.regexp_like("_window", F.col("letters")))
    id_type = tiles.schema["record_id"].dataType.simpleString()
    schema = f"record_id {id_type}, _name string, _offset long, n long, motif string, start long, end long, strand string, match string, score double, extra map<string,double>, _bound array<struct<label:string,start:long,end:long>>"
    found = d.mapInArrow(_kernels(strand), schema)
    back = F.col("strand") == "-"
    place = lambda b: F.when(back, F.col("end") - b["end"]).otherwise(b["start"] - F.col("start"))
    text = lambda b: F.substring("match", (place(b) + 1).cast("int"), (b["end"] - b["start"]).cast("int"))
    return found.withColumn("bindings", F.transform("_bound", lambda b: F.struct(b["label"].alias("label"), b["start"].alias("start"), b["end"].alias("end"), text(b).alias("text")))).select(*_OUT)


# ------------------------------------------------------------------- searches


def _listed(rows: list[tuple]):
    """f(tiles) -> tiles with each motif of their class, which are constants of the plan."""
    names = [c.split()[0] for c in _COMPILED.replace("array<struct<kind:string,label:string,at:int,allowed:array<string>>>", "x").split(", ")]
    kind = "array<struct<" + _COMPILED.replace("array<struct<kind:string,label:string,at:int,allowed:array<string>>>", "array<struct<kind:string;label:string;at:int;allowed:array<string>>>").replace(", ", ",").replace(" ", ":").replace(";", ",") + ">>"

    def value(x) -> Column:
        if isinstance(x, (list, tuple)):
            return F.array(*map(value, x)) if isinstance(x, list) else F.struct(*[value(y).alias(f"_{k}") for k, y in enumerate(x)])
        return F.lit(x)

    def of(nuc: bool) -> Column:
        return F.array(*[F.struct(*[value(x).alias(c) for c, x in zip(names, row)]) for row in rows if row[2] == nuc]).cast(kind)

    def joined(d: DataFrame) -> DataFrame:
        return d.withColumn("_motif", F.explode(F.when(F.col("_nuc"), of(True)).otherwise(of(False)))).select(*d.columns, "_motif.*")

    return joined


def _from_table(motifs: DataFrame, own: bool):
    """f(tiles) -> tiles joined with each motif of their class, or the one of their name; the motifs are at most MOST rows."""
    return lambda d: d.join(F.broadcast(motifs), (d["_nuc"] == motifs["nuc"]) & (d["_name"] == motifs["motif"]) if own else d["_nuc"] == motifs["nuc"])


def located_hits(records: DataFrame, motifs: DataFrame | list | str, strand: str = "both", tile: int = TILE, own: bool = False) -> DataFrame:
    """The hits of :func:`search` with ``n``, the number of the record's letters. With ``own`` a record only meets the motif of a table that has its name."""
    kind = F.coalesce(F.col("type"), guess_type(F.col("seq")))
    r = records.select("record_id", F.col("name").alias("_name"), F.coalesce(F.col("offset"), F.lit(0)).cast("long").alias("_offset"), kind.isin("dna", "rna").alias("_nuc"), normalize(letters(F.col("seq")), kind).alias("_t"))
    if isinstance(motifs, DataFrame):
        # Parsed once. Beyond MOST motifs the table is taken in parts, each of which is small enough for every task.
        m = written(compiled(motifs), "motifs")
        stats = m.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.max("widest").alias("widest"), F.count("fixed").alias("fixed"), F.max(F.size("groups")).alias("groups")).collect()
        count = sum(x["n"] for x in stats)
        parts = max(1, -(-count // MOST))
        tiers = {x["tier"]: (x["widest"], x["fixed"] == x["n"], not x["groups"]) for x in stats}
        joins = {t: [_from_table(m.where((F.col("tier") == t) & (F.pmod(F.xxhash64("motif"), F.lit(parts)) == k)), own) for k in range(parts)] for t in tiers}
        spread = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    else:
        if isinstance(motifs, str):
            motifs = [(show(motif(motifs)), motifs)]
        rows = [row for m in motifs for row in compiled_rows(m[0], m[1], m[2] if len(m) > 2 else None)]
        if bad := next((row for row in rows if row[3] == "error"), None):
            raise MotifError(bad[-1])
        some = {t: [row for row in rows if row[3] == t] for t in dict.fromkeys(row[3] for row in rows)}
        tiers = {t: (max((row[12] or 0 for row in of), default=0), all(row[11] is not None for row in of), not any(row[10] for row in of)) for t, of in some.items()}
        joins = {t: [_listed(of)] for t, of in some.items()}
        spread = 0
    out = None
    for tier, of in joins.items():
        if tier == "error":
            continue
        widest, fixed, plain = tiers[tier]
        if tier == "tile":
            cut = _windows(r, tile, widest)
        elif tier == "kernel":
            cut = _windows(r, WIDE_TILE if tile == TILE else tile, widest)
        elif tier == "kernel-whole":
            whole_text = F.col("_t").alias("own")
            cut = r.select("record_id", "_name", "_offset", "_nuc", F.length("_t").cast("long").alias("n"), F.lit(0).cast("long").alias("base"), F.lit("").alias("left"), whole_text, F.lit("").alias("right")).where(F.col("n") > 0)
        else:
            cut = r
        # Many motifs work long on little text, so a library's tiles are spread over all tasks.
        if spread:
            cut = cut.repartition(spread, "record_id", *(["base"] if "base" in cut.columns else []))
        for joined in of:
            if tier == "tile":
                one = _bound(_regular(cut, joined, strand, fixed), plain)
            elif tier == "whole":
                one = _bound(_whole(cut, joined, strand), plain)
            else:
                one = _irregular(cut, joined, strand)
            out = one if out is None else out.unionByName(one)
    if out is None:
        d = r.select("record_id", "_name", "_offset", F.length("_t").cast("long").alias("n"), F.lit("").alias("motif")).where(F.lit(False))
        out = d.selectExpr(*d.columns, "0L start", "0L end", "'' strand", "'' match", "0D score", "cast(map() as map<string,double>) extra", "cast(array() as array<struct<label:string,start:bigint,end:bigint,text:string>>) bindings")
    return out.select("record_id", F.col("_name").alias("sequence"), F.col("_offset").alias("offset"), *[F.col(c).cast("long").alias(c) if c in ("start", "end", "n") else F.col(c) for c in _OUT[3:]])


def search(records: DataFrame, motifs: DataFrame | list[tuple[str, str]] | list[tuple[str, str, str | None]] | str, strand: str = "both", tile: int = TILE) -> DataFrame:
    """All hits (record_id, sequence, offset, motif, start, end, strand, match, score, extra, bindings).

    ``motifs`` is one motif's text, a list of (name, text[, alphabet]) or a table (name, expr, alphabet), whose unreadable rows are
    skipped; with an alphabet a motif only meets records of the same class, nucleic or protein.  Each start of each strand has one hit at
    most, the first alternative in the motif's own order.  Proteins have one strand.  Positions are
    0-based, half-open, forward and count the record's letters without its offset.  The text is upper-cased and U read as T in nucleic acids; a null type is guessed.
    Records with null, empty or letterless text give no hit; extra columns are dropped; an invalid motif raises MotifError before any job starts.
    Motifs without a bound of width read each strand as a whole, in one task.
    """
    return located_hits(records, motifs, strand, tile).select(*HITS)


def absolute(hits: DataFrame) -> DataFrame:
    """Positions with the record's offset added, those of bindings too."""
    shift = F.transform("bindings", lambda b: F.struct(b["label"].alias("label"), (b["start"] + F.col("offset")).alias("start"), (b["end"] + F.col("offset")).alias("end"), b["text"].alias("text")))
    return hits.withColumns({"bindings": shift, "start": F.col("start") + F.col("offset"), "end": F.col("end") + F.col("offset")})


def first_hits(hits: DataFrame, limit: int) -> DataFrame:
    """The first hits of each record and motif in search order, the forward strand first; a limit below 1 counts as 1."""
    local = F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("end"))
    rank = F.row_number().over(W.partitionBy("record_id", "motif").orderBy("strand", local))
    return hits.withColumn("_rank", rank).where(F.col("_rank") <= max(limit, 1)).drop("_rank")


def full_match(text: Column, source: str, nuc: bool = True) -> Column:
    """Whether a regular motif can take up a text as a whole; null for a null text.

    Runs as one pattern in the JVM. Motifs that aren't regular raise MotifError.
    """
    pattern = whole(motif(source), nuc)
    if pattern is None:
        raise MotifError("only regular motifs can be matched as a whole")
    prepared = F.translate(F.upper(text), "U", "T") if nuc else F.upper(text)
    return prepared.rlike(pattern)


def _whole_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for source, alphabet in zip(*(c.to_pylist() for c in batch.columns[1:])):
            try:
                found.append((True, whole(motif(source), alphabet != "protein")))
            except (MotifError, AttributeError, TypeError):
                found.append((False, None))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.string())], names=["motif", "expr", "alphabet", "readable", "pattern"])


def _taken_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [taken_up(source, alphabet != "protein")(normal(text, alphabet != "protein")) for text, source, alphabet in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.bool_())], names=["match_id", "whole"])


def whole_matches(matches: DataFrame, library: DataFrame) -> DataFrame:
    """(match_id, whole): whether each match's text is taken up as a whole by its own motif, regular or not, as the library has it.

    ``whole`` is null for a null text and for a motif that is null, not in the library or cannot be read.  Names of the library are its key.
    Regular motifs are told by the JVM, each text by the pattern of its own row; only texts of irregular ones go through Python.
    """
    source = library.where(F.col("name").isNotNull()).select(F.col("name").alias("motif"), "expr", "alphabet")
    motifs = written(source.mapInArrow(_whole_patterns, "motif string, expr string, alphabet string, readable boolean, pattern string"), "patterns")
    m = matches.select("match_id", "motif", "match").join(hinted(motifs), "motif", "left")
    prepared = F.when(F.coalesce("alphabet", F.lit("dna")) != "protein", F.translate(F.upper("match"), "U", "T")).otherwise(F.upper("match"))
    slow = F.coalesce(F.col("readable") & F.col("pattern").isNull() & F.col("match").isNotNull(), F.lit(False))
    quick = m.where(~slow).select("match_id", F.when(F.col("pattern").isNotNull(), F.regexp_like(prepared, F.col("pattern"))).alias("whole"))
    rest = m.where(slow).select("match_id", "match", "expr", "alphabet").mapInArrow(_taken_up, f"match_id {matches.schema['match_id'].dataType.simpleString()}, whole boolean")
    return quick.unionByName(rest)


def usable_motifs(library: DataFrame, most: int = MOST, enzymes: bool = False) -> tuple[list[tuple[str, str, str | None]], list[tuple[str, str]]]:
    """Motifs of a small library that take part in scans, in name order, and those that cannot be read with the reason, on the driver; more than ``most`` raise an error.

    :func:`scan` takes libraries of any size.
    """
    rows = usable(library, enzymes).where(F.col("name").isNotNull() & F.col("expr").isNotNull()).select("name", "expr", "alphabet").orderBy("name").limit(most + 1).collect()
    if len(rows) > most:
        raise MotifError(f"the library has more than {most} motifs")
    good, bad = [], []
    for name, expr, alphabet in rows:
        try:
            motif(expr)
            good.append((name, expr, alphabet))
        except MotifError as e:
            bad.append((name, str(e)))
    return good, bad


def scan(records: DataFrame, library: DataFrame, strand: str = "both", tile: int = TILE) -> DataFrame:
    """Hits of every usable motif of the library on the records of its alphabet class; motifs that cannot be read are skipped."""
    return search(records, usable(library), strand, tile)
