"""Motifs by name in SQL: functions of a registered motif, and views of its hits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..lang.motif import MotifError, motif
from ..lang.patterns import FIRST, LAST, whole
from .search import compiled_rows, search


def _literal(text: str) -> str:
    """A raw SQL string."""
    quote = "'" if "'" not in text else '"'
    if quote in text:
        raise MotifError("a pattern with both kinds of quotes cannot be registered")
    return f"r{quote}{text}{quote}"


def register_motif(spark: SparkSession, name: str, source: str, nuc: bool = True) -> list[str]:
    """Make a regular motif known to SQL; gives the names of its functions.

    ``name_whole(text)`` says whether it takes up a text as a whole, ``name_in(text)`` whether the text's letters contain it on the forward
    strand, ``name_starts(text)`` where (0-based, overlapping ones too). All are null for a null text and run in the JVM. A motif
    that isn't regular, or has no bound of width, raises MotifError.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise MotifError(f"{name!r} is no name of a function")
    node = motif(source)
    (row,) = compiled_rows(name, source, "dna" if nuc else "protein")
    pattern = whole(node, nuc)
    if row[3] != "tile" or pattern is None:
        raise MotifError("only regular motifs of bounded width can be registered")
    folded = lambda x: f"translate(upper({x}), 'U', 'T')" if nuc else f"upper({x})"
    strand = f"concat('{FIRST}', {folded('regexp_replace(t, r' + repr('[^A-Za-z]') + ', ' + repr('') + ')')}, '{LAST}')"
    parts = f"split({strand}, {_literal(row[4])}, -1)"
    starts = f"slice(aggregate(slice({parts}, 1, size({parts}) - 1), array(-1), (a, x) -> concat(a, array(element_at(a, -1) + length(x)))), 2, length(t))"
    made = {
        f"{name}_whole": ("BOOLEAN", f"regexp_like({folded('t')}, {_literal(pattern)})"),
        f"{name}_in": ("BOOLEAN", f"regexp_like({strand}, {_literal(row[4])})"),
        f"{name}_starts": ("ARRAY<INT>", f"CASE WHEN t IS NOT NULL THEN {starts} END"),
    }
    for function, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(t STRING) RETURNS {kind} RETURN {body}")
    return list(made)


def motif_view(view: str, records: DataFrame, motifs: DataFrame | list | str, strand: str = "both") -> None:
    """Register the hits of a search as a view for SQL; see ``search.search``."""
    search(records, motifs, strand).createOrReplaceTempView(view)
