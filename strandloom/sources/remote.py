"""Public sequence databases as a Spark source: one partition for each identifier.

The opener, a function (url) -> (status, text), is named by an option, so that tests and closed networks can put their own.
"""

from __future__ import annotations

import importlib
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import identifiers as I

NAMES = {"ncbi": "NCBI", "ensembl": "Ensembl", "ena": "ENA", "uniprot": "UniProt"}


class SourceError(ValueError):
    """What a database answered, in words."""


def region_of(query: str) -> tuple[str, str, str, str] | None:
    """(name, from, to, strand) of a place; see ``identifiers.region``."""
    name, _, rest = query.strip().replace("\t", " ").replace(" ", ":", 1 if ":" not in query else 0).partition(":")
    span, _, strand = rest.partition(":")
    ends = [e.strip().replace(",", "") for e in span.replace("..", "-").replace("–", "-").split("-")]
    ok = re.fullmatch(r"[\w.]+", name) and len(ends) == 2 and all(e.isdigit() for e in ends) and strand.strip() in ("", "1", "+1", "-1")
    return (name.removeprefix("chr"), *ends, strand.strip() or "1") if ok else None


def route(query: str) -> str | None:
    """Which database an identifier belongs to, by its form; see ``identifiers.detect_source``."""
    q = query.strip()
    if region_of(q):
        return "ensembl"
    for source, pattern in (("ensembl", I.ENSEMBL), ("ncbi", I.REFSEQ), ("uniprot", I.UNIPROT), ("ncbi", I.GENBANK)):
        if re.match(pattern, q):
            return source
    return "ensembl" if len(q) <= I.LONGEST_SYMBOL and re.fullmatch(r"[A-Za-z][\w.-]*", q) else None


def url_of(source: str, query: str, species: str = "homo_sapiens", upstream: int = 0) -> str:
    q = urllib.parse.quote(query.strip(), safe="")
    if source == "ncbi":
        return f"https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=nuccore&id={q}&rettype=fasta&retmode=text"
    if source == "uniprot":
        return f"https://rest.uniprot.org/uniprotkb/{q}.fasta"
    if source == "ena":
        return f"https://www.ebi.ac.uk/ena/browser/api/fasta/{q}"
    further = f"&expand_5prime={min(upstream, 100_000)}" if upstream > 0 else ""
    if found := region_of(query):
        name, begin, end, strand = found
        place = f"{name}:{begin}..{end}:{strand}"
        return f"https://rest.ensembl.org/sequence/region/{species}/{place}?content-type=text/x-fasta{further}"
    kind = "id" if re.match(I.ENSEMBL, query.strip()) else f"symbol/{species}"
    return f"https://rest.ensembl.org/sequence/{kind}/{q}?content-type=text/x-fasta{further}"


def open_url(url: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url, timeout=60) as reply:  # noqa: S310
            return reply.status, reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("retry-after", "")
    except OSError:
        return 0, ""


#: What an answer's status means; the hundreds stand for all others of their kind.
TROUBLE = {
    0: "{where} gave no answer at all",
    400: "{where} holds no record of {what}",
    404: "{where} holds no record of {what}",
    429: "{where} asks for fewer requests, next one in {after} s",
    5: "{where} failed with status {status}",
}


def checked(status: int, text: str, where: str, what: str, largest: int | None = None) -> str:
    """The text of a good answer; SourceError otherwise, also for more than ``largest`` letters, if that is set."""
    trouble = TROUBLE.get(status, TROUBLE.get(status // 100))
    if trouble is None and not (status == 200 and text.lstrip().startswith(">")):
        trouble = "{where} sent something else than a sequence for {what}"
    if trouble is None and largest is not None and sum(len(x) for x in text.split("\n") if not x.startswith(">")) > largest:
        trouble = "{what} has more than {largest} letters; ask for a region of it"
    if trouble:
        raise SourceError(trouble.format(where=where, what=what, status=status, after=text if status == 429 and text else "a few", largest=largest) + ".")
    return text


class _Ask(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_Ask]:
        return [_Ask(q.strip()) for q in self.options.get("ids", "").split(";") if q.strip()]

    def read(self, partition: _Ask) -> Iterator[tuple]:
        source = self.options.get("source", "auto")
        source = route(partition.query) if source == "auto" else source
        if source not in NAMES:
            raise SourceError(f"{partition.query!r} does not look like an identifier.")
        module, _, name = self.options.get("opener", f"{__name__}:open_url").partition(":")
        opener = getattr(importlib.import_module(module), name)
        url = url_of(source, partition.query, self.options.get("species", "homo_sapiens"), int(self.options.get("upstream", "0")))
        largest = self.options.get("largest")
        yield partition.query, source, checked(*opener(url), NAMES[source], partition.query, int(largest) if largest else None)


class SequenceSource(DataSource):
    """format("sequences"): options ids (separated by ;), source (auto), species, upstream, largest (letters; no limit unless set) and opener (module:function)."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return "query string, source string, text string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make format("sequences") known; ``text.parse_sequences`` turns its answers into records."""
    spark.dataSource.register(SequenceSource)
