"""Problem 6: token ids of whole texts by a public byte-level BPE.

Texts of one chunk are encoded where they are read.  Longer texts are cut into
overlapping chunks, which are pre-tokenised in parallel; two neighbours are stitched at
the first place of their overlap where both have a pre-token boundary, since from there
on they agree; then the pieces between the stitches are encoded.  A text whose
neighbours never agree within an overlap is encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: Folder of the vocabulary files, on every executor.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
CHUNK, OVERLAP = 16_384, 512
#: The published pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: So many characters at a chunk's end are not trusted: what follows could change their boundaries.
MARGIN = 8


@lru_cache(maxsize=4)
def encoding(vocabulary: str, folder: str = FOLDER):
    """The encoder of a rank file, once a Python worker."""
    import tiktoken

    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(enc, text: str) -> np.ndarray:
    """Ids of one text; lone surrogates cannot occur in Spark strings."""
    return enc.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)


def _encoder(vocabulary: str, folder: str, counts: bool):
    """(keys..., text) -> (keys..., ids) or (keys..., tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, folder)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                keys, texts = part.columns[:-1], part.columns[-1]
                found = [_ids(enc, x.as_py() or "") for x in texts]
                sizes = np.array([len(x) for x in found], np.int64)
                if counts:
                    last = pa.array(sizes)
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    flat = np.concatenate([*found, np.empty(0, np.uint32)]).astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*keys, last], names=[*part.schema.names[:-1], "ids"])

    return run


def _boundaries(chunk: int, overlap: int):
    """Chunks -> pre-token boundaries in the head and in the tail of each, relative to its own and to its successor's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern = regex.compile(PATTERN)
        for batch in batches:
            heads, tails = [], []
            for text in batch.column("_text").to_pylist():
                # After white space a piece could end otherwise if its text ended here, so such boundaries are left out.
                at = [m.start() for m in pattern.finditer(text)]
                good = [b for b in at if b and not text[b - 1].isspace() and b <= len(text) - MARGIN]
                heads.append([b for b in good if b < overlap])
                tails.append([b - chunk for b in good if b >= chunk])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_k"), pa.array(heads, kind), pa.array(tails, kind)], names=["_id", "_k", "_head", "_tail"])

    return run


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    n = F.length("_text")
    last = F.greatest(F.ceil((n - overlap) / chunk) - 1, F.lit(0)).cast("int")
    rows = long.withColumn("_k", F.explode(F.sequence(F.lit(0), last)))
    text = F.when(F.col("_k") == last, F.expr(f"substring(_text, _k * {chunk} + 1)")).otherwise(F.expr(f"substring(_text, _k * {chunk} + 1, {chunk + overlap})"))
    return rows.select("_id", "_k", text.alias("_text"))


def _encoded(df: DataFrame, key: str, text: str, vocabulary: str, folder: str, chunk: int, overlap: int, counts: bool) -> DataFrame:
    kind = "long" if counts else "array<int>"
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    encode = _encoder(vocabulary, folder, counts)
    is_long = F.coalesce(F.length("_text"), F.lit(0)) > chunk + overlap
    short = rows.where(~is_long).mapInArrow(encode, f"_id {key_type}, ids {kind}")
    long = rows.where(is_long)
    chunks = _chunks(long, chunk, overlap).repartition("_id", "_k")
    edges = chunks.mapInArrow(_boundaries(chunk, overlap), f"_id {key_type}, _k int, _head array<int>, _tail array<int>")
    w = W.partitionBy("_id").orderBy("_k")
    whole = W.partitionBy("_id")
    meet = F.array_min(F.array_intersect("_tail", F.lead("_head").over(w)))
    edges = edges.withColumn("_next", F.lead("_k").over(w)).withColumn("_stop", meet)
    edges = edges.withColumn("_lost", F.max(F.col("_next").isNotNull() & F.col("_stop").isNull()).over(whole)).withColumn("_start", F.coalesce(F.lag("_stop").over(w), F.lit(0)))
    # Pieces between stitches; a text that could not be stitched keeps one row, its whole text.
    stitched = chunks.join(edges.where(~F.col("_lost")).select("_id", "_k", "_start", "_stop"), ["_id", "_k"])
    piece = F.when(F.col("_stop").isNull(), F.expr("substring(_text, _start + 1)")).otherwise(F.expr(f"substring(_text, _start + 1, {chunk} + _stop - _start)"))
    pieces = stitched.select("_id", "_k", piece.alias("_text"))
    unstitched = long.join(edges.where(F.col("_lost") & (F.col("_k") == 0)).select("_id"), "_id", "left_semi").select("_id", F.lit(0).alias("_k"), "_text")
    parts = pieces.unionByName(unstitched).mapInArrow(encode, f"_id {key_type}, _k int, ids {kind}")
    if counts:
        joined = parts.groupBy("_id").agg(F.sum("ids").alias("ids"))
    else:
        joined = parts.groupBy("_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(joined).select(F.col("_id").alias(key), "ids")


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids): the ids of each row's text without special tokens; an empty list for an empty or null text.

    ``key`` must be unique and not null for texts longer than a chunk.  Further columns are dropped.  Strings of special tokens are ordinary text.
    """
    return _encoded(df, key, text, vocabulary, folder, chunk, overlap, counts=False)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, tokens): the number of ids of each row's text; 0 for an empty or null text."""
    return _encoded(df, key, text, vocabulary, folder, chunk, overlap, counts=True).withColumnRenamed("ids", "tokens")


def _decoder(vocabulary: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, folder)
        for batch in batches:
            # Raw bytes of all ids are concatenated before they are read as UTF-8: a character may span several ids.
            texts = [None if x is None else b"".join(map(enc.decode_single_token_bytes, x)).decode("utf-8", "replace") for x in batch.columns[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.columns[0], pa.array(texts, pa.string())], names=["_id", "text"])

    return run


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, text): the texts of lists of ids; null for a null list, an empty text for an empty one."""
    key_type = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("_id"), F.col(ids).cast("array<int>").alias("_ids")).mapInArrow(_decoder(vocabulary, folder), f"_id {key_type}, text string")
    return out.withColumnRenamed("_id", key)
