"""Problem 1: records that are equal but for formatting.

Canonical keys are counted with partial counts; hot ones are
aggregated in two levels over salts, all others in one shuffle.  The representative of a
group is its smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.letters import letters
from ..session import written

#: Hot keys that are broadcast; more are joined in the plain way.
MOST = 100_000
#: A key is hot if it has more than this share of what a task gets on average, but at least so many rows.
SHARE, LEAST, SALTS = 0.25, 1000, 64


def hot_bound(rows: int, tasks: int) -> int:
    """From how many rows on a group is split: a quarter of an average task."""
    return max(LEAST, int(SHARE * rows / max(tasks, 1)))


def name_fields(name: Column) -> Column:
    """The name's fields as a sorted text: parts between | ; or , reduced to lower-case ASCII letters and digits; empty ones dropped."""
    parts = F.transform(F.split(name, "[|;,]"), lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", "")))
    return F.array_join(F.array_sort(F.filter(parts, lambda x: x != "")), "|")


def canonical_key(name: Column, seq: Column) -> Column:
    """SHA-256 of the record's letters and sorted name fields; null for records in no group."""
    fields, text = name_fields(name), letters(seq)
    key = F.sha2(F.concat_ws("#", text, fields), 256)
    return F.when((F.length(text) > 0) & (F.length(fields) > 0), key)


def formatting_duplicates(records: DataFrame, hot: int | None = None, salts: int = SALTS) -> DataFrame:
    """(record_id, keep_id, copies) of every record that is in a group.

    Records without letters, or whose name is null or has no field, are in no group and give
    no row; a record without a copy is its own representative with one copy.  Other columns,
    whatever their names, do not matter; an empty table gives no rows.  Groups of more than ``hot`` rows, by default a
    quarter of an average task, are aggregated in two levels.
    """
    spark = records.sparkSession
    keyed = records.select("record_id", canonical_key(F.col("name"), F.col("seq")).alias("_key")).where(F.col("_key").isNotNull())
    # Keys are made of whole texts, so they are made once.
    keyed = written(keyed, "keys")
    counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"))
    if hot is None:
        hot = hot_bound(keyed.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # At most rows / hot keys are hot, a few for each task.
    hot_keys = written(counts.where(F.col("copies") > hot), "hot-keys")
    n_hot = hot_keys.count()
    cold = keyed
    parts = []
    if n_hot:
        small = n_hot <= MOST
        hinted = F.broadcast(hot_keys.select("_key")) if small else hot_keys.select("_key")
        salted = keyed.join(hinted, "_key").groupBy("_key", F.pmod(F.xxhash64("record_id"), F.lit(salts)).alias("_salt"))
        level1 = salted.agg(F.min("record_id").alias("_min"), F.count(F.lit(1)).alias("_n"))
        level2 = level1.groupBy("_key").agg(F.min("_min").alias("keep_id"), F.sum("_n").alias("copies"))
        parts.append(keyed.join(F.broadcast(level2) if small else level2, "_key").select("record_id", "keep_id", "copies"))
        cold = keyed.join(hinted, "_key", "left_anti")
    # Light groups have at most ``hot`` rows, so their members travel in one array through the one shuffle.
    groups = cold.groupBy("_key").agg(F.collect_list("record_id").alias("_ids"))
    light = groups.select(F.explode("_ids").alias("record_id"), F.array_min("_ids").alias("keep_id"), F.size("_ids").cast("long").alias("copies"))
    for part in parts:
        light = light.unionByName(part)
    return light


def distinct_records(records: DataFrame, **options: int) -> DataFrame:
    """One row (keep_id, copies) for each group."""
    found = formatting_duplicates(records, **options)
    return found.where(F.col("record_id") == F.col("keep_id")).select("keep_id", "copies")
