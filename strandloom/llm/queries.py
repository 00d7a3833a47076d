"""Registered queries of the numbered problems for training data, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from .duplicates import distinct_records, formatting_duplicates
from .packing import fill, pack_documents, rules
from .spans import shared_share, shared_spans
from .splitting import rejoined, split_records, unbroken_stretches
from .tokens import token_ids
from .topn import best_matches
from .truncation import field_limits, truncated, truncation_by_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_KEYED = """
    with k as (select record_id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') l,
               array_to_string(list_sort(list_filter(list_transform(string_split_regex(name, '[|;,]'),
                   lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'))), lambda x: x <> '')), '|') f
               from seq_records where seq is not null and name is not null),
    g as (select *, min(record_id) over (partition by l, f) keep_id, count(*) over (partition by l, f) copies from k where l <> '' and f <> '')
"""


@query("p1_found", _KEYED + "select keep_id, record_id from g where record_id <> keep_id")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = formatting_duplicates(table(spark, d, "seq_records"))
    return found.where(F.col("record_id") != F.col("keep_id")).select("keep_id", "record_id")


@query("p1_copies", _KEYED + "select keep_id, copies from g where record_id = keep_id")
def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    return distinct_records(table(spark, d, "seq_records"))


_SPANS = """
    with r as (select record_id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') s from seq_records where seq is not null),
    w as (select record_id, p, substring(s, p + 1, 100) x from (select record_id, s, unnest(range(0, length(s) - 99)) p from r where length(s) >= 100)),
    h as (select x from w group by x having min(record_id) < max(record_id)),
    m as (select record_id, p, lag(p) over (partition by record_id order by p) b from w where x in (select x from h)),
    i as (select *, sum(case when b is null or p > b + 100 then 1 else 0 end) over (partition by record_id order by p rows unbounded preceding) n from m),
    o as (select record_id, min(p) as from_pos, max(p) + 100 as to_pos from i group by record_id, n)
"""


@query("p3_found", _SPANS + "select * from o")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "seq_records"))


@query("p3_share", _SPANS + "select record_id, length(s) as letters, coalesce(h, 0)::bigint as shared, coalesce(h, 0) / length(s) as share from r left join (select record_id, sum(to_pos - from_pos) h from o group by 1) using (record_id) where s <> ''")
def p3_share(spark: SparkSession, d: str) -> DataFrame:
    return shared_share(table(spark, d, "seq_records"))


@query(
    "p4_found",
    """
    with r as (select record_id, type, coalesce("offset", 0) o, regexp_replace(upper(seq), '[^A-Z]', '', 'g') s from seq_records where type is not null and seq is not null),
    l as (select r.*, max_letters from r join split_limits using (type) where length(s) > max_letters),
    b as (select record_id, o, max_letters, case type when 'protein' then string_split_regex(s, 'X{10,}') else string_split_regex(s, 'N{10,}') end x,
                 case type when 'protein' then regexp_extract_all(s, 'X{10,}') else regexp_extract_all(s, 'N{10,}') end y from l),
    u as (select record_id, o, max_letters, unnest(range(1, len(x) + 1)) i, x, y from b),
    v as (select record_id, o, max_letters, length(x[i]) n, o + list_sum(list_transform(x[1:i-1], lambda e: length(e))) + list_sum(list_transform(y[1:i-1], lambda e: length(e))) f, o as f0, i from u)
    select record_id, coalesce(f, f0)::bigint as from_pos, (coalesce(f, f0) + n)::bigint as to_pos from v where n > max_letters
    """,
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unbroken_stretches(table(spark, d, "seq_records"), table(spark, d, "split_limits"))


@query("p4_pieces")
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_records(table(spark, d, "seq_records"), table(spark, d, "split_limits"))


_BEST = """
    with r as (select *, row_number() over (partition by sequence, motif order by case when isnan(score) then null else score end desc nulls last, "start" asc nulls last, match_id) as rank
               from motif_matches where sequence is not null and motif is not null)
"""


@query(
    "p4_rejoined",
    """select record_id, coalesce("offset", 0) as "offset", length(s) as letters, md5(s) as md5, true as within, true as joined
       from (select *, regexp_replace(upper(seq), '[^A-Z]', '', 'g') s from seq_records where seq is not null) join split_limits using (type) where length(s) > max_letters""",
)
def p4_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces put together again: limits, overlaps, offsets and letters."""
    return rejoined(table(spark, d, "seq_records"), table(spark, d, "split_limits"))


@query("p5_found", _BEST + "select match_id from r where rank <= 3")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return best_matches(table(spark, d, "motif_matches")).select("match_id")


@query("p5_best", _BEST + 'select sequence, motif, case when not isnan(score) then score end as score, "start", match_id, rank from r where rank <= 3')
def p5_best(spark: SparkSession, d: str) -> DataFrame:
    return best_matches(table(spark, d, "motif_matches"))


@query("p6_ids")
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


@query("p7_containers")
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), table(spark, d, "pack_limits"))


@query("p7_fill")
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(pack_documents(table(spark, d, "documents"), table(spark, d, "pack_limits")))


@query("p7_rules")
def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules(pack_documents(table(spark, d, "documents"), table(spark, d, "pack_limits")))


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "documents")).select("doc_id")


@query("p8_sources")
def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation_by_source(table(spark, d, "documents"))


@query(
    "p8_limits",
    """
    with t as (select distinct coalesce(source, '') source, length(text)::bigint c, strlen(text)::bigint b, text from documents
               where rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288) || chr(65279) || chr(8203)) <> ''),
    l as (select source, 'chars' unit, c as length from t union all select source, 'bytes', b from t),
    n as (select source, unit, length, count(*) texts from l group by all),
    r as (select *, (sum(texts) over (partition by source, unit order by length desc rows unbounded preceding))::bigint at_risk from n),
    w as (select *, list_sort(list(texts) over v) o, avg(at_risk) over v a from r window v as (partition by source, unit order by length range between 16 preceding and 16 following)),
    e as (select *, at_risk * ((coalesce(list_sum(o[1:greatest(len(o) - 3, 0)]), 0) + 1) / (a * 30)) expected from w),
    p as (select *, case when texts > expected then exp(-(texts * ln(texts / expected) - texts + expected)) else 1.0 end p, count(*) over (partition by source, unit) m from e),
    k as (select *, row_number() over (partition by source, unit order by p, length) i from p where p <= 1e-4),
    u as (select *, max(case when p <= i * 1e-4 / m then i end) over (partition by source, unit) upto from k)
    select source, unit, length, texts, at_risk, texts / at_risk as hazard, expected, p from u where i <= upto
    """,
)
def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    return field_limits(table(spark, d, "documents"))
