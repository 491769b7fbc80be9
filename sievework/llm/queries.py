"""Queries of the corpus operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence_rules, jaccard_join, licenses, mixture, ordinal_quality, secrets, substring_dedup, token_output, toxicity
from .common import load


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(load(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, *toxicity.train(docs, load(spark, sf_dir, "labels")))


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence_rules.judge(load(spark, sf_dir, "documents"))
    return judged.drop("char_distance", "word_distance")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(load(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return ordinal_quality.score_documents(docs, ordinal_quality.train(docs, load(spark, sf_dir, "labels")))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(load(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(load(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_divergence_rules, op4_decontaminate, op5_secrets, op6_quality_classifier, op7_mixture, op8_token_output, op9_licenses, op10_jaccard_join)
}

OP7_SQL = r"""
with sizes as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), 'null')) as k
  from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sizes group by source),
weighed as (
  select *, [5, 2, 1][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int] as weight from totals),
levels as (
  select *, (1.5::double * (sum(source_size) over ())::double
      - coalesce((2 * sum(source_size) over (order by source_size::double / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding))::double, 0))
      / (sum(weight) over (order by source_size::double / weight, source is null, encode(source) rows between current row and unbounded following))::double as level
  from weighed),
plan as (
  select source, source_size,
    coalesce(least((select arg_min(level, row(source_size::double / weight, source is null, encode(source))) from levels where level * weight <= 2 * source_size) * weight,
                   (2 * source_size)::double), (2 * source_size)::double) as target
  from levels),
epoch as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from plan),
room as (select *, floor(target)::bigint - epochs * source_size as room from epoch),
tied as (select source, k, size, count(*) as n from sizes group by all),
upto as (
  select *, sum(size * n) over (partition by source order by k, size) - size * n as before from tied),
extra as (
  select u.source, u.k, u.size, case when u.before + u.size * u.n <= r.room then u.size when u.before < r.room then floor((r.room - u.before) / u.n)::bigint else 0 end as more
  from upto u join room r on u.source is not distinct from r.source)
select s.doc_id, s.size, r.source_size, r.target, cast(r.epochs * s.size + e.more as bigint) as taken
from sizes s join room r on s.source is not distinct from r.source
join extra e on s.source is not distinct from e.source and s.k = e.k and s.size = e.size
"""

def _lists(words: dict[str, list[str]]) -> str:
    return " ".join(f"when '{lang}' then [{', '.join(repr(w) for w in some)}]" for lang, some in words.items())


OP3_SQL = r"""
with texts as (
  select row_number() over () as r, doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
places as (select r, unnest(range(1, len(w) - 6)) as i, w from texts where len(w) >= 8),
hit as (
  select r, i from (select r, i, count(*) over (partition by r, array_to_string(w[i : i + 7], ' ')) as c from places) where c > 1),
again as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from hit) group by r),
lines as (select r, count(*) - count(distinct x) as n from (select r, unnest(string_split(text, chr(10))) as x from texts) where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
base as (
  select t.r, doc_id, lang, len(w) as n_words, array_to_string(w, '') as solid, w,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(a.n, 0) as n_repeat_words,
    case lang LISTS end as common
  from texts t left join again a using (r) left join lines l using (r)),
counted as materialized (
  select *, length(solid) as word_chars, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    [KINDS] as five, list_transform(common, lambda c: len(list_filter(w, lambda x: x = c))) as nums
  from base),
bins as materialized (
  select * exclude (five, nums, w, solid), list_append(five, word_chars - list_sum(five)) as kinds, list_append(nums, n_words - list_sum(nums)) as commons from counted),
pool as (select lang, [sum(kinds[1]), KSUM] as k, [sum(commons[1]), CSUM] as c from bins where common is not null and not base_failed group by lang),
d1 as (
  select b.*, case when word_chars >= 100 then DIST(b.kinds, f.k) end as dk, case when n_words >= 60 then DIST(b.commons, f.c) end as dc
  from bins b left join pool f using (lang)),
pool2 as (
  select lang, [sum(kinds[1]), KSUM] as k, [sum(commons[1]), CSUM] as c from d1
  where common is not null and not base_failed and coalesce(dk, 0) <= 0.2 and coalesce(dc, 0) <= 0.33 group by lang),
d2 as (
  select b.*, case when word_chars >= 100 then DIST(b.kinds, f.k) end as dk, case when n_words >= 60 then DIST(b.commons, f.c) end as dc
  from bins b left join pool2 f using (lang))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and coalesce(dk, 0) <= 0.2 and coalesce(dc, 0) <= 0.33 as kept
from d2
"""


def _op3_sql() -> str:
    import re

    kinds = ", ".join("length(regexp_replace(solid, '[^{}]+', '', 'g'))".format(k.replace("'", "''")) for k in divergence_rules.KINDS)
    sums = {"KSUM": ("kinds", len(divergence_rules.KINDS) + 1), "CSUM": ("commons", divergence_rules.BINS + 1)}
    sql = OP3_SQL.replace("LISTS", _lists(divergence_rules.COMMON)).replace("[KINDS]", f"[{kinds}]")
    for name, (c, n) in sums.items():
        sql = sql.replace(name, ", ".join(f"sum({c}[{i}])" for i in range(2, n + 1)))
    share = "case when {0} > 0 then {0} * log2(2 * {0} / ({0} + {1})) else 0 end"
    p, q = "(z[1] / list_sum({0})::double)", "(z[2] / list_sum({1})::double)"
    body = f"{share.format(p, q)} + {share.format(q, p)}"
    return re.sub(r"DIST\(([\w.]+), ([\w.]+)\)", lambda m: f"sqrt(greatest(list_sum(list_transform(list_zip({m[1]}, {m[2]}), lambda z: {body.format(m[1], m[2])})) / 2, 0))", sql)


OP10_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as materialized (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as g
  from words),
n as materialized (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as materialized (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edges as materialized (select a, b from links union all select b, a from links),
reach as (
  select a as doc_id, a as label from edges
  union
  select edges.b, reach.label from reach join edges on edges.a = reach.doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(r.label, d.doc_id) as component_id
from documents d left join n using (doc_id)
left join (select doc_id, min(label) as label from reach group by doc_id) r using (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op3_divergence_rules": _op3_sql(), "op7_mixture": OP7_SQL, "op10_jaccard_join": OP10_SQL}
