"""A query an operator over the driver's tables, each beside its SQL.

The queries on customers run on the fixture; AS_OF stands for today.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contract import POST, PRE, load_contract
from .fixture import RAW_CUSTOMERS, raw_customers
from .functions import masks
from .functions import normalise as N
from .functions import text as T
from .operators import clean as C
from .operators import detect as D
from .operators import explore as X
from .operators import mask as M
from .operators import profile as P
from .operators import validate as V
from .sources import files

AS_OF = date(2025, 8, 1)
CONTRACT = load_contract()
NAMES = [r.name for r in CONTRACT.columns]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_TOKENS = ", ".join("'{}'".format(t) for t in CONTRACT.null_tokens)
_RAW = "raw as (" + RAW_CUSTOMERS.replace("{customer}", "customer") + ")"
_CELLS = _RAW + ", cells as (" + " union all ".join(f"select _row_id, '{c}' as \"column\", {c} as value, trim({c}) in ({_TOKENS}) as gone from raw" for c in NAMES) + ")"
_DATES = "['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%d-%b-%Y', '%Y/%m/%d']"
_NUMBER = "case when regexp_matches(trim(replace(replace({0}, '$', ''), ',', '')), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(trim(replace(replace({0}, '$', ''), ',', '')) as double) end"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return add


def _freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.frequencies(raw_customers(spark, sf_dir), NAMES, CONTRACT.null_tokens)


# --- profiling ---------------------------------------------------------------------------------------------------------

@query(f"""with {_CELLS} select "column", count(*) as total, count(*) filter (where gone) as missing, count(*) filter (where not gone) as present,
round(100.0::double * count(*) filter (where gone) / count(*), 2) as missing_pct from cells group by 1""")
def completeness_by_column(spark, sf_dir):
    return P.completeness(_freq(spark, sf_dir))


@query(f"""with {_CELLS} select "column", count(distinct value) filter (where not gone) as distinct_count, count(*) filter (where not gone) as present,
count(*) filter (where not gone and value <> trim(value)) as whitespace_padded, coalesce(min(length(value)) filter (where not gone), 0) as min_length,
coalesce(max(length(value)) filter (where not gone), 0) as max_length,
round(100.0::double * count(distinct value) filter (where not gone) / count(*) filter (where not gone), 2) as distinct_pct from cells group by 1""")
def distinct_and_lengths(spark, sf_dir):
    return P.distinct_and_lengths(_freq(spark, sf_dir))


@query(f"""with {_CELLS}, v as (select {_NUMBER.format('value')} as n from cells where "column" = 'income' and not gone)
select count(*) filter (where n is null) as non_numeric, min(n) as min_value, max(n) as max_value, round(sum(n) / count(n), 2) as mean_value,
count(*) filter (where n < 0) as below_min, count(*) filter (where n > 10000000) as above_max from v""")
def numeric_profile(spark, sf_dir):
    return P.numeric(_freq(spark, sf_dir), CONTRACT.rule("income"))


@query("""select count(*) filter (where o_totalprice is null) as missing, min(o_totalprice) as min_value, max(o_totalprice) as max_value, round(avg(o_totalprice), 2) as mean_value,
count(*) filter (where o_totalprice < 1000) as below_min from orders""")
def numeric_profile_orders(spark, sf_dir):
    p = F.col("o_totalprice")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.count_if(p.isNull()).alias("missing"), F.min(p).alias("min_value"), F.max(p).alias("max_value"), F.round(F.avg(p), 2).alias("mean_value"), F.count_if(p < 1000).alias("below_min"))


def _label_case(tests: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when {t} then '{label}'" for t, label in tests) + " end"


_STRPTIME = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%b-%Y", "%Y/%m/%d")


@query(f"""with {_CELLS}, v as (select {_label_case([(f"try_strptime(trim(value), '{f}') is not null", label) for f, (_, label) in zip(_STRPTIME, T.DATE_FORMATS)])} as label
from cells where "column" = 'date_of_birth' and not gone) select label, count(*) as n from v group by 1""")
def date_format_breakdown(spark, sf_dir):
    return P.labels(_freq(spark, sf_dir), CONTRACT.rule("date_of_birth"), T.date_label(F.col("value"))).drop("first_row")


@query(f"""with {_CELLS}, v as (select try_strptime(trim(value), {_DATES})::date as d from cells where "column" = 'date_of_birth' and not gone)
select count(*) filter (where d is null) as unparseable, min(d)::varchar as min_value, max(d)::varchar as max_value, count(*) filter (where d > date '{AS_OF}') as future from v""")
def date_profile(spark, sf_dir):
    return P.dates(_freq(spark, sf_dir), CONTRACT.rule("date_of_birth"), AS_OF)


@query(f"""with {_CELLS}, v as (select {_label_case([(f"regexp_matches(trim(value), '{p}')", label) for p, label in T.PHONE_FORMATS])} as label
from cells where "column" = 'phone' and not gone) select label, count(*) as n from v group by 1""")
def phone_format_breakdown(spark, sf_dir):
    return P.labels(_freq(spark, sf_dir), CONTRACT.rule("phone"), T.phone_label(F.col("value"))).drop("first_row")


@query(f"""with {_CELLS} select value, count(*) as n, case when value in ('active', 'inactive', 'suspended') then 'allowed' when lower(trim(value)) in ('active', 'inactive', 'suspended') then 'case_only' else 'unknown' end as kind
from cells where "column" = 'account_status' and not gone group by 1""")
def category_profile(spark, sf_dir):
    return P.categories(_freq(spark, sf_dir), CONTRACT.rule("account_status")).drop("first_row")


@query("select o_orderstatus as value, count(*) as n from orders group by 1")
def category_profile_orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n"))


@query(f"""with {_CELLS} select "column", count(*) filter (where not gone and "column" = 'email' and not regexp_matches(trim(value), '{T.EMAIL}')) as invalid_email,
count(*) filter (where not gone and "column" in ('first_name', 'last_name') and not regexp_matches(replace(replace(value, ' ', ''), '-', ''), '^\\p{{L}}+$')) as non_alphabetic,
count(*) filter (where not gone and length(trim(value)) < case "column" when 'address' then 10 when 'first_name' then 2 when 'last_name' then 2 end) as too_short,
count(*) filter (where not gone and length(trim(value)) > case "column" when 'address' then 200 when 'first_name' then 50 when 'last_name' then 50 end) as too_long
from cells where "column" in ('email', 'first_name', 'last_name', 'address') group by 1""")
def string_profile(spark, sf_dir):
    freq = _freq(spark, sf_dir)
    parts = [P.strings(freq, CONTRACT.rule(c)).withColumn("column", F.lit(c)) for c in ("email", "first_name", "last_name", "address")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"with {_RAW} select coalesce(sum(n - 1), 0) as n from (select count(*) as n from raw group by {', '.join(NAMES)})")
def exact_duplicate_rows(spark, sf_dir):
    return V.duplicate_rows(raw_customers(spark, sf_dir))


@query("select coalesce(sum(n - 1), 0) as n from (select count(*) as n from documents group by text)")
def exact_duplicate_documents(spark, sf_dir):
    return V.duplicate_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))


@query(f"with {_RAW} select coalesce(sum(n - 1), 0) as n from (select count(*) as n from raw group by lower(trim(first_name)), lower(trim(last_name)), trim(date_of_birth))")
def duplicate_people(spark, sf_dir):
    return P.duplicate_people(raw_customers(spark, sf_dir), CONTRACT)


@query(f"""with {_RAW} select coalesce(sum(k - 1), 0) as n from (select count(distinct trim(customer_id)) as k from raw
where trim(first_name) <> '' and trim(last_name) <> '' and trim(date_of_birth) <> '' group by lower(trim(first_name)), lower(trim(last_name)), trim(date_of_birth))""")
def duplicate_people_strict(spark, sf_dir):
    return P.duplicate_people(raw_customers(spark, sf_dir), CONTRACT, strict=True)


@query(f"""with {_RAW}, k as (select count(*) as n from raw where trim(customer_id) not in ({_TOKENS}) group by trim(customer_id) having count(*) > 1)
select coalesce(sum(n), 0) as rows, count(*) as keys from k""")
def duplicate_keys(spark, sf_dir):
    return V.duplicate_keys(raw_customers(spark, sf_dir), "customer_id", CONTRACT.null_tokens)


@query(f"""with {_RAW}, p as (select case when trim(date_of_birth) not in ({_TOKENS}) then try_strptime(trim(date_of_birth), {_DATES})::date end as b, case when trim(created_date) not in ({_TOKENS}) then try_strptime(trim(created_date), {_DATES})::date end as c,
lower(trim(account_status)) = 'active' and trim(email) in ({_TOKENS}) and trim(phone) in ({_TOKENS}) as x from raw)
select count(*) filter (where b > c) as born_after_created, count(*) filter (where (date '{AS_OF}' - b) / 365.25::double > 120) as age_over_120, count(*) filter (where (date '{AS_OF}' - b) / 365.25::double < 18) as age_under_18,
round(min((date '{AS_OF}' - b) / 365.25::double), 1) as age_min, round(max((date '{AS_OF}' - b) / 365.25::double), 1) as age_max, count(*) filter (where x) as active_but_unreachable from p""")
def cross_column_checks(spark, sf_dir):
    return P.cross_columns(raw_customers(spark, sf_dir), CONTRACT, AS_OF)


# --- exploration -------------------------------------------------------------------------------------------------------

EXPLORED = [r.name for r in CONTRACT.columns if r.type in ("integer", "numeric", "date")]
_AS_NUMBER = {r.name: f"(try_strptime(trim({r.name}), {_DATES})::date - date '1970-01-01')::double" if r.type == "date" else f"({_NUMBER.format(r.name)})" for r in CONTRACT.columns if r.name in EXPLORED}
_WIDE = f"{_RAW}, wide as (select " + ", ".join(f"{x} as {c}" for c, x in _AS_NUMBER.items()) + " from raw)"
_LONG = _WIDE + ", v as (" + " union all ".join(f"select '{c}' as \"column\", {c} as value from wide" for c in EXPLORED) + ")"


def _coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.coerced(raw_customers(spark, sf_dir), CONTRACT)


@query(f"""with {_LONG} select "column", count(*) as total, count(value) as present, round(avg(value), 4) as mean, round(stddev(value), 4) as std, min(value) as min_value,
{", ".join(f"quantile_disc(value, {q}) as {name}" for name, q in X.QUANTILES.items())}, max(value) as max_value from v group by 1""")
def explore_summary(spark, sf_dir):
    return X.summary(_coerced(spark, sf_dir), EXPLORED)


@query(f"""with {_LONG}, e as (select "column", min(value) as lo, max(value) as hi from v group by 1)
select "column", (case when hi > lo then least(floor((value - lo) / (hi - lo) * 10), 9) else 0 end)::int as bin, count(*) as n from v join e using ("column") where value is not null group by 1, 2""")
def explore_histogram(spark, sf_dir):
    return X.histogram(_coerced(spark, sf_dir), EXPLORED)


@query(f"with {_WIDE} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from wide" for a, b in combinations(EXPLORED, 2)))
def explore_correlations(spark, sf_dir):
    return X.correlations(_coerced(spark, sf_dir), EXPLORED)


# --- validation --------------------------------------------------------------------------------------------------------

def _failed(check: str, column: str, when: str, pre: str, post: str, stage: str) -> str:
    return f"select '{check}' as \"check\", '{column}' as \"column\", '{pre if stage == PRE else post}' as severity, count(*) as n from t where {when}"


def _failures_sql(stage: str, count=_failed) -> str:
    """Counts by check and column over a table t of the contract's columns; flags are there after cleaning. Another `count` gets the checks of cells alone."""
    gone = f"trim({{}}) in ({_TOKENS})"
    rows = []
    for r in CONTRACT.columns:
        v, there = f"trim({r.name})", f"trim({r.name}) not in ({_TOKENS})"
        add = lambda check, when, mended=False, r=r: rows.append(count(check, r.name, when, "warn" if mended else CONTRACT.severity.get(check), CONTRACT.severity.get(check), stage))
        if r.required:
            flag = f"{r.name}_missing" if stage == POST and CONTRACT.missing[r.name] == "flag" else "false"
            add("required_missing_recorded", f"{gone.format(r.name)} and {flag}")
            add("required_missing", f"{gone.format(r.name)} and not {flag}")
        if r.type in ("integer", "numeric"):
            n = f"({_NUMBER.format(v)})"
            add("type_invalid", f"{there} and ({n} is null" + (f" or {n} <> floor({n}))" if r.type == "integer" else ")"), True)
            limits = [f"{n} < {r.min}"] * (r.min is not None) + [f"{n} > {r.max}"] * (r.max is not None)
            add("range_invalid", f"{there} and ({' or '.join(limits)})")
        elif r.type == "date":
            d = f"try_strptime({v}, '%Y-%m-%d')::date"
            add("type_invalid", f"{there} and {d} is null", True)
            if count is not _failed:
                continue
            old = f"(date '{AS_OF}' - {d}) / 365.25::double"
            parts = [f"(case when {d} > date '{AS_OF}' then 1 else 0 end)"]
            if r.max_age_years is not None:
                parts += [f"(case when {old} > {r.max_age_years} then 1 else 0 end)", f"(case when {old} < {r.min_age_years} then 1 else 0 end)"]
            sev = CONTRACT.severity["range_invalid"]
            rows.append(f"select 'range_invalid' as \"check\", '{r.name}' as \"column\", '{sev}' as severity, coalesce(sum({' + '.join(parts)}), 0) as n from t where {there}")
        elif r.type == "category":
            add("category_invalid", f"{there} and {v} not in ('active', 'inactive', 'suspended')", True)
        else:
            if r.format:
                add("format_invalid", f"{there} and not regexp_matches({v}, '{T.EMAIL_STRICT if r.format == 'email' else T.PHONE_STRICT}')", True)
            if r.min_length is not None:
                add("length_invalid", f"{there} and (length({v}) < {r.min_length} or length({v}) > {r.max_length})", True)
            if r.alphabetic:
                add("alphabetic_invalid", f"{there} and not regexp_matches(replace(replace({v}, ' ', ''), '-', ''), '^\\p{{L}}+$')", True)
    if count is not _failed:
        return " union all ".join(filter(None, rows))
    rows.append(_failed("cross_field_invalid", "date_of_birth", "try_strptime(trim(date_of_birth), '%Y-%m-%d') > try_strptime(trim(created_date), '%Y-%m-%d')", "quarantine", "quarantine", stage))
    columns = NAMES + ([f"{c}_missing" for c, how in CONTRACT.missing.items() if how == "flag"] if stage == POST else [])
    rows.append(f"select 'duplicate_row' as \"check\", null as \"column\", 'warn' as severity, case when count(*) < sum(n) then 1 else 0 end as n from (select count(*) as n from t group by {', '.join(columns)})")
    rows.append(f"select 'duplicate_key' as \"check\", 'customer_id' as \"column\", 'quarantine' as severity, case when max(n) > 1 then 1 else 0 end as n from (select count(*) as n from t where trim(customer_id) not in ({_TOKENS}) group by trim(customer_id))")
    return " union all ".join(rows)


# Normal forms in SQL, of a trimmed value v.
_ISO = "coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%d-%b-%Y'), try_strptime({0}, '%Y/%m/%d'), case when regexp_matches({0}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') then case when split_part({0}, '/', 1)::int > 12 then try_strptime({0}, '%d/%m/%Y') when split_part({0}, '/', 2)::int > 12 then try_strptime({0}, '%m/%d/%Y') else try_strptime({0}, '%d/%m/%Y') end end)::date::varchar"
_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_TEN = f"(case when length({_DIGITS}) = 11 and {_DIGITS}[1] = '1' then {_DIGITS}[2:] else {_DIGITS} end)"
_FORMS = {
    "phone": f"case when length({_TEN}) = 10 then {_TEN}[1:3] || '-' || {_TEN}[4:6] || '-' || {_TEN}[7:10] end",
    "email": "lower({0})",
    "date": _ISO,
    "integer": f"case when ({_NUMBER}) = floor({_NUMBER}) then ({_NUMBER})::bigint::varchar end",
    "numeric": f"regexp_replace(printf('%.2f', {_NUMBER}), '([.][0-9])0$', '\\1')",
    "category": "case lower({0}) when 'actv' then 'active' when 'act' then 'active' when 'a' then 'active' when 'inact' then 'inactive' when 'susp' then 'suspended' else lower({0}) end",
    "name": "list_reduce(list_prepend('', list_transform(regexp_extract_all({0}, '[A-Za-z]+(?:''[A-Za-z]+)?|[^A-Za-z]+'), lambda p: case when regexp_matches(p, '^[A-Za-z]') then upper(p[1]) || lower(p[2:]) else p end)), lambda x, y: x || y)",
}


def _form(rule) -> str | None:
    key = rule.format if rule.format in ("phone", "email") else rule.type if rule.type in _FORMS else "name" if rule.alphabetic else None
    return _FORMS[key] if key else None


def _clean_sql() -> str:
    """std: normal forms and flags of rows that aren't dropped; one: first of equal rows; cleaned and held: by key."""
    bare = ", ".join(f"case when trim({c}) in ({_TOKENS}) then '' else trim({c}) end as {c}" for c in NAMES)
    forms = ", ".join(f"case when {r.name} = '' then '' else coalesce({_form(r).format(r.name)}, '') end as {r.name}" if _form(r) else r.name for r in CONTRACT.columns)
    flags = ", ".join(f"{c} = '' as {c}_missing" for c, how in CONTRACT.missing.items() if how == "flag")
    filled = ", ".join(f"case when {c} = '' then 'UNKNOWN' else {c} end as {c}" if CONTRACT.missing.get(c) == "placeholder" else c for c in NAMES)
    every = ", ".join(NAMES + [f"{c}_missing" for c, how in CONTRACT.missing.items() if how == "flag"])
    return f"""{_RAW}, bare as (select _row_id, {bare} from raw), forms as (select _row_id, {forms} from bare),
usable as (select _row_id, {filled}, {flags} from forms where customer_id <> '' and account_status <> ''),
one as (select min(_row_id) as _row_id, {every} from usable group by {every}),
shared as (select customer_id from one group by 1 having count(*) > 1),
cleaned as (select * from one where customer_id not in (select customer_id from shared)), held as (select * from one where customer_id in (select customer_id from shared))"""


_CLEAN = _clean_sql()
_BY = 'select "check", "column", severity, n from f where n > 0'


def _shape_of(check: str, column: str, when: str, pre: str, post: str, stage: str) -> str:
    shape = f"regexp_replace(regexp_replace(trim({column})[1:24], '\\p{{L}}', 'x', 'g'), '[0-9]', '9', 'g')"
    return f"select _row_id::bigint as row_index, '{check}' as \"check\", '{column}' as \"column\", {shape} as value_shape from t where {when}" if check in SHAPED else ""


#: Checks whose failures show the shape of the value.
SHAPED = ("type_invalid", "category_invalid", "format_invalid", "alphabetic_invalid")


@query(f"with {_RAW}, t as (select * from raw) {_failures_sql(PRE, _shape_of)}")
def failure_shapes_pre(spark, sf_dir):
    found = V.row_failures(raw_customers(spark, sf_dir), CONTRACT, PRE, AS_OF)
    return found.where("value_shape is not null").select("row_index", "check", "column", "value_shape")


def _counts(found: DataFrame) -> DataFrame:
    return found.groupBy("check", "column", "severity").agg(F.count("*").alias("n"))


@query(f"with {_RAW}, t as (select * from raw), f as ({_failures_sql(PRE)}) {_BY}")
def failures_pre(spark, sf_dir):
    return _counts(V.failures(raw_customers(spark, sf_dir), CONTRACT, PRE, AS_OF))


@query(f"with {_CLEAN}, t as (select * from cleaned), f as ({_failures_sql(POST)}) {_BY}")
def failures_post(spark, sf_dir):
    return _counts(V.failures(C.clean(raw_customers(spark, sf_dir), CONTRACT).rows, CONTRACT, POST, AS_OF))


def _quarantine_when() -> str:
    """A row with a failure of severity quarantine, after cleaning."""
    out = []
    for r in CONTRACT.columns:
        v, there = f"trim({r.name})", f"trim({r.name}) not in ({_TOKENS})"
        if r.required:
            out.append(f"trim({r.name}) in ({_TOKENS})" + (f" and not {r.name}_missing" if CONTRACT.missing[r.name] == "flag" else ""))
        if r.type in ("integer", "numeric"):
            n = f"({_NUMBER.format(v)})"
            out.append(f"{there} and ({n} is null or {n} < {r.min}" + (f" or {n} > {r.max}" if r.max is not None else "") + (f" or {n} <> floor({n})" if r.type == "integer" else "") + ")")
        elif r.type == "date":
            d = f"try_strptime({v}, '%Y-%m-%d')::date"
            old = f"(date '{AS_OF}' - {d}) / 365.25::double"
            out.append(f"{there} and ({d} is null or {d} > date '{AS_OF}'" + (f" or {old} > {r.max_age_years} or {old} < {r.min_age_years}" if r.max_age_years is not None else "") + ")")
        elif r.type == "category":
            out.append(f"{there} and {v} not in ('active', 'inactive', 'suspended')")
        elif r.format:
            out.append(f"{there} and not regexp_matches({v}, '{T.EMAIL_STRICT if r.format == 'email' else T.PHONE_STRICT}')")
    out.append("coalesce(try_strptime(trim(date_of_birth), '%Y-%m-%d') > try_strptime(trim(created_date), '%Y-%m-%d'), false)")
    return " or ".join(f"({x})" for x in out)


@query(f"with {_CLEAN} select count(*) as rows, count(*) filter (where {_quarantine_when()}) as quarantined, 100.0::double * count(*) filter (where {_quarantine_when()}) / greatest(count(*), 1) as rate_pct from cleaned")
def quarantine_rate(spark, sf_dir):
    return V.quarantine_rate(C.clean(raw_customers(spark, sf_dir), CONTRACT).rows, CONTRACT, POST, AS_OF)


@query("""select l_linenumber, count(*) filter (where l_quantity < 1) as below_min, count(*) filter (where l_quantity > 45) as above_max, count(*) filter (where l_shipdate < o_orderdate) as shipped_before_ordered
from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def range_and_crossfield_lineitem(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return lines.join(orders, "l_orderkey").groupBy("l_linenumber").agg(F.count_if(F.col("l_quantity") < 1).alias("below_min"), F.count_if(F.col("l_quantity") > 45).alias("above_max"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("shipped_before_ordered"))


# --- cleaning ----------------------------------------------------------------------------------------------------------

def _normalised(name: str, column: str, fn: Callable[[Column], Column]):
    rule = CONTRACT.rule(column)

    def run(spark, sf_dir):
        return raw_customers(spark, sf_dir).select("_row_id", fn(T.strip(F.col(column))).alias("value"))

    run.__name__ = name
    query(f"with {_RAW} select _row_id, {_form(rule).format(f'trim({column})')} as value from raw")(run)


_normalised("normalise_phone", "phone", N.phone)
_normalised("normalise_email", "email", N.email)
_normalised("normalise_date", "date_of_birth", N.date)
_normalised("normalise_number", "income", N.decimal)
_normalised("normalise_integer", "customer_id", N.whole)
_normalised("normalise_name", "last_name", N.name)
_normalised("normalise_category", "account_status", lambda c: N.category(c, CONTRACT.synonyms["account_status"]))


@query(f"""with {_RAW}, v as (select trim(date_of_birth) as v from raw union all select trim(created_date) from raw) select count(*) as n from v
where regexp_matches(v, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') and split_part(v, '/', 1)::int <= 12 and split_part(v, '/', 2)::int <= 12 and try_strptime(v, '%d/%m/%Y') is not null""")
def ambiguous_dates(spark, sf_dir):
    return C.standardise(raw_customers(spark, sf_dir), CONTRACT).agg(F.sum("_ambiguous").cast("long").alias("n"))


@query(f"with {_CLEAN} select * from cleaned")
def cleaned_rows(spark, sf_dir):
    return C.clean(raw_customers(spark, sf_dir), CONTRACT).rows


@query(f"with {_CLEAN} select * from held")
def quarantined_keys(spark, sf_dir):
    return C.clean(raw_customers(spark, sf_dir), CONTRACT).quarantined


def _changes_sql() -> str:
    rows = []
    for r in CONTRACT.columns:
        c, how = r.name, CONTRACT.missing.get(r.name)
        one = lambda action, when, table="b", c=c: rows.append(f"select '{c}' as \"column\", '{action}' as action, count(*) as n from {table} where {when}")
        one("normalised", f"trim({c}) in ({_TOKENS}) and trim({c}) <> ''", "raw")
        one("normalised", f"(trim({c}) not in ({_TOKENS}) or trim({c}) = '') and {c} <> trim({c})", "raw")
        form = _form(r)
        if form:
            one("normalised", f"{c} <> '' and {form.format(c)} <> {c}", "bare")
            one("flagged", f"{c} <> '' and {form.format(c)} is null", "bare")
        if how:
            one({"drop_row": "dropped", "placeholder": "placeholder", "flag": "flagged"}[how], f"{c} = ''", "forms")
    rows.append("select '<row>' as \"column\", 'dropped' as action, (select count(*) from usable) - (select count(*) from one) as n")
    rows.append("select 'customer_id' as \"column\", 'quarantined' as action, count(*) as n from held")
    return f'with {_CLEAN} select "column", action, sum(n)::bigint as n from ({" union all ".join(rows)}) group by 1, 2 having sum(n) > 0'


@query(_changes_sql())
def change_counts(spark, sf_dir):
    return C.change_counts(C.clean(raw_customers(spark, sf_dir), CONTRACT).changes)


# --- detection ---------------------------------------------------------------------------------------------------------

def _pattern_sql(p: str) -> str:
    """The Unicode classes that (?U) gives in Spark, spelled out; \\b stays and is ASCII in SQL, which takes `st` in `212 das üst` for a word, as Spark and Python don't."""
    flags = "i" if p.startswith("(?Ui)") else ""
    for a in ("(?Ui)", "(?U)"):
        p = p.removeprefix(a)
    p = p.replace("[\\w'.-]", "[\\p{L}\\p{N}_'.-]").replace("[\\w\\s'-]", "[\\p{L}\\p{N}_\\s'-]").replace("[\\w\\s]", "[\\p{L}\\p{N}_\\s]")
    return "'" + p.replace("'", "''") + "'" + (f", '{flags}'" if flags else "")


def _hits_sql(table: str, column: str) -> str:
    return " union all ".join(f"select '{column}' as \"column\", '{d}' as detector, count(*) filter (where trim({column}) <> '' and regexp_matches({column}, {_pattern_sql(p)})) as match_count, count(*) filter (where trim({column}) <> '') as non_blank from {table}" for d, p in D.CONTENT.items())


@query(_hits_sql("documents", "text"))
def pii_hits_documents(spark, sf_dir):
    return D.content_hits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["text"], examples=False).drop("example_shape")


@query(_hits_sql("conversations", "text"))
def pii_hits_conversations(spark, sf_dir):
    return D.content_hits(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "text"), ["text"], examples=False).drop("example_shape")


@query(_hits_sql("pages", "html"))
def pii_hits_pages(spark, sf_dir):
    return D.content_hits(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), ["html"], examples=False).drop("example_shape")


@query("with " + _RAW + " " + " union all ".join(_hits_sql("raw", c) for c in NAMES))
def pii_hits_customers(spark, sf_dir):
    return D.content_hits(raw_customers(spark, sf_dir), NAMES).drop("example_shape")


_HINTS = "case " + " ".join("when regexp_matches(lower(\"column\"), '{}') then '{}'".format(p, k) for p, k in D.NAME_HINTS) + " end"
_PLACE = "list_position([" + ", ".join(f"'{d}'" for d in D.CONTENT) + "], detector)"


def _one_of(table: dict, otherwise: str) -> str:
    return "case pii_type " + " ".join("when '{}' then {}".format(k, repr(v)) for k, v in table.items()) + f" else {otherwise} end"


_PROTECTED = "declared in ({})".format(", ".join(f"'{x}'" for x in sorted(D.PROTECTED)))
_FOUND = "with " + _RAW + ", hits as (" + " union all ".join(_hits_sql("raw", c) for c in NAMES) + f"""),
rated as (select "column", detector, match_count, {_PLACE} as place, round(100.0::double * match_count / non_blank, 1) as rate from hits where match_count > 0),
best as (select "column", arg_min(detector, row(-rate, place)) as detector, max(rate) >= {D.SUPPORTS} as supports, sum(match_count)::bigint as matches from rated group by 1),
about as (select "column", max(non_blank) as populated, {_HINTS} as name_signal, case "column" {" ".join(f"when '{r.name}' then '{r.pii}'" for r in CONTRACT.columns)} end as declared from hits group by 1),
joined as (select a.*, coalesce(name_signal, b.detector) as pii_type, coalesce(matches, 0) as matches, b.detector is null as nothing,
  ({_PROTECTED})::int + (name_signal is not null)::int + coalesce(supports, false)::int as votes from about a left join best b using ("column")),
found as (select "column", declared, name_signal, pii_type, ['none', 'low', 'medium', 'high'][votes + 1] as confidence, populated, matches, {_one_of(D.SENSITIVITY, "0")} as sensitivity,
  {_one_of(D.IDENTIFIABILITY, "'n/a'")} as identifiability, pii_type is not null and votes > 0 as is_pii, not ({_PROTECTED}) and pii_type is not null as undeclared, {_PROTECTED} and nothing as unmatched,
  coalesce((select string_agg(r.detector, ',' order by -r.rate, r.place) from rated r where r."column" = joined."column" and name_signal is not null and r.detector <> name_signal and r.rate >= {D.CONTRADICTS}), '') as hidden
  from joined)"""


@query(_FOUND + " select * from found")
def pii_findings(spark, sf_dir):
    found = D.findings(raw_customers(spark, sf_dir), CONTRACT)
    matches = F.aggregate(F.map_values("content"), F.lit(0).cast("long"), lambda n, h: n + h["match_count"]).alias("matches")
    return found.select(*(c for c in D.FINDING if c not in ("content", "hidden")), matches, F.array_join("hidden", ",").alias("hidden"))


_QUASI = "identifiability = 'quasi' or declared in ({})".format(", ".join(f"'{x}'" for x in sorted(D.QUASI)))


@query(_FOUND + f""", t as (select (select count(*) from raw) as rows, count(*) filter (where is_pii) as pii_columns,
coalesce(string_agg("column", ',' order by "column") filter (where is_pii and identifiability = 'direct'), '') as direct, coalesce(string_agg("column", ',' order by "column") filter (where {_QUASI}), '') as quasi,
coalesce(sum(populated * sensitivity) filter (where is_pii), 0)::bigint as exposure, coalesce(max(sensitivity) filter (where is_pii), 0) as max_sensitivity, count(*) filter (where is_pii and identifiability = 'direct') as n from found)
select * exclude (n), case when max_sensitivity >= 5 or n >= 3 and rows > 100 then 'HIGH' when max_sensitivity >= 3 or n >= 1 then 'MEDIUM' else 'LOW' end as risk from t""")
def pii_risk(spark, sf_dir):
    raw = raw_customers(spark, sf_dir)
    total = raw.agg(F.count("*").alias("total"))
    return D.risk(D.findings(raw, CONTRACT).crossJoin(F.broadcast(total)), F.col("total"))


def _first_shapes(column: str) -> str:
    shape = f"regexp_replace(regexp_replace({column}[1:40], '[A-Za-z]', 'x', 'g'), '[0-9]', '9', 'g')"
    return " union all ".join(f"select '{column}' as \"column\", '{d}' as detector, arg_min({shape}, _row_id) as example_shape from raw where regexp_matches({column}, {_pattern_sql(p)})" for d, p in D.CONTENT.items())


@query("with " + _RAW + ", s as (" + " union all ".join(map(_first_shapes, NAMES)) + ") select * from s where example_shape is not null")
def pii_example_shapes(spark, sf_dir):
    return D.content_hits(raw_customers(spark, sf_dir), NAMES).where("match_count > 0").select("column", "detector", "example_shape")


# --- masking and risk --------------------------------------------------------------------------------------------------

_GROUP = "regexp_replace(reverse(regexp_replace(reverse(abs({0})::varchar), '([0-9]{{{{3}}}})', '\\1,', 'g')), '^,', '')"
_COMMAS = f"case when {{0}} < 0 then '-' else '' end || {_GROUP}"
_BAND = "floor(try_cast(trim({0}) as double) / 25000)::bigint * 25000"
_MASKS = {
    "initial_only": "case when trim({0}) = '' then '' else trim({0})[1] || '***' end",
    "partial_email": "case when contains(trim({0}), '@') then regexp_extract(trim({0}), '^(.*)@[^@]*$', 1)[1:1] || '***@' || regexp_extract(trim({0}), '([^@]*)$', 1) else '***' end",
    "partial_tail": f"case when {_DIGITS} = '' then '' else '***-***-' || right({_DIGITS}, 4) end",
    "year_only": "case when regexp_matches(trim({0}), '^[0-9]{{4}}') then trim({0})[1:4] || '-**-**' else '' end",
    "redact": "case when trim({0}) = '' then '' else '[MASKED ADDRESS]' end",
    "access_control": "case when trim({0}) = '' then '' else '[ACCESS CONTROLLED]' end",
    "pseudonymize": f"case when trim({{0}}) = '' then '' else 'CUST_' || sha256('{M.DEV_SALT}' || trim({{0}}))[1:12] end",
    "band": "case when regexp_matches(trim({0}), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') then " + _COMMAS.format("(" + _BAND + ")") + " || '-' || " + _COMMAS.format("(" + _BAND + " + 25000)") + " else '' end",
}


@query(f"with {_CLEAN} select _row_id, " + ", ".join(f"{_MASKS[CONTRACT.masking[c]['method']].format(c)} as {c}" if c in CONTRACT.masking else c for c in NAMES) + " from cleaned")
def masked_rows(spark, sf_dir):
    return M.mask(C.clean(raw_customers(spark, sf_dir), CONTRACT).rows, CONTRACT, M.DEV_SALT)


def _masked(method: str, column: str):
    def run(spark, sf_dir):
        params = {k: v for k, v in CONTRACT.masking[column].items() if k != "method"}
        return raw_customers(spark, sf_dir).select("_row_id", masks.METHODS[method](F.col(column), salt=F.lit(M.DEV_SALT), **params).alias("value"))

    run.__name__ = f"mask_{method}"
    query(f"with {_RAW} select _row_id, {_MASKS[method].format(column)} as value from raw")(run)


for _column, _rule in CONTRACT.masking.items():
    if _column != "last_name":
        _masked(_rule["method"], _column)


@query("select c_custkey, " + _MASKS["band"].format("c_acctbal::varchar").replace("25000", "1000") + " as value from customer")
def mask_band_customer(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", masks.band(F.col("c_acctbal").cast("string"), width=1000).alias("value"))


def _k_sql(source: str, columns: str) -> str:
    return f"""g as (select count(*) as k from {source} group by {columns}), s as (select k, count(*) * k as rows from g group by k),
u as (select *, sum(rows) over (order by k) as upto, sum(rows) over () as total from s)
select sum(rows)::bigint as rows, min(k) as k_min, min(k) filter (where upto > total // 2) as k_median, coalesce(sum(rows) filter (where k = 1), 0)::bigint as unique_rows,
round(100.0::double * coalesce(sum(rows) filter (where k = 1), 0) / sum(rows), 1) as unique_pct from u"""


@query(f"""with {_RAW}, b as (select coalesce(nullif(regexp_extract(date_of_birth, '([0-9]{{4}})', 1), ''), '?') as y, lower(trim(split_part(address, ',', -1))) as c from raw), {_k_sql('b', 'y, c')}""")
def reident_raw(spark, sf_dir):
    return M.birth_year_and_city(raw_customers(spark, sf_dir), CONTRACT.birth, CONTRACT.address)


@query(f"with {_CLEAN}, m as (select " + ", ".join(f"{_MASKS[CONTRACT.masking[c]['method']].format(c)} as {c}" for c in CONTRACT.quasi) + f" from cleaned), {_k_sql('m', ', '.join(CONTRACT.quasi))}")
def residual_k(spark, sf_dir):
    return M.k_anonymity(masked_rows(spark, sf_dir), list(CONTRACT.quasi))


@query("with b as (select c_nationkey, c_mktsegment, floor(c_acctbal / 1000) as band from customer), " + _k_sql("b", "c_nationkey, c_mktsegment, band"))
def residual_k_customer(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).alias("band"))
    return M.k_anonymity(rows, ["c_nationkey", "c_mktsegment", "band"])


@query("select c_custkey, regexp_replace(regexp_replace(c_name, '[A-Za-z]', 'x', 'g'), '[0-9]', '9', 'g')[1:24] as shape from customer")
def value_shape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", T.shape(F.col("c_name")).alias("shape"))


# --- files -------------------------------------------------------------------------------------------------------------

@query(f"with {_RAW} select row_number() over (order by _row_id) - 1 as _row_id, {', '.join(NAMES)} from raw")
def csv_round_trip(spark, sf_dir):
    """Written as parts in the order of rows and read again, cell by cell as they were."""
    rows = raw_customers(spark, sf_dir).select(V.ROW_ID, *NAMES).repartitionByRange(V.ROW_ID)
    path = f"{files.shared_dir(spark)}/customers-{uuid.uuid4().hex}.csv"
    files.write_csv(rows, path, order=V.ROW_ID)
    return files.read_csv(spark, path, NAMES)[0].select(F.col(V.ROW_ID).cast("long").alias(V.ROW_ID), *NAMES)
