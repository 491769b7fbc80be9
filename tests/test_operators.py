"""Validation, cleaning, profiling, detection, masking on small tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sievework.contract import POST, PRE, InputError, load_contract, parse
from sievework.fixture import raw_customers
from sievework.functions import text as T
from sievework.operators import clean as C
from sievework.operators import detect as D
from sievework.operators import explore as X
from sievework.operators import mask as M
from sievework.operators import profile as P
from sievework.operators import validate as V
from sievework.plans.retry import GaveUp, may_pass, persist_in
from sievework.sources import files
from sievework.streaming import rows as S

CONTRACT = load_contract()
NAMES = [r.name for r in CONTRACT.columns]
AS_OF = date(2025, 8, 1)
GOOD = ("1", "Ann", "Lee", "ann@x.com", "200-300-4000", "1990-01-02", "12 Long Street, Accra", "100", "active", "2020-01-02")


def table(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row_id long, " + ", ".join(f"{n} string" for n in NAMES)).coalesce(1)


def changed(**kw):
    return tuple(kw.get(n, v) for n, v in zip(NAMES, GOOD))


def found(df, stage=POST):
    return sorted((r.row_index, r.column, r.check, r.severity) for r in V.failures(df, CONTRACT, stage, AS_OF).where("row_index is not null").collect())


def test_severity_depends_on_stage():
    assert CONTRACT.severity_of("format_invalid", PRE, "phone") == "warn"
    assert CONTRACT.severity_of("format_invalid", POST, "phone") == "quarantine"
    strict = parse({"columns": {"a": {"on_fail": "fail"}}})
    assert strict.severity_of("range_invalid", PRE, "a") == "fail" and strict.severity_of("type_invalid", PRE, "a") == "warn"


def test_each_rule(spark):
    rows = {
        "customer_id": [("0", "range_invalid"), ("1.5", "type_invalid"), ("x", "type_invalid"), ("", "required_missing")],
        "first_name": [("A", "length_invalid"), ("A" * 51, "length_invalid"), ("A1b", "alphabetic_invalid"), ("UNKNOWN", "required_missing")],
        "email": [("a@b", "format_invalid"), ("a b@c.d", "format_invalid")],
        "phone": [("2003004000", "format_invalid")],
        "date_of_birth": [("02/01/1990", "type_invalid"), ("1850-01-01", "range_invalid"), ("2010-01-01", "range_invalid")],
        "income": [("-1", "range_invalid"), ("10000001", "range_invalid"), ("1d", "type_invalid")],
        "account_status": [("ACTIVE", "category_invalid")],
        "created_date": [("2025-08-02", "range_invalid"), ("1980-01-01", "cross_field_invalid")],
    }
    cases = [(c, v, check) for c, some in rows.items() for v, check in some]
    got = found(table(spark, GOOD, *(changed(**{c: v}) for c, v, _ in cases)))
    wanted = [(i + 1, "date_of_birth" if check == "cross_field_invalid" else c, check, CONTRACT.severity_of(check, POST, c)) for i, (c, _, check) in enumerate(cases)]
    assert got == sorted(wanted)


def test_recorded_gap_is_only_a_warning(spark):
    df = table(spark, changed(email=""), changed(email="")).withColumn("email_missing", F.col("_row_id") == 0)
    assert found(df) == [(0, "email", "required_missing_recorded", "warn"), (1, "email", "required_missing", "quarantine")]


def test_structure_and_breaker(spark):
    good = table(spark, GOOD)
    assert V.validate(good.limit(0), CONTRACT, PRE, AS_OF).fatal == "no rows"
    assert "absent" in V.validate(good.drop("email"), CONTRACT, PRE, AS_OF).fatal
    bad = table(spark, GOOD, changed(customer_id="2", income="-1"))
    assert V.validate(bad, CONTRACT, PRE, AS_OF).fatal is None
    post = V.validate(bad, CONTRACT, POST, AS_OF)
    assert post.quarantined == 1 and "50.0%" in post.fatal
    twice = V.validate(table(spark, GOOD, GOOD), CONTRACT, PRE, AS_OF)
    assert twice.by_check == {"duplicate_row": 1, "duplicate_key": 1} and twice.by_column == {"<dataset>": 1, "customer_id": 1} and twice.quarantined == 0


def test_cleaning_keeps_an_account_of_every_row(spark):
    df = table(spark, GOOD, GOOD, changed(customer_id="2", email=" ANN@X.com "), changed(customer_id="2", phone="(200) 300-4001"), changed(customer_id=""), changed(customer_id="3", first_name="N/A", date_of_birth="05/06/1990", income="bad"))
    out = C.clean(df, CONTRACT)
    s = out.summary()
    assert s == {"rows_in": 6, "dropped_rows": 1, "ambiguous_dates": 1, "rows_out": 2, "quarantined": 2}
    kept = {r.customer_id: r for r in out.rows.collect()}
    assert kept["1"]._row_id == 0 and kept["3"].first_name == "UNKNOWN" and kept["3"].date_of_birth == "1990-06-05"
    assert kept["3"].income == "" and kept["3"].income_missing and not kept["1"].income_missing
    trail = {(r.row_index, r.column, r.action) for r in out.changes.collect()}
    assert {(1, None, "dropped"), (2, "customer_id", "quarantined"), (3, "customer_id", "quarantined"), (3, "phone", "normalised"), (4, "customer_id", "dropped"), (5, "first_name", "placeholder"), (5, "income", "flagged")} <= trail
    assert any("null token" in r.reason for r in out.changes.where("row_index = 5 and column = 'first_name'").collect())
    out.release()


def test_undeclared_columns_pass_and_count_for_equality(spark):
    df = table(spark, GOOD, GOOD).withColumn("note", F.concat(F.lit(" n"), F.col("_row_id")))
    out = C.clean(df, CONTRACT)
    assert out.quarantined.count() == 2 and {r.note for r in out.quarantined.collect()} == {"n0", "n1"}
    out.release()


def test_profile(spark):
    df = table(spark, GOOD, changed(customer_id="1", income="$5"), changed(customer_id="2", account_status="Active", email="x", date_of_birth="13/01/1990", income="?"))
    facts = P.profile(df, CONTRACT, AS_OF)
    c = facts["columns"]
    assert c["customer_id"]["duplicate_values"] == 1 and c["customer_id"]["duplicate_examples"] == ["1"]
    assert c["income"] | {} and (c["income"]["min_value"], c["income"]["max_value"], c["income"]["mean_value"], c["income"]["missing"]) == (5.0, 100.0, 52.5, 1)
    assert c["email"]["invalid_email"] == 1 and len(c["date_of_birth"]["formats"]) == 2 and c["account_status"]["value_counts"][0] == ("active", 2)
    assert facts["rows"] == 3 and facts["missing_cells"] == 1 and facts["cross"]["same_person"] == 1
    empty = P.profile(df.limit(0), CONTRACT, AS_OF)
    assert empty["completeness_pct"] == 100.0 and empty["rows"] == 0


def test_detection(spark):
    df = table(spark, *(changed(customer_id=str(i)) for i in range(3))).withColumn("note", F.lit("mail me@x.org"))
    found_ = D.detect(df, CONTRACT)
    f = found_["columns"]
    assert f["email"].confidence == "high" and f["customer_id"].pii_type is None and not f["customer_id"].is_pii
    assert f["note"].pii_type == "email" and any("UNDECLARED" in x for x in D.remarks(f["note"])) and D.remarks(f["email"]) == []
    assert f["created_date"].pii_type == "date_of_birth" and found_["table"].quasi == "created_date,date_of_birth,income"
    levels = spark.createDataFrame([(5, 0, 1), (0, 3, 101), (0, 3, 100), (3, 0, 1), (0, 0, 9)], "s int, d int, r int").select(D.risk_level(F.col("s"), F.col("d"), F.col("r")).alias("l")).collect()
    assert found_["table"].risk == "MEDIUM" and [x.l for x in levels] == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert [D.name_signal(c) for c in ("first_name", "ip_address", "hotel", "xyz")] == ["name", "address", "phone", None]
    assert f["email"].content["email"]["example_shape"] == "xxx@x.xxx"


def test_personal_data_after_row_500_is_found(spark, monkeypatch):
    from sievework import queries

    df = table(spark, GOOD).crossJoin(spark.range(1200).select(F.col("id").alias("_n"))).withColumn("_row_id", F.col("_n").cast("int")).drop("_n")
    df = df.withColumn("note", F.when(F.col("_row_id") >= 600, "mail me@x.org").otherwise("plain"))
    monkeypatch.setattr(queries, "raw_customers", lambda spark, sf_dir: df)
    got = {r.column: r for r in queries.pii_findings(spark, "").collect()}["note"]
    assert got.pii_type == "email" and got.undeclared and got.populated == 1200
    found = D.detect(df, CONTRACT)["columns"]["note"]
    assert found.content["email"]["match_rate"] == 50.0 and found.confidence == "low" and D.detect(df, CONTRACT, sample=500)["columns"]["note"].pii_type is None


def test_unicode_digits_and_words_are_content(spark):
    df = spark.createDataFrame([(0, "12 Štrasse Größe, Köln"), (1, "١٢٣-٤٥-٦٧٨٩")], "_row_id long, t string")
    hits = {r.detector: r.match_count for r in D.content_hits(df, ["t"]).collect()}
    assert hits["address"] == 1 and hits["national_id"] == 1


def test_masking_leaves_no_raw_value_and_no_salt_in_the_plan(spark, monkeypatch):
    df = table(spark, GOOD, changed(customer_id="2", email="")).withColumn("email_missing", F.col("email") == "")
    out = M.mask(df, CONTRACT, "pepper-and-salt")
    assert "pepper-and-salt" not in out._jdf.queryExecution().toString()
    assert out.columns == ["_row_id", *NAMES]
    rows = out.orderBy("_row_id").collect()
    raw = {v for n, v in zip(NAMES, GOOD) if len(v) >= 5 and n in CONTRACT.masking}
    assert not any(v in str(x) for v in raw for x in rows[0]) and rows[1].email == "***"
    assert M.mask_counts(df, CONTRACT, "s").first().email == 2 and M.mask_samples(df, CONTRACT, "s", "email") == [("ann@x.com", "a***@x.com")]
    monkeypatch.delenv(CONTRACT.salt_env, raising=False)
    with pytest.raises(M.SaltError):
        M.salt(CONTRACT)
    assert M.salt(CONTRACT, True) == M.DEV_SALT


def test_k_median_is_the_upper_one_over_rows(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), *[("d",)] * 4], "x string")
    r = M.k_anonymity(df, ["x"]).first()
    assert (r.rows, r.k_min, r.k_median, r.unique_rows, r.unique_pct) == (8, 1, 4, 2, 25.0)


def test_contract_errors(tmp_path):
    with pytest.raises(InputError):
        load_contract(tmp_path / "none.yaml")
    for text in ("a: [", "[]", "columns: 3"):
        (tmp_path / "c.yaml").write_text(text)
        with pytest.raises(InputError):
            load_contract(tmp_path / "c.yaml")
    apart = parse({"columns": {"a": {"type": "date"}}, "missing_strategy": {"a": "flag"}, "masking": {"a": {"method": "redact"}}})
    assert apart.missing == {"a": "flag"} and apart.masking["a"]["method"] == "redact" and apart.expected == ("a",)


def test_what_may_pass_is_tried_again():
    waits, calls = [], []

    def flaky(error, good_at):
        calls.append(1)
        if len(calls) < good_at:
            raise error
        return "done"

    assert persist_in(lambda: flaky(ConnectionError("reset"), 3), tries=3, first=1, longest=1.5, wait=waits.append) == "done"
    assert len(calls) == 3 and 1 <= waits[0] <= 1.25 and 1.5 <= waits[1] <= 1.5 * 1.25
    calls.clear()
    with pytest.raises(GaveUp, match="2 tries"):
        persist_in(lambda: flaky(TimeoutError("late"), 9), tries=2, wait=waits.append)
    assert len(calls) == 2
    for error in (InputError("wrong"), FileNotFoundError("gone"), ValueError("no")):
        calls.clear()
        with pytest.raises(type(error)):
            persist_in(lambda: flaky(error, 9), tries=3, wait=waits.append)
        assert len(calls) == 1


def test_errors_of_spark_are_told_apart(spark):
    from pyspark.errors import AnalysisException, PySparkException

    with pytest.raises(AnalysisException) as wrong:
        spark.read.parquet("/nowhere/at/all").count()
    assert not may_pass(wrong.value)
    assert may_pass(PySparkException("Job aborted: java.net.SocketTimeoutException: Read timed out")) and may_pass(PySparkException("java.io.IOException: lease lost"))
    assert not may_pass(PySparkException("java.io.FileNotFoundException: x (java.io.IOException)"))


def test_stream_gets_what_a_batch_gets(spark, tmp_path):
    df = table(spark, GOOD, changed(customer_id="2", phone="2003004000"), changed(customer_id="", email="x"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = S.standardised(stream, CONTRACT, AS_OF).writeStream.format("memory").queryName("std").start()
    q.processAllAvailable()
    q.stop()
    got = {r.customer_id: r for r in spark.table("std").collect()}
    assert set(got) == {"1", "2"} and got["2"].phone == "200-300-4000" and got["1"]._failures == []


def test_the_salt_is_in_no_plan_of_a_stream(spark, tmp_path):
    df = table(spark, GOOD)
    df.write.parquet(f"{tmp_path}/in")
    stream = S.masked(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), CONTRACT, "TOPSECRETKEY")
    q = stream.writeStream.format("memory").queryName("masked").start()
    q.processAllAvailable()
    shown = q._jsq.toString() + stream._jdf.queryExecution().toString() + q._jsq.streamingQuery().explainInternal(True)
    q.stop()
    got, want = spark.table("masked").drop("_row_id").collect(), M.mask(df, CONTRACT, "TOPSECRETKEY").drop("_row_id").collect()
    assert "TOPSECRETKEY" not in shown and [r.asDict() for r in got] == [r.asDict() for r in want]


def test_rows_of_a_folder_are_numbered_by_file_name(spark, tmp_path):
    from sievework.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n0,x\n")
    (tmp_path / "in" / "b.csv").write_text("k,v\n" + "".join(f"{i},{'y' * 50}\n" for i in range(1, 30)))
    (tmp_path / "in" / "c.csv").write_text('k,v\n30,"two\nlines"\n31,z\n')
    rows, _ = files.read_csv(spark, f"{tmp_path}/in")
    assert [(r._row_id, r.k) for r in rows.orderBy("_row_id").collect()] == [(i, str(i)) for i in range(32)]


def test_a_long_blank_run_is_linear(spark):
    import time

    df = spark.createDataFrame([("x" + " " * 200_000 + "y",)], "v string")
    began = time.perf_counter()
    assert df.select(T.strip(F.col("v")).alias("s")).first().s == "x" + " " * 200_000 + "y" and time.perf_counter() - began < 5


def test_failures_keep_their_shapes_and_rows_without_any_give_none(spark):
    df = table(spark, GOOD, changed(email="not mail 7", phone="5"), changed(income="abc"))
    shapes = {(r.row_index, r["column"]): r.value_shape for r in V.row_failures(df, CONTRACT, PRE, AS_OF).collect()}
    assert shapes == {(1, "email"): "xxx xxxx 9", (1, "phone"): "9", (2, "income"): "xxx"}


def test_explored_numbers_and_dates(spark):
    df = spark.createDataFrame([(1.0, date(1970, 1, 2), None), (2.0, date(1970, 1, 3), None), (None, date(1970, 1, 4), None), (4.0, None, None)], "a double, d date, empty double")
    got = {r["column"]: r for r in X.summary(df, ["a", "d", "empty"]).collect()}
    a = got["a"]
    assert (a.total, a.present, a.mean, a.min_value, a.median, a.max_value) == (4, 3, 2.3333, 1.0, 2.0, 4.0)
    assert (got["d"].min_value, got["d"].max_value, got["empty"].present, got["empty"].median) == (1.0, 3.0, 0, None)
    bins = {(r["column"], r.bin): r.n for r in X.histogram(df, ["a", "d", "empty"], bins=3).collect()}
    assert bins == {("a", 0): 1, ("a", 1): 1, ("a", 2): 1, ("d", 0): 1, ("d", 1): 1, ("d", 2): 1}
    r = {(x.a, x.b): x.r for x in X.correlations(df, ["a", "d", "empty"]).collect()}
    assert r[("a", "d")] == 1.0 and r[("a", "empty")] is None
    same = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    assert [(x.bin, x.n) for x in X.histogram(same, ["a"]).collect()] == [(0, 2)]
    assert X.histogram(df.limit(0), ["a"]).count() == 0


def test_cells_come_back_from_csv_as_they_were(spark, tmp_path):
    cells = ["  padded ", 'a "quoted" one', "two\nlines", "a,b", "", "back\\slash", "\ttab"]
    df = spark.createDataFrame([(i, c, str(i)) for i, c in enumerate(cells)], "_row_id long, cell string, n string").repartitionByRange(3, "_row_id")
    files.write_csv(df, f"file://{tmp_path}/t.csv", order="_row_id")
    back = files.read_csv(spark, f"file://{tmp_path}/t.csv")[0]
    assert [(r._row_id, r.cell) for r in back.orderBy("_row_id").collect()] == list(enumerate(cells))


def test_keys_whose_products_pass_32_bits_make_rows(spark, tmp_path):
    keys = [271177, 271178, 899996, 15700001, 2000000008]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    df = raw_customers(spark, str(tmp_path))
    assert df.schema["_row_id"].dataType.simpleString() == "int"
    digits = {r._row_id: "".join(c for c in r.phone if c.isdigit()) for r in df.collect()}
    assert digits == {k: f"{200 + k * 37 % 800}{k * 91 % 1000:03d}{k * 7919 % 10000:04d}" for k in keys}


def test_a_street_type_within_a_word_is_no_address(spark):
    df = spark.createDataFrame([(0, "212 das üst"), (1, "212 das st")], "_row_id long, t string")
    assert {r.detector: r.match_count for r in D.content_hits(df, ["t"]).collect()}["address"] == 1
