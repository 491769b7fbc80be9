"""Whole runs on files."""

import json
from datetime import date

import pytest

from sievework.contract import InputError
from sievework.fixture import raw_customers
from sievework.plans.pipeline import INPUT, OK, QUALITY, BUG, Pipeline
from sievework.sources import files

AS_OF = date(2025, 8, 1)
SF = "/root/testdata/sf0.001"


def put(root, text, name="customers_raw.csv"):
    (root / "data/raw").mkdir(parents=True, exist_ok=True)
    (root / "data/raw" / name).write_text(text, encoding="utf-8")
    return f"{root}/data/raw/{name}"


def test_csv_reading(spark, tmp_path):
    path = put(tmp_path, 'a,b\n1,"x, ""y""\nz"\n2\n 3 ,NA\n')
    df, warnings = files.read_csv(spark, path, ["a"])
    assert [tuple(r)[:2] for r in df.select("a", "b", "_row_id").orderBy("_row_id").collect()] == [("1", 'x, "y"\nz'), ("2", ""), (" 3 ", "NA")]
    assert "['b']" in warnings[0]
    for text, why in (("a,b\n1,2\n1,2,3\n", "more fields"), ("a,b\n1,2,3\n1,2\n", "more fields"), ("a,b\n", "no rows"), ("", "empty"), ("b\n1\n", "lacks"), ("a,a\n1,2\n", "repeated")):
        with pytest.raises(InputError, match=why):
            files.read_csv(spark, put(tmp_path, text), ["a"])
    with pytest.raises(InputError, match="no such file"):
        files.read_csv(spark, f"{tmp_path}/none.csv")


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    (root / "data/raw").mkdir(parents=True)
    rows = raw_customers(spark, SF).orderBy("_row_id").drop("_row_id").toPandas()
    rows.to_csv(root / "data/raw/customers_raw.csv", index=False)
    return root


def contract_with(tmp_path, limit):
    from sievework.contract import CUSTOMERS

    (tmp_path / "c.yaml").write_text(CUSTOMERS.read_text().replace("max_quarantine_rate_pct: 40", f"max_quarantine_rate_pct: {limit}"))
    return tmp_path / "c.yaml"


def test_gate_stops_a_run(spark, raw, tmp_path):
    r = Pipeline(spark, str(raw), contract_with(tmp_path, 1), as_of=AS_OF, allow_dev_salt=True).run()
    assert r.exit_code == QUALITY and r.halted_at == "validate_post" and "would be quarantined" in r.halt_reason
    assert [s.status for s in r.steps] == ["ok"] * 6 + ["failed"]
    for f in ("reports/data_quality_report.txt", "reports/pii_detection_report.txt", "reports/cleaning_log.txt", "reports/validation_results.txt", "reports/execution_report.txt"):
        assert (raw / f).read_text().startswith("====")
    assert not list((raw / "data/processed").glob("*masked*"))


def test_run_to_its_end_and_again(spark, raw):
    outs = []
    for _ in range(2):
        r = Pipeline(spark, str(raw), as_of=AS_OF, allow_dev_salt=True, write_sample=True).run()
        assert r.exit_code == OK, (r.halted_at, r.halt_reason)
        outs.append(sorted(tuple(x) for x in spark.read.option("header", True).csv(f"{raw}/data/processed/customers_masked.csv").collect()))
    assert outs[0] == outs[1] and "RESTRICTED" in (raw / "reports/masked_sample.txt").read_text()
    m = json.loads((raw / f"logs/manifest-{r.run_id}.json").read_text())
    clean = next(s for s in r.steps if s.name == "clean")
    held = spark.read.option("header", True).csv(f"{raw}/data/quarantine/duplicate_keys.csv").count()
    gone = spark.read.option("header", True).csv(f"{raw}/data/processed/changes.csv").where("action = 'dropped'").select("row_index").distinct().count()
    assert clean.rows_in == clean.rows_out + held + gone and m["output_rows"] == clean.rows_out == len(outs[0])
    assert "data/quarantine/duplicate_keys.csv" in m["outputs"] and m["assumptions"]["as_of"] == "2025-08-01"


def test_diverting_quarantined_rows_passes_the_gate(spark, raw):
    r = Pipeline(spark, str(raw), as_of=AS_OF, allow_dev_salt=True, divert_quarantined=True).run()
    assert r.exit_code == OK, (r.halted_at, r.halt_reason)


def test_exit_codes(spark, tmp_path, raw, monkeypatch):
    r = Pipeline(spark, str(tmp_path), as_of=AS_OF).run()
    assert (r.exit_code, r.halted_at) == (INPUT, "load_raw")
    r = Pipeline(spark, str(tmp_path), tmp_path / "none.yaml", as_of=AS_OF).run()
    assert (r.exit_code, r.halted_at) == (INPUT, "load_config")
    monkeypatch.delenv("PII_PSEUDONYM_SALT", raising=False)
    r = Pipeline(spark, str(raw), as_of=AS_OF, divert_quarantined=True).run()
    assert (r.exit_code, r.halted_at) == (BUG, "mask") and "SaltError" in r.halt_reason
    monkeypatch.setattr("sievework.operators.profile.profile", lambda *a: 1 / 0)
    r = Pipeline(spark, str(raw), as_of=AS_OF, allow_dev_salt=True, divert_quarantined=True).run()
    assert r.exit_code == OK and next(s for s in r.steps if s.name == "profile").status == "failed"
