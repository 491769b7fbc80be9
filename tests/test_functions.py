"""Column functions, against values worked out by hand and against a specification in plain Python."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions import masks
from sievework.functions import normalise as N
from sievework.functions import text as T


def apply(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("fn,given,wanted", [
    (N.whole, ["1029", "1029.5", "1e3", "x", "", "$1,000", "nan", "0x10", "1d", "1_000"], ["1029", None, "1000", None, None, "1000", None, None, None, None]),
    (N.decimal, ["1029.50", "$ 5", "99000000", "2.675", "0.125", "-5", ".5", "inf", None], ["1029.5", "5.0", "99000000.0", "2.67", "0.12", "-5.0", "0.5", None, None]),
    (N.date, ["14/05/1990", "05/14/1990", "1990-05-14", "05/06/1990", "14-MAY-1990", "1990/5/4", "31/02/1990", "13/13/1990", "x", "1990-05-14x"],
     ["1990-05-14", "1990-05-14", "1990-05-14", "1990-06-05", "1990-05-14", "1990-05-04", None, None, None, None]),
    (lambda c: N.date(c, "month_first"), ["05/06/1990"], ["1990-05-06"]),
    (N.ambiguous_date, ["05/06/1990", "05/05/1990", "14/05/1990", "1990-05-14", "", "99/99/1990"], [True, True, False, False, False, False]),
    (N.phone, ["(212) 300-4001", "312.400.5002", "+14155006003", "4155006003", "212-GO-HOME", "212-300-4001 ext.7", ""], ["212-300-4001", "312-400-5002", "415-500-6003", "415-500-6003", None, None, None]),
    (N.name, ["jean-luc o'BRIEN", "éric a1b", "MARY", ""], ["Jean-Luc O'brien", "éRic A1B", "Mary", ""]),
    (lambda c: N.category(c, {"actv": "active"}), [" ACTV ", "Active", "pending"], ["active", "active", "pending"]),
    (masks.initial_only, ["John", "  ", "", "É"], ["J***", "", "", "É***"]),
    (masks.partial_email, ["mary.major@mail.rw", "a@@b.com", "", "none"], ["m***@mail.rw", "a***@b.com", "***", "***"]),
    (masks.partial_tail, ["212-300-4001", "12", "x", ""], ["***-***-4001", "***-***-12", "", ""]),
    (masks.year_only, ["1985-03-15", "x1985", ""], ["1985-**-**", "", ""]),
    (masks.redact, ["a", " ", None], ["[REDACTED]", "", ""]),
    (masks.access_control, ["a", ""], ["[ACCESS CONTROLLED]", ""]),
    (masks.band, ["30000", "-5000", "0", "x", "", "1234567.8"], ["25,000-50,000", "-25,000-0", "0-25,000", "", "", "1,225,000-1,250,000"]),
    (T.strip, ["\t a ", "　b ", None], ["a", "b", ""]),
    (T.shape, ["Ab-12 é"], ["xx-99 é"]),
    (T.date_label, ["1990-01-02", "13/01/1990", "01/13/1990", "2-Jan-1990", "x"], ["ISO (YYYY-MM-DD)", "day-first (DD/MM/YYYY)", "month-first (MM/DD/YYYY)", "abbreviated month (DD-Mon-YYYY)", None]),
    (T.phone_label, ["200-300-4000", "(200) 300-4000", "200.300.4000", "+12003004000", "2003004000", "200-300-4000 ext.12", "x"], [label for _, label in T.PHONE_FORMATS] + [None]),
    (T.birth_year, ["12/03/1985", "x"], ["1985", "?"]),
    (T.locality, ["1 Street,  Kigali ", "Accra"], ["kigali", "accra"]),
    (T.is_alphabetic, ["Jean-Luc", "a1", "É d", ""], [True, False, True, False]),
])
def test_values(spark, fn, given, wanted):
    assert apply(spark, given, fn) == wanted


def test_pseudonym_is_stable_and_hides_its_input(spark):
    a, b, blank = apply(spark, ["1029", "1029", " "], lambda c: masks.pseudonymize(c, salt=F.lit("s")))
    assert a == b and re.fullmatch("CUST_[0-9a-f]{12}", a) and "1029" not in a and blank == ""


def _iso(v):
    v = v.strip()
    for f in ("%Y-%m-%d", "%d-%b-%Y", "%Y/%m/%d"):
        try:
            return datetime.strptime(v, f).date().isoformat()
        except ValueError:
            pass
    m = re.fullmatch(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", v)
    if not m:
        return None
    order = "%d/%m/%Y" if int(m[1]) > 12 or int(m[2]) <= 12 else "%m/%d/%Y"
    try:
        return datetime.strptime(v, order).date().isoformat()
    except ValueError:
        return None


def test_random_cells_agree_with_a_plain_specification(spark):
    rng = random.Random(5)
    dates = [rng.choice(["{d}/{m}/{y}", "{y}-{m}-{d}", "{m}/{d}/{y}", "{y}/{m}/{d}", "{d}-Jan-{y}", " {d}/{m}/{y}"]).format(d=rng.randint(0, 33), m=rng.randint(0, 14), y=rng.randint(1900, 2030)) for _ in range(400)]
    assert apply(spark, dates, N.date) == [_iso(d) for d in dates]
    phones = ["".join(rng.choice("0123456789-() .+x1") for _ in range(rng.randint(8, 18))) for _ in range(400)]

    def phone(v):
        d = re.sub(r"\D", "", v)
        d = d[1:] if len(d) == 11 and d[0] == "1" else d
        return f"{d[:3]}-{d[3:6]}-{d[6:]}" if len(d) == 10 else None

    assert apply(spark, phones, N.phone) == [phone(p) for p in phones]
    numbers = [rng.choice(["{:.3f}", "{:,.2f}", "${:.1f}", "{:.0f}", "x{:.0f}"]).format(rng.uniform(-1e6, 1e7)) for _ in range(400)]

    def number(v):
        try:
            return str(round(float(v.replace(",", "").replace("$", "").strip()), 2))
        except ValueError:
            return None

    got = apply(spark, numbers, N.decimal)
    assert [g.replace("-0.0", "0.0") if g in ("-0.0",) else g for g in got] == [number(n) for n in numbers]
    names = ["".join(rng.choice("abcDEF'- éÑ1") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    assert apply(spark, names, N.name) == [re.sub("[A-Za-z]+('[A-Za-z]+)?", lambda m: m[0][0].upper() + m[0][1:].lower(), n.strip()) for n in names]
