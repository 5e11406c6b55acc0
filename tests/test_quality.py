import datetime
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gumshoe.operators import quality
from gumshoe.operators.quartiles import long_values, quartiles
from gumshoe.sources import audits, tables


def report(df):
    return quality.table_quality_report(df, "t").orderBy("ord").collect()


def kinds(rows):
    return [(r.bug_type, r.column_name, r.severity) for r in rows]


def write(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_clean_table(spark, tmp_path):
    df = tables.read_csv_table(spark, write(tmp_path, "a,b\n1,x\n2,y\n3,z\n"))
    assert kinds(report(df)) == [("No Issues", None, "info")]


def test_dirty_table_in_report_order(spark, tmp_path):
    rows = []
    for i in range(16):
        one_gap = "" if i == 3 else str(i)
        many = "NA" if i < 7 else "v"
        mixed = str(i) if i < 9 else "t"
        far = "1000" if i == 15 else str(i % 4)
        rows.append([one_gap, many, "", mixed, far])
    rows[2] = list(rows[1])
    text = "one,many,none,mixed,far\n" + "\n".join(",".join(r) for r in rows) + "\n"
    found = report(tables.read_csv_table(spark, write(tmp_path, text)))
    assert kinds(found) == [
        ("Missing Values", "one", "medium"),
        ("Missing Values", "many", "high"),
        ("Missing Values", "none", "high"),
        ("Duplicate Rows", None, "medium"),
        ("Type Mismatch", "mixed", "high"),
        ("Empty Columns", None, "low"),
        ("Data Anomaly", "far", "medium"),
    ]
    assert "6.2%" in found[0].explanation  # 6.25 rounds to the even digit
    assert all(r.line_number == 0 and r.source == "csv_analyzer" for r in found)


def test_header_only(spark, tmp_path):
    found = report(tables.read_csv_table(spark, write(tmp_path, "a,b\n")))
    assert kinds(found) == [("Empty Columns", None, "low")]
    assert found[0].explanation.endswith("a, b")


def test_ragged_rows(spark, tmp_path):
    long_row = tables.csv_report(spark, write(tmp_path, "a,b\n1,2\n1,2,3\n"), "t").collect()
    assert [(r.bug_type, r.line_number, r.severity) for r in long_row] == [("CSV Parse Error", 1, "critical")]
    short = tables.csv_report(spark, write(tmp_path, "a,b\n1,2\n3\n"), "t").collect()
    assert [(r.bug_type, r.column_name) for r in short] == [("Missing Values", "b")]


def test_csv_quotes_and_widths(spark, tmp_path):
    rows = tables.read_csv_table(spark, write(tmp_path, 'a,b\n"say ""hi"", ok",2\n"x,y",3\n')).collect()
    assert [(r.a, r.b) for r in rows] == [('say "hi", ok', 2.0), ("x,y", 3.0)]
    for text in ("a,b\n1,2,,9\n", "a,b\n3,4,,\n", "a,b\n3,4,\n"):
        assert [r.bug_type for r in tables.csv_report(spark, write(tmp_path, text), "t").collect()] == ["CSV Parse Error"]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "x"), (1.0, "x"), (-0.0, None), (0.0, None)], "`a``b.c` double, `d e` string")
    assert quality.duplicate_rows(df).first().n_duplicates == 2
    assert quality.column_quartiles(df).first().column_name == "a`b.c"
    assert quality.table_quality_report(df, "t").count() > 0


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(Exception):
        tables.read_csv_table(spark, str(tmp_path / "absent.csv"))


def test_quoted_line_breaks(spark, tmp_path):
    df = tables.read_csv_table(spark, write(tmp_path, 'a,b\n1,"x\ny"\n2,z\n'))
    assert [tuple(r) for r in df.collect()] == [(1.0, "x\ny"), (2.0, "z")]


def test_numbers_are_compared_as_numbers(spark, tmp_path):
    df = tables.read_csv_table(spark, write(tmp_path, "a\n1\n1.0\n2\n"))
    assert quality.duplicate_rows(df).first().n_duplicates == 1


def test_half_numeric_is_not_mixed(spark):
    df = spark.createDataFrame([(str(i) if i < 8 else f"t{i}",) for i in range(16)], "c string")
    assert quality.mixed_type_columns(df).count() == 0


def test_flat_column_has_no_outliers(spark):
    df = spark.createDataFrame([(1.0,)] * 20 + [(99.0,)], "c double")
    assert quality.iqr_outliers(df).count() == 0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "c double")
    assert quality.missing_values(df).first().n_missing == 2


def test_duplicates_treat_nulls_as_equal_and_read_long_texts_whole(spark):
    tail = "x" * 500
    rows = [(None, 1)] * 3 + [(tail + "a", 1), (tail + "b", 1), (tail + "a", 1), ("", 1), (None, 2)]
    got = quality.duplicate_rows(spark.createDataFrame(rows, "s string, i int")).first()
    assert (got.n_rows, got.n_duplicates) == (8, 3)


def test_outlier_rows_are_above_the_fence(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(50)] + [(500.0,), (-500.0,)], "v double")
    assert [r.v for r in quality.outlier_rows(df, "v").collect()] == [500.0]
    assert quality.iqr_outliers(df).first().n_outliers == 2


@pytest.mark.parametrize("seed", range(4))
def test_histogram_quartiles_are_exact(spark, seed):
    rnd = random.Random(seed)
    makers = [
        lambda: rnd.gauss(0, 1e6),
        lambda: float(rnd.choice([0, 0, 0, 7])),
        lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300),
        lambda: float(rnd.randrange(-50, 50)),
    ]
    n = rnd.choice([1, 2, 3, 5, 17, 100, 999])
    data = [tuple(m() for m in makers) for _ in range(n)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    both = {
        "histogram": {r.column_name: r for r in quality.column_quartiles(df).collect()},
    }
    for i, c in enumerate("abcd"):
        want = np.percentile([row[i] for row in data], [25, 75])
        for got in both.values():
            assert got[c].n == n
            assert got[c].q1 == pytest.approx(want[0], rel=1e-12) and got[c].q3 == pytest.approx(want[1], rel=1e-12)


def test_histogram_quartiles_with_a_hot_value(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 5.5).otherwise(F.col("id") * 0.1).alias("x"))
    want = np.percentile([5.5 if i % 3 == 0 else i * 0.1 for i in range(30000)], [25, 75])
    got = quartiles(long_values(df)).first()
    assert (got.q1, got.q3) == pytest.approx(tuple(want))


def test_approximate_quartiles(spark):
    got = quartiles(long_values(spark.range(1001).select(F.col("id").alias("x"))), accuracy=10000).first()
    assert (got.q1, got.q3) == (250.0, 750.0)


def test_other_types_are_left_alone(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1), True, None)], "d date, b boolean, n int")
    rows = quality.profile(df).collect()
    assert [(r.kind, r.n_missing) for r in rows] == [("other", 0), ("other", 0), ("number", 1)]


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, None)], "`a.b` double, `c d` string")
    assert kinds(report(df)) == [("Missing Values", "c d", "high")]


def test_row_keys_of_all_types(spark):
    """Rows that differ in the last digit of any type are different; equal ones are equal, however they are written."""
    shape = (
        "s string, i int, l long, d double, f float, n decimal(38,10), b boolean, y date, t timestamp, u timestamp_ntz, x binary, "
        "a array<string>, k struct<p:string,q:double>, m map<string,int>, v array<struct<z:decimal(20,2)>>"
    )
    base = {
        "s": "a", "i": 1, "l": 2**60, "d": 0.1, "f": 0.5, "n": "1234567890123456789.0000000001", "b": True, "y": "2024-01-01",
        "t": "2024-01-01 00:00:00.000001", "u": "2024-01-01 00:00:00.000001", "x": "ab", "a": ["x", None], "k": {"p": "u", "q": 1.0},
        "m": {"one": 1, "two": 2}, "v": [{"z": "1.10"}],
    }
    other = {
        "s": "a ", "i": 2, "l": 2**60 + 1, "d": 0.1 + 2e-17, "f": 0.25, "n": "1234567890123456789.0000000002", "b": False, "y": "2024-01-02",
        "t": "2024-01-01 00:00:00.000002", "u": "2024-01-01 00:00:00.000002", "x": "ac", "a": ["x", "null"], "k": {"p": "u", "q": -1.0},
        "m": {"one": 2, "two": 1}, "v": [{"z": "1.11"}],
    }

    def frame(rows):
        text = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
        parsed = text.select(F.from_json("j", shape.replace("x binary", "x string")).alias("r")).select("r.*")
        return parsed.withColumn("x", F.encode("x", "UTF-8"))

    changed = [{**base, c: other[c]} for c in base if other[c] != base[c]] + [{**base, c: None} for c in base]
    assert len(changed) == 2 * len(base)
    got = quality.duplicate_rows(frame([base, *changed])).first()
    assert (got.n_rows, got.n_duplicates) == (len(changed) + 1, 0)
    again = [{**base, "m": {"two": 2, "one": 1}}, dict(reversed(base.items()))]
    assert quality.duplicate_rows(frame([base, *again])).first().n_duplicates == 2


def test_row_keys_do_not_run_together(spark):
    rows = [("a", "bc"), ("ab", "c"), ("~", None), (None, "~"), ("1:a", ""), ("", "1:a"), ("null", None), (None, None), (None, "null")]
    assert quality.duplicate_rows(spark.createDataFrame(rows, "a string, b string")).first().n_duplicates == 0
    nan = spark.createDataFrame([(float("nan"),), (float("nan"),), (0.0,), (-0.0,), (None,)], "d double")
    assert quality.duplicate_rows(nan).first().n_duplicates == 2
    assert quality.duplicate_rows(spark.createDataFrame([(1,)], "a int").select()).first().n_rows == 1


def test_report_reads_the_table_three_times(spark, tmp_path):
    spark.range(3000).selectExpr("id", "cast(id % 7 as double) v", "cast(id as string) s").write.parquet(str(tmp_path / "t"))
    plan = quality.table_quality_report(spark.read.parquet(str(tmp_path / "t")), "t")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("FileScan") <= 3


@pytest.mark.parametrize("seed", range(3))
def test_two_read_quartiles_with_large_columns_and_infinities(spark, seed):
    rnd = np.random.default_rng(seed)
    n = 40_000
    data = {
        "a": rnd.normal(0, 1e6, n), "b": rnd.choice([0.0, 0.0, 7.0], n), "c": np.where(rnd.random(n) < 0.4, np.inf, rnd.normal(size=n)),
        "d": np.where(rnd.random(n) < 0.3, -np.inf, 5.0), "e": np.sort(rnd.exponential(1, n) ** 9), "g": np.round(rnd.normal(size=n), 1),
    }
    df = spark.createDataFrame(pd.DataFrame(data))
    got = {r.column_name: r for r in quality.column_quartiles(df).collect()}
    far = {r.column_name: r.n_outliers for r in quality.iqr_outliers(df).collect()}
    for name, values in data.items():
        with np.errstate(invalid="ignore"):
            q1, q3 = np.percentile(values, [25, 75])
        assert got[name].n == n
        if np.isfinite([q1, q3]).all():
            assert (got[name].q1, got[name].q3) == pytest.approx((q1, q3), rel=1e-12)
            iqr = q3 - q1
            want = int(((values < q1 - 3 * iqr) | (values > q3 + 3 * iqr)).sum()) if iqr > 0 else 0
            assert far.get(name, 0) == want


def test_audited_batches_equal_one_report(spark, tmp_path):
    rows = spark.range(2000).selectExpr(
        "id % 500 as a", "if(id % 3 = 0, null, cast(id % 9 as string)) as b", "cast(null as string) as c", "if(id = 7, 1e9, cast(id % 50 as double)) as d",
        "if(id % 4 = 0, 'x', cast(id % 5 as string)) as e",
    )
    parts = [rows.filter(f"a % 5 = {i}") for i in range(5)] + [rows.filter("a < 0")]  # the last one is empty
    for i, part in enumerate([*parts, parts[2]]):
        audits.audit_batch(part, str(tmp_path), str(i % 6 if i < 6 else 2))  # batch 2 is replayed
    one = quality.table_quality_report(rows, "t").orderBy("ord").collect()
    assert audits.audited_report(rows, str(tmp_path), "t").orderBy("ord").collect() == one
    assert {r.bug_type for r in one} >= {"Missing Values", "Duplicate Rows", "Type Mismatch", "Empty Columns", "Data Anomaly"}


def test_audit_without_numbers(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("a", None)], "s string, n string")
    audits.audit_batch(rows, str(tmp_path), "x")
    found = audits.audited_report(rows, str(tmp_path), "t").orderBy("ord").collect()
    assert found == quality.table_quality_report(rows, "t").orderBy("ord").collect()
