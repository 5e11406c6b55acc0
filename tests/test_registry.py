import math

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# One query of each family; the driver compares them all.
SAMPLE = [
    "table_quality_report_gappy", "quartiles_by_histogram", "intake_manifest", "document_lines", "clean_extracted_text",
    "detected_language", "js_null_reference", "js_undefined_variable", "py_undefined_variable", "page_script_risks",
    "deduped_findings", "voted_findings", "similar_history", "file_report",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v if isinstance(v, (str, bool)) else round(float(v), 6)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_spark_equals_sql(spark, duck, name):
    got = entry_module.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry_module.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() >= 1
