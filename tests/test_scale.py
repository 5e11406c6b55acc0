"""What keeps tasks and workers small, whatever the size of the tables."""

import hashlib
import os
import re
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from gumshoe.functions import text
from gumshoe.lineage import keep
from gumshoe.operators import code_scan, js_scan, lookups, python_scan, voting
from gumshoe.operators.vectors import best_of_block
from gumshoe.plans import corpus, registry, rescan
from gumshoe.sources import history


def test_files_of_one_row_group_are_dealt_out(spark, tmp_path):
    orders = spark.range(8000).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus")
    )
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    files = corpus.code_files(spark, str(tmp_path))
    rows = files.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 1500
    assert files.select("file_id").distinct().count() == 8000


def test_kept_rows_are_compressed_and_equal(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.repeat(F.lit("a long sentence "), 20).alias("text"), F.lit(None).cast("int").alias("gap"))
    before = {p for p in spark_files(spark)}
    kept = keep(rows)
    size = sum(os.path.getsize(p) for p in set(spark_files(spark)) - before)
    assert size < 1_000_000
    assert kept.schema.simpleString() == rows.schema.simpleString()
    assert kept.exceptAll(rows).count() == 0 and kept.count() == 20_000


def spark_files(spark):
    top = spark.conf.get("spark.checkpoint.dir")
    return [os.path.join(at, f) for at, _, names in os.walk(top) for f in names]


def test_a_block_holds_few_scores_at_a_time():
    random = np.random.default_rng(1)
    vectors = list(random.normal(size=(2048, 8)))
    left = pd.DataFrame({"asked_id": np.arange(2048), "l_vector": vectors})
    right = pd.DataFrame({"vec_id": np.arange(2048), "r_vector": vectors})
    tracemalloc.start()
    best = best_of_block(3, 0.3, 6)((), left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # all scores at once, with their copies: over 100 MB
    unit = np.stack(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    for q in (0, 700, 2047):
        order = np.lexsort((np.arange(2048), -scores[q]))[:3]
        assert best[best["query_id"] == q]["vec_id"].tolist() == [i for i in order if scores[q][i] > 0.3]


def test_many_unknown_names_are_found_as_few_are(spark, files):
    n = lookups.FEW + 6
    names = [f"zz{i}" for i in range(n)]
    js = "\n".join(["let known = 1;", "known zz0;", *[f"known {x} known;" for x in names]])
    py = "\n".join(["def known(a):", *[f"    a + {x}" for x in names]])
    few_js, few_py = "\n".join(js.split("\n")[:5]), "\n".join(py.split("\n")[:4])
    given = files(("javascript", js), ("python", py), ("javascript", few_js), ("python", few_py))
    hits = js_scan.js_hits(given).filter("type = 'undefined_variable'").select("file_id", "line", "variable")
    risks = python_scan.python_risks(python_scan.parse_python(given)).filter("type = 'undefined_variable'").select("file_id", "line", "variable")
    found = sorted(tuple(r) for r in hits.unionByName(risks).collect())
    wanted = [("f0", 2, "zz0"), *[("f0", i + 3, x) for i, x in enumerate(names)], *[("f1", i + 2, x) for i, x in enumerate(names)]]
    wanted += [("f2", 2, "zz0"), ("f2", 3, "zz0"), ("f2", 4, "zz1"), ("f2", 5, "zz2"), *[("f3", i + 2, x) for i, x in enumerate(names[:3])]]
    assert found == sorted(wanted)


def orders(spark, path, n):
    rows = spark.range(n).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus")
    )
    rows.write.parquet(f"{path}/orders.parquet")
    return str(path)


def exchanges(df):
    """What each shuffle of a plan deals rows out by, and the number of sorts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange (\w+\([^\n]*?)\), [A-Z]", plan)], len(re.findall(r"[- ]Sort \[", plan))


def test_hits_are_sorted_once_to_drop_repeats(spark, files):
    placed, sorts = exchanges(code_scan.candidate_findings(files(("javascript", "eval(x);"), ("python", "x = 1 / y"))))
    assert [p for p in placed if "file_id" in p] == ["hashpartitioning(file_id, 4"] and sorts == 1


def test_findings_stay_in_place_for_their_language(spark, tmp_path):
    frame = registry._with_language(spark, orders(spark, tmp_path, 200))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed, _ = exchanges(frame)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("ENSURE" in p or "file_id, 4" in p for p in placed) == 2  # the hits and the languages, each once


def vote_inputs(spark):
    found = [("f0", 1, "Division by Zero"), ("f0", 1, "Bare Except"), ("f0", 2, "Division by Zero"), ("f0", None, "Bare Except"), ("f0", 3, None),
             (None, 1, "Bare Except"), ("f1", 1, "Other"), ("f1", 0, "Bare Except"), ("f0", 1, "Bare Except")]
    said = [("f0", "a", 0, 0, 1.0, "except", "line", "x"), ("f0", "a", 0, 1, 7.0, "division", "type", ""), ("f0", "b", 1, 0, 1.5, None, "all", None),
            ("f0", "b", 1, 1, 2.0, "odd", "second", ""), (None, "a", 0, 0, 1.0, "bare", "no file", ""), ("f1", "c", 2, 0, 1e300, "zzz", "far", ""),
            ("f1", "c", 2, 1, 1.0, "zzz", "", "fix"), ("f1", "a", 0, 0, None, "BARE EXCEPT!", "", "")]
    findings = spark.createDataFrame(found, "file_id string, line_number int, bug_type string")
    verdicts = spark.createDataFrame(
        said, "file_id string, model string, model_ord int, ord int, line_number double, bug_type string, explanation string, suggested_fix string"
    )
    return found, said, findings, verdicts


def first_votes(found, said):
    """Each model's first verdict on a key, finding by finding and verdict by verdict."""
    out = {}
    for key in {f for f in found if f[0] is not None}:
        for v in sorted((v for v in said if v[0] == key[0]), key=lambda v: v[3]):
            mine, theirs = key[2] and key[2].lower(), (v[5] or "").lower()
            if (key[1] is not None and v[4] == key[1]) or (mine is not None and (mine in theirs or theirs in mine)):
                out.setdefault((*key, v[1]), v)
    return out


def test_votes_are_those_of_comparing_every_pair(spark):
    found, said, findings, verdicts = vote_inputs(spark)
    wanted = first_votes(found, said)
    rows = voting.first_match_per_model(findings, verdicts).collect()
    assert sorted((r[:4], r.ord, r.v_explanation) for r in rows if None not in r[:3]) == sorted(
        (k, v[3], v[6]) for k, v in wanted.items() if None not in k
    )
    assert len(rows) == len(wanted)
    counts = {tuple(r[:3]): r.votes for r in voting.count_votes(findings, verdicts).collect()}
    assert counts == {k: sum(w[:3] == k for w in wanted) for k in {w[:3] for w in wanted}}
    runs = spark.createDataFrame([("f0", "a", "ok", ""), ("f0", "b", "ok", ""), ("f1", "c", "ok", "")], "file_id string, model string, status string, response string")
    whole = findings.select("*", F.lit("e").alias("explanation"), F.lit("s").alias("suggested_fix"))
    plain = voting.decide(whole, voting.count_votes(findings, verdicts), voting.models_asked(runs))
    voted = voting.vote(whole, runs, verdicts)
    assert voted.columns == plain.columns and voted.exceptAll(plain).count() == plain.exceptAll(voted).count() == 0


def test_findings_move_once_for_the_votes(spark):
    _, _, findings, verdicts = vote_inputs(spark)
    whole = findings.select("*", F.lit("e").alias("explanation"), F.lit("s").alias("suggested_fix"))
    runs = verdicts.select("file_id", "model", F.lit("ok").alias("status"), F.lit("").alias("response"))
    placed, _ = exchanges(voting.vote(whole, runs, verdicts))
    assert placed and not [p for p in placed if "line_number, bug_type" in p or "key" in p]


def test_lines_are_trimmed_and_breaks_found_once(spark, tmp_path):
    path = orders(spark, tmp_path, 200)
    for name in ("identifiers", "code_lines", "lines_without_strings"):
        plan = registry.QUERIES[name](spark, path)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("StartsWith(text#") == 3 and len(re.findall(r"(?<![a-z])trim\(text#", plan)) == 1
        assert plan.count("RLIKE(content#") == 1


def test_risks_are_scanned_and_sorted_once_to_drop_repeats(spark, tmp_path):
    frame = registry.QUERIES["deduped_risks"](spark, orders(spark, tmp_path, 200))
    placed, sorts = exchanges(frame)
    assert [p for p in placed if "file_id" in p] == ["hashpartitioning(file_id, 4"] and sorts == 1
    assert "MapInArrow" not in frame._jdf.queryExecution().executedPlan().toString()  # what the three parts read is scanned already
    scanned = code_scan.scan(corpus.code_files(spark, str(tmp_path))).risks.select("file_id", "line", "type", "message")
    assert frame.exceptAll(scanned).count() == scanned.exceptAll(frame).count() == 0


def test_names_that_are_listed_need_no_definitions(spark, files, monkeypatch):
    js = "function f(a, b) {\nif (a) {\nb.x; a.y;\nf(null); g(null);\nzz = a.q + yy;\n\n\n\n\na.late;\n}\nlet c = (d) + zz;\nc = ww;"
    py = "import os\ndef f(a, b=0):\n    c = a / zz + yy\n    return f(0, c) + os + zz\nzz\n"
    given = files(("javascript", js), ("typescript", ""), ("python", py), ("python", "x ="), ("javascript", None), ("python", None))
    rows = lambda: sorted(map(str, code_scan.candidate_findings(given).collect()))
    found = rows()
    assert sum("Undefined" in r for r in found) >= 4 and any("Null Ref" in r for r in found) and any("Null Arg" in r for r in found)
    monkeypatch.setattr(lookups, "FEW", -1)  # every name is looked up by sorting
    assert rows() == found
    monkeypatch.undo()
    frame = spark.range(1).select(F.array(lookups.use("any", F.lit("b"), F.lit(2)), lookups.use("function", F.lit("a"), F.lit(1))).alias("e"))
    for listed, lines in ((True, [1, 2]), (False, [2])):  # without a definition the function does not count
        assert [x["line"] for x in lookups.resolved(frame, "e", ["any"], F.lit(listed)).first()["e"]] == lines


def test_history_is_written_without_a_sort_by_language(spark, tmp_path, monkeypatch):
    seen, name, parquet = [], "spark.sql.maxConcurrentOutputFileWriters", DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(spark.conf.get(name)), parquet(self, *a, **k))[1])
    before = spark.conf.get(name)
    rows = [(f"f{i}", i, "Division by Zero", "e", "i", "high", "s", ("python", "java", None)[i % 3]) for i in range(30)]
    names = "file_id string, line_number int, bug_type string, explanation string, impact string, severity string, suggested_fix string, language string"
    history.append_history(spark.createDataFrame(rows, names).coalesce(1), str(tmp_path), "b")
    assert seen == [str(history.OPEN_FILES)] and spark.conf.get(name) == before
    assert len(list(tmp_path.glob("batch=b/language=*/*.parquet"))) == 3 and history.read_history(spark, str(tmp_path)).count() == 30


def test_numbers_of_a_text_are_the_bytes_of_its_digest(spark):
    for bits in (256, 384):
        rows = spark.range(200).select(F.col("id").cast("string").alias("c")).select("c", text.hash_embedding(F.col("c"), bits).alias("v"))
        for r in rows.collect():
            assert r.v == [(b - 128) / 128 for b in hashlib.new(f"sha{bits}", r.c.encode()).digest()]


def test_a_scan_of_changes_leaves_no_contents_and_moves_none(spark, tmp_path):
    before = set(spark_files(spark))
    files = corpus.code_files(spark, orders(spark, tmp_path, 9000))
    rescan.rescan(files.filter("file_id < 'f5'"), str(tmp_path / "store"), "1")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed, _ = exchanges(rescan.changed_files(files, str(tmp_path / "store"), "2"))
        assert not [p for p in placed if "digest" in p]  # contents stay where they were dealt out, by file
        found = rescan.rescan(files, str(tmp_path / "store"), "2")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [p for p in set(spark_files(spark)) - before if "/kept-" in p]
    whole = code_scan.candidate_findings(files)
    assert sorted(found.columns) == sorted(whole.columns)
    assert found.select(whole.columns).exceptAll(whole).count() == whole.exceptAll(found.select(whole.columns)).count() == 0
