from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gumshoe.llm import decontamination, mixing, ngram_join, queries, store, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)  # written and read by others
        left = docs.count()
        assert name == "mixing" or 0.5 * n < left <= n
        n = left
        if name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert not decontamination.contamination(docs, items).where("contaminated").count()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


NAMES = "doc_id long, text string, lang string, source string, n_chars long, key string, score int, of_id int, copies int, _key int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, empty texts, repeats, a very long text and columns of names that stages use inside, and their tables."""
    path = tmp_path_factory.mktemp("tables")
    text = lambda i, n=40: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, text(i) + (" vilest" if i % 5 == 0 else ""), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, text(1), "en", "s0"), (101, text(2) + " end", "en", None), (3, text(3), "en", "s1"), (3, text(3), "en", "s1")]
    rows += [(200, None, None, "s0"), (201, "", "en", None), (None, text(7, 60), "en", "s1"), (None, None, None, None), (202, "...", "en", "s2")]
    rows += [(203, "start " + text(4, 30_000), "en", "s2"), (204, "before " + text(900, 14) + " after", "en", "s0")]
    docs = spark.createDataFrame([(*r, 1, "k", 2, 3, 4, 5) for r in rows], NAMES)
    docs.write.parquet(str(path / "documents.parquet"))
    labels = [(i, 1, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (200, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    items = [(1, text(900, 14)), (2, text(4, 9)), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def listed(df):
    return Counter(map(tuple, df.collect()))


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, rows = docs.columns, docs.collect()
    steps = dict(corpus_pipeline.STAGES)

    model = queries.toxicity_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = model.scorer()
    got = steps["toxicity"](spark, docs, folder)
    assert got.columns == names and listed(got) == Counter(tuple(r) for r in rows if score(r["text"]) < toxicity.THRESHOLD)
    assert not got.where("text like '%vilest%'").count() and got.where("text is null").count() == 2

    got = steps["ngram_join"](spark, docs, folder)
    grams = {(r["doc_id"], r["text"]): frozenset(map(int, ngram_join.grams_of(r["text"]))) for r in rows}
    kept = []
    for r in sorted({tuple(x) for x in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        g = grams[r[0], r[1]]
        if g and any(len(g & grams[k[0], k[1]]) >= 0.8 * len(g | grams[k[0], k[1]]) for k in kept if grams[k[0], k[1]]):
            continue
        kept.append(r)
    wordless = [tuple(r) for r in rows if not grams[r["doc_id"], r["text"]]]
    # of rows that repeat id and text any one stays
    want = Counter(r[:2] for r in [r for r in kept if grams[r[0], r[1]]] + wordless)
    assert got.columns == names and listed(got.select("doc_id", "text")) == want

    got = steps["decontamination"](spark, docs, folder)
    passages = [decontamination.words_of(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(p[i : i + 10]) for p in passages for i in range(max(1, len(p) - 9)) if p}

    def clean(text):
        w = decontamination.words_of(text)
        return not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    assert got.columns == names and listed(got) == Counter(tuple(r) for r in rows if clean(r["text"]))

    got = steps["mixing"](spark, docs, folder)
    copies = {}
    for r in mixing.mix(mixing.sizes_of(docs), seed=corpus_pipeline.MIX_SEED).collect():
        copies[r["doc_id"], r["key"]] = copies.get((r["doc_id"], r["key"]), 0) + r["copies"]
    keyed = got.withColumn("hash", F.xxhash64("text")).groupBy("doc_id", "hash").agg(F.count("*").alias("n")).collect()
    assert got.columns == names and {(r["doc_id"], r["hash"]): r["n"] for r in keyed} == {k: n for k, n in copies.items() if n}

    got = steps["token_files"](spark, docs, folder).orderBy("start").collect()
    assert len(got) == len(rows) and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert sorted(r["n_tokens"] for r in got)[:3] == [1, 1, 1]


def test_whole_run_and_empty_documents(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 30
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).collect() == [], name


def test_tables_of_a_query_outlive_a_run(spark, folder):
    """What one caller stored is not deleted by another; a run leaves its token files only."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    frame = queries.QUERIES["op2_ngram_join"](spark, folder)
    before = {p.name for p in shared.iterdir()}
    result = corpus_pipeline.run(spark, folder)
    left = {p.name for p in shared.iterdir()} - before
    assert {n.partition("-")[0] for n in left} == {"tokens"}
    assert frame.count() == spark.read.parquet(f"{folder}/documents.parquet").count() and result.count() > 30
    owner = store.Owner()
    with owner.holding():
        path = store.new_folder(spark, "mine")
        spark.range(3).write.parquet(path)
    owner.delete(spark)
    assert not Path(path).exists()
