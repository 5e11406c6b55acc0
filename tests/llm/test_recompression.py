"""Runs against a plain search of all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gumshoe.llm import queries, recompression

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    """start, length, period of every run."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(recompression.LEAST, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return [(s, n, p) for s, p, n in sorted((s, p, n) for (s, n), p in found.items())]


def plain_collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def drawn(random):
    n, k = int(random.choice([0, 1, 11, 12, 13, 40, 150])), int(random.choice([1, 2, 3, 40]))
    w = [f"w{x}" for x in random.integers(0, k, n)]
    if n > 4 and random.random() < 0.6:
        a = int(random.integers(n))
        p = int(random.integers(1, max(2, (n - a) // 2 + 1)))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def fibonacci(least):
    a, b = ["a"], ["a", "b"]
    while len(b) < least:
        a, b = b, b + a
    return b


@pytest.mark.parametrize("portion", [1, 300, 1 << 18])
def test_runs_and_collapsed_texts(spark, monkeypatch, portion):
    monkeypatch.setattr(recompression, "PORTION", portion)
    monkeypatch.setattr(recompression, "CANDIDATES", 500 if portion == 300 else 1 << 21)
    random = np.random.default_rng(portion % 97)
    texts = [" ".join(drawn(random)) for _ in range(80)] + [" ".join(fibonacci(400)), "x " * 3000, "\tÉ\xa0é  É\xa0é\n" * 9, None, "", " \n"]
    texts += [texts[-2 - 4]] * 2 + ["one two three four five six seven. " * 40 + "end"]
    rows = [(i if i % 9 else None, t, "r", 1) for i, t in enumerate(texts)]
    got = recompression.with_runs(spark.createDataFrame(rows, "doc_id int, text string, row string, period int"))
    assert got.columns == ["doc_id", "text", "row", "period", "runs", "collapsed"]
    seen = {(r["doc_id"], r["text"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()}
    assert got.count() == len(rows)
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert seen[i, t] == (plain_runs(w), plain_collapsed(w, plain_runs(w)))


def test_extensions_of_the_grammar():
    """Every pair of places, both ways, against a comparison word by word."""
    random = np.random.default_rng(8)
    for k in (1, 2, 5):
        words = np.append(random.integers(0, k, 70), 10**6)
        words[30:60] = np.resize(words[30:37], 30)
        grammar = recompression.Grammar(words)
        x, y = np.triu_indices(70, 1)
        right, left = grammar.right(x, y), grammar.left(x, y)
        for a, b, r, n in zip(x.tolist(), y.tolist(), right.tolist(), left.tolist(), strict=True):
            i = 0
            while words[a + i] == words[b + i]:
                i += 1
            j = 0
            while a - j > 0 and words[a - j - 1] == words[b - j - 1]:
                j += 1
            assert (r, n) == (a + i, a - j)


def test_grammar_shrinks():
    assert len(recompression.Grammar(np.append(np.zeros(100_000, dtype=np.int64), 1)).top) <= 3
    text = np.append(np.random.default_rng(1).integers(0, 5000, 100_000), 10**6)
    assert len(recompression.Grammar(text).top) < 100


def test_empty_table_and_names(spark):
    none = spark.createDataFrame([], "text string, runs int")
    assert recompression.with_runs(none).columns == ["text", "runs", "collapsed"] and recompression.with_runs(none).count() == 0
    odd = spark.createDataFrame([("a", "b", 1)], "text string, `a.b` string, `collapsed` int")
    assert recompression.with_runs(odd).select(F.col("`a.b`"), "collapsed").first() == ("b", "a")


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op12_recompression_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(w) > 2500:
            continue  # the plain search takes too long
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(((-n, s, p) for s, n, p in runs), default=None)
        r = got[doc_id]
        want = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
