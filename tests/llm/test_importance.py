"""Resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gumshoe.llm import importance


def plain(docs, target, longest, buckets, percent, least, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])

    s, t = counts(d[1] for d in docs), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n_words, fs = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n_words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for rank, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = rank + 1
    return sorted(map(tuple, rows), key=str)


def test_resampled(spark):
    random = np.random.default_rng(3)
    text = lambda n: " ".join(f"W{random.integers(60)}é" for _ in range(n))
    docs = [(i, text(int(random.integers(0, 60)))) for i in range(200)] + [(9, text(40)), (9, text(40)), (None, text(30)), (None, None)]
    docs += [(500, None), (501, ""), (502, "...?"), (503, "a" * 70_000), (504, text(50_000))] + [(505, "same words again " * 9)] * 4
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, salt string, score int, weight int")
    target = [text(25) for _ in range(8)] + ["same words", None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    for longest, buckets, percent in ((1, 10_000, 10), (3, 97, 55)):
        got = importance.resampled(frame, items, longest, buckets, percent)
        want = plain(docs, target, longest, buckets, percent, importance.LEAST_WORDS, importance.SEED)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert importance.resampled(none, none).count() == 0
    assert importance.resampled(some, none, percent=100).where("rank is not null").count() == 1
    assert importance.resampled(some, some, percent=0).where(F.col("rank").isNotNull()).count() == 0


def test_portions_do_not_matter(spark, monkeypatch):
    words = [b"%d" % i for i in range(500)] * 3
    batch = importance.pa.record_batch([importance.pa.array([b" ".join(words), None, b"x y"], importance.pa.binary())], names=["text"])
    whole = [row for p in importance.portions(batch, 2) for row in zip(p[3], p[4], strict=True)]
    monkeypatch.setattr(importance, "PORTION", 1)
    assert [row for p in importance.portions(batch, 2) for row in zip(p[3], p[4], strict=True)] == whole == [(2999, 1500), (0, 0), (3, 2)]


def test_crc_matrices():
    random = np.random.default_rng(1)
    features = [random.integers(0, 256, int(n)).astype(np.uint8).tobytes() for n in random.integers(0, 50, 3000)]
    assert importance.crc32s(features).tolist() == [zlib.crc32(f) for f in features]
    assert importance.crc32s([]).tolist() == []
