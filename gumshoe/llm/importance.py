"""Draw the documents that look most like a target, by importance weights of hashed word runs.

A text's features are all runs of 1 to ``longest`` words, repeats counted; a feature falls in the bucket of its CRC-32. Each
bucket's gain is the log ratio of its smoothed shares in target and raw texts, in whole thousandths; a document's weight is
the mean gain of its features, and a draw without replacement takes the highest of weight plus Gumbel noise, which is a hash of
seed and id, so that reruns agree.

CRCs are made for the distinct features of some documents at once: features of equal length are the rows of one matrix of
bytes, the CRCs of all rows advance together, one column of the matrix at a time, and the buckets are scattered back to the
places of the features.

Words: A-Z is lower-cased, words are the runs of UTF-8 bytes that are 0-9, a-z or not ASCII. Both passes read the texts where
they lie; between them only counts of buckets are shuffled. The draw finds the lowest score from a count per score and sorts only
rows that reach it, in ranges.

Nulls and ties: a null or empty text has no features and weight 0; a null id draws its noise as the empty id; equal scores are
drawn in the order of their ids, nulls last, and rows that repeat an id by number of features, then weight; rows that repeat all
of these are interchangeable. A text may be of any length: features are handled in portions of a bounded number. Empty tables
give an empty result, or gains that only smoothing makes. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
PORTION = 1 << 20
_INDEX_BITS = 33  # of monotonically_increasing_id, below the partition


def _folding() -> bytes:
    """What each byte becomes: lower case, or a space if it is in no word."""
    word = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    return bytes(b if b in word else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_FOLD, _CRC = _folding(), _crc_table()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def features_of(words: list[bytes], longest: int) -> list[bytes]:
    out = list(words)
    for n in range(2, longest + 1):
        out.extend(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return out


def crc32s(features: list[bytes]) -> np.ndarray:
    """The CRC-32 of each feature, from one byte matrix for each length."""
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    joined = np.frombuffer(b"".join([features[i] for i in order.tolist()]), dtype=np.uint8)
    out = np.zeros(len(features), dtype=np.uint32)
    row = byte = 0
    for length, n in zip(*np.unique(lengths, return_counts=True), strict=True):
        columns = np.ascontiguousarray(joined[byte : byte + n * length].reshape(n, length).T)
        crc = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
        for column in columns:
            crc = _CRC[(crc ^ column) & 0xFF] ^ crc >> 8
        out[order[row : row + n]] = ~crc
        row, byte = row + n, byte + n * length
    return out


def buckets_of(features: list[bytes], buckets: int) -> np.ndarray:
    """The bucket of each feature; a feature that repeats is hashed once."""
    distinct = list(set(features))
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    places = np.fromiter(map(number.__getitem__, features), np.int64, len(features))
    return (crc32s(distinct) % np.uint32(buckets)).astype(np.int64)[places]


def portions(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[int, int, list[bytes], list[int], list[int]]]:
    """Runs of rows with about ``PORTION`` features: first row, row behind the last, features, their number and that of words."""
    first, features, n_features, n_words = 0, [], [], []
    for row, text in enumerate(batch["text"]):
        words = words_of(text.as_py())
        features += features_of(words, longest) if longest > 1 else words
        n_words.append(len(words))
        n_features.append(sum(max(0, len(words) - n) for n in range(longest)))
        if len(features) >= PORTION or row == batch.num_rows - 1:
            yield first, row + 1, features, n_features, n_words
            first, features, n_features, n_words = row + 1, [], [], []


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds; one sum for each task and bucket is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, features, _, _ in portions(batch, longest):
                total += np.bincount(buckets_of(features, buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's shares, one feature added to each bucket."""
    raw, target = raw.astype(float), target.astype(float)
    ratio = (target + 1) * (raw.sum() + len(raw)) / ((raw + 1) * (target.sum() + len(raw)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for first, end, features, n_features, n_words in portions(batch, longest):
                n = np.array(n_features, dtype=np.int64)
                running = np.concatenate([[0], np.cumsum(gain[buckets_of(features, len(gain))])])
                ends = np.cumsum(n)
                total = running[ends] - running[ends - n]
                arrays = [pa.array(n_words, pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, end - first), *arrays], names=["doc_id", "n_words", "n_features", "weight"]
                )

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(weigh, f"doc_id {id_type}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, from the first 32 bits of a digest of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` to ``scored (doc_id, n_words, n_features, weight, score)``: 1, 2, 3... of the drawn rows, else null.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred are drawn, the highest scores first.
    """
    scored = stored(scored.withColumn("salt", F.monotonically_increasing_id()), "scores")
    may = F.col("n_words") >= least_words
    wanted = percent * scored.where(may).count() // 100
    per_score = scored.where(may).groupBy("score").agg(F.count("*").alias("n"))  # whole numbers of a narrow range
    reached = F.sum("n").over(Window.orderBy(F.col("score").desc()))
    lowest = per_score.withColumn("reached", reached).where(F.col("reached") >= max(1, wanted)).agg(F.max("score")).first()[0]
    if not wanted or lowest is None:
        return scored.drop("salt").withColumn("rank", F.lit(None).cast("long"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("salt")]
    high = may & (F.col("score") >= lowest)
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scored.where(high).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("at", _INDEX_BITS).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = ranged.groupBy(part).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("at").bitwiseAND((1 << _INDEX_BITS) - 1) + 1
    ranked = ranged.withColumn("part", part).join(bases, "part").withColumn("rank", F.when(rank <= wanted, rank))
    rest = scored.where(~high).withColumn("rank", F.lit(None).cast("long"))
    columns = [*(c for c in scored.columns if c != "salt"), "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of ``docs (doc_id, text)`` for ``target (text)``."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(scored, percent, least_words)
