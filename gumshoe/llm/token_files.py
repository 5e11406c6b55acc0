"""Token ids in Parquet list columns, laid out for reading only some documents or only the metadata.

Files hold ``doc_id, tie, n_tokens, ids`` in ascending order of (doc_id, tie); ids are dictionary encoded
(the vocabulary bounds the dictionary), everything else is written with the version 2 pages, whose
integers are delta encoded. Row groups and pages are of fixed size and carry the page index, so a filter on
doc_id reads few pages, and a read without ``ids`` reads none of them.

Nulls and ties: a null text is empty and holds only the end id; null ids come first; rows that repeat an id
are ordered by ``tie``, a hash of the text, and rows that repeat both are interchangeable. An empty table
gives no files worth reading and an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_folder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
ROWS_PER_FILE = 100_000
CACHE_WORDS = 300_000
"""Words of one generation of an encoder's memory; it holds two, and what is used moves to the younger one."""
BATCH_ROWS = 1024
_separators = regex.compile(r"[\x1c-\x1f]")
_space = regex.compile(r"[^\S\x1c-\x1f]+")
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
PLAIN = rf"^(?P<word>[{_LETTERS}]+)(?P<signs>[!-&(-/:;=>?@\[-`{{-~]*)$"
"""Latin letters, whose lower case is one letter whatever surrounds them, and signs behind them that go with no letter."""
SCHEMA = "doc_id long, tie long, n_tokens long, ids array<int>"
LAYOUT = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.columnindex.truncate.length": "64",
    "compression": "zstd",
}


class Encoder:
    """Encode texts by the words in them, with a bounded memory of words.

    The vocabularies used here drop white space and never merge across it, nor from letters to signs, and they read letters in
    lower case. So the ids of a text are those of its words and signs: these are numbered in Arrow, looked up once a batch, and put
    back in their places. New words are encoded in one go; the tokens that end a word tell them apart again.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends_word[ends] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text."""
        # Arrow and Python also split at these four signs, the tokenizer does not
        if pc.any(pc.match_substring_regex(texts, r"[\x1c-\x1f]")).as_py():
            cut = pa.array([_space.split(t) if _separators.search(t) else t.split() for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            cut = pc.utf8_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary
        parts = pc.extract_regex(pieces, PLAIN)
        words, signs = pc.struct_field(parts, "word"), pc.struct_field(parts, "signs")
        plain = pc.is_valid(parts)
        first = pc.if_else(plain, pc.utf8_lower(words), pieces)
        keys = pa.concat_arrays([first, pc.fill_null(signs, "")]).dictionary_encode()
        n = len(pieces)
        found = self._found(keys.dictionary.to_pylist(), set(keys.indices[:n].filter(plain).to_pylist()))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        ids = np.frombuffer(b"".join(found), dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))
        key, place = keys.indices.to_numpy(), coded.indices.to_numpy()
        both = np.empty(2 * len(place), dtype=np.int32)
        both[0::2], both[1::2] = key[:n][place], key[n:][place]
        placed = lists.take(pa.array(both))
        before = np.append(0, np.cumsum(placed.value_lengths().to_numpy()))
        bounds = before[2 * np.append(0, np.cumsum(cut.value_lengths().to_numpy()))]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), placed.flatten())

    def _found(self, keys: list[str], words: set[int]) -> list[bytes]:
        """The ids of each key; ``words`` are the places of those that are lower-case words."""
        found = list(map(self.known.get, keys))
        new = [i for i, f in enumerate(found) if f is None]
        if not new:
            return found
        known, older, ordered = self.known, self.older, []
        for i in new:
            key = keys[i]
            ids = older.get(key)
            if ids is not None:
                known[key] = ids
            elif i in words:
                ordered.append(key)
            else:
                known[key] = self._encode(key).tobytes()
        self._learn(ordered)
        for i in new:
            found[i] = known[keys[i]]
        if len(known) > CACHE_WORDS:
            self.known, self.older = {}, known
        return found

    def _learn(self, words: list[str]) -> None:
        known = self.known
        ids = self._encode(" ".join(words))
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
        if len(ends) != len(words):
            known.update((w, self._encode(w).tobytes()) for w in words)
            return
        data, start = ids.tobytes(), 0
        for word, end in zip(words, ends.tolist(), strict=True):
            known[word] = data[start:end]
            start = end

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker, which keeps it from task to task."""
    return Encoder(path)


def encoded(rows: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``rows (doc_id, tie, text)`` to the columns of the files, in the same order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            for part in (batch.slice(i, BATCH_ROWS) for i in range(0, batch.num_rows, BATCH_ROWS)):
                coded = encoder(pc.fill_null(part["text"], ""))
                n = coded.value_lengths().to_numpy().astype(np.int64)
                ends = np.cumsum(n)
                ids = np.insert(coded.flatten().to_numpy(), ends, end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n + 1)), pa.int32()), pa.array(ids))
                n += 1
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["tie"], pa.array(n), lists], names=["doc_id", "tie", "n_tokens", "ids"]
                )

    return rows.mapInArrow(encode, SCHEMA)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Write the files below ``path``, each a range of (doc_id, tie)."""
    files = max(1, -(-docs.count() // ROWS_PER_FILE), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    rows = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    encoded(rows, vocabulary, end_id).write.options(**LAYOUT).parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).withColumn("file", F.input_file_name())


def _placed(spark: SparkSession, path: str, rows: DataFrame, *order: str) -> DataFrame:
    """Add ``start`` to rows that carry file, tie and n_tokens: the sum inside the file and that of the files before."""
    files = (
        _files(spark, path)
        .groupBy("file")
        .agg(F.sum("n_tokens").alias("total"), F.min(F.struct("doc_id", "tie")).alias("first"))
    )
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("doc_id", "tie", *order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.withColumn("inside", inside).join(files, "file").withColumn("start", F.col("base") + F.col("inside"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens without reading ids. ``start`` counts the ids of all documents before."""
    rows = _files(spark, path).select("doc_id", "tie", "n_tokens", "file")
    return _placed(spark, path, rows).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, where=None) -> DataFrame:
    """doc_id, n_tokens, ids of the documents for which the column ``where`` over doc_id holds, or of all."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return (rows if where is None else rows.where(where)).select("doc_id", "n_tokens", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files: the checksum is of 32-bit little-endian ids."""

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            ids, ends = lists.flatten().to_numpy().astype("<u4"), np.cumsum(lists.value_lengths().to_numpy())
            sums = [zlib.crc32(x.tobytes()) for x in np.split(ids, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["file"], batch["tie"], batch["n_tokens"], pa.array(sums, pa.int64())],
                names=["doc_id", "file", "tie", "n_tokens", "ids_crc32"],
            )

    rows = _files(spark, path).mapInArrow(checksums, "doc_id long, file string, tie long, n_tokens long, ids_crc32 long")
    return _placed(spark, path, rows, "ids_crc32").select("doc_id", "start", "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write token files of ``docs`` to a new shared folder and return :func:`digests` of them."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_token_files(docs, path, vocabulary, end_id)
    return digests(spark, path)
