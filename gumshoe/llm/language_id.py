"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's maximum in the window is
kept (max pooling), and a linear layer with softmax gives the languages. Trained in numpy by Adam on the driver, on
windows drawn from anywhere in a bounded sample of labelled documents; applied to all windows of every whole text on the executors. The score of a
language is its mean probability over the windows, weighted by their bytes.

Applying the network needs no multiplication: embedding and filter taps are first combined into tables that hold, for
each pair of neighbouring bytes, what the pair adds to each filter.

Nulls and ties: a null text, or one without a letter, is ``und`` with score 0; equal scores go to the language that sorts
first; rows without text or language are not learned from; rows that repeat are separate rows. Without any labelled row
every text is ``und``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .drawing import under

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIMENSIONS = 8
STEPS_PER_UNIT = 1024
"""The tables hold whole multiples of one part of so many."""
SAMPLE_PER_LANGUAGE = 600
"""Documents that are learned from, for each language: those whose ids have the smallest MD5."""
WINDOWS_PER_DOCUMENT = 2
MOST_LANGUAGES = 200
"""Labels that are learned, those with most documents: mistyped ones do not add up without end."""
EPOCHS = 6
BATCH = 64
UND = "und"
_letter = regex.compile(r"\p{L}")


def windows_of(data: bytes) -> np.ndarray:
    """All bytes in rows of ``WINDOW``; the last row is filled with zeros, which no text holds in practice."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embedding": random.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32)}
        for w in WIDTHS:
            scale = 1 / np.sqrt(w * DIMENSIONS)
            self.p[f"filter{w}"] = random.normal(0, scale, (w * DIMENSIONS, FILTERS)).astype(np.float32)
            self.p[f"bias{w}"] = np.zeros(FILTERS, dtype=np.float32)
        self.p["out"] = random.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.p["out_bias"] = np.zeros(len(languages), dtype=np.float32)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over windows ``x`` with languages ``y``."""
        p, n = self.p, len(x)
        e = p["embedding"][x]
        pooled, saved = [], []
        for w in WIDTHS:
            spans = np.concatenate([e[:, i : WINDOW - w + 1 + i] for i in range(w)], axis=2)
            z = spans @ p[f"filter{w}"]
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + p[f"bias{w}"]
            pooled.append(np.maximum(top, 0))
            saved.append((w, spans, at, top > 0))
        h = np.concatenate(pooled, axis=1)
        d = softmax(h @ p["out"] + p["out_bias"])
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "out_bias": d.sum(axis=0), "embedding": np.zeros_like(p["embedding"])}
        dh = d @ p["out"].T
        rows = np.arange(n)[:, None]
        for k, (w, spans, at, on) in enumerate(saved):
            dz = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
            g[f"bias{w}"] = dz.sum(axis=0)
            picked = spans[rows, at]  # window, filter, taps
            g[f"filter{w}"] = np.einsum("nft,nf->tf", picked, dz)
            back = dz[:, :, None] * p[f"filter{w}"].T[None]
            for i in range(w):
                np.add.at(g["embedding"], x[rows, at + i], back[:, :, i * DIMENSIONS : (i + 1) * DIMENSIONS])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11, rate: float = 0.01) -> Network:
        random = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = random.permutation(len(x))
            for i in range(0, len(x), BATCH):
                step += 1
                for k, g in self.gradient(x[order[i : i + BATCH]], y[order[i : i + BATCH]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def tables(self) -> list[np.ndarray]:
        """What each pair of bytes adds to the filters, side by side, at taps 0 and 1 and at taps 2 and 3."""
        out = []
        for first in range(0, max(WIDTHS), 2):
            parts = []
            for w in (w for w in WIDTHS if w > first):
                taps = [self.p["embedding"] @ f for f in self.p[f"filter{w}"].reshape(w, DIMENSIONS, FILTERS)]
                other = taps[first + 1] if first + 1 < w else np.zeros_like(taps[0])
                parts.append((taps[first][:, None] + other[None]).reshape(-1, FILTERS))
            rounded = np.clip(np.rint(np.concatenate(parts, axis=1) * STEPS_PER_UNIT), -16_000, 16_000)
            out.append(np.ascontiguousarray(rounded, dtype=np.int16))
        return out

    def predict(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the languages for each window."""
        x = np.ascontiguousarray(x.T).astype(np.int32)  # places first: their maximum is then over whole rows
        # the pair at a window's last byte counts for widths that end there
        pair = x << 8 | np.concatenate([x[1:], np.zeros_like(x[:1])])
        begin = tables[0].take(pair[:-1], axis=0, mode="clip")
        rest = tables[1].take(pair[2:], axis=0, mode="clip")
        pooled, later = [], 0
        for k, w in enumerate(WIDTHS):
            spans = WINDOW - w + 1
            z = begin[:spans, :, k * FILTERS : (k + 1) * FILTERS]
            if w > 2:
                z = z + rest[:spans, :, later : later + FILTERS]
                later += FILTERS
            pooled.append(np.maximum(z.max(axis=0) / np.float32(STEPS_PER_UNIT) + self.p[f"bias{w}"], 0))
        return softmax(np.concatenate(pooled, axis=1) @ self.p["out"] + self.p["out_bias"])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _drawn_windows(data: bytes, draw: str) -> list[bytes]:
    """Windows at places that the digest draws, and a short beginning alone, so that short texts are known too."""
    n, number = max(1, -(-len(data) // WINDOW)), int(draw, 16)
    found = []
    for _ in range(min(n, WINDOWS_PER_DOCUMENT)):
        number, at = divmod(number, n)
        found.append(data[at * WINDOW : (at + 1) * WINDOW])
    return [*dict.fromkeys(found), data[: 16 + number % 48]]


def _sample(labelled: DataFrame) -> DataFrame:
    """``(lang, draw, windows)`` of the documents that are learned from; texts stay on the executors."""
    draw = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text")))
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", draw.alias("draw"))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES).collect()
    if not most:
        return rows.select("lang", "draw", F.array(F.lit(b"")).alias("windows")).limit(0)
    bounds = F.create_map(*[F.lit(x) for r in most for x in (r["lang"], under(r["n"], SAMPLE_PER_LANGUAGE))])
    few = rows.where(F.col("draw") < bounds[F.col("lang")]).select("lang", "draw").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    few = few.withColumn("place", place).where(F.col("place") <= SAMPLE_PER_LANGUAGE)
    few = few.select(F.col("lang").alias("of"), F.col("draw").alias("drawn"))  # at most MOST_LANGUAGES times SAMPLE_PER_LANGUAGE
    texts = rows.join(F.broadcast(few), (F.col("lang") == F.col("of")) & (F.col("draw") == F.col("drawn")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["text"].to_pylist(), batch["draw"].to_pylist(), strict=True)
            windows = [_drawn_windows(t.encode("utf-8", "surrogatepass"), d) if _letter.search(t) else [] for t, d in rows]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["draw"], pa.array(windows, pa.list_(pa.binary()))], names=["lang", "draw", "windows"])

    found = texts.select("lang", "draw", "text").mapInArrow(cut, "lang string, draw string, windows array<binary>")
    return found.where(F.size("windows") > 0).dropDuplicates(["lang", "draw"])


def train(labelled: DataFrame) -> Network | None:
    """Learn from ``labelled (doc_id, text, lang)``; None without rows."""
    sample = sorted(_sample(labelled).collect(), key=lambda r: (r["lang"], r["draw"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return None
    x = np.concatenate([windows_of(w)[:1] for r in sample for w in r["windows"]])
    y = np.array([languages.index(r["lang"]) for r in sample for _ in r["windows"]])
    return Network(languages).train(x, y)


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs (doc_id, text)`` to doc_id, lang_pred, score."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else []
        for batch in batches:
            labels, scores = [], []
            for texts in (batch["text"].slice(i, 64).to_pylist() for i in range(0, batch.num_rows, 64)):
                known = [i for i, t in enumerate(texts) if network and t and _letter.search(t)]
                found = dict(zip(known, _scores([texts[i] for i in known], network, tables), strict=True))
                labels += [found.get(i, (UND, 0.0))[0] for i in range(len(texts))]
                scores += [found.get(i, (UND, 0.0))[1] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def _scores(texts: list[str], network: Network, tables: list) -> list[tuple[str, float]]:
    if not texts:
        return []
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    parts = [windows_of(d) for d in data]
    weights = [np.minimum(WINDOW, len(d) - WINDOW * np.arange(len(w))) for d, w in zip(data, parts, strict=True)]
    x = np.concatenate(parts)
    p = np.concatenate([network.predict(x[i : i + 128], tables) for i in range(0, len(x), 128)])
    p *= np.concatenate(weights)[:, None]
    ends = np.cumsum([len(w) for w in parts])
    p = np.add.reduceat(p, np.concatenate([[0], ends[:-1]]), axis=0) / np.array([w.sum() for w in weights])[:, None]
    best = p.argmax(axis=1)
    return [(network.languages[b], min(1.0, float(p[i, b]))) for i, b in enumerate(best)]
