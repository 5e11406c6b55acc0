"""Toxicity scores from a linear model that is trained to ignore which group a sentence names.

A text's features are those of its distinct words: the word itself and its beginnings of 4 to 6 letters, so that
inflected forms count. Logistic regression is trained on a bounded sample of labelled texts, each of them whole. For every
sampled text that names a group, copies are made in which the name is swapped for the other names of its set, and the squared
change of the model's log odds from text to copy is added to the loss: a name alone then cannot make a neutral sentence toxic.

A copy differs from its text by one word, so what it changes depends on the two names alone: the copies of a pair of names are
counted and their change is weighed by that count. Only features that go with the label more than chance explains are used, and
the names themselves, whatever they go with. Features are counted where the texts lie; the driver gets the chosen features, arrays of
their numbers for each sampled text, and the counts of pairs, but no texts. What a word adds is kept in one table, which the
executors look words up in. The score of a text is the logistic function of the bias and the sum over its words.

Nulls and ties: a null or empty text has no words and the score of the bias alone; labels without id or value are left out;
a document with several labels counts once for each; rows that repeat are scored alike, and learned from once. Without labels of both kinds every
score is the share of toxic labels, or 0. Texts may be of any length. Other columns of the input are passed on by
:func:`with_scores` only; one of the name of the score is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .drawing import under
from .store import stored

SAMPLE_PER_LABEL = 4000
"""Labelled texts that are learned from, for each label: those whose ids have the smallest MD5."""
THRESHOLD = 0.3
MIN_TEXTS = 4
MIN_G2 = 16.0
SWAP_WEIGHT = 1.0
RIDGE = 1e-4
STEPS = 150
CACHE_WORDS = 500_000
MOST_NAMES = 10_000
# fixed values: names of groups that may stand for one another, in English, French, German and Spanish
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "locals"),
    ("disabled", "blind", "deaf"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("musulmane", "chrétienne", "juive", "hindoue", "athée"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "étrangers"),
    ("handicapés", "aveugles", "sourds"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "atheistisch"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("schwule", "heterosexuelle", "lesben", "bisexuelle", "transgender"),
    ("einwanderer", "flüchtlinge", "einheimische"),
    ("behinderte", "blinde", "gehörlose"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
    ("musulmana", "cristiana", "judía", "hindú", "atea"),
    ("negros", "blancos", "asiáticos", "latinos"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales", "transgénero"),
    ("inmigrantes", "refugiados", "locales"),
    ("discapacitados", "ciegos", "sordos"),
)

Sets = tuple[tuple[str, ...], ...]
_words = re.compile(r"[^\W\d_]+").findall


def identity_sets(rows: DataFrame) -> Sets:
    """The sets of a table ``(set, name)`` of at most ``MOST_NAMES`` names."""
    names = rows.where("name is not null").select(F.col("set").cast("string"), F.lower("name").alias("name")).distinct()
    found: dict[str | None, list[str]] = {}
    for r in names.orderBy("set", "name").limit(MOST_NAMES + 1).collect():
        found.setdefault(r["set"], []).append(r["name"])
    if sum(map(len, found.values())) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return tuple(map(tuple, found.values()))


def words_of(text: str | None) -> set[str]:
    return set(_words((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]


def swaps_of(words: set[str], identity: Sets = IDENTITY) -> Iterator[tuple[str, str]]:
    """Name and other name of each copy of a text."""
    for names in identity:
        for name in names:
            if name in words:
                for other in names:
                    if other not in words:
                        yield name, other


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    copies: int = 0
    """How many swapped copies it was trained with."""

    def scorer(self):
        known: dict[str, float] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            if len(known) > CACHE_WORDS:
                known.clear()
            z = bias
            for word in words_of(text):
                added = known.get(word)
                if added is None:
                    added = known[word] = sum(weights.get(f, 0.0) for f in features_of(word))
                z += added
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


@dataclass
class Sample:
    """What is learned from: ``rows``, ``columns`` and ``values`` are the sparse counts of chosen features in the texts."""

    names: list[str]
    labels: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    swaps: dict[tuple[str, str], int]


def chosen(counts: DataFrame, toxic: int, neutral: int, identity: Sets = IDENTITY) -> list[str]:
    """Features of ``counts (feature, n0, n1)`` whose number of toxic texts is above chance by the likelihood ratio G2, or of names."""
    n = F.col("n0") + F.col("n1")
    part = lambda k, total: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * (toxic + neutral) / (n * total))).otherwise(0.0)
    g2 = 2 * (part("n0", neutral) + part("n1", toxic))
    # what makes a text look harmless is a matter of its length and language here, not of its meaning
    telling = (n >= MIN_TEXTS) & (g2 >= MIN_G2) & (F.col("n1") * neutral > F.col("n0") * toxic)
    names = sorted({name for names in identity for name in names})
    rows = counts.where(telling | F.col("feature").isin(*names) if names else telling).select("feature")
    return sorted(r["feature"] for r in rows.collect())


def gather(texts: DataFrame, identity: Sets = IDENTITY) -> Sample:
    """Read ``texts (toxic, draw, text)``, distinct in the first two; toxic is 0 or 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for label, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist(), strict=True):
                seen[label].update({f for w in words_of(text) for f in features_of(w)})
        features = sorted(seen[0].keys() | seen[1].keys())
        arrays = [pa.array(features, pa.string()), *(pa.array([s[f] for f in features], pa.int64()) for s in seen)]
        yield pa.RecordBatch.from_arrays(arrays, names=["feature", "n0", "n1"])

    texts = stored(texts.select("toxic", "draw", "text"), "sample")
    totals = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = texts.select("toxic", "text").mapInArrow(count, "feature string, n0 long, n1 long")
    counts = counts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    names = chosen(counts, totals.get(1, 0), totals.get(0, 0), identity)
    sent = texts.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = sent.value
        for batch in batches:
            held, swaps = [], []
            for text in batch["text"].to_pylist():
                words = words_of(text)
                found = Counter(columns[f] for w in words for f in features_of(w) if f in columns)
                held.append([x for pair in sorted(found.items()) for x in pair])
                swaps.append(["\t".join(s) for s in swaps_of(words, identity)])
            arrays = [batch["toxic"], batch["draw"], pa.array(held, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["toxic", "draw", "held", "swaps"])

    found = stored(texts.mapInArrow(look_up, "toxic int, draw string, held array<int>, swaps array<string>"), "features")
    held = found.orderBy("toxic", "draw").select("toxic", "held").toArrow()
    pairs = found.select(F.explode("swaps").alias("swap")).groupBy("swap").agg(F.count("*").alias("n")).collect()
    lists = held["held"].combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False) // 2 if held.num_rows else np.zeros(0, dtype=np.int32)
    rows = np.repeat(np.arange(held.num_rows, dtype=np.int32), lengths)
    labels = held["toxic"].to_numpy().astype(np.int64)
    return Sample(names, labels, rows, flat[::2], flat[1::2].astype(float), {tuple(r["swap"].split("\t")): r["n"] for r in pairs})


def fit(sample: Sample, swap_weight: float = SWAP_WEIGHT, share: float | None = None) -> Model:
    """``share`` is that of toxic texts where the sample comes from; the sample's own if it is not given."""
    y = sample.labels
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))), {})
    rows, cols, values = sample.rows, sample.columns, sample.values
    column = {f: i for i, f in enumerate(sample.names)}
    swaps = sorted(sample.swaps.items())
    # a copy's change: the counts of its name less those of the text's
    change = [(i, column[f], sign) for i, (pair, _) in enumerate(swaps) for sign, w in zip((-1, 1), pair, strict=True) for f in features_of(w) if f in column]
    dr, dc, dv = (np.array(x, dtype=float if k == 2 else np.int64) for k, x in enumerate(zip(*change, strict=True))) if change else (np.zeros(0, dtype=np.int64),) * 3
    copies = np.array([n for _, n in swaps], dtype=float)
    n, m, k = len(y), len(swaps), len(sample.names)
    share = float(y.mean()) if share is None else share
    w, bias = np.zeros(k), float(np.log(share / (1 - share)))
    balance = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    mw = vw = np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(rows, weights=values * w[cols], minlength=n)
        d = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * balance
        g = np.bincount(cols, weights=values * d[rows], minlength=k) + RIDGE * w
        if len(dr):
            moved = np.bincount(dr, weights=dv * w[dc], minlength=m) * copies
            g += swap_weight * 2 / copies.sum() * np.bincount(dc, weights=dv * moved[dr], minlength=k)
        g = np.append(g, d.sum())
        mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
        move = 0.15 * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.99**step)) + 1e-10)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(float(bias), {f: float(w[i]) for f, i in column.items() if w[i]}, int(copies.sum()))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(toxic, doc_id, draw, filled, n)``: the labelled documents without their texts, rows that repeat counted in ``n``."""
    marks = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
        .agg(F.count("*").alias("marks"))
        .where("toxic in (0, 1)")
    )
    filled = F.coalesce(F.length("text") > 0, F.lit(False))
    rows = docs.where("doc_id is not null").select("doc_id", _draw().alias("draw"), filled.alias("filled"))
    rows = rows.groupBy("doc_id", "draw", "filled").agg(F.count("*").alias("rows"))
    found = rows.join(marks, F.col("doc_id") == F.col("labelled"))
    return found.select("toxic", "doc_id", "draw", "filled", (F.col("rows") * F.col("marks")).alias("n"))


def _draw() -> Column:
    return F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.md5(F.coalesce("text", F.lit("")))))


def train(docs: DataFrame, labels: DataFrame, identity: Sets = IDENTITY, swap_weight: float = SWAP_WEIGHT) -> Model:
    """Learn from ``labels (doc_id, toxic)`` of ``docs (doc_id, text)``.

    The sample is drawn from digests: only the texts drawn are shuffled, whatever the table's size.
    """
    labelled = stored(_labelled(docs, labels), "labelled")
    per_label = labelled.groupBy("toxic").agg(F.sum("n").alias("n"), F.count_if("filled").alias("eligible")).collect()
    counts = {r["toxic"]: r["n"] for r in per_label}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    drawn = [
        labelled.where((F.col("toxic") == r["toxic"]) & F.col("filled") & (F.col("draw") < under(r["eligible"], SAMPLE_PER_LABEL)))
        .orderBy("draw")
        .limit(SAMPLE_PER_LABEL)
        .select("toxic", F.col("doc_id").alias("labelled"), F.col("draw").alias("drawn"))
        for r in per_label
    ]
    if not drawn:
        return Model(float(np.log(1e-6)), {})
    chosen_rows = reduce(DataFrame.unionByName, drawn)
    same = (F.col("doc_id") == F.col("labelled")) & (_draw() == F.col("drawn"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen_rows), same)  # two times SAMPLE_PER_LABEL rows
    texts = texts.groupBy("toxic", F.col("drawn").alias("draw")).agg(F.min("text").alias("text"))
    return fit(gather(texts, identity), swap_weight, share)


def with_scores(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = sent.value.scorer()
        for texts in batches:
            yield pa.array([one(t) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(column, F.arrow_udf(score_iterator(score), "double")("text"))


def score_iterator(f):
    """Type the function as Spark wants it: annotations of this module are strings."""
    f.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return f
