"""The operators as queries over the driver's tables, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    decontamination,
    embedding_neighbours,
    html_extraction,
    importance,
    language_id,
    mixing,
    ngram_join,
    recompression,
    suffix_dedup,
    token_files,
    toxicity,
    warc,
)
from .store import table

MIX_SEED = "mix 1"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


ORACLES["op1_decontamination"] = r"""
WITH item AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, w[s:s + 9] AS p FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s)
  WHERE len(w) > 0),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (SELECT r, len(w) AS n, unnest(range(1, len(w) + 1)) AS s, w FROM doc),
lengths AS (SELECT DISTINCT len(p) AS k FROM phrase),
hit AS (
  SELECT r, s, k, item_id FROM (SELECT r, s, k, w[s:s + k - 1] AS p FROM place, lengths WHERE s + k - 1 <= n) JOIN phrase USING (p)),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS x FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"), vocabulary())


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed is that of the SQL too: both engines draw the same offset for each source."""
    sizes = mixing.sizes_of(table(spark, sf_dir, "documents"))
    return mixing.mix(sizes, seed=MIX_SEED).drop("copies", "source", "key", "place")


ORACLES["op10_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS lim,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN level * weight >= lim THEN lim
    ELSE max(CASE WHEN level * weight < lim THEN level END) OVER () * weight END AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{MIX_SEED}:' || coalesce(d.source, '')), 1, 12))::UBIGINT::DOUBLE / 281474976710656::DOUBLE AS drawn,
    row_number() OVER (PARTITION BY d.source ORDER BY floor(sqrt(size)), md5(coalesce(doc_id::VARCHAR, '')),
      doc_id NULLS FIRST, size) AS place
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(place * rate + drawn) - floor((place - 1) * rate + drawn)))::BIGINT AS taken FROM placed
"""


def _crc(doc_id: str, by: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learn from all labelled rows but those that are held out."""
    return toxicity.train(docs.where(_crc("doc_id", 4) != 2), labels)


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_model(docs, labels)
    scored = toxicity.with_scores(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id",
        F.coalesce(_crc("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language_id.train(docs.where(_crc("doc_id", 3) != 1))
    return language_id.identify(docs, network).select(
        "doc_id", F.coalesce(_crc("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@query
def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are made of the pages; the date is a constant, as the table has none."""
    return warc.derivatives(warc.responses_of(table(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes_of(table(spark, sf_dir, "documents")).drop("key")


@query
def op8_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neighbours.neighbours(table(spark, sf_dir, "embeddings"))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


ORACLES["op8_embedding_neighbours"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, link.b FROM reach r JOIN link ON r.b = link.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(vec_id = component_id, true) AS kept
FROM embeddings LEFT JOIN links ON vec_id = links.a LEFT JOIN least ON vec_id = least.a
"""

ORACLES["op2_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
gram AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(s) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c >= 0.8::DOUBLE * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, link.b FROM reach r JOIN link ON r.b = link.a),
least AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(class_id = doc_id, true) AS kept
FROM documents LEFT JOIN least ON doc_id = least.a LEFT JOIN links ON doc_id = links.a
"""


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


ORACLES["op11_importance"] = r"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) ORDER BY i) AS step FROM range(256) r(i)),
text AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
worded AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM text),
used AS (SELECT side, r, unnest(w) AS f FROM worded),
bytes AS (
  SELECT f, list_transform(range(1, 2 * octet_length(encode(f)), 2), lambda k: ('0x' || substr(hex(encode(f)), k, 2))::UBIGINT) AS b
  FROM (SELECT DISTINCT f FROM used)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(step[(xor(c, x) % 256 + 1)::BIGINT], c // 256)),
    4294967295::UBIGINT) % 10000 AS bucket FROM bytes, crc),
per AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM used JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS gain FROM per),
mean AS (
  SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM used JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN mean USING (r) WHERE side = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
    10 * (count(*) FILTER (n_features >= 20) OVER ()) // 100 AS wanted FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= wanted THEN place END AS rank FROM placed
"""


def _planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in every tenth document by CRC-32 the words from a drawn place on repeat a drawn period."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(crc % 10 == 0, F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(mixing.WORD), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(crc / 10).alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))
    rest = F.col("n") - F.col("a")
    period = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(F.flatten(period), F.lit(1), rest)), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query
def op12_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.with_runs(_planted_periods(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"], r["period"])))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = -F.col("best.minus"), F.col("best.period")
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the table are one layout, the added conversation is another; what is returned is read from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", chat.record_of("turn", "role", "text").alias("record"))
    added = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'
    one = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.parse_json(F.lit(added)).alias("record"))
    done = chat.formatted(chat.canonical_turns(rows.unionByName(one)))
    turns, learned = chat.read_turns(F.col("formatted")), chat.learned_texts(F.col("formatted"), F.col("loss"))
    done = done.select("conv_id", "formatted", turns.alias("turns"), F.array_join(learned, "").alias("learned"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op13_chat_format"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
body AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*/?(?:(?:INST|SYS|ANS|ROLE|AS)\]|s>))', '\1\\\2', 'g'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10
      ELSE 21 + length(regexp_replace(role, '([\[<])(\\*/?(?:(?:INST|SYS|ANS|ROLE|AS)\]|s>))', '\1\\\2', 'g')) END AS n FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n))::BIGINT AS formatted_chars
FROM body GROUP BY conv_id
"""
