"""The corpus queries by name, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from cutline.llm import bpe, chat, decontaminate, hard_negatives, near_duplicates, passages, pieces, quality_rules, rule_ensemble, spelling, token_files, toxicity, warc
from cutline.llm.frames import remainder, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_RULE_VALUES = {
    "symbols": "n_symbols / nullif(word_chars, 0)", "punctuation": "n_punctuation / nullif(word_chars, 0)", "capitals": "n_upper / nullif(word_chars, 0)",
    "repeats": "n_repeat_words / nullif(n_words, 0)", "lines": "n_dup_lines / nullif(n_lines, 0)", "length": "(word_chars / nullif(n_words, 0)) / 40"}


@register("op8_quality_rules", f"""
WITH w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
li AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(li.n - li.u, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(li.n, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!-/:-@\\[-`{{-~]', '', 'g')) AS n_punctuation
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN li USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS ({" UNION ALL ".join(f"SELECT doc_id, lang, base_failed, '{r}' AS rule, CAST(ceil(least(1.0, coalesce({x}, 0.0)) * 200) AS INTEGER) AS step FROM b" for r, x in _RULE_VALUES.items())}),
k AS (SELECT lang, rule, step, count(*) FILTER (y = 1) AS good, count(*) FILTER (y = 0) AS bad
  FROM v JOIN (SELECT doc_id, max(quality) AS y FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
c AS (SELECT k.lang, k.rule, cut, sum(good) AS n, coalesce(sum(good) FILTER (step > cut), 0) AS lost, coalesce(sum(bad) FILTER (step > cut), 0) AS caught
  FROM k, range(200) t(cut) GROUP BY ALL),
p AS (SELECT *, n > 0 AND lost <= 0.05 / 6 * n AND
  CASE WHEN lost >= n THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(least(lost, 0.05 / 6 * n) AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05 / 6) + (n - i) * ln(1 - 0.05 / 6)))) END
  <= 0.05 / (6 * (SELECT count(*) FROM (SELECT DISTINCT lang FROM k))) AS ok FROM c),
q AS (SELECT lang, rule, cut FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY cut DESC ROWS UNBOUNDED PRECEDING) AS certified FROM p)
  WHERE certified AND caught - 20 * lost > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY caught - 20 * lost DESC, cut DESC) = 1),
r AS (SELECT doc_id, bool_or(v.step > q.cut) AS broken FROM v JOIN q ON q.rule = v.rule AND q.lang IS NOT DISTINCT FROM v.lang GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(broken, false) AS kept FROM b LEFT JOIN r USING (doc_id)""")
def quality_rule_verdicts(spark: SparkSession, path: str) -> DataFrame:
    found = quality_rules.judged(table(spark, path, "documents"), table(spark, path, "labels"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, path: str) -> DataFrame:
    return corpus_pipeline.run(spark, path)


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@register("op3_decontamination", f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN sizes ON len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, s, n, item_id FROM dw JOIN iw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def decontamination(spark: SparkSession, path: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, path, "documents"), table(spark, path, "benchmark")))


@register("op7_byte_bpe")
def byte_bpe(spark: SparkSession, path: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(*bpe.encode(table(spark, path, "documents"), vocabulary), vocabulary)


@register("op6_token_files")
def token_file_rows(spark: SparkSession, path: str) -> DataFrame:
    folder = token_files.new_folder(spark, "tokens")
    token_files.write(table(spark, path, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.crc32(token_files.read(spark, folder))


@register("op1_near_duplicates")
def near_duplicate_classes(spark: SparkSession, path: str) -> DataFrame:
    return near_duplicates.classes(table(spark, path, "documents")).withColumnRenamed("id", "doc_id")


@register("op2_repeated_passages")
def repeated_passages(spark: SparkSession, path: str) -> DataFrame:
    return passages.passages(table(spark, path, "documents")).withColumnRenamed("id", "doc_id")


@register("op5_warc_captures", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f""")
def warc_captures(spark: SparkSession, path: str) -> DataFrame:
    folder = token_files.new_folder(spark, "warc")
    warc.write(table(spark, path, "pages"), folder)
    found = warc.captures(warc.read(spark, folder), payloads=False)
    return found.select(F.col("metadata.page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


_ESCAPED = "regexp_replace({}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"


@register("op9_chat", f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + length({_ESCAPED.format('text')}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""")
def chat_texts(spark: SparkSession, path: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, path, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    output = stored(chat.conversations(chat.chains(rows)), "conversations")
    return chat.digests(output.withColumn("key", chat.conversation_of(F.col("leaf"))), "key").withColumnRenamed("key", "conv_id")


def _scores(found: DataFrame, held_out) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op4_toxicity")
def toxicity_scores(spark: SparkSession, path: str) -> DataFrame:
    held_out = remainder("id", 5) == 0
    return _scores(toxicity.scored(table(spark, path, "documents"), table(spark, path, "labels"), ~held_out), held_out)


@register("op10_quality_rules_ensemble")
def quality_scores(spark: SparkSession, path: str) -> DataFrame:
    held_out = remainder("id", 3) == 1
    return _scores(rule_ensemble.scored(table(spark, path, "documents"), table(spark, path, "labels"), ~held_out), held_out)


@register("op12_sentence_pieces")
def sentence_pieces(spark: SparkSession, path: str) -> DataFrame:
    model = pieces.Model(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.digests(pieces.encode(table(spark, path, "documents"), model, end=True), model)


@register("op11_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id,
  CAST(coalesce(list_sum(list_transform(list_zip(a.e, v.e), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""")
def hard_negative_rows(spark: SparkSession, path: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, path, "embeddings"), F.col("id") % 100 == 0, label)


@register("op13_spelling_variants")
def spelling_variants(spark: SparkSession, path: str) -> DataFrame:
    return spelling.variants(table(spark, path, "documents"), slip=spelling.one_in(199))
