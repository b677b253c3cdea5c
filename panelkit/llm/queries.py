"""The registered query of every operator in this package, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import (
    collocations,
    conversation_repair,
    decontamination,
    language_id,
    line_dedup,
    more_sql,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    top_k,
    toxicity,
)
from panelkit.session import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("kept_lines_before").cast("long").alias("n_lines"),
        F.col("kept_lines_dropped").alias("n_dropped"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
        # the bitmap as text: word:bits for every 64 lines that lose one
        F.coalesce(F.array_join(F.transform("kept_bitmap", lambda x: F.concat_ws(":", x["word"].cast("string"), F.lower(F.lpad(F.hex(x["bits"]), 16, "0")))), ","), F.lit("")).alias("keep"),
    )


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(length(k.key) >= 10 AND k.doc_id > f.first_doc, false) AS dropped
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key
), words AS (
  SELECT doc_id, pos // 64 AS word, 18446744073709551615::UBIGINT - bit_or(1::UBIGINT << (pos % 64)::UBIGINT) AS bits FROM marked WHERE dropped GROUP BY 1, 2
), bitmaps AS (SELECT doc_id, string_agg(word || ':' || lpad(lower(to_hex(bits)), 16, '0'), ',' ORDER BY word) AS keep FROM words GROUP BY 1)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256,
       coalesce(any_value(keep), '') AS keep
FROM marked LEFT JOIN bitmaps USING (doc_id) GROUP BY doc_id
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_report(packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.document_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT item, k, q, array_to_string(w[q:q + k - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS q FROM i WHERE len(w) > 0)
), places AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (SELECT doc_id, item, k, p, q FROM places JOIN windows USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM (SELECT DISTINCT doc_id, k, p FROM hits)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1),
runs AS (SELECT doc_id, item, k, p - q AS diagonal, p - row_number() OVER (PARTITION BY doc_id, item, k, p - q ORDER BY p) AS run FROM hits),
longest AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) + k - 1 AS n FROM runs GROUP BY doc_id, item, k, diagonal, run) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_items IS NOT NULL AS contaminated, coalesce(l.n, 0)::BIGINT AS longest
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest l USING (doc_id)
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("n_stop_words", "n_word_lines")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def _passes(r: quality_rules.Rule) -> str:
    """A rule as SQL over the columns of `counted`."""
    bounds = [f"{r.numerator} / {r.denominator} {sign} {x!r}" for sign, x in ((">=", r.low), ("<=", r.high)) if abs(x) != float("inf")]
    return f"coalesce({r.denominator} < {r.least} OR {r.denominator} = 0 OR ({' AND '.join(bounds)}), true)"


_LONGEST = 2 + max(len(w) for ws in quality_rules.STOP_WORDS.values() for w in ws)
_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws}))
OP7_SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM split WHERE len(ws) >= 8)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1) GROUP BY 1
), counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_word_lines,
         CASE WHEN octet_length(encode(t)) < 1.5 * length(t) THEN len(list_filter(ws, lambda x: length(x) <= {_LONGEST} AND lower(rtrim(x, '.,')) IN ({_STOP}))) END AS n_stop_words
  FROM split LEFT JOIN covered USING (doc_id)
), judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(map(_passes, quality_rules.THRESHOLDS))} AS kept
FROM judged
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"), 8)


_SHARD = """arg_max({{k: k}}, {{score: -1 / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || k), 1, 13))::BIGINT + 0.5) / 4503599627370496), k: k}}).k"""
OP10_SQL = f"""
WITH t AS (SELECT {more_sql.crc_table()}::UBIGINT[] AS t),
b AS (SELECT row_number() OVER () AS row, doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT) AS bytes FROM documents),
d AS (
  SELECT row, doc_id, len(bytes) + 1 AS size, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM b, t
), s AS (SELECT row, {_SHARD.format()} AS shard FROM d, (SELECT unnest(range(8)) AS k) GROUP BY 1),
g AS (SELECT row, {_SHARD.format()} AS grown_shard FROM d, (SELECT unnest(range(9)) AS k) GROUP BY 1),
h AS (
  SELECT doc_id, size, text_crc32, shard, grown_shard, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || text_crc32 || '/' || size), 1, 13))::BIGINT AS h
  FROM d JOIN s USING (row) JOIN g USING (row)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY h % 1024, h, doc_id, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard FROM h
"""


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "op11_top_k": op11_top_k,
    "op12_collocations": op12_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op6_decontamination": OP6_SQL, "op7_quality_rules": OP7_SQL, "op10_sharding": OP10_SQL, "op11_top_k": more_sql.OP11_SQL, "op12_collocations": more_sql.OP12_SQL, "op13_conversation_repair": more_sql.OP13_SQL}
