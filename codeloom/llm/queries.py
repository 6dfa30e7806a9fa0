"""One query for each operator, over whole tables and with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, langid, media, neardup, packing, pfor, pii, quality, rules, secrets
from codeloom.llm._shared import documents, labels


def op1_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, labels(spark, sf_dir)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))[0]


def op4_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media(documents(spark, sf_dir), with_media=False)
    # the keyframes' byte ranges are long for long texts: their number, the first, and a hash of all
    first = F.try_element_at("keyframes", F.lit(1))
    feature = F.concat_ws("|", "codec", "duration", "timescale", F.size("keyframes"), F.concat_ws("-", first["start"], first["end"]), F.sha2(F.array_join(F.transform("keyframes", lambda k: F.concat_ws("-", k["start"], k["end"])), ","), 256))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op6_minhash_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pfor.store_and_read(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.surrogates(documents(spark, sf_dir).select("doc_id", "text")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rules.score(docs, rules.fit(docs, labels(spark, sf_dir)))


_ALL = (op1_quality_ordinal, op2_language_id, op3_best_fit_packing, op4_bpe_segment_tree, op5_media_columns, op6_minhash_bottom_k, op7_token_files, op8_pii_surrogates, op9_secret_scan, op10_quality_rules)
QUERIES = {f.__name__: f for f in _ALL}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Trained models, byte formats and tokenizers are beyond SQL; tests hold the other queries against brute force.
SQL: dict[str, str] = {
    "op6_minhash_bottom_k": rf"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b USING (v) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, component_id = doc_id AS kept FROM sets JOIN least USING (doc_id)""",
}
