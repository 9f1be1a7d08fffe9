"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.llm import decontaminate, edit_embedding, gated_lm, near_dup, packing, quality, sharding, spelling, sql, toxicity, url_filter, warc, weak_rules, whitening
from vecatlas.llm.common import fold, folder, table

#: The host rules of the contract, and the words that block any other url.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
WORD_RULES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

#: Documents of a lower probability to be good are rejected.
QUALITY_AT_LEAST = 0.5


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("is_good", F.col("score") >= QUALITY_AT_LEAST)


def op3_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "is_kept")


def op4_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold_of = fold("doc_id", 7)
    scored = gated_lm.score(table(spark, sf_dir, "documents"), fold_of != 2)
    return scored.select("doc_id", (fold_of == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_index_first_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = folder(spark, "warc")
    index = warc.write(warc.plan_records(table(spark, sf_dir, "pages")), place)
    return warc.read(index, place).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.against_next(table(spark, sf_dir, "documents"))


def op7_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_rule(*r) for r in HOST_RULES] + [url_filter.word_rule(w) for w in WORD_RULES]
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes")


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, *whitening.fit(vectors))


def op13_spelling_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_power_of_two_packing, op2_co_training, op3_bag_minhash, op4_gated_lm, op5_index_first_warc, op6_edit_embedding, op7_nnpu_toxicity, op8_url_rules, op9_sampled_splitters, op10_simhash_windows, op11_weak_rules, op12_jacobi_whitening, op13_spelling_tiles)}

_HOST = "translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " ".join(f"WHEN ('.' || host) LIKE '%.{n.partition('/')[0]}' AND starts_with(path, '/{n.partition('/')[2]}') THEN '{n}'" for n, _ in sorted(HOST_RULES, key=lambda r: -len(r[0])))
_VERDICTS = " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in HOST_RULES)

ORACLE: dict[str, str] = {
    "op5_index_first_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q""",
    "op8_url_rules": f"""
WITH u AS (SELECT page_id, url, {_HOST} AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {_FITS} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE rule {_VERDICTS} ELSE
  CASE WHEN regexp_matches(lower(url), '(^|[^a-z0-9])({'|'.join(WORD_RULES)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END END AS verdict
FROM r""",
    "op11_weak_rules": sql.weak_rules(),
    "op13_spelling_tiles": sql.spelling_groups(),
}
