"""The registered queries of the numbered operators, each over its whole table. Nulls, empty and long texts, ties, repeated
rows, empty tables and other columns are what the called function says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, idfiles, kneser_ney, langid, linededup, oracles, packing, phrases, quality, secrets, sharding, simhash, urls


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without passages of 50 words or more that came before."""
    return linededup.deduped_documents(_docs(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known shapes of secrets and tokens that look random, in every text."""
    return secrets.secret_report(_docs(spark, sf_dir))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard and slot under the law of even row counts."""
    return sharding.shard_documents(_docs(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and its group of near duplicates."""
    return simhash.near_duplicate_documents(_docs(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit words and benchmark items of each document."""
    return decontaminate.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's log probability under a model of four fifths of them."""
    return kneser_ney.score_documents(_docs(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's language, learned from three quarters of them."""
    return langid.identify(_docs(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule and verdict."""
    return urls.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(_docs(spark, sf_dir), tokenizer_path())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's measures and whether the cascade keeps it."""
    return quality.judge(_docs(spark, sf_dir))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files hold of each document, once written and read back."""
    return idfiles.round_trip(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations."""
    return phrases.collocations(_docs(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language are apart, and in which terms."""
    return divergence.audit(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_secret_scan, op3_feistel_shards, op4_simhash, op5_decontaminate, op6_kneser_ney, op7_language_id, op8_url_filter, op9_packing, op10_quality_rules, op11_token_files, op12_collocations, op13_source_divergence)}
ORACLES: dict[str, str] = {
    "op3_feistel_shards": oracles.op3_sql(),
    "op5_decontaminate": oracles.OP5,
    "op10_quality_rules": oracles.OP10,
    "op12_collocations": oracles.OP12,
    "op13_source_divergence": oracles.OP13,
    "op8_url_filter": r"""WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
b AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host, '\b(spam|pills|casino|poker|viagra|malware|phishing|warez)\b') OR regexp_matches(path, '/(adserver|affiliate|banners|doubleclick|popunder|tracker)/') THEN 'block' ELSE 'allow' END) AS verdict FROM h LEFT JOIN b ON h.r = b.r""",
}
