"""The queries opN_<name>: each applies an operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, embedding_dedup, line_dedup, lm_score, merkle, minhash_dedup, secret_scan, token_count, toxicity, url_filter, warc, whitening
from .common import table
from .oracle import ORACLE


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold=toxicity.training_fold)
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    return toxicity.score(docs, grammar).select("doc_id", held_out, "score", "predicted", "patterns")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


#: The rules of op11_url_filter: host, path, action.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules(spark, URL_RULES)).drop("url")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    tampered = [(F.col(f) + 1) if f == "n_chars" else F.col(f) for f in fields]
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_of(tampered))
    made = merkle.manifest(docs, fields, "lang", "doc_id", claimed=claimed)
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(whitening.usable(F.col("embedding")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * 64) + 1_000_000)
    rows = rows.select("vec_id", x.alias("x"))
    return whitening.transform(rows, whitening.fit(rows, "x"), "vec_id", "x")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_byte_bpe, op3_token_count, op4_embedding_dedup, op5_lm_score, op6_toxicity, op7_minhash_dedup, op8_secret_scan, op9_decontaminate, op10_warc, op11_url_filter, op12_merkle, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
