"""Registered queries of the subpackage: each applies one operator with its production parameters to whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.llm import gru_lm, hard_negatives, mixture_packing, order_minhash, packing, page_diff, quality_gam, quality_rules, spaced_seeds, substring_dedup, toxicity, url_lists, whitening
from geoledger.llm.labelled import remainder
from geoledger.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed tokenizer files lie; every executor has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trained = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, trained).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(quality_gam.measure(_table(spark, sf_dir, "documents")))
    model = quality_gam.train(measured, _table(spark, sf_dir, "labels"))
    return quality_gam.score_quality(measured, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures; the given table has no fetch times, so each follows from the page's id (one year, to the second)."""
    seconds = F.col("page_id") * 7919 % 366 * 86400 + F.col("page_id") % 86400
    return pages.select("page_id", "url", F.timestamp_seconds(seconds + 1704067200).alias("fetched_at"))


def list_events(pages: DataFrame) -> DataFrame:
    """Dated list events for the hosts of the pages and their parent domains, dealt out by a hash of the name."""
    host = url_lists.host_of(F.col("url"))
    number = lambda name, at: F.conv(F.substring(F.md5(F.col(name).cast("binary")), at, 4), 16, 10).cast("int")
    hosts = pages.select(host.alias("host")).where("host is not null").distinct()
    parents = hosts.select(F.substring_index("host", ".", -3).alias("domain")).distinct().where(number("domain", 1) % 3 == 0)
    when = lambda shift: F.timestamp_seconds((number("domain", 5) + shift) % 366 * 86400 + 1704067200)
    kind = F.when(number("domain", 9) % 2 == 0, "spam").otherwise("malware").alias("list")
    dated = parents.select("domain", kind, F.explode(F.array(*[
        F.struct(F.lit(action).alias("action"), when(97 * k).alias("at")) for k, action in enumerate(("add", "remove", "add"))])).alias("e"))
    single = hosts.select(F.col("host").alias("domain")).where(number("domain", 1) % 5 == 0)
    return dated.select("domain", "list", "e.action", "e.at").unionByName(
        single.select("domain", F.lit("phishing").alias("list"), F.lit("add").alias("action"), when(0).alias("at")))


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_lists.filter_urls(page_captures(pages), list_events(pages))
    return judged.select("page_id", "url", F.unix_timestamp("fetched_at").alias("fetched_s"), "blocked", "matched", "n_lists")


def op8_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path())


def op10_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = gru_lm.language_model_scores(_table(spark, sf_dir, "documents"), remainder(10) != 0)
    return scores.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.piece_digests(mixture_packing.pack_mixture(_table(spark, sf_dir, "documents"), vocabulary_path()))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_order_minhash": op5_order_minhash,
    "op6_spaced_seeds": op6_spaced_seeds,
    "op7_url_lists": op7_url_lists,
    "op8_page_diff": op8_page_diff,
    "op9_packing": op9_packing,
    "op10_gru_lm": op10_gru_lm,
    "op11_mixture_packing": op11_mixture_packing,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}
