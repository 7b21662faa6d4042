"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm import alignment, fingerprints, jaccard, language, lm_scoring, mixing, packing, secrets, spelling, token_counts, token_ids, toxicity, vector_search
from rasterloom.llm.shared import as_parquet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.topk(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.copies(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs.select("doc_id", "text"), labels.where(~language.held_out("doc_id", 4, 2)))
    rows = toxicity.score(docs, lexicon)
    return rows.select("doc_id", language.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = lm_scoring.score(docs, docs.where(~language.held_out("doc_id", 10, 0)))
    return rows.select("doc_id", language.held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language.train(docs.where(~language.held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    rows = language.identify(docs.select("doc_id", "text"), net)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), language.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digests(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.pieces_of(tokenizer_file("piece_bpe_32k.model")))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.digests(token_ids.write(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    # of the groups only their digest is written
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = alignment.counted(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.forms(as_parquet(spelling.words(table(spark, sf_dir, "documents"), change=spelling.drop_one(31)), "words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprints, op2_vector_search, op3_mixing, op4_toxicity, op5_lm_scoring, op6_jaccard_join, op7_language_id, op8_secret_scans, op9_packing, op10_token_counts, op11_token_ids, op12_token_alignment, op13_spelling_variants)}
ORACLE_SQL: dict[str, str] = {"op2_vector_search": vector_search.ORACLE_SQL, "op3_mixing": mixing.ORACLE_SQL, "op6_jaccard_join": jaccard.ORACLE_SQL, "op13_spelling_variants": spelling.ORACLE_SQL}
