"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import fast_quality, hpy_model, importance, metric_tree, mixing, near_dup, packing, quality, secrets, sharding, spelling, token_codes, toxicity
from tidemark.llm.common import id_hash, table


def op1_secret_spans(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_mtree_topk(spark, sf_dir):
    vectors = metric_tree.quantized(table(spark, sf_dir, "embeddings"))
    return metric_tree.top_k(vectors, vectors.where(F.col("id") % 50 == 0))


def op3_hpy_scores(spark, sf_dir):
    df = hpy_model.score(table(spark, sf_dir, "documents"))
    return df.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op4_quality_divergence(spark, sf_dir):
    df = quality.quality(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op5_histogram_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_token_codes(spark, sf_dir):
    return token_codes.encode_and_read(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op8_pareto_mix(spark, sf_dir):
    df = mixing.mix(mixing.sized(table(spark, sf_dir, "documents")))
    return df.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op9_nearest_toxic(spark, sf_dir):
    df = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.pmod(id_hash(F.col("doc_id")), F.lit(4)) == 2
    return df.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op10_hyperminhash(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_subword_quality(spark, sf_dir):
    df = fast_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.pmod(id_hash(F.col("doc_id")), F.lit(5)) == 0
    return df.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_secret_spans, op2_mtree_topk, op3_hpy_scores, op4_quality_divergence, op5_histogram_shards, op6_token_codes, op7_best_fit_packing, op8_pareto_mix, op9_nearest_toxic, op10_hyperminhash, op11_spelling_variants, op12_importance_resampling, op13_subword_quality)}
SQL = {"op8_pareto_mix": mixing.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_importance_resampling": importance.ORACLE}
