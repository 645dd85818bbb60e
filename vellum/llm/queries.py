"""The registered queries of the ten operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fingerprints, jaccard, language, licences, mixing, oracles, packing, repeats, scoring, stages, toolcalls, vectors
from .textops import tokenizer_path


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_context_tree(spark, sf_dir):
    return scoring.score(_read(spark, sf_dir, "documents"))


def op2_repeated_passages(spark, sf_dir):
    return repeats.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_language_evidence(spark, sf_dir):
    model = language.fit(_read(spark, sf_dir, "documents"))
    return language.identify(_read(spark, sf_dir, "pages"), model, "page_id", "html", url_col="url", is_html=True)


def op4_vector_groups(spark, sf_dir):
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


def op5_mixture(spark, sf_dir):
    kept = mixing.mix(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 8).alias("probability"))


def op6_tool_calls(spark, sf_dir):
    return toolcalls.link(*toolcalls.calls_of_turns(_read(spark, sf_dir, "conversations")), toolcalls.TURN_SCHEMAS)


def op7_licences(spark, sf_dir):
    found = licences.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op8_fingerprints(spark, sf_dir):
    return fingerprints.edited_likeness(_read(spark, sf_dir, "documents"))


def op9_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op10_packing(spark, sf_dir):
    """A document's first quarter is its prompt; its last three quarters bear loss, 896 tokens a sequence at most."""
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), loss_share=0.75, loss_limit=896, ranks=tokenizer_path("tiktoken"))


def pipeline(spark, sf_dir):
    return stages.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_context_tree, op2_repeated_passages, op3_language_evidence, op4_vector_groups, op5_mixture, op6_tool_calls, op7_licences, op8_fingerprints, op9_jaccard, op10_packing, pipeline)}

SQL = {"op2_repeated_passages": oracles.repeats(50), "op4_vector_groups": oracles.vectors(0.98), "op5_mixture": mixing.oracle(), "op6_tool_calls": oracles.tool_calls(), "op9_jaccard": oracles.jaccard(3, 90, 100)}
