"""The stages of the corpus pipeline: from raw documents to packed training sequences.

Each stage works on all rows that its predecessor kept. A stage's function takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of documents (doc_id, text, lang, source, n_chars).

Edge cases, in every stage: an empty table gives an empty result; columns beyond those of documents are dropped; null
texts have no letters and go at the first stage; null ids and repeated rows are as the stage's operator says.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from . import jaccard, language, mixing, packing, repeats, textops

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


_left: list[str] = []


def _tidied(stage):
    """The stage, which first deletes the tables that the stage before it needed until its result was written."""

    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        textops.removed(spark, _left)
        _left.clear()
        at = len(textops.STORED)
        out = stage(spark, docs, sf_dir)
        _left.extend(textops.STORED[at:])
        return out

    return run


@_tidied
def language_stage(spark, docs, sf_dir):
    """Documents whose language the evidence names; text, the declared language and the source as host count. Equal rows
    have equal evidence, so a hash of the row stands for it."""
    named = docs.select(*COLUMNS).withColumn("_row", F.xxhash64(*COLUMNS))
    found = language.identify(named, language.fit(docs), "_row", "text", declared_col="lang", host_col="source")
    gone = found.filter("rejected").select("_row").distinct()
    return named.join(gone, "_row", "left_anti").select(*COLUMNS)


@_tidied
def near_copies_stage(spark, docs, sf_dir):
    """The document with the smallest id of each group of five-word shingle sets with Jaccard 0.8 or more."""
    return jaccard.keep_firsts(docs, n=5, num=8, den=10).select(*COLUMNS)


@_tidied
def repeats_stage(spark, docs, sf_dir):
    """Texts without passages of 50 words that started earlier; texts that had none keep their white space."""
    out = repeats.remove_repeats(docs, carry=("text", "lang", "source"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = out.filter("n_removed = 0 or n_removed < n_words").select("doc_id", text.alias("text"), "lang", "source")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@_tidied
def mixing_stage(spark, docs, sf_dir):
    """A sample by source, language and topic with calibrated probabilities."""
    return mixing.mix(docs).select(*COLUMNS)


@_tidied
def packing_stage(spark, docs, sf_dir):
    """Pieces of at most 1024 tokens in sequences."""
    return packing.pack(docs, textops.tokenizer_path(), ranks=textops.tokenizer_path("tiktoken"), loss_share=0.75, loss_limit=896)


STAGES = [("language", language_stage), ("near_copies", near_copies_stage), ("repeats", repeats_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The stages use models and automata that SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = textops.stored(stage(spark, docs, sf_dir), name)
    return docs
