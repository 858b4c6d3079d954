"""The corpus pipeline: stages that filter, deduplicate and pack `documents`.

Each stage takes and, but for the last, returns the columns of documents. Null texts
count as empty, which the quality rules reject; empty tables pass through all stages.
Rows without an id are judged like others, but owe no passage and no place to another
row: near-duplicate and substring dedup keep them whole. Of rows that repeat an id,
near-duplicate dedup keeps one. Ties (equal texts) fall to the smallest id. Columns
beyond those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import functions as F

from plumbline.llm import near_dup, packing, quality, repeats, toxicity, workspace


def quality_rules(spark, docs, sf_dir):
    """Documents that the repetition rules reject go: null, empty and short texts among them."""
    return quality.keep_rows(docs)


def toxic_spans(spark, docs, sf_dir):
    """Documents with a toxicity score of 0.7 or more go; learnt from the labels that may train.

    Without labels of both kinds the score is the toxic share of the labelled rows (0 without any).
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_rows(docs, model)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays: that with the smallest id."""
    return near_dup.keep_rows(docs)


def repeated_passages(spark, docs, sf_dir):
    """Words in windows that a document with a smaller id has too are cut out; n_chars follows the text."""
    cut = repeats.remove(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def packed_sequences(spark, docs, sf_dir):
    """Pieces of at most 2048 tokens, with their place in the training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_spans),
    ("near_dup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed_sequences),
]
#: Scores of a trained model are not SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole of `documents`; each but the last is written and read again.

    What a stage kept on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = workspace.keep_result(spark, partial(stage, spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
