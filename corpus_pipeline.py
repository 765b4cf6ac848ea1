"""The corpus pipeline: toxicity, line dedup, near-dedup, source mixing, BPE encoding.

All stages take any columns beside doc_id, text, lang, source and n_chars, also with dots in their names or
with names that a stage uses itself, and return them as they are.  A null id is an id like others, a null text
counts as empty, texts of any length are read whole, rows that repeat are rows of their own
unless a stage removes them, and an empty table gives an empty one; each stage says what else holds.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, all but the last with the columns of ``docs``.  Between stages
the rows are written as Parquet and read again, which also cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage_spark.llm.common import saved, table, unused
from triage_spark.llm.op1_line_dedup import dedup_lines
from triage_spark.llm.op2_source_mix import ADDED as MIXED
from triage_spark.llm.op2_source_mix import mix, tree, weight_table
from triage_spark.llm.op3_bpe_tree import digests, encode_decode
from triage_spark.llm.op5_toxicity import ADDED as SCORES
from triage_spark.llm.op5_toxicity import fit_model, score
from triage_spark.llm.op9_near_dedup import keep_first


def own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def apart(docs: DataFrame, taken: Iterable[str]) -> DataFrame:
    """``docs`` with new names for the columns that have dots in theirs or are named as one that an operator adds."""
    return docs.toDF(*[c if c.lower() not in taken and "." not in c else unused(docs, f"own_{i}_")[0] for i, c in enumerate(docs.columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose chance of a toxic grade is below the model's cut; the model is fitted on the labelled rows among them.

    Equal texts are judged alike; null and empty ones by the thresholds alone, which keep them.
    """
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    safe = apart(docs, SCORES)
    return score(safe, model).filter(F.col("tox_p") < model.cut).select(*own(safe)).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the lines that an earlier line matches; n_chars follows the text.

    Null texts stay null; of rows equal in id and text all keep the same lines.
    """
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, the one of least doc_id (then of least text hash); null and empty texts are one class."""
    return keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the target mix, in all as many words as come in: a row of a scarce source comes twice at most, of an ample one some are left out.

    Texts without words come with whole epochs of their source, or if their place is before the end of its prefix.
    """
    safe = apart(docs, MIXED)
    return mix(safe, tree(), weight_table(spark), budget_percent=100, max_epochs=2).select(*own(safe)).toDF(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text for each row."""
    return digests(encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs


#: A classifier and a tokenizer are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None
