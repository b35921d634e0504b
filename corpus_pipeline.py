"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before it kept, and returns a DataFrame that is written as
Parquet and read again for the next one. All but the last return the columns of documents, whatever others docs has. An empty
table gives an empty result in each. Rows are told apart by doc_id; what a stage does with null texts, null ids and repeated
rows its docstring says."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import minhash, mixing, packing, pii, quality
from marginalia.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Where the key of the pseudonyms is found: a setting of the session, or else a variable of the driver's environment.
KEY_SETTING, KEY_VARIABLE = "spark.marginalia.pseudonyms.key", "MARGINALIA_PSEUDONYMS_KEY"


def pseudonyms_key(spark: SparkSession) -> bytes:
    """The caller's key. Without one the public example takes its place, of which a warning tells: whoever reads this repository
    can then undo the pseudonyms."""
    if found := spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE):
        return found.encode()
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the public example key", stacklevel=2)
    return pii.EXAMPLE_KEY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go; labels calibrate the forest. Null, empty and short texts
    go. Repeated rows are judged alike; null ids are no hindrance."""
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays. A text without words is a group of its own. Ids must
    tell rows apart: rows that repeat an id that stays all stay, and so do rows without id if one of them stays."""
    return minhash.keep_first(docs.select(*COLUMNS), percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values are replaced by pseudonyms of the same format and length. No row goes; null texts stay null."""
    return pii.pseudonymise(docs.select(*COLUMNS), pseudonyms_key(spark), kinds_col=None)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with the probabilities that raking gives their source, language and topic, half of all tokens in sum.
    Null sources and languages are values like others; rows that repeat an id are drawn together."""
    return mixing.mix(docs.select(*COLUMNS), targets=mixing.TARGETS).where("kept").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences. A null text is one piece, the end mark."""
    return packing.pack_digest(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("pseudonyms", pseudonyms), ("mixture", mixture), ("packing", packed)]

#: The forest, the forest of signatures, the keyed permutation and the raking can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs
