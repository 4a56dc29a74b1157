"""A training corpus from raw documents, in five stages.

quality (classifier rejects leave) -> exact copies -> near copies -> mix of sources -> packing. Each stage
takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents. ``run`` writes every stage as Parquet below spark.checkpoint.dir and reads it again.

In all stages null texts count as empty and stay null, texts are read whole, repeated rows and null ids are rows
like others unless said otherwise, extra columns come along under any names, and an empty table gives an
empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from burdenkit.functions.storage import remove, shared_folder
from burdenkit.llm.common import table
from burdenkit.llm.exact import drop_exact_copies
from burdenkit.llm.mixing import mixed_documents
from burdenkit.llm.packing import pack_documents
from burdenkit.llm.quality_crf import keep_good
from burdenkit.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject (score 0.5 or more); equal rows share their fate."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the smallest doc_id; one without id stays only where no other has the text."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more, the smallest doc_id.

    Texts without words are one group; rows without id stay.
    """
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes, per document and pass; rows without words leave, null is a source."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; rows without words have no bin."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: SQL can't express the trained classifier and the pseudorandom mix; operators and stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. A stage's folder goes when the next is written; the result still reads the last."""
    docs, before = table(spark, sf_dir, "documents"), None
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
            if before:
                remove(spark, before)
            before = f"{at}/{k}-{name}"
    return docs
