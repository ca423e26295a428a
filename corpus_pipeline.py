"""From raw documents to packed training sequences: five stages over whole tables.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents, and
columns besides doc_id, text and n_chars pass through them unchanged, whatever their names. Texts
are read whole, however long. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, minhash, packing, pii, quality
from tidewright.llm.common import Scratch, table
from tidewright.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Each row is judged by its own text, a null
    one as an empty text, so repeated rows share their fate."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 80 %): that of the smallest id.
    Of rows that repeat a doc_id one stays; rows without id, and texts without words, all stay."""
    return minhash.one_of_each(docs, size=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts hold none; repeated rows
    share their fate; an empty benchmark leaves all rows."""
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, n_chars that of the new text. Null and
    empty texts stay as they are; every row stays."""
    return pii.cleaned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. A null or empty text has the end id alone; repeated
    rows and rows without id are packed like any other."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each),
    ("decontaminate", drop_leaks),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: The classifier, the tokenizer and the packing order are not expressible in SQL; the tests
#: compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
