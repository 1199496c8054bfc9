"""The corpus pipeline: five stages over ``documents``, each one of the operators of ``evidex.llm``.

Low-quality documents go, then near duplicates, repeated passages, documents that contain benchmark passages;
the rest is encoded. Every stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm.bpe import recode_descriptions
from evidex.llm.leaks import clean_items
from evidex.llm.neardup import near_duplicate_items
from evidex.llm.quality import score_items, train
from evidex.llm.queries import _table, _tokenizer
from evidex.llm.substrings import strip_repeated_passages
from evidex.session import configure, stored

ACCEPTED = 0.3
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def _items(docs: DataFrame) -> DataFrame:
    """Documents as items; columns that documents do not have are left behind, whatever their names."""
    configure(docs.sparkSession)
    return docs.select(DOCUMENT).withColumnsRenamed({"doc_id": "item_id", "text": "description"})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; one with a null or empty text has the score of the bias."""
    items = _items(docs)
    model = train(items, _table(spark, sf_dir, "labels").selectExpr("doc_id as item_id", "quality as accepted"))
    kept = score_items(items, model).filter(F.col("score") >= ACCEPTED)
    return kept.withColumnsRenamed({"item_id": "doc_id", "description": "text"}).select(DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least, of each group of near duplicates; documents without words or id all stay."""
    gone = near_duplicate_items(_items(docs)).filter("not kept").select(F.col("item_id").alias("doc_id"))
    return docs.select(DOCUMENT).join(gone, "doc_id", "left_anti").select(DOCUMENT)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words that also start in an earlier one; texts without such a passage stay as they are."""
    found = strip_repeated_passages(_items(docs)).filter("n_removed > 0 and item_id is not null")
    cut = found.groupBy(F.col("item_id").alias("doc_id")).agg(F.min("description").alias("rest"))
    text = F.coalesce("rest", "text")
    return docs.select(DOCUMENT).join(cut, "doc_id", "left").withColumns({"text": text, "n_chars": F.when(F.col("rest").isNull(), F.col("n_chars")).otherwise(F.char_length("rest"))}).select(DOCUMENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, whole or with few edits."""
    passages = _table(spark, sf_dir, "benchmark").selectExpr("item_id as passage_id", "text")
    return clean_items(_items(docs), passages).withColumnsRenamed({"item_id": "doc_id", "description": "text"}).select(DOCUMENT)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left, and a digest of the text they decode to."""
    coded = recode_descriptions(_items(docs), _tokenizer())
    return coded.select(F.col("item_id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("bpe", bpe)]

#: A learned model, sketches and a tokenizer are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
