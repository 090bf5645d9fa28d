"""The corpus pipeline: five stages, each over what its predecessor kept.

Every stage but the last returns the columns of documents. A document goes in the first stage
only if it has no letter or no language at all; of each group of near duplicates the smallest
id stays; documents that hold a benchmark item go; personal data is replaced in the texts; and
what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.llm.common import read_table
from surveyloom.llm.decontaminate import find_leaks
from surveyloom.llm.jaccard_join import near_duplicates
from surveyloom.llm.language import UNKNOWN, fit_languages, identify_languages
from surveyloom.llm.packing import pack
from surveyloom.llm.pii import redact_pii
from surveyloom.llm.registry import held_out, tokenizer_path
from surveyloom.operators.lookup import attach, scratch_folder, settle


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones; texts without letters go."""
    model = fit_languages(docs.filter(~held_out()))
    found = identify_languages(docs.withColumnRenamed("lang", "__lang"), model)
    # without any labelled text nothing can be told, and only texts without letters are rejected
    kept = found.filter(F.col("lang_pred") != UNKNOWN) if model.languages else found.filter(F.col("text").rlike("\\p{L}"))
    return kept.withColumnRenamed("__lang", "lang").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows are told apart by a number of their own, which is written before it is used. Where ids
    repeat in a group one of their rows stays; a document without an id stays only if no member
    has one. Texts without shingles are in no group and all stay.
    """
    rows = settle(docs.withColumn("__row", F.monotonically_increasing_id()))
    # in the order in which members of a group are preferred
    key = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    groups = near_duplicates(rows.select(key.alias("doc_id"), "text"))
    kept = settle(groups.filter("doc_id = component_id").select(F.col("doc_id.row").alias("__row")))
    return attach(rows, kept, "__row", how="inner").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item.

    That follows from the text alone, so texts are looked up by their digests, whatever the ids are.
    """
    rows = docs.withColumn("__content", F.sha2("text", 256))
    leaks = find_leaks(rows, read_table(spark, sf_dir, "benchmark"), id_column="__content")
    found = settle(leaks.select("__content").distinct().withColumn("__leak", F.lit(True)))
    return attach(rows, found, "__content", how="left").filter("__leak IS NULL").select(*docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and ``n_chars`` counted anew."""
    out = redact_pii(docs)
    changed = F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    packed = pack(docs, tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("personal_data", replace_pii),
    ("packing", pack_documents),
]

#: A learned language model, links of sets and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written before the next stage reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
