"""From raw documents to packed training sequences, one written table a stage.

Every stage takes documents with doc_id, text, lang, source and n_chars and any further columns, whatever their names, and
all but the last return the same columns.  Null ids, texts, languages and sources, empty and very long texts, repeated rows
and empty tables have the results that the operators' modules define; each stage names what it does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import decontam, jaccard, langid, linededup, packing
from gridlark.llm.common import named, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted.  Null and empty texts have none and go; equal rows are judged alike."""
    return langid.accepted_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; those left without lines by it go.  ``n_chars`` follows the text.
    Null and empty texts stay; equal rows (same doc_id) lose the same lines."""
    return linededup.deduplicated(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*map(named, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (word 5-grams, similarity 0.8 or more): the one with the least doc_id.
    Texts without words are near to nothing and stay; of equal rows one stays."""
    return jaccard.one_of_each_class(docs, n=5, threshold=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.  Null and empty texts overlap none; equal rows are judged alike."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document as pieces in sequences of 2048 tokens.  Null and empty texts are one end token; each of equal rows is packed."""
    return packing.pack_documents(docs, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Tokenization and edit distance over whole corpora are not expressible in SQL at a usable speed; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage wrote on its way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep_last:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as keep:
                docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        name, stage = STAGES[-1]
        return keep_last(stage(spark, docs, sf_dir), f"pipeline-{name}")
