"""The corpus pipeline: quality, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

Defined results of every stage: an empty table gives an empty result; extra columns, whatever their names, pass through all but
the last; texts of any length are read whole; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.llm import mixing, packing, quality, simhash, substring
from tallyspan.llm.common import drop_stored, stored, table
from tallyspan.llm.queries import word_tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's threshold allows, judged row by row: copies and ties alike. A null text is one end
    token, a null language one of its own, and rows with a null or repeated doc_id are told apart by their texts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id; of equal ids the least text, null ids last. Null
    and blank texts are one group."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur more than once, copies in repeated rows included; the rest is joined by
    single blanks. A null text stays null, and a text that loses nothing stays as it is."""
    out = substring.dedup_documents(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null text has no words, a null source is one of its own, the last; ties of size go by
    doc_id, whose repeats are steps of their own."""
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix's documents in sequences of 2048 tokens; a null text is an empty one, its end alone, and repeated rows are packed
    each."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]
#: SQL can't express the stages; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result stored before the next begins; what it was made from is removed then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = stored(stage(spark, docs, sf_dir))
        drop_stored(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
