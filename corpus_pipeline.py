"""From raw documents to packed sequences: toxicity filter, exact and near deduplication, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; the caller may write it as Parquet and read it again.
All but the last give the columns of docs, whatever other columns there are and whatever their names; an empty table gives
an empty result in every stage. SQL cannot express the first stage (trained trees) or the packing, so
ORACLE_SQL is None and the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import exact_dedup, mixing, packing, simhash, toxicity
from bitloom.llm.queries import toxic_model, vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels of sf_dir, scores below 0.5. A null text counts as empty; repeated rows and equal texts fare alike; ids are not read."""
    return toxicity.keep_clean(docs, toxic_model(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text that is the same but for the case of A-Z: the one with the largest doc_id.

    A null text counts as empty, and empty texts are the same. Of rows that repeat id and text one stays; of rows that repeat an
    id with other texts, each text is a document of its own. Rows without an id stay: no decision can name them.
    """
    return exact_dedup.keep_one(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link: the one with the smallest doc_id.

    A null text counts as empty; texts without words have fingerprint 0 and so are one group. Of rows that repeat id and text
    one stays. Rows without an id stay.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from not at all to three times.

    A null source is a source of its own. Texts without words, null ones too, are taken once: they cost nothing. Rows that
    repeat an id queue one after the other, and rows alike in id and size may change places.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens.

    A null text is empty: one piece of the end's id. Rows that repeat an id, or have none, each give their pieces.
    """
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each cut off from the one before by a checkpoint."""
    from bitloom.llm.common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
