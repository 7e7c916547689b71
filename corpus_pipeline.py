"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of
documents, also such as have names that a stage uses inside. An empty table goes through every stage and gives no row.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracequarry.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from tracequarry.llm.common import shared_dir, table
from tracequarry.llm.queries import tokenizer_path

#: No SQL expresses the language model, the Jaccard classes or the tokenizer.
ORACLE_SQL = None


def keep_recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is trained on the labelled training fold of docs.

    A null or empty text, and one without a letter, goes; rows that repeat stay as often as they come; a null id, which is in
    the training fold, or a null source changes nothing; a null language is not learned from; without any labelled document all rows go. A text of any length is read whole, in slices.

    The session's limit of a batch for Python workers stays at packing.BATCH_BYTES: what is returned runs when it is written.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", packing.BATCH_BYTES)
    return language_id.recognised(docs, language_id.train(docs.filter(language_id.in_training())))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the one with the smallest id.

    Null and empty texts are one group; rows that repeat an id and a text are one document; a null id stays only where no row of equal length has one. Texts of any length are
    compared whole.
    """
    return exact_dedup.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts, by a Jaccard similarity of 0.8 of their five-word shingles: the one with the smallest id.

    A text of fewer words is one shingle; one without a word is a class of its own and stays; rows that repeat the smallest id of a class all stay; a null id comes first. All shingles of a text count, however
    long it is.
    """
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix; those of a second epoch come twice.

    The budget is half of all tokens, so that the target weights can be kept without more than two epochs of any source. A null text has no tokens; null languages and sources are a
    leaf of their own; rows that repeat an id are taken together; a leaf without tokens is taken once. A text of any length is counted and taken whole.
    """
    return mixing.taken(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; rows that repeat are documents of their own; very long texts are cut into full pieces.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_recognised),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_to_weights", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tracequarry/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
