"""From raw documents to token digests: toxic documents go, copies go, near copies go, sources are mixed, texts encoded.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from captionloom.llm import bpe, exact_dedup, mixing, simhash, toxicity
from captionloom.llm.common import table
from captionloom.session import new_shared_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier chain does not call toxic. It learns from the labels of ``sf_dir``.

    Null and empty texts have no words and stay, null ids are judged like others, and rows that repeat alike. Without labels
    nothing is toxic; where labels exist, but none is of a document, ``ValueError`` says so. An empty table stays empty. A
    text of any length is judged whole; those over ``max_text`` bytes are not learned from.
    """
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.default_categories())
    return toxicity.drop_toxic(docs, chain)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty), one row: that of the largest id. Rows without an id stay only where no other
    row has their text; of rows that share id and text, the one of least hash of all columns stays. An empty table stays
    empty; of a text of any length only its digests travel with the decision."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of 2 or fewer differing bits, one row: that of the smallest id. Most pairs of a
    similarity of 0.8 differ in more bits and stay (measured recall in the README).

    Texts without a word, null ones too, have fingerprint zero and are linked like any other. Rows without an id stay only where
    their group has no id; of rows that share the id, the one of least hash of all columns stays. An empty table
    stays empty. A text is held whole while its words are hashed.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the copies are whole rows, ids included.

    Null texts have size 0 and are taken or not like others, null sources are one source, rows with null or shared ids are
    documents of their own, and rows alike in all columns are taken together. An empty table stays empty. Of a text only its
    number of words travels with the decision.
    """
    return mixing.mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row a row: null ids and repeats as they come, null and
    empty texts without tokens, an empty table without rows. Long texts are encoded in pieces."""
    import public_tokenizers

    return bpe.digested(docs, bpe.read_ranks(bpe.default_path()), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: The first stage is a trained classifier, which SQL can't express; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
