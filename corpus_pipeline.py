"""Corpus preparation in five stages over documents: rules, near copies, repeated passages, the mix, and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserakit.llm import bpe, mixing, quality_rules, simhash, substring
from tesserakit.llm.common import release, scratch, shared_folder, table, write_cut


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines.

    Null, empty and short texts go; repeated rows are judged one by one; very long texts are cleaned whole; an empty table
    gives no rows; other columns pass through.
    """
    return quality_rules.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a confirmed similarity of 0.8 or more.

    The smallest doc_id of a group stays (rows without one only where there is no other), of repeated rows one; null
    and empty texts are one group; very long texts are compared whole; an empty table gives no rows; other columns pass
    through.
    """
    return simhash.similar(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a document of smaller doc_id has too.

    Null texts, empty ones and those that lose nothing stay as they are; texts that lose every word go; rows of one
    doc_id, and rows without one, take nothing from each other; very long texts are cut whole; an empty table gives no
    rows; other columns pass through.
    """
    return substring.strip(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them.

    Texts without words go; null sources are one source, the last; rows equal in doc_id, source and text share their
    copies evenly; a very long text counts whole; an empty table gives no rows; other columns pass through.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids_le (ids as little-endian unsigned 32-bit integers), and a digest of what they decode to.

    Null texts count as empty ones, without ids; very long texts are encoded whole; a row stays a row, repeated or not; an
    empty table gives no rows.
    """
    out = bpe.encode_decode(docs, bpe.vocabulary_path())
    return out.select("doc_id", "source", "lang", "n_tokens", "ids_le", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", rules),
    ("near_dedup", near_copies),
    ("substring_dedup", passages),
    ("mix_sources", mix),
    ("encode", encode),
]
#: The tokens and fingerprints of the stages are beyond SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what a stage leaves in the shared folder goes when the next one's documents are written.

    The documents of the last stage go with the application, as the result is read when it is asked for.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        outside = shared_folder(spark)
        with scratch(spark):
            docs, path = write_cut(stage(spark, docs, sf_dir), name, folder=outside)
        if last:
            release(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
