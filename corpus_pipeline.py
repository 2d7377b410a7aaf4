"""Corpus pipeline: quality rules, near-duplicate groups, repeated passages, source mix, BPE ids.

Rows with a null text have no words: the quality rules reject them.  Stages keep
every other row they do not name; repeated rows count one by one, extra columns
(also with an operator's own names) pass through, an empty table gives an empty
table, texts of any length are read whole.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  Stages read whole tables only and
work on any partitioning; each works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemscope.llm.bpe import encode_documents
from itemscope.llm.common import read_table, stash
from itemscope.llm.mixing import mixed_documents
from itemscope.llm.ngram_jaccard import keep_one
from itemscope.llm.quality import judge_quality
from itemscope.llm.suffix_dedup import remove_repeats


#: Bytes of a repeated passage: a passage of 50 words has more, sentences that documents share by chance have fewer.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (null, empty and very short texts among them); equal rows share their verdict."""
    return judge_quality(docs, read_table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest doc_id (null last): five-word shingles, similarity
    0.8 or more.  Repeated rows are copies; rows without words are in no group and stay."""
    return keep_one(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of PASSAGE_BYTES bytes that stand elsewhere too leave the text; n_chars follows.
    A null text becomes empty, shorter texts lose nothing, no row goes."""
    out = remove_repeats(docs, length=PASSAGE_BYTES).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (documents without words, or that the mix passes over, not
    at all); ties and repeated rows are taken one by one, a null source is a source."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text (null: none), and whether decoding them gives the text back."""
    back = F.col("decoded") == F.coalesce("text", F.lit(""))
    return encode_documents(docs).withColumn("exact", back).select("doc_id", "source", "n_tokens", "ids", "exact")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates),
          ("suffix-array dedup", repeated_passages), ("mixing sources", mix), ("BPE encoding", encode)]

#: The quality verdict (hashed n-grams) and BPE cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
