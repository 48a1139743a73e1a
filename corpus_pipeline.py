"""A corpus from raw documents to packed sequences: five stages, each one operator, each on all that the one before kept.

Every stage decides about rows, not ids: rows that share an id, and rows without one, are documents of their own. In all
stages null texts are empty ones, an empty table gives an empty table, columns besides doc_id and text are carried along
whatever their names are, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfold.llm import toxicity
from cairnfold.llm.common import numbered, save, without
from cairnfold.llm.exact_dedup import distinct_rows
from cairnfold.llm.minhash import near_duplicates
from cairnfold.llm.packing import pack_documents
from cairnfold.llm.queries import vocabulary
from cairnfold.llm.suffix_dedup import cut_repeats


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the toxicity model, trained on the labelled ones, does not reject. Empty texts stay, repeated rows share a verdict."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group with equal texts (white space aside): most code points, smallest id (null last), least row; so one of repeated rows, and one empty text."""
    return distinct_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): the smallest id, rows without an id of their own last.

    Rows without words are linked with nothing and stay.
    """
    rows, top = numbered(docs)
    rows = rows.withColumn("row", F.when(F.col("tie") == 0, F.col("id")).otherwise(F.lit(top) + F.col("tie")))
    verdicts = near_duplicates(rows.select("row", F.col("doc.text").alias("text")), id="row", words=5, num=80, den=100)
    return without(rows, "row", verdicts.where("not kept").select("row")).select("doc.*")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that start earlier (by id, then by row; null ids last); rows stay, if need be with an empty text; n_chars follows."""
    rows, _ = numbered(docs)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    others = F.struct(*(F.col(f"doc.`{c}`") for c in rest or ["doc_id"])).alias("others")
    cut = cut_repeats(rows.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "tie", others), length=100, carry=("others",), tie="tie")
    out = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text")} | {c: F.col(f"carried.others.`{c}`") for c in rest}
    if "n_chars" in rest:
        out["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(out[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a sequence of at most 2048 tokens for every piece of every row; an empty text is its end token."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=2048, end=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("suffix_dedup", cut_passages),
    ("packing", pack),
]

#: SQL can express neither the trained stage nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all pieces of what the stages keep of the table of documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    An empty table gives an empty one; nulls, repeated rows and ids, and very long texts are treated as the stages say.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
