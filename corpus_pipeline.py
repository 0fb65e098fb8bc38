"""A corpus pipeline of five stages over the documents table.

Each stage takes the documents that its predecessor kept. All but the last return the columns of the
documents; rows with a null id pass the stages that compare documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopelens.llm import decontaminate, near_duplicates, repeats, toxicity, word_bpe
from scopelens.llm.tables import crc_fold, free_name, stored, table

#: Documents with at least this probability of being toxic go.
TOXIC = 0.7


def _own(documents: DataFrame) -> list:
    return [F.col(f"`{name}`") for name in documents.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; the classifier learns from the training fold."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(crc_fold("doc_id", 3) != 1), labels.where(crc_fold("doc_id", 3) != 1))
    return docs.where(toxicity.score(model) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; of rows with one id, one."""
    kept = near_duplicates.near_duplicates(docs).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*_own(docs)).union(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; those of which nothing is left go."""
    row = free_name(docs, "row")
    packed = docs.select("doc_id", "text", F.struct(*_own(docs)).alias(row))
    cut = repeats.without_repeats(packed).where("n_bytes = 0 or octet_length(kept_bytes) > 0")
    text = F.when(F.size("spans") > 0, repeats.whole_characters()).otherwise(F.col("kept_bytes").cast("string"))
    shortened = cut.select(row, text.alias("text"))
    changed = F.col(row).withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return shortened.select(changed.alias(row)).select(f"{row}.*").union(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit) of each document, their count, and the text they decode to."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    own = [name for name in ("doc_id", "lang", "source") if name in docs.columns]
    found = docs.select(*own, word_bpe.coded(vocabulary).alias("coded"))
    return found.select(*own, "coded.*").withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: A classifier and a tokenizer are among the stages; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
