"""From raw documents to token ids: five stages, each over all that the one before it kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. The stages drop what the classifier finds toxic, all but one of equal texts, all but one of each
near-duplicate group, and what the source mix doesn't take (a row that it takes twice stands there twice); the last
turns texts into ids.

In every stage a null text counts as empty, whole texts count, further columns go along whatever their names, and an
empty table stays empty. What else each does with ids that are null or repeated, and with ties, its docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, pieces, shared, simhash, toxicity


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under 0.7 by a classifier fitted to the labels in ``sf_dir``. Rows are judged by their texts alone, so
    equal texts stay or go together, whatever their ids; without labels of both classes, all stay or all go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest doc_id; null ids are larger than all others.
    Rows that repeat both the id and the text, or have no id where none of their copies has one, all stay."""
    return exact_dedup.drop_copies(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 of five-word shingles, the row with the smallest doc_id, and of several
    texts with that id one; texts without words are one group. Rows that repeat both the id and the text all stay."""
    return simhash.drop_near_copies(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them; rows without words aren't taken. A null source is one, the last in
    order; rows that repeat an id are each a row of their queue."""
    return mixing.mix_rows(docs)


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the digest of what the ids decode to, a row for each row; no text has no ids."""
    vocabulary = pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = pieces.encode(docs, vocabulary, and_decode=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("pieces", stage_pieces),
]

#: SQL can express neither the classifier, nor the 64-bit hash of the fingerprints, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
