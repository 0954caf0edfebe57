"""A training corpus from documents, in five stages of chronoloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and rereads
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import decontam, neardup, packing, pii, toxicity
from chronoloom.llm._shared import dropped, read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labelled ones that aren't held out."""
    model = toxicity.fitted(docs, read(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicated(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark windows."""
    return decontam.decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the new text."""
    out = pii.pseudonymised(docs.select(*COLUMNS), key=pii.key_of(spark))
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 2048."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("packing", pack),
]

# The stages hold a trained model, a similarity join and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents."""
    docs, path = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept, written = stored(stage(spark, docs, sf_dir), name)
        if path:
            dropped(spark, path)
        docs, path = kept, written
    return STAGES[-1][1](spark, docs, sf_dir)
