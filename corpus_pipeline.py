"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets are masked, sources are
mixed to their target weights, and what is left is tokenised.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of documents. A document that the mix takes several times stands there as often, with the same id.

Cases: docs needs the columns of documents; further columns are left out. Any column may be null: a null text counts as
an empty one, which is not toxic, has no secrets and is like other empty ones; documents without words, null or empty
texts among them, take nothing in the mix and so end there. Repeated rows are near-duplicates of each other. An empty table
goes through all stages. Very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, common, mixing, secrets, simhash, toxicity
from tracemill.llm.queries import RANKS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    scored = toxicity.toxicity(docs, common.table(spark, sf_dir, "labels"), drop_text=False)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return simhash.representatives(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret; n_chars follows the text."""
    clean = secrets.redact(docs, secrets.fit(secrets.labelled_findings(spark)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixture(docs).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (packed unsigned 32-bit integers), with the digest of what they decode to."""
    out = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("tokens", tokenise),
]

#: Learned scores, hashed draws and merges have no SQL form; tests/llm/test_pipeline.py holds the stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what each keeps is written to the checkpoint folder, so none is computed twice."""
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = common.checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
