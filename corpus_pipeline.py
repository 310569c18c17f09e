"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns as Parquet in the shared folder and reads it again as the
next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.llm import decontaminate as _decontaminate
from fleetseries.llm import line_dedup as _line_dedup
from fleetseries.llm import ngram_join as _ngram_join
from fleetseries.llm import piece_codec as _piece_codec
from fleetseries.llm import toxicity as _toxicity
from fleetseries.llm.common import table
from fleetseries.session import write_table

#: The model and similarity need no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
#: Near copies: words of a shingle, and percent of their shingles that two texts share (op10 has values of its own).
NEAR_WORDS = 5
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (score under 0.5; null and empty texts stay)."""
    model = _toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = _toxicity.scorer(spark, model)(F.col("text"))
    return docs.withColumn("__toxic", score).where("__toxic < 0.5").drop("__toxic")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share; texts without such lines stay as they are."""
    cleaned = _line_dedup.dedup_lines(docs)
    changed = F.col("__lines.n_dropped") > 0
    cleaned = cleaned.withColumn("text", F.when(changed, F.col("__lines.kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the first in the table. Texts without words all stay.

    Near copies share ``NEAR_PERCENT`` % of their ``NEAR_WORDS``-word shingles.
    Rows are numbered by their place in the Parquet table that ``docs`` reads,
    so rows without an id, or that share one, are told apart. The numbers are
    written once: a second scan may cut the table into other splits.
    """
    numbered = write_table(docs.withColumn("__row", F.monotonically_increasing_id()), "near-numbered")
    rows = numbered.select(F.col("__row").alias("doc_id"), "text")
    groups = write_table(_ngram_join.jaccard_components(rows, NEAR_WORDS, NEAR_PERCENT), "near-copies")
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__kept"))
    return numbered.join(kept, numbered["__row"] == kept["__kept"], "left_semi").drop("__row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = _decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("__found.items") == 0).drop("__found")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows doc_id, n_tokens, token_ids, ids_sha256, round_trip of every document left."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return _piece_codec.round_trip(docs, path).drop("decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("piece_codec", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
