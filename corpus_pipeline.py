"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again as the next stage's docs.

Defined cases: a null or empty text gets a score as any other and is kept or not by it; it has no lines, no near duplicates and no
windows, and encodes to no ids. Documents that repeat an id, or have none, are told apart, in the order that ``identified`` gives them; rows that repeat
both id and text lose their later copies in the line stage (or, without words, in the stage of near duplicates). Of equal lines the first document's stays, of near
duplicates the one with the least id. Very long texts are read whole. Empty tables pass through all stages; without labels nothing is rejected. Columns other
than those of documents are dropped at the first stage, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figlake.llm import bpe, chosen_path, decontam, line_dedup
from figlake.llm.common import attached, checkpointed, identified, table
from figlake.llm.queries import LEAST_SCORE, quality_scores, vocabulary_path
from figlake.sources.store import delete, fresh_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below LEAST_SCORE go. The classifier learns from the labelled rows of docs that are not held out."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go; so do documents of which no line with words is left though they had some."""
    left = line_dedup.dedup_lines(docs)
    some = lambda text: F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return _shaped(left.where((F.size("removed_lines") == 0) | some(F.col("text"))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return chosen_path.one_of_each(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    rows = identified(docs, "doc_id", "text", "_uid")
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), key="_uid").where("n_hit > 0").select("_uid").distinct()
    return attached(rows, checkpointed(found), "_uid", "left_anti").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (packed, little-endian unsigned 32-bit) of every text, their count, and whether decoding gives the text back."""
    path = vocabulary_path("byte_bpe_50k.tiktoken")
    both = bpe.round_trip(docs.select("doc_id", "text"), "text", path)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Training a network and tokenising are beyond SQL; test_pipeline_stages compares each stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What lies between them is written beside the checkpoints and deleted when the next stage is written; what the last one reads stays."""
    docs, folder, before = table(spark, sf_dir, "documents"), fresh_folder(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
