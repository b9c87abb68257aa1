"""PDF files made from the benchmark tables, which hold none: one for each supplier, with a drawing and a caption whose places follow from its key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figlake.sources.pdf_writer import pdf_file, shown
from figlake.sources.store import opened, put

FILES = "doc_id string, source_path string, content binary"
#: Files that a task makes, and reads or draws after that.
FILES_PER_TASK = 64
#: Digits that a caption's number needs to hold any key.
KEY_DIGITS = 19


def sample_pdf(key: int) -> bytes:
    """One page: a line of prose, a frame with two bars, and the caption below it; every fourth caption stands above its frame."""
    left, foot, wide, high = 90 + key % 40, 320 + key % 30, 180 + key % 200, 120 + key % 90
    frame = f"{left} {foot} m {left} {foot + high} l {left + wide} {foot + high} l {left + wide} {foot} l h S\n{left + 20} {foot + 10} 30 60 re f\n{left + 80} {foot + 10} 40 90 re f\n".encode()
    caption = shown(left, foot + high + 14 if key % 4 == 0 else foot - 30, 10, f"Figure {key}: measured for supplier {key}.")
    return pdf_file([shown(72, 640, 11, f"What follows concerns supplier {key}; see Figure {key}.") + frame + caption])


def sample_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' keys, which are not negative; a supplier without one has no file."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("key")).where("key IS NOT NULL")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key once, as suppliers of one key share a file; dealt over tasks by their number, as the table is small beside the work on the files."""
    keys = sample_keys(spark, sf_dir)
    return keys.repartition(keys.count() // FILES_PER_TASK + 1, "key").distinct()


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source_path, content), as a scan of a folder would give; the id is the supplier's key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].tolist()
            yield pd.DataFrame({"doc_id": [str(k) for k in keys], "source_path": [f"/papers/supplier {k}.pdf" for k in keys], "content": [sample_pdf(k) for k in keys]})

    return _keys(spark, sf_dir).mapInPandas(run, FILES)


def save_samples(spark: SparkSession, sf_dir: str, folder: str) -> int:
    """Writes the files to a folder that all executors share; how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        for batch in batches:
            for key in batch["key"].tolist():
                put(store, f"{root}/supplier {key}.pdf", sample_pdf(key))
            yield pd.DataFrame({"n": [len(batch)]})

    return _keys(spark, sf_dir).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
