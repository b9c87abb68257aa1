"""PDF files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from figlake.session import FigureEngine
from figlake.sources.reader import with_ids

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """New PDF files under a path; bytes that came before, in any file, come no more."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.pdf").load(path)
    return with_ids(files).dropDuplicates(["doc_id"])


def ingest(engine: FigureEngine, path: str, checkpoint: str, sink: Callable[[DataFrame, DataFrame, DataFrame, int], None]) -> StreamingQuery:
    """Hands (files, pages, figures, batch) of what is there to sink, then ends; the next call goes on from the checkpoint. A batch may be handed over again after a failure."""

    def batch(files: DataFrame, number: int) -> None:
        sink(files, *engine.extract(files), number)

    return stream_files(engine.spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
