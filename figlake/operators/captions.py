"""Captions: anchor lines and the lines that follow them closely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figlake.functions import geometry as G
from figlake.functions import text as X

PAGE = ("doc_id", "page_number")
#: A paragraph ends at a gap above this share of the line before, which counts as this high at least.
GAP_SHARE, LEAST_HEIGHT = 0.8, 6.0


def find_captions(lines: DataFrame, digits: int = X.DIGITS) -> DataFrame:
    """(doc_id, page_number, caption_no, number, label, text, box) of lines (doc_id, page_number, line_no, text, box).

    A caption is an anchor line and what follows until another anchor or a gap: gaps and islands, one sort per page.
    """
    order = W.partitionBy(*PAGE).orderBy("line_no")
    before = F.lag("box").over(order)
    gap = F.col("box.top") - before["bottom"]
    breaks = X.is_anchor(F.col("text"), digits) | before.isNull() | (gap > GAP_SHARE * F.greatest(G.height(before), F.lit(LEAST_HEIGHT)))
    marked = lines.withColumn("anchor", X.is_anchor(F.col("text"), digits)).withColumn("breaks", F.when(breaks, 1).otherwise(0))
    grouped = marked.withColumn("run", F.sum("breaks").over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: X.stripped(x["text"]))
    captions = grouped.groupBy(*PAGE, "run").agg(
        G.hull(F.col("box")).alias("box"),
        X.stripped(F.array_join(parts, " ")).alias("text"),
        F.min(F.struct("line_no", "anchor", F.col("text").alias("first"))).alias("head"),
    )
    captions = captions.where("head.anchor").withColumn("number", X.anchor_number(F.col("head.first"), digits))
    return captions.select(*PAGE, F.col("head.line_no").alias("caption_no"), "number", X.figure_label(F.col("number")).alias("label"), "text", "box")
