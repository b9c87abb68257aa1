"""Lines, graphics and regions derived from the benchmark tables, which hold no PDFs; pages are 612 x 792 points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figlake.functions import geometry as G

def page_box() -> Column:
    return G.box(0.0, 0.0, 612.0, 792.0)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    odd = "doc_id % 4 = 2 AND line_no % 2 = 1"
    x0 = f"CASE WHEN {odd} THEN 340e0 ELSE 72e0 END"
    top = "((line_no % 8) DIV 2) * 180 + (line_no % 2) * 16 + ((line_no * 5) % 3) * 4"
    marked = """CASE WHEN (doc_id * 7 + line_no) % 11 = 3 THEN concat('Figure ', line_no % 9 + 1,
        CASE (doc_id + line_no) % 4 WHEN 0 THEN ': ' WHEN 1 THEN '. ' WHEN 2 THEN ' - ' ELSE ' shows ' END, t) ELSE t END AS text"""
    return rows.selectExpr(
        "doc_id",
        "CAST(line_no DIV 8 + 1 AS BIGINT) AS page_number",
        "CAST(line_no AS BIGINT) AS line_no",
        marked,
        f"named_struct('x0', {x0}, 'top', 40e0 + {top}, 'x1', {x0} + least(length(t) + 8, CASE WHEN doc_id % 4 = 2 THEN 40 ELSE 80 END) * 5.5e0, 'bottom', 50e0 + {top}) AS box",
    )

def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))
    return table(spark, sf_dir, "lineitem").join(F.broadcast(n)).selectExpr("*", "l_orderkey % n_docs AS doc_id", "(l_linenumber - 1) % 3 + 1 AS page_number")

def graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = "CASE WHEN l_suppkey % 20 = 7 THEN 6e0 ELSE 72e0 + l_partkey % 300 END"
    x1 = "CASE l_suppkey % 20 WHEN 7 THEN 606e0 WHEN 9 THEN 72e0 + l_partkey % 300 ELSE 72e0 + l_partkey % 300 + l_quantity * 7 END"
    top = "40e0 + (l_orderkey * 37) % 700"
    high = "CASE WHEN l_suppkey % 20 = 7 THEN 1e0 ELSE l_quantity * 3 END"
    kind = "CASE l_suppkey % 4 WHEN 0 THEN 'image' ELSE 'vector' END AS kind"
    return _items(spark, sf_dir).selectExpr("doc_id", "page_number", kind, f"named_struct('x0', {x0}, 'top', {top}, 'x1', {x1}, 'bottom', {top} + {high}) AS box")

def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detections on page images of 1224 x 1584 pixels."""
    return _items(spark, sf_dir).selectExpr(
        "doc_id",
        "page_number",
        "CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS region_no",
        "CASE l_partkey % 3 WHEN 0 THEN 'Figure' WHEN 1 THEN ' Figure Caption ' ELSE 'Plain Text' END AS label",
        "(l_partkey % 320) * 4e0 - 20.3e0 AS x0",
        "(l_partkey % 320) * 4e0 - 20.3e0 + l_quantity * 14 AS x1",
        "((l_orderkey * 37) % 700) * 2 + 80.25e0 AS y0",
        "((l_orderkey * 37) % 700) * 2 + 80.25e0 + l_quantity * 6 AS y1",
        "l_discount * 10 AS confidence",
        "CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'no number here' ELSE concat('FIG. ', l_suppkey % 12 + 1, '. region caption') END AS caption_text",
    )
