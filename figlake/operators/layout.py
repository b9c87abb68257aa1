"""The layout path: regions of a detector become figures with the captions nearest to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figlake.config import ExtractionConfig
from figlake.functions import geometry as G
from figlake.functions import text as X

PAGE = ("doc_id", "page_number")
#: Added to the gap of a caption above its figure (fixed value, in pixels).
ABOVE_PENALTY = 40
FIGURE, CAPTION = "figure", "figure_caption"


def normalized_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(label)), " ", "_")


def normalize_regions(raw: DataFrame, wide: Column, high: Column) -> DataFrame:
    """Raw detections (label, x0, y0, x1, y1 as doubles) as regions with whole pixels inside the page image; degenerate ones go."""
    whole = lambda n: F.greatest(F.lit(0), F.col(n).cast("int"))
    box = F.struct(*[whole(n).alias(n) for n in ("x0", "y0", "x1", "y1")])
    out = raw.withColumn("box", G.pixel_clamped(box, wide, high)).withColumn("label", normalized_label(F.col("label")))
    return out.where("box.x1 > box.x0 and box.y1 > box.y0").drop("x0", "y0", "x1", "y1")


def figure_regions(regions: DataFrame, config: ExtractionConfig) -> DataFrame:
    return regions.where((F.col("label") == FIGURE) & (F.col("confidence") >= config.layout_min_confidence))


def reading_order(regions: DataFrame) -> DataFrame:
    """Adds index: 1, 2, ... from the top, then from the left, then as detected."""
    order = W.partitionBy(*PAGE).orderBy("box.y0", "box.x0", "region_no")
    return regions.withColumn("index", F.row_number().over(order))


def to_points(box: Column, page: Column, dpi: int) -> Column:
    scale = F.lit(72.0 / dpi)
    points = G.box(page["x0"] + box["x0"] * scale, page["top"] + box["y0"] * scale, page["x0"] + box["x1"] * scale, page["top"] + box["y1"] * scale)
    return G.clamped(points, page)


def caption_gap(figure: Column, caption: Column) -> Column:
    """Pixels between a figure and a caption; above costs more."""
    return F.when(caption["y0"] >= figure["y1"], caption["y0"] - figure["y1"]).when(caption["y1"] <= figure["y0"], figure["y0"] - caption["y1"] + ABOVE_PENALTY).otherwise(F.lit(0))


def figures_with_captions(regions: DataFrame, config: ExtractionConfig) -> DataFrame:
    """The confident figure regions with index (see reading_order) and caption: the nearest of their page that overlaps them sideways (struct of gap, region_no, text; null if none), the first detected of equals.

    A page's captions, few as they are, are gathered by a window, so regions are shuffled once; then an arg-min over them.
    """
    page = W.partitionBy(*PAGE)
    own = F.when(F.col("label") == CAPTION, F.struct("region_no", "box", F.col("caption_text").alias("text")))
    figures = figure_regions(regions.withColumn("captions", F.collect_list(own).over(page)), config)
    overlap = lambda c: F.least(F.col("box.x1"), c["box"]["x1"]) - F.greatest(F.col("box.x0"), c["box"]["x0"]) > 0
    rated = F.transform(F.filter("captions", overlap), lambda c: F.struct(caption_gap(F.col("box"), c["box"]).alias("gap"), c["region_no"].alias("region_no"), c["text"].alias("text")))
    return reading_order(figures.withColumn("caption", F.array_min(rated)).drop("captions"))


def name_figures(figures: DataFrame, digits: int = X.DIGITS) -> DataFrame:
    """Adds number, figure_id, label and caption_text: the number in the caption, else p<page>-<index>."""
    text = F.coalesce(F.col("caption.text"), F.lit(""))
    named = figures.withColumn("number", F.coalesce(X.caption_number(text, digits), F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("-"), F.col("index").cast("string"))))
    named = named.withColumn("figure_id", X.figure_id(F.col("number"))).withColumn("label", X.figure_label(F.col("number")))
    return named.withColumn("caption_text", F.when(text == "", X.missing_caption(F.col("label"))).otherwise(text))


def layout_figures(regions: DataFrame, page: Column, config: ExtractionConfig | None = None) -> DataFrame:
    """(doc_id, page_number, cand_no, figure_id, number, label, caption, region) of regions with caption_text."""
    config = config or ExtractionConfig()
    found = name_figures(figures_with_captions(regions, config), config.figure_number_digits)
    return found.select(*PAGE, F.col("index").alias("cand_no"), "figure_id", "number", "label", F.col("caption_text").alias("caption"), to_points(F.col("box"), page, config.layout_detect_dpi).alias("region"))
