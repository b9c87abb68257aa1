"""What is decided about a crop before any pixel is drawn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from figlake.config import ExtractionConfig
from figlake.functions import geometry as G

#: Sides below this are not rendered, and the reduced resolution does not fall below this (fixed values).
LEAST_SIDE, LEAST_DPI = 4.0, 72


def effective_dpi(longest: Column, config: ExtractionConfig) -> Column:
    """The resolution, reduced where the longest side would exceed max_render_edge_px."""
    reduced = F.greatest(F.lit(LEAST_DPI), F.floor(F.lit(config.max_render_edge_px * 72.0) / longest).cast("int"))
    return F.when(longest * F.lit(config.resolution) / F.lit(72.0) > F.lit(config.max_render_edge_px), reduced).otherwise(F.lit(config.resolution))


def crop_box(region: Column, page: Column, config: ExtractionConfig) -> Column:
    return G.clamped(G.padded(region, config.bbox_padding_pt), page)


def renderable(crop: Column) -> Column:
    return (G.width(crop) >= LEAST_SIDE) & (G.height(crop) >= LEAST_SIDE)


def pixels(length: Column, dpi: Column) -> Column:
    """Whole pixels of a length in points, at least one."""
    return F.greatest(F.lit(1), F.floor(length * dpi / F.lit(72.0) + F.lit(0.5)).cast("int"))
