"""The region of a figure from its caption: above it, else below it, else a window of fixed height.

Two forms with equal results: ``locate_regions`` joins the tables of lines and graphics on (doc_id, page_number);
``locate_on_page`` is an expression over the arrays that a page row holds, without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figlake.config import ExtractionConfig
from figlake.functions import geometry as G

PAGE = ("doc_id", "page_number")
KEY = (*PAGE, "caption_no")
# Fixed values, in points but for the shares.
COLUMN_SLACK, CAPTION_GAP, FALLBACK_GAP, BAND_HEIGHT = 15.0, 1.0, 2.0, 25.0
BOUNDARY_SHARE, RULE_SHARE, RULE_HEIGHT = 0.5, 0.9, 3.0
IMAGE, VECTOR, FALLBACK = "embedded-image", "vector-cluster", "caption-fallback"
DIRECTIONS = ("above", "below")


def column_of(caption: Column, page: Column) -> Column:
    """The caption's strip of the page, with some slack."""
    return G.box(F.greatest(page["x0"], caption["x0"] - COLUMN_SLACK), page["top"], F.least(page["x1"], caption["x1"] + COLUMN_SLACK), page["bottom"])


def is_boundary(line: Column, caption: Column, column: Column, direction: str) -> Column:
    """Whether a line is a paragraph that ends the band on that side of the caption."""
    side = line["bottom"] <= caption["top"] - CAPTION_GAP if direction == "above" else line["top"] >= caption["bottom"] + CAPTION_GAP
    wide = G.width(line) >= BOUNDARY_SHARE * F.greatest(G.width(caption), F.lit(1.0))
    return side & wide & (G.horizontal_overlap(line, column) > 0)


def band(caption: Column, column: Column, page: Column, edge: Column, direction: str) -> Column:
    """From the nearest boundary (null: none) to the caption; null if it is too low to be used."""
    if direction == "above":
        out = G.box(column["x0"], F.greatest(page["top"], edge), column["x1"], caption["top"] - CAPTION_GAP)
    else:
        out = G.box(column["x0"], caption["bottom"] + CAPTION_GAP, column["x1"], F.least(page["bottom"], edge))
    return F.when(G.height(out) >= BAND_HEIGHT, out)


def in_band(graphic: Column, kind: Column, area: Column, page: Column) -> Column:
    center = G.vertical_center(graphic)
    rule = (kind == "vector") & (G.width(graphic) > RULE_SHARE * G.width(page)) & (G.height(graphic) < RULE_HEIGHT)
    return (center >= area["top"]) & (center <= area["bottom"]) & (G.horizontal_overlap(graphic, area) > 0) & ~rule


def plausible(hull: Column, config: ExtractionConfig) -> Column:
    return (G.width(hull) >= config.min_figure_width_pt) & (G.height(hull) >= config.min_figure_height_pt)


def clipped(hull: Column, area: Column, page: Column) -> Column:
    """Sideways to the page, up and down to the band."""
    return G.box(F.greatest(hull["x0"], page["x0"]), F.greatest(hull["top"], area["top"]), F.least(hull["x1"], page["x1"]), F.least(hull["bottom"], area["bottom"]))


def fallback(caption: Column, column: Column, page: Column, config: ExtractionConfig) -> Column:
    high = config.fallback_region_height_pt
    top = F.greatest(page["top"], caption["top"] - high)
    bottom = F.greatest(top + 1.0, caption["top"] - FALLBACK_GAP)
    under = F.least(page["bottom"], caption["bottom"] + high)
    over = F.least(caption["bottom"] + FALLBACK_GAP, under - 1.0)
    low = (bottom - top) < config.min_figure_height_pt
    return G.box(column["x0"], F.when(low, over).otherwise(top), column["x1"], F.when(low, under).otherwise(bottom))


def content_bands(captions: DataFrame, lines: DataFrame, direction: str, page: Column) -> DataFrame:
    """(key, caption, column, band): an equi-join on the page with the side as residual, then one aggregate."""
    own = captions.select(*KEY, F.col("box").alias("caption")).withColumn("column", column_of(F.col("caption"), page))
    seen = lines.select(*PAGE, F.col("box").alias("line"))
    joined = own.join(seen, list(PAGE), "left")
    hit = is_boundary(F.col("line"), F.col("caption"), F.col("column"), direction)
    edge = F.max(F.when(hit, F.col("line.bottom"))) if direction == "above" else F.min(F.when(hit, F.col("line.top")))
    edges = joined.groupBy(*KEY).agg(F.first("caption").alias("caption"), F.first("column").alias("column"), edge.alias("edge"))
    return edges.select(*KEY, "caption", "column", band(F.col("caption"), F.col("column"), page, F.col("edge"), direction).alias("band"))


def graphics_in_bands(bands: DataFrame, graphics: DataFrame, page: Column) -> DataFrame:
    """(key, band, kind, graphic): what a band holds, page-wide rules left out."""
    usable = bands.where(F.col("band").isNotNull())
    joined = usable.join(graphics.select(*PAGE, "kind", F.col("box").alias("graphic")), list(PAGE))
    return joined.where(in_band(F.col("graphic"), F.col("kind"), F.col("band"), page)).select(*KEY, "band", "kind", "graphic")


def detected_regions(bands: DataFrame, graphics: DataFrame, page: Column, config: ExtractionConfig) -> DataFrame:
    """(key, region, method) of the bands whose graphics look like a figure."""
    held = graphics_in_bands(bands, graphics, page)
    hulls = held.groupBy(*KEY).agg(G.hull(F.col("graphic")).alias("hull"), F.first("band").alias("band"), F.bool_or(F.col("kind") == "image").alias("raster"))
    return hulls.where(plausible(F.col("hull"), config)).select(*KEY, clipped(F.col("hull"), F.col("band"), page).alias("region"), F.when(F.col("raster"), IMAGE).otherwise(VECTOR).alias("method"))


def locate_regions(captions: DataFrame, lines: DataFrame, graphics: DataFrame, page: Column, config: ExtractionConfig | None = None) -> DataFrame:
    """captions with (region, method, direction); page is the page's box as a Column that holds for all rows.

    One pass: captions meet the lines of their page once, for the edges of both bands, and its graphics once, for the hulls in both.
    """
    config = config or ExtractionConfig()
    own = captions.select(*KEY, F.struct(*captions.columns).alias("own"), F.col("box").alias("caption")).withColumn("column", column_of(F.col("caption"), page))
    met = own.join(lines.select(*PAGE, F.col("box").alias("line")), list(PAGE), "left")
    hit = {d: is_boundary(F.col("line"), F.col("caption"), F.col("column"), d) for d in DIRECTIONS}
    edges = met.groupBy(*KEY).agg(
        F.first("own").alias("own"),
        F.first("column").alias("column"),
        F.max(F.when(hit["above"], F.col("line.bottom"))).alias("above"),
        F.min(F.when(hit["below"], F.col("line.top"))).alias("below"),
    )
    bands = edges.withColumns({d: band(F.col("own.box"), F.col("column"), page, F.col(d), d) for d in DIRECTIONS})
    met = bands.join(graphics.select(*PAGE, "kind", F.col("box").alias("graphic")), list(PAGE), "left")
    held = {d: F.coalesce(in_band(F.col("graphic"), F.col("kind"), F.col(d), page), F.lit(False)) for d in DIRECTIONS}
    hulls = met.groupBy(*KEY).agg(
        *[F.first(c).alias(c) for c in ("own", "column", *DIRECTIONS)],
        *[G.hull(F.when(held[d], F.col("graphic"))).alias(f"{d}_hull") for d in DIRECTIONS],
        *[F.bool_or(held[d] & (F.col("kind") == "image")).alias(f"{d}_raster") for d in DIRECTIONS],
    )
    at = {d: F.when(F.coalesce(plausible(F.col(f"{d}_hull"), config), F.lit(False)), clipped(F.col(f"{d}_hull"), F.col(d), page)) for d in DIRECTIONS}
    located = hulls.select("own", "column", *[at[d].alias(d) for d in DIRECTIONS], *[F.when(F.col(f"{d}_raster"), IMAGE).otherwise(VECTOR).alias(f"{d}_method") for d in DIRECTIONS])
    first = lambda above, below, rest: F.when(F.col("above").isNotNull(), above).when(F.col("below").isNotNull(), below).otherwise(rest)
    return located.select(
        "own.*",
        F.coalesce("above", "below", fallback(F.col("own.box"), F.col("column"), page, config)).alias("region"),
        first(F.col("above_method"), F.col("below_method"), F.lit(FALLBACK)).alias("method"),
        first(F.lit("above"), F.lit("below"), F.lit("fallback")).alias("direction"),
    )


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def locate_on_page(caption: Column, lines: Column, graphics: Column, page: Column, config: ExtractionConfig | None = None) -> Column:
    """A struct (region, method, direction) from the arrays of the caption's page."""
    config = config or ExtractionConfig()

    def side(caption: Column, column: Column, direction: str) -> Column:
        edges = F.transform(F.filter(lines, lambda x: is_boundary(x["box"], caption, column, direction)), lambda x: x["box"]["bottom" if direction == "above" else "top"])
        edge = F.array_max(edges) if direction == "above" else F.array_min(edges)

        def of_band(area: Column) -> Column:
            def of_held(held: Column) -> Column:
                least = lambda n: F.array_min(F.transform(held, lambda x: x["box"][n]))
                most = lambda n: F.array_max(F.transform(held, lambda x: x["box"][n]))
                method = F.when(F.exists(held, lambda x: x["kind"] == "image"), IMAGE).otherwise(VECTOR)

                def of_hull(hull: Column) -> Column:
                    return F.when((F.size(held) > 0) & plausible(hull, config), F.struct(clipped(hull, area, page).alias("region"), method.alias("method"), F.lit(direction).alias("direction")))

                return _let(G.box(least("x0"), least("top"), most("x1"), most("bottom")), of_hull)

            return F.when(area.isNotNull(), _let(F.filter(graphics, lambda x: in_band(x["box"], x["kind"], area, page)), of_held))

        return _let(band(caption, column, page, edge, direction), of_band)

    def whole(caption: Column) -> Column:
        def of_column(column: Column) -> Column:
            rest = F.struct(fallback(caption, column, page, config).alias("region"), F.lit(FALLBACK).alias("method"), F.lit("fallback").alias("direction"))
            return F.coalesce(side(caption, column, "above"), side(caption, column, "below"), rest)

        return _let(column_of(caption, page), of_column)

    return _let(caption, whole)
