"""Schemas of the tables. Boxes are in points, origin at the top left, y downwards; pixel boxes are in pixels of a page image."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "top", "x1", "bottom")])
PIXEL_BOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x0", "y0", "x1", "y1")])

LINE = T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("box", BOX)])
GRAPHIC = T.StructType([T.StructField("obj_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("box", BOX)])

_KEY = [T.StructField("doc_id", T.StringType()), T.StructField("page_number", T.IntegerType())]
LINES = T.StructType([*_KEY, *LINE.fields])
GRAPHICS = T.StructType([*_KEY, *GRAPHIC.fields])
#: One row per page as the PDF source reads it; error says why a page or file could not be read.
PAGES = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("page_box", BOX),
        T.StructField("text", T.StringType()),
        T.StructField("lines", T.ArrayType(LINE)),
        T.StructField("graphics", T.ArrayType(GRAPHIC)),
        T.StructField("error", T.StringType()),
    ]
)
#: caption_text and variants are the text inside a caption region, read with the default and with tighter word spacing.
REGIONS = T.StructType(
    [
        *_KEY,
        T.StructField("region_no", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("box", PIXEL_BOX),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("caption_text", T.StringType()),
    ]
)
METHODS = ("layout-model", "embedded-image", "vector-cluster", "caption-fallback")
