"""The engine: PDF files to pages, captions, figures and datasets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figlake.config import ExtractionConfig
from figlake.functions import geometry as G
from figlake.functions import text as X
from figlake.operators import captions, layout, regions, render, resolve
from figlake.sources.dataset import write_dataset
from figlake.sources.pdf import PdfReader, read_pages
from figlake.sources.reader import DetectorFactory, pdf_files, read_pdfs, render_figures
from figlake.sources.store import materialised

PAGE = ["doc_id", "page_number"]


@dataclass
class FigureEngine:
    """Two crossings to Python, to read files and to draw figures; all that is decided in between is Catalyst's."""

    spark: SparkSession
    config: ExtractionConfig = field(default_factory=ExtractionConfig)
    detector: DetectorFactory | None = None
    reader: PdfReader = read_pages

    def pages(self, files: DataFrame) -> DataFrame:
        return read_pdfs(files, self.config, self.detector, self.reader)

    @staticmethod
    def lines(pages: DataFrame) -> DataFrame:
        return pages.select(*PAGE, F.explode("lines").alias("x")).select(*PAGE, "x.*")

    @staticmethod
    def graphics(pages: DataFrame) -> DataFrame:
        return pages.select(*PAGE, F.explode("graphics").alias("x")).select(*PAGE, "x.*")

    def heuristic_candidates(self, pages: DataFrame) -> DataFrame:
        """Captions with the region that their page's own arrays give; nothing but the captions is shuffled."""
        digits = self.config.figure_number_digits
        own = pages.where(F.exists("lines", lambda x: X.is_anchor(x["text"], digits))).select(*PAGE, "page_box", "lines", "graphics")
        found = captions.find_captions(self.lines(pages), digits).join(own, PAGE)
        located = found.withColumn("at", regions.locate_on_page(F.col("box"), F.col("lines"), F.col("graphics"), F.col("page_box"), self.config))
        return located.select(*PAGE, F.lit("heuristic").alias("path"), F.col("caption_no").cast("int").alias("cand_no"), X.figure_id(F.col("number")).alias("figure_id"), "number", "label", F.col("text").alias("caption"), F.col("at.region").alias("region"), F.col("at.method").alias("detection_method"), "page_box")

    def layout_candidates(self, pages: DataFrame) -> DataFrame:
        scale = self.config.layout_detect_dpi / 72.0
        raw = pages.select(*PAGE, "page_box", F.explode("regions").alias("x")).select(*PAGE, "page_box", "x.*")
        text = X.collapsed(F.col("caption_text"))
        raw = raw.withColumn("caption_text", X.best_spacing(text, F.transform("variants", lambda t: X.collapsed(t)))).drop("variants")
        wide, high = (F.round(length(F.col("page_box")) * scale).cast("int") for length in (G.width, G.height))
        found = layout.normalize_regions(raw, wide, high)
        named = layout.name_figures(layout.figures_with_captions(found, self.config), self.config.figure_number_digits)
        region = layout.to_points(F.col("box"), F.col("page_box"), self.config.layout_detect_dpi)
        return named.select(*PAGE, F.lit("layout").alias("path"), F.col("index").cast("int").alias("cand_no"), "figure_id", "number", "label", F.col("caption_text").alias("caption"), region.alias("region"), F.lit("layout-model").alias("detection_method"), "page_box")

    def figures(self, pages: DataFrame) -> DataFrame:
        """One row per figure, without pixels: seq, stem, ids, caption, region, crop, dpi, width, height."""
        found = self.heuristic_candidates(pages)
        use_layout = self.detector is not None and self.config.layout_on
        if use_layout:
            found = self.layout_candidates(pages).unionByName(found)
        found = found.withColumn("crop", render.crop_box(F.col("region"), F.col("page_box"), self.config)).withColumn("renderable", render.renderable(F.col("crop")))
        if use_layout:
            kept = resolve.resolve_documents(found).select("doc_id", "page_number", "path", "figure_id", "cand_no")
            found = found.join(kept, ["doc_id", "page_number", "path", "figure_id", "cand_no"], "left_semi")
        else:
            found = resolve.first_wins(found)
        dpi = render.effective_dpi(F.greatest(G.width(F.col("crop")), G.height(F.col("crop"))), self.config)
        out = resolve.document_order(found).withColumn("dpi", dpi)
        size = {n: render.pixels(f(F.col("crop")), F.col("dpi")) for n, f in (("width", G.width), ("height", G.height))}
        return out.withColumns(size).select("doc_id", "page_number", "seq", "stem", "figure_id", "label", "number", "caption", F.col("region").alias("bbox"), "detection_method", "dpi", "width", "height", "crop")

    def rendered(self, files: DataFrame, figures: DataFrame) -> DataFrame:
        images = render_figures(files, figures, self.reader)
        return figures.join(images, ["doc_id", "page_number", "figure_id"], "left")

    def process(self, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(files, pages, figures) of the PDF files under a path."""
        files = pdf_files(self.spark, path)
        return files, *self.extract(files)

    def extract(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pages, figures), computed now and kept: every file is read, and every page shown to the detector, once."""
        pages = materialised(self.pages(files))
        return pages, materialised(self.figures(pages))

    def export(self, files: DataFrame, pages: DataFrame, figures: DataFrame, target: str, paper_name: str | None = None) -> None:
        """Writes a directory per document with PNG, TXT and JSON files and an index; documents without figures get an index too."""
        documents = pages.where("page_number IS NOT NULL").groupBy("doc_id").agg(F.min("source_path").alias("source_path"))
        write_dataset(files, documents, figures, target, paper_name, self.reader)

    def register(self, pages: DataFrame, figures: DataFrame) -> None:
        """Temporary views pages, lines, graphics and figures for SQL."""
        for name, df in (("pages", pages), ("lines", self.lines(pages)), ("graphics", self.graphics(pages)), ("figures", figures)):
            df.createOrReplaceTempView(name)
