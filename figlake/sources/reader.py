"""PDF files as a table of pages, and the pixels of figures."""

from __future__ import annotations

import logging
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figlake import schemas as S
from figlake.config import ExtractionConfig
from figlake.sources.pdf import Page, PdfError, PdfReader, read_pages
from figlake.sources.store import materialised

#: (label, x0, y0, x1, y1, confidence) in pixels of the page image.
Detection = tuple[str, float, float, float, float, float]
#: Word gaps, as shares of the character size, with which a caption region is read again (fixed values).
TIGHTER_GAPS = (0.15, 0.1, 0.07)
#: Points that a caption region is widened by, and the side below which it holds no text.
REGION_PAD, REGION_SIDE = 2.0, 1.0
#: Paths of repeated files that may be broadcast.
BROADCAST_PATHS = 100_000
#: Figures (of about a kilobyte) that may be broadcast to the files that they are drawn from.
BROADCAST_FIGURES = 50_000
#: PDF files in one batch of a Python worker.
FILES_PER_BATCH = 8


class RegionDetector(Protocol):
    """Finds regions on a page image (bytes, high x wide x 3)."""

    def detect(self, image: Any) -> list[Detection]: ...


#: Makes a detector in a worker; must be picklable. What it makes is kept for the worker's life.
DetectorFactory = Callable[[], RegionDetector]

PAGES = T.StructType([*S.PAGES.fields, T.StructField("regions", T.ArrayType(T.StructType([
    T.StructField("region_no", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("x0", T.DoubleType()), T.StructField("y0", T.DoubleType()),
    T.StructField("x1", T.DoubleType()), T.StructField("y1", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("caption_text", T.StringType()), T.StructField("variants", T.ArrayType(T.StringType())),
])))])
_held: dict[Any, Any] = {}


@dataclass(frozen=True)
class Reader:
    """What happens to a file in a worker."""

    config: ExtractionConfig
    detector: DetectorFactory | None = None
    read: PdfReader = read_pages

    def _detector(self) -> RegionDetector | None:
        """Made once per worker; a detector that cannot be made is not tried again."""
        if self.detector is None or not self.config.layout_on:
            return None
        if self.detector not in _held:
            try:
                _held[self.detector] = self.detector()
            except Exception as e:  # noqa: BLE001  pages then take the heuristic path
                logging.getLogger(__name__).warning("no layout model (%s): figures are found from captions and geometry", e)
                _held[self.detector] = None
        return _held[self.detector]

    def _regions(self, page: Page) -> list[dict]:
        detector = self._detector()
        if detector is None:
            return []
        from figlake.sources.raster import render

        scale = self.config.layout_detect_dpi / 72.0
        x0, top, x1, bottom = page.box
        out = []
        try:
            found = detector.detect(render(page, page.box, max(1, round((x1 - x0) * scale)), max(1, round((bottom - top) * scale))))
        except Exception as e:  # noqa: BLE001  a page that the detector fails on takes the heuristic path
            logging.getLogger(__name__).warning("the layout model failed on page %s: %s", page.number, e)
            return []
        for k, (label, a, b, c, d, confidence) in enumerate(found):
            area = (max(x0, x0 + a / scale - REGION_PAD), max(top, top + b / scale - REGION_PAD), min(x1, x0 + c / scale + REGION_PAD), min(bottom, top + d / scale + REGION_PAD))
            texts = ["", *[""] * len(TIGHTER_GAPS)]
            if area[2] - area[0] > REGION_SIDE and area[3] - area[1] > REGION_SIDE and "caption" in label.lower():
                texts = [page.text_in(area), *[page.text_in(area, gap) for gap in TIGHTER_GAPS]]
            out.append({"region_no": k, "label": label, "x0": float(a), "y0": float(b), "x1": float(c), "y1": float(d), "confidence": float(confidence), "caption_text": texts[0], "variants": texts[1:]})
        return out

    def rows(self, doc_id: str, path: str, content: bytes) -> Iterator[dict]:
        box = lambda b: dict(zip(("x0", "top", "x1", "bottom"), map(float, b), strict=True))
        finite = lambda b: all(abs(v) < float("inf") for v in b)
        try:
            for page in self.read(content):
                lines = [(t, b) for t, b in page.lines() if finite(b)]
                graphics = [("image" if kind == "image" else "vector", b) for kind, b in page.graphics if finite(b)]
                order = {"image": 0, "vector": 1}
                graphics.sort(key=lambda g: order[g[0]])
                yield {
                    "doc_id": doc_id, "source_path": path, "page_number": page.number, "page_box": box(page.box), "text": page.text,
                    "lines": [{"line_no": k, "text": t, "box": box(b)} for k, (t, b) in enumerate(lines)],
                    "graphics": [{"obj_no": k, "kind": kind, "box": box(b)} for k, (kind, b) in enumerate(graphics)],
                    "error": page.error, "regions": self._regions(page),
                }
        except (PdfError, zlib.error) as e:
            yield {"doc_id": doc_id, "source_path": path, "page_number": None, "page_box": None, "text": None, "lines": [], "graphics": [], "error": str(e) or type(e).__name__, "regions": []}


def pdf_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(doc_id, source_path, content) of PDF files: the id is the SHA-256 of the bytes. Files of equal bytes are one document, by the least path.

    Bytes are hashed once, into a table of ids. Few paths are broadcast to the files; of many, only those of repeated files.
    """
    loaded = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    ids = materialised(with_ids(loaded).select("doc_id", "source_path"))
    first = ids.groupBy("doc_id").agg(F.min("source_path").alias("source_path"))
    if ids.count() <= BROADCAST_PATHS:
        return loaded.select(_path(), "content").join(F.broadcast(first), "source_path").select("doc_id", "source_path", "content")
    again = materialised(ids.join(first, ["doc_id", "source_path"], "left_anti").select("source_path"))
    return with_ids(loaded).join(F.broadcast(again) if again.count() <= BROADCAST_PATHS else again, "source_path", "left_anti").select("doc_id", "source_path", "content")


def _path() -> Column:
    return F.regexp_replace("path", r"^file:/+", "/").alias("source_path")


def with_ids(files: DataFrame) -> DataFrame:
    return files.select(F.sha2("content", 256).alias("doc_id"), _path(), "content")


def with_asked(files: DataFrame, asked: DataFrame, weight: Column) -> DataFrame:
    """Joins asked (doc_id, ..) to the files: broadcast if the sum of its rows' weights is small, so that files stay where they are."""
    few = asked.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0] <= BROADCAST_FIGURES
    return files.join(F.broadcast(asked) if few else asked.hint("shuffle_hash"), "doc_id")


def read_pdfs(files: DataFrame, config: ExtractionConfig | None = None, detector: DetectorFactory | None = None, reader: PdfReader = read_pages) -> DataFrame:
    """One row per page with nested lines, graphics and detected regions; a file that cannot be read is one row with an error."""
    own = Reader(config or ExtractionConfig(), detector, reader)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), FILES_PER_BATCH):
                part = batch.iloc[k : k + FILES_PER_BATCH]
                rows = [r for x in part.itertuples(index=False) for r in own.rows(x.doc_id, x.source_path, bytes(x.content))]
                yield pd.DataFrame(rows, columns=PAGES.fieldNames())

    return files.select("doc_id", "source_path", "content").mapInPandas(run, PAGES)


def drawn(page: Page, figure: Any) -> tuple[bytes | None, str | None]:
    """(PNG file, error) of a figure's crop."""
    from figlake.sources.raster import png, render

    try:
        return png(render(page, tuple(figure["crop"][n] for n in ("x0", "top", "x1", "bottom")), int(figure["width"]), int(figure["height"]))), None
    except (ValueError, MemoryError) as e:
        return None, str(e)


IMAGES = "doc_id string, page_number int, figure_id string, png binary, render_error string"


def render_figures(files: DataFrame, figures: DataFrame, reader: PdfReader = read_pages) -> DataFrame:
    """(doc_id, page_number, figure_id, png, render_error): each file is opened once for all its figures; only names and boxes are shuffled with it."""
    item = F.struct("page_number", "figure_id", "crop", "width", "height")
    asked = materialised(figures.groupBy("doc_id").agg(F.collect_list(item).alias("asked")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples(index=False):
                wanted: dict[int, list] = {}
                for a in x.asked:
                    wanted.setdefault(a["page_number"], []).append(a)
                for page in reader(bytes(x.content)):
                    rows = []
                    for a in wanted.get(page.number, ()):
                        image, error = drawn(page, a)
                        rows.append((x.doc_id, page.number, a["figure_id"], image, error))
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "page_number", "figure_id", "png", "render_error"])

    return with_asked(files, asked, F.size("asked")).select("doc_id", "content", "asked").mapInPandas(run, IMAGES)
