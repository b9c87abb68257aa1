"""Page contents for PDF files of tests."""

from figlake.sources.pdf_writer import pdf_file, shown

#: A frame with two bars, and their boxes in points from the page's top.
DRAWING = b"90 300 m 90 520 l 400 520 l 400 300 l h S\n150 330 60 90 re f\n260 340 50 150 re f\n"
BOXES = [(90.0, 272.0, 400.0, 492.0), (150.0, 372.0, 210.0, 462.0), (260.0, 302.0, 310.0, 452.0)]
FRAME = BOXES[0]
#: Pixels of the frame's crop.
PIXELS = (1342, 967)


def build(*contents: bytes, size=(612, 792), flate=False) -> bytes:
    return pdf_file(list(contents), size, flate)


def text(x, y, size, words) -> bytes:
    return shown(x, y, size, words)


def figure(caption, y=270) -> bytes:
    """A page with a line that only mentions a figure, the drawing, and a caption below it."""
    return text(72, 640, 11, "Yields rose in both seasons, which Figure 9 of an earlier report shows too.") + DRAWING + text(95, y, 10, caption)
