"""Small PDF files: pages with content streams, one font and one image."""

from __future__ import annotations

import zlib
from itertools import accumulate

#: The font and the 2 x 2 image that every page may use, as /F1 and /Im1.
_SHARED = {
    3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    4: b"<< /Type /XObject /Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Length 12 >> stream\n%s\nendstream" % bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9]),
}


def _stream(content: bytes, flate: bool) -> bytes:
    data, name = (zlib.compress(content), b"/Filter /FlateDecode ") if flate else (content, b"")
    return b"<< %s/Length %d >> stream\n%s\nendstream" % (name, len(data), data)


def pdf_file(contents: list[bytes], size: tuple[float, float] = (612, 792), flate: bool = False) -> bytes:
    """A file with a page for each content stream; what all pages share stands in the page tree's root."""
    pages = {5 + k: (105 + len(contents) + k, content) for k, content in enumerate(contents)}
    kids = b" ".join(b"%d 0 R" % number for number in pages)
    shared = b"/Resources << /Font << /F1 3 0 R >> /XObject << /Im1 4 0 R >> >>"
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 %g %g] %s >>" % (len(pages), kids, *size, shared), **_SHARED}
    bodies |= {number: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % at for number, (at, _) in pages.items()}
    bodies |= {at: _stream(content, flate) for at, content in pages.values()}
    head, parts = b"%PDF-1.7\n", [b"%d 0 obj %s endobj\n" % x for x in bodies.items()]
    places = dict(zip(bodies, accumulate(map(len, parts), initial=len(head)), strict=False))
    sections = b"".join(b"%d 1\n%010d 00000 n\r\n" % x for x in places.items())  # a section for each object, as numbers have gaps
    end = len(head) + sum(map(len, parts))
    return b"%s%sxref\n%strailer << /Root 1 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF" % (head, b"".join(parts), sections, max(bodies) + 1, end)


def shown(x: float, y: float, size: float, words: str) -> bytes:
    """Operators that show words with their baseline at y from the page's foot."""
    escaped = words.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return b"BT /F1 %g Tf %g %g Td (%s) Tj ET\n" % (size, x, y, escaped)
