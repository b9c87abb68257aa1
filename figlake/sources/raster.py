"""Pixels of a page with numpy, and PNG files with zlib.

Paths and simple images are drawn; of letters, as there are no font outlines, a block for each where its ink would be, so that lines, words and the shape of
lower and upper case show. The size in pixels is exact, the content is not meant to match a full renderer.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from figlake.sources.pdf import Page, Paint

#: A renderer takes (page, crop box in points, pixels wide, pixels high) and returns an array (high, wide, 3) of bytes.


def _fill(out: np.ndarray, polygons: list[np.ndarray], colour: tuple[int, int, int], even_odd: bool) -> None:
    high, wide = out.shape[:2]
    edges = [np.column_stack([p, np.roll(p, -1, axis=0)]) for p in polygons if len(p) > 2]
    if not edges:
        return
    e = np.concatenate(edges)
    e = e[e[:, 1] != e[:, 3]]
    if not len(e):
        return
    lo, hi = max(0, int(np.floor(e[:, [1, 3]].min()))), min(high, int(np.ceil(e[:, [1, 3]].max())) + 1)
    centres = np.arange(wide) + 0.5
    for row in range(lo, hi):
        y = row + 0.5
        down, up = (e[:, 1] <= y) & (e[:, 3] > y), (e[:, 3] <= y) & (e[:, 1] > y)
        cross = down | up
        if not cross.any():
            continue
        c = e[cross]
        xs = c[:, 0] + (y - c[:, 1]) / (c[:, 3] - c[:, 1]) * (c[:, 2] - c[:, 0])
        order = np.argsort(xs)
        turns = np.cumsum(np.where(down[cross], 1, -1)[order])
        at = np.searchsorted(xs[order], centres, side="right")
        inside = (at % 2 == 1) if even_odd else np.r_[0, turns][at] != 0
        out[row, inside] = colour


def _stroke(out: np.ndarray, points: np.ndarray, width: float, colour: tuple[int, int, int]) -> None:
    for a, b in zip(points[:-1], points[1:], strict=True):
        d = b - a
        length = float(np.hypot(*d))
        n = np.array([-d[1], d[0]]) / length * width / 2 if length else np.array([0.0, width / 2])
        along = d / length * width / 2 if length else np.array([width / 2, 0.0])
        _fill(out, [np.array([a - along + n, b + along + n, b + along - n, a - along - n])], colour, False)


def _image(out: np.ndarray, corners: np.ndarray, image: tuple[int, int, bytes]) -> None:
    w, h, data = image
    pixels = np.frombuffer(data, np.uint8).reshape(h, w, 3)
    u, v, origin = corners[1] - corners[0], corners[3] - corners[0], corners[0]
    det = u[0] * v[1] - u[1] * v[0]
    if not det:
        return
    (x0, y0), (x1, y1) = np.floor(corners.min(axis=0)).astype(int), np.ceil(corners.max(axis=0)).astype(int)
    x0, y0, x1, y1 = max(0, x0), max(0, y0), min(out.shape[1], x1), min(out.shape[0], y1)
    if x1 <= x0 or y1 <= y0:
        return
    x, y = np.meshgrid(np.arange(x0, x1) + 0.5 - origin[0], np.arange(y0, y1) + 0.5 - origin[1])
    s, t = (x * v[1] - y * v[0]) / det, (u[0] * y - u[1] * x) / det
    inside = (s >= 0) & (s < 1) & (t >= 0) & (t < 1)
    out[y0:y1, x0:x1][inside] = pixels[np.clip(((1 - t) * h).astype(int), 0, h - 1), np.clip((s * w).astype(int), 0, w - 1)][inside]


def render(page: Page, crop: tuple[float, float, float, float], wide: int, high: int) -> np.ndarray:
    out = np.full((high, wide, 3), 255, np.uint8)
    x0, top, x1, bottom = crop
    scale = np.array([wide / max(x1 - x0, 1e-9), high / max(bottom - top, 1e-9)])
    at = lambda points: (np.array(points, float) - (x0, top)) * scale
    for paint in page.paints:
        _draw(out, paint, [at(p) for p in paint.polygons], float(scale.mean()))
    _letters(out, page, at)
    return out


#: Heights of letters above the baseline and depths below it, as shares of the size.
_TALL, _LOW, _DEEP = 0.70, 0.50, 0.20
_INK, _SIDE = (48, 48, 48), 0.12


def _letters(out: np.ndarray, page: Page, at) -> None:
    inked = [c for c in page.chars if c.text.strip()]
    if not inked:
        return
    tall = np.array([c.text[0].isupper() or c.text[0].isdigit() or c.text[0] in "bdfhklt()[]|/" for c in inked])
    deep = np.array([c.text[0] in "gjpqy,;()[]|/" for c in inked])
    x0, x1, base, size = (np.array([getattr(c, n) for c in inked]) for n in ("x0", "x1", "base", "size"))
    side = (x1 - x0) * _SIDE
    first = at(np.column_stack([x0 + side, base - size * np.where(tall, _TALL, _LOW)])).round().astype(int)
    last = np.maximum(at(np.column_stack([x1 - side, base + size * np.where(deep, _DEEP, 0.0)])).round().astype(int), first + 1)
    for (a, b), (c, d) in zip(np.maximum(first, 0).tolist(), last.tolist(), strict=True):
        if c > a and d > b:
            out[b:d, a:c] = _INK


def _draw(out: np.ndarray, paint: Paint, polygons: list[np.ndarray], scale: float) -> None:
    if paint.image:
        _image(out, polygons[0], paint.image)
        return
    if paint.fill is not None:
        _fill(out, polygons, paint.fill, paint.even_odd)
    if paint.stroke is not None:
        for p in polygons:
            _stroke(out, p, max(1.0, paint.width * scale), paint.stroke)


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB PNG file."""
    high, wide = pixels.shape[:2]
    rows = np.zeros((high, 1 + 3 * wide), np.uint8)
    rows[:, 1:] = pixels.reshape(high, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
