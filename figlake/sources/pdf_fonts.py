"""Text and widths of PDF fonts, as far as a reader without font files can tell."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

# Advance widths of Helvetica for the codes 32 to 126, in thousandths of the size.
_HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
_OTHER_WIDTH, _FIXED_WIDTH, _DESCENT = 556, 600, -207
#: Glyph names that are no single letter (fixed values).
_GLYPHS = {"space": " ", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "hyphen": "-", "endash": "–", "emdash": "—", "parenleft": "(", "parenright": ")", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "fi": "fi", "fl": "fl", "ff": "ff", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "bar": "|", "slash": "/", "bullet": "•"}


def _glyph(name: str) -> str:
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})", name):
        return chr(int(m[1], 16))
    return name if len(name) == 1 else _GLYPHS.get(name, "")


def _unicode_map(data: bytes) -> tuple[dict[int, str], int]:
    """(text of each code, bytes of a code) of a ToUnicode map."""
    out: dict[int, str] = {}
    size = 1
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
    for block in re.findall(rb"begincodespacerange(.*?)endcodespacerange", data, re.S):
        for lo in re.findall(rb"<([0-9A-Fa-f]+)>", block):
            size = max(size, len(lo) // 2)
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(code, 16)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for lo, hi, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            first, last = int(lo, 16), min(int(hi, 16), int(lo, 16) + 65535)
            if to:
                start = text(to)
                for k in range(first, last + 1):
                    out[k] = start[:-1] + chr(ord(start[-1]) + k - first) if start else ""
            else:
                for k, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many)):
                    out[first + k] = text(x)
    return out, size


class Font:
    def __init__(self, codes: dict[int, str] | None, size: int, widths: dict[int, float], other: float, descent: float):
        self.codes, self.size, self.widths, self.other, self.descent = codes, size, widths, other, descent

    @classmethod
    def of(cls, document: Any, info: dict) -> Font:
        get = document.get
        name = str(get(info.get("BaseFont")) or "")
        mapped = get(info.get("ToUnicode"))
        codes, size = _unicode_map(document.decoded(mapped)) if hasattr(mapped, "raw") else ({}, 1)
        if get(info.get("Subtype")) == "Type0":
            below = get((get(info.get("DescendantFonts")) or [{}])[0]) or {}
            widths: dict[int, float] = {}
            items = [get(x) for x in get(below.get("W")) or []]
            while len(items) >= 2:
                if isinstance(items[1], list):
                    widths |= {items[0] + k: float(get(w)) for k, w in enumerate(items[1])}
                    items = items[2:]
                elif len(items) >= 3:
                    widths |= dict.fromkeys(range(items[0], min(items[1], items[0] + 65535) + 1), float(items[2]))
                    items = items[3:]
                else:
                    break
            return cls(codes, 2, widths, float(get(below.get("DW")) or 1000), _DESCENT)
        encoding = get(info.get("Encoding"))
        table = {k: bytes([k]).decode("cp1252", "ignore") for k in range(32, 256)}
        if isinstance(encoding, dict):
            at = 0
            for x in map(get, get(encoding.get("Differences")) or []):
                if isinstance(x, int):
                    at = x
                else:
                    table[at] = _glyph(str(x))
                    at += 1
        first = get(info.get("FirstChar")) or 0
        given = get(info.get("Widths"))
        fixed = "Courier" in name
        widths = {first + k: float(get(w)) for k, w in enumerate(given)} if given else {k + 32: float(_FIXED_WIDTH if fixed else w) for k, w in enumerate(_HELVETICA)}
        descriptor = get(info.get("FontDescriptor")) or {}
        return cls(table | codes, 1, widths, float(_FIXED_WIDTH if fixed else _OTHER_WIDTH), float(get(descriptor.get("Descent")) or _DESCENT))

    def decode(self, data: bytes) -> Iterator[tuple[str, float, bool]]:
        """(text, width, whether word spacing applies) of every code."""
        for k in range(0, len(data) - self.size + 1, self.size):
            code = int.from_bytes(data[k : k + self.size], "big")
            yield self.codes.get(code, ""), self.widths.get(code, self.other), self.size == 1 and code == 32
