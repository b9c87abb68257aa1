"""Settings of an extraction run."""

from __future__ import annotations

import os
from dataclasses import dataclass

#: Values of LAYOUT_DETECTION that switch the layout path off (fixed values).
OFF_VALUES = ("0", "off", "false", "no")


def layout_enabled(value: str | None) -> bool:
    """Whether a LAYOUT_DETECTION value leaves the layout path on: unset and empty do."""
    return (value or "").strip().lower() not in OFF_VALUES


def load_env(path: str = ".env") -> None:
    """Takes NAME=value lines of a file into the environment; what is set already stays, and a missing file is none."""
    if not os.path.isfile(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and name.strip() and not name.startswith("#"):
                os.environ.setdefault(name.strip(), value.strip().strip("'\""))


@dataclass(frozen=True)
class ExtractionConfig:
    """Lengths are in points (1/72 inch) unless a name says otherwise."""

    resolution: int = 300
    max_render_edge_px: int = 4000
    bbox_padding_pt: float = 6.0
    min_figure_width_pt: float = 60.0
    min_figure_height_pt: float = 40.0
    fallback_region_height_pt: float = 320.0
    use_layout_model: bool | None = None
    layout_detect_dpi: int = 144
    layout_min_confidence: float = 0.3
    #: Digits that a figure's number may have before a dot: captions of longer numbers are no captions.
    figure_number_digits: int = 3

    def __post_init__(self):
        if self.resolution < 72:
            raise ValueError(f"a resolution of {self.resolution} DPI is below 72")
        if self.figure_number_digits < 1:
            raise ValueError("a figure's number has a digit at least")

    @property
    def layout_on(self) -> bool:
        return layout_enabled(os.environ.get("LAYOUT_DETECTION")) if self.use_layout_model is None else self.use_layout_model
