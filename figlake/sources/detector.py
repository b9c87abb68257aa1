"""Detectors made from the weights of a layout model, where the packages that run it are installed."""

from __future__ import annotations

import importlib.util
import logging
import os
from dataclasses import dataclass, field
from typing import Any

from figlake.config import ExtractionConfig

# The weights that are fetched where none are given, and the packages needed.
HUB_REPO, HUB_FILE = "juliozhao/DocLayout-YOLO-DocStructBench", "doclayout_yolo_docstructbench_imgsz1024.pt"
RUNTIME, HUB = "doclayout_yolo", "huggingface_hub"
IMAGE_SIDE = 1024


def weights(path: str | None = None) -> str:
    """The file given, else the one LAYOUT_MODEL_PATH names, else a download (kept by the hub's cache); ImportError if that needs a package that is missing."""
    found = path or os.environ.get("LAYOUT_MODEL_PATH")
    if found:
        return found
    try:
        from huggingface_hub import hf_hub_download
    except ImportError as e:
        raise ImportError(f"fetching the weights needs {HUB}; or name a file in LAYOUT_MODEL_PATH") from e
    return hf_hub_download(HUB_REPO, HUB_FILE)


class ModelDetector:
    """Regions that the model finds on a page image (high x wide x 3 bytes)."""

    def __init__(self, path: str | None, confidence: float, side: int, device: str):
        try:
            from doclayout_yolo import YOLOv10
        except ImportError as e:
            raise ImportError(f"the layout model needs the package {RUNTIME}") from e
        self.settings = {"imgsz": side, "conf": confidence, "device": device, "verbose": False}
        self.model = YOLOv10(weights(path))

    def detect(self, image: Any) -> list[tuple[str, float, float, float, float, float]]:
        out = []
        for result in self.model.predict(image[:, :, ::-1], **self.settings):  # arrays count as BGR
            boxes = result.boxes
            for corners, confidence, kind in zip(boxes.xyxy.tolist(), boxes.conf.tolist(), boxes.cls.tolist(), strict=True):
                out.append((result.names[int(kind)], *corners, confidence))
        return out


@dataclass(frozen=True)
class ModelFactory:
    """Makes a detector in a worker. The weights' path is taken from the driver's environment when the factory is made."""

    path: str | None = field(default_factory=lambda: os.environ.get("LAYOUT_MODEL_PATH"))
    confidence: float = 0.25
    side: int = IMAGE_SIDE
    device: str = "cpu"

    def __call__(self) -> ModelDetector:
        return ModelDetector(self.path, self.confidence, self.side, self.device)


def default_detector(config: ExtractionConfig) -> ModelFactory | None:
    """The factory for a configuration that has the layout path on; None, with a warning, if the packages are missing here."""
    if not config.layout_on:
        return None
    factory = ModelFactory(confidence=config.layout_min_confidence)
    missing = [name for name in ([RUNTIME] if factory.path else [RUNTIME, HUB]) if importlib.util.find_spec(name) is None]
    if missing:
        logging.getLogger(__name__).warning("no layout model (%s is not installed): figures are found from captions and geometry", " and ".join(missing))
        return None
    return factory
