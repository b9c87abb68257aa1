"""The figure dataset: <target>/<paper>/figure_001.png, .txt, .json and index.json."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figlake.functions import text as X
from figlake.sources.pdf import PdfReader, read_pages
from figlake.sources.reader import drawn, with_asked
from figlake.sources.store import materialised, opened, put


class NameClash(ValueError):
    """Documents that would share a directory."""


def metadata(row) -> dict:
    """Metadata of a figure, in the order in which it is written."""
    return {
        "figure_id": row["figure_id"],
        "label": row["label"],
        "number": row["number"],
        "page_number": int(row["page_number"]),
        "caption": row["caption"],
        "detection_method": row["detection_method"],
        "dpi": int(row["dpi"]),
        "bbox_pdf_points": {n: float(row["bbox"][n]) for n in ("x0", "top", "x1", "bottom")},
        "image_size_px": [int(row["width"]), int(row["height"])],
        "files": {"image": f"{row['stem']}.png", "caption": f"{row['stem']}.txt"},
    }


def _dump(value: dict) -> bytes:
    return json.dumps(value, indent=2, ensure_ascii=False).encode()


FIGURE = ("seq", "stem", "figure_id", "label", "number", "page_number", "caption", "detection_method", "dpi", "bbox", "width", "height", "crop")


def write_dataset(files: DataFrame, documents: DataFrame, figures: DataFrame, target: str, paper_name: str | None = None, reader: PdfReader = read_pages) -> None:
    """files with content; documents (doc_id, source_path); figures without pixels. The target is a folder or URI that all executors share.

    What is known of a document's figures goes to its file; the task that has the file draws and writes them, so no pixels are shuffled. Each file is
    written in one go, so a task that is run again writes the same files.
    """
    name = F.lit(paper_name) if paper_name else X.path_stem(F.col("source_path"))
    named = documents.withColumn("paper", X.safe_name(name))
    clash = named.groupBy("paper").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise NameClash(f"{clash[0].n} documents would be written to {clash[0].paper}")
    asked = figures.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*FIGURE))).alias("asked"))
    asked = materialised(named.join(asked, "doc_id", "left").withColumn("asked", F.coalesce("asked", F.array())))
    rows = with_asked(files.select("doc_id", "content"), asked, F.size("asked") + 1).select("paper", "source_path", "content", "asked")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(target)
        written = 0
        for batch in batches:
            for x in batch.itertuples(index=False):
                folder, entries, images = f"{root}/{x.paper}", [], {}
                pages = {int(a["page_number"]) for a in x.asked}
                for page in reader(bytes(x.content)) if pages else ():
                    images |= {a["stem"]: drawn(page, a)[0] for a in x.asked if a["page_number"] == page.number}
                for a in x.asked:
                    own = metadata(a)
                    if images.get(a["stem"]) is not None:
                        put(store, f"{folder}/{a['stem']}.png", images[a["stem"]])
                    put(store, f"{folder}/{a['stem']}.txt", a["caption"].encode())
                    put(store, f"{folder}/{a['stem']}.json", _dump(own))
                    entries.append({"stem": a["stem"], **own})
                put(store, f"{folder}/index.json", _dump({"source_pdf": x.source_path, "figures": entries}))
                written += len(entries)
        yield pd.DataFrame({"written": [written]})

    rows.mapInPandas(write, "written long").agg(F.sum("written")).collect()
