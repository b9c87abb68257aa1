"""One PDF from the command line: python -m figlake.cli paper.pdf -o dataset"""

from __future__ import annotations

import argparse
import io
import logging
import os
import sys
import tempfile
import zipfile

from pyspark.sql import SparkSession

from figlake.config import ExtractionConfig, load_env
from figlake.library import DocumentParser

#: Exit codes.
DONE, FAILED, NO_FILE = 0, 1, 2


def argument_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="figlake", description="Writes each figure of a paper, with its caption and metadata, to a folder.")
    p.add_argument("pdf", help="the paper")
    out = p.add_argument_group("output")
    out.add_argument("-o", "--output", default="dataset", metavar="FOLDER", help="where the paper's folder goes")
    out.add_argument("--name", metavar="NAME", help="what the paper's folder is called (else as the file)")
    out.add_argument("--dpi", type=int, default=300, help="pixels an inch of the images")
    p.add_argument("--no-layout-model", action="store_true", help="find figures from captions and geometry only")
    p.add_argument("-v", "--verbose", action="store_true", help="log more")
    return p


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, where it may not be installed."""
    root, held = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("figlake", os.path.relpath(path, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="figlake-"), "figlake.zip")  # the driver serves it to the executors
    with open(path, "wb") as f:
        f.write(held.getvalue())
    spark.sparkContext.addPyFile(path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code. A resolution below 72 raises ValueError."""
    args = argument_parser().parse_args(argv)
    load_env()
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(levelname)s %(message)s")
    layout = {"use_layout_model": False} if args.no_layout_model else {}
    config = ExtractionConfig(resolution=args.dpi, **layout)
    if not os.path.isfile(args.pdf):
        logging.error("there is no file %s", args.pdf)
        return NO_FILE
    if spark is None:
        spark = SparkSession.builder.appName("figlake").getOrCreate()
        ship(spark)
    parser = DocumentParser(spark, config)
    try:
        document = parser.parse(args.pdf)
        parser.export(document, args.output, args.name)
    except Exception as e:  # noqa: BLE001
        logging.error("%s", e)
        return FAILED
    print(f"{len(document.figures)} figures of {len(document.pages)} pages are in {args.output}")
    return DONE


def run() -> None:
    sys.exit(main())


if __name__ == "__main__":
    run()
