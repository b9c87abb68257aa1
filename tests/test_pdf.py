import json
import os
import sys

import pytest
from pyspark import cloudpickle

from pdfs import BOXES, DRAWING, FRAME, PIXELS, build, figure, text

from figlake.cli import main, ship
from figlake.config import ExtractionConfig, load_env
from figlake.library import DocumentParser, Orchestrator
from figlake.session import FigureEngine
from figlake.sources.dataset import NameClash
from figlake.sources.pdf import PdfError, read_pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


@pytest.fixture
def save(tmp_path):
    def put(name, data):
        path = tmp_path / name
        path.write_bytes(data)
        return str(path)

    return put


def test_reader_geometry():
    for flate in (False, True):
        page = next(read_pages(build(figure("Figure 1: Wheat and barley by season."), flate=flate)))
        assert [b for _, b in page.graphics] == BOXES
        assert page.lines()[1][0] == "Figure 1: Wheat and barley by season."


def test_reader_errors():
    for bad in (b"", b"%PDF-1.4\nnothing", build(b"")[:60], build(b"").replace(b"/Root", b"/Encrypt 9 0 R /Root")):
        with pytest.raises(PdfError):
            list(read_pages(bad))
    assert [p.text for p in read_pages(build(b"q 1 0 bogus ( Q", b""))] == ["", ""]


def test_figure_and_caption(spark, save):
    doc = DocumentParser(spark).parse(save("a.pdf", build(figure("Figure 1: Wheat and barley by season."))))
    assert len(doc.pages) == 1 and "Figure 1" in doc.page_text(1) and doc.full_text == doc.pages[0].text
    (f,) = doc.figures
    assert (f.figure_id, f.label, f.number, f.detection_method, f.dpi, f.width, f.height) == ("figure-1", "Figure 1", "1", "vector-cluster", 300, *PIXELS)
    assert tuple(f.bbox) == FRAME and f.caption == "Figure 1: Wheat and barley by season."
    with pytest.raises(KeyError):
        doc.page_text(2)


def test_other_documents(spark, save):
    parse = DocumentParser(spark).parse
    (f,) = parse(save("b.pdf", build(figure("Figure 3.2: Numbers with a part.")))).figures
    assert (f.figure_id, f.label) == ("figure-3.2", "Figure 3.2")
    assert not parse(save("c.pdf", build(text(72, 700, 11, "Nothing here but a hint at Figure 1 in prose.")))).figures
    (f,) = parse(save("d.pdf", build(figure("Figure 1: first."), figure("Figure 1: again.")))).figures
    assert f.page_number == 1
    (f,) = parse(save("e.pdf", build(b"q 160 0 0 120 130 380 cm /Im1 Do Q\n" + text(120, 350, 10, "Figure 2: raster.")))).figures
    assert f.detection_method == "embedded-image" and tuple(f.bbox) == (130.0, 292.0, 290.0, 412.0)
    (f,) = parse(save("f.pdf", build(text(95, 600, 10, "Figure 4: above its figure.") + DRAWING))).figures
    assert f.detection_method == "vector-cluster" and tuple(f.bbox) == FRAME
    (f,) = parse(save("g.pdf", build(text(100, 775, 10, "Figure 5: at the top.")))).figures
    assert f.detection_method == "caption-fallback" and f.bbox.top > 10
    (f,) = parse(save("h.pdf", build(b"90 300 1300 900 re S\n" + text(100, 270, 10, "Figure 6: large."), size=(1700, 1500)))).figures
    assert f.dpi < 300 and max(f.width, f.height) <= 4000


class Stub:
    def detect(self, image):
        assert image.shape == (1584, 1224, 3) and (image < 255).any()
        letters = image[1028:1048, 190:700]  # where the caption is
        assert letters.min() < 128 < letters.mean()
        return [("Table", 60, 90, 300, 210, 0.88), ("Figure Caption", 170, 1010, 1100, 1064, 0.64), (" Figure", 170, 530, 815, 1000, 0.72)]


def failing():
    raise ImportError("no model")


def test_layout_path(spark, save):
    path, config = save("a.pdf", build(figure("Figure 1: Wheat."))), ExtractionConfig(use_layout_model=True)
    (f,) = DocumentParser(spark, config, Stub).parse(path).figures
    assert (f.detection_method, f.figure_id, f.label, tuple(f.bbox)) == ("layout-model", "figure-1", "Figure 1", (85.0, 265.0, 407.5, 500.0))
    assert f.caption == "Figure 1: Wheat." and f.width > 100
    (f,) = DocumentParser(spark, config, failing).parse(path).figures
    assert f.detection_method == "vector-cluster"


def test_detector_and_settings(spark, tmp_path, monkeypatch, caplog):
    from figlake.sources import detector

    monkeypatch.delenv("LAYOUT_MODEL_PATH", raising=False)
    on = ExtractionConfig(use_layout_model=True)
    assert detector.default_detector(ExtractionConfig(use_layout_model=False)) is None and not caplog.records
    monkeypatch.setattr(detector.importlib.util, "find_spec", lambda name: None)
    assert detector.default_detector(on) is None and "no layout model" in caplog.text
    monkeypatch.setattr(detector.importlib.util, "find_spec", lambda name: name)
    (tmp_path / ".env").write_text("# note\nexport LAYOUT_MODEL_PATH='/models/own.pt'\nFIGLAKE_TEST_SET=new\nbroken\n")
    monkeypatch.setenv("FIGLAKE_TEST_SET", "old")
    load_env(str(tmp_path / ".env"))
    load_env(str(tmp_path / "none"))
    factory = detector.default_detector(on)
    assert (factory.path, factory.confidence, os.environ["FIGLAKE_TEST_SET"]) == ("/models/own.pt", 0.3, "old")
    assert detector.weights() == "/models/own.pt" and detector.weights("/x.pt") == "/x.pt"
    with pytest.raises(ImportError):
        factory()


def test_files_are_read_once_for_pages_and_once_for_pixels(spark, save, tmp_path):
    from figlake.sources import pdf

    seen, shown = str(tmp_path / "reads"), str(tmp_path / "shown")

    def counting(content):
        with open(seen, "ab") as f:
            f.write(b"x")
        return pdf.read_pages(content)

    class Counting:
        def detect(self, image):
            with open(shown, "ab") as f:
                f.write(b"x")
            return []

    paths = [save(f"{k}.pdf", build(figure(f"Figure {k}: x."), figure(f"Figure {k + 5}: y."))) for k in range(3)]
    engine = FigureEngine(spark, ExtractionConfig(use_layout_model=True), Counting, counting)
    files, pages, figures = engine.process(paths)
    engine.export(files, pages, figures, str(tmp_path / "out"))
    assert figures.count() == 6 and pages.count() == 6
    assert (os.path.getsize(seen), os.path.getsize(shown)) == (6, 6)
    assert engine.rendered(files, figures).where("png IS NOT NULL").count() == 6 and os.path.getsize(seen) == 9


def test_many_paths_and_figures_are_not_broadcast(spark, save, tmp_path, monkeypatch):
    from figlake.sources import reader

    monkeypatch.setattr(reader, "BROADCAST_PATHS", 0)
    monkeypatch.setattr(reader, "BROADCAST_FIGURES", 0)
    for name in ("a", "b", "c"):
        save(f"{name}.pdf", build(figure(f"Figure 1: {name == 'c'}.")))
    engine = FigureEngine(spark)
    files, pages, figures = engine.process(str(tmp_path))
    assert sorted(r.source_path.rsplit("/", 1)[1] for r in files.collect()) == ["a.pdf", "c.pdf"]
    engine.export(files, pages, figures, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out/c")) == ["figure_001.json", "figure_001.png", "figure_001.txt", "index.json"]


def test_export(spark, save, tmp_path):
    owner = Orchestrator(DocumentParser(spark))
    assert owner.figures == []
    with pytest.raises(RuntimeError):
        owner.export(str(tmp_path / "out"))
    path = save("my paper.pdf", build(figure("Figure 1: Kept in files.")))
    owner.process_document(path)
    with pytest.raises(FileNotFoundError):
        owner.process_document(path + "x")
    with pytest.raises(RuntimeError):
        owner.process_document(save("bad.pdf", b"%PDF-1.4 junk"))
    assert len(owner.figures) == 1
    owner.export(str(tmp_path / "out"))
    folder = tmp_path / "out" / "my_paper"
    assert sorted(os.listdir(folder)) == ["figure_001.json", "figure_001.png", "figure_001.txt", "index.json"]
    own, index = json.loads((folder / "figure_001.json").read_text()), json.loads((folder / "index.json").read_text())
    assert own["figure_id"] == "figure-1" and own["image_size_px"] == list(PIXELS) and own["files"] == {"image": "figure_001.png", "caption": "figure_001.txt"}
    assert index == {"source_pdf": path, "figures": [{"stem": "figure_001", **own}]}
    assert (folder / "figure_001.txt").read_text() == "Figure 1: Kept in files."
    head = (folder / "figure_001.png").read_bytes()[:24]
    assert head[:8] == b"\x89PNG\r\n\x1a\n" and (int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")) == PIXELS


def test_corpus(spark, save, tmp_path):
    (tmp_path / "sub").mkdir()
    save("a.pdf", build(figure("Figure 1: x.")))
    save("copy.pdf", build(figure("Figure 1: x.")))
    save("none.pdf", build(text(72, 700, 11, "words")))
    save("broken.pdf", b"%PDF-1.4 junk")
    engine = FigureEngine(spark)
    files, pages, figures = engine.process(str(tmp_path))
    assert files.count() == 3 and figures.count() == 1
    assert [r.error for r in pages.where("error IS NOT NULL").collect()] == ["no page tree"]
    engine.export(files, pages, figures, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a", "none"]
    assert json.loads((tmp_path / "out/none/index.json").read_text())["figures"] == []
    engine.register(pages, figures)
    assert spark.sql("SELECT count(*) FROM figures JOIN pages USING (doc_id, page_number)").first()[0] == 1
    (tmp_path / "sub" / "a.pdf").write_bytes(build(figure("Figure 2: other.")))
    with pytest.raises(NameClash):
        engine.export(*engine.process(str(tmp_path)), str(tmp_path / "out2"))


def test_stream(spark, save, tmp_path):
    from figlake.streaming.ingest import ingest

    os.makedirs(tmp_path / "in")
    (tmp_path / "in/a.pdf").write_bytes(build(figure("Figure 1: x.")))
    seen = []
    sink = lambda files, pages, figures, n: seen.extend(r.caption for r in figures.collect())
    ingest(FigureEngine(spark), str(tmp_path / "in"), str(tmp_path / "ckpt"), sink).awaitTermination(120)
    (tmp_path / "in/b.pdf").write_bytes(build(figure("Figure 1: x.")))
    (tmp_path / "in/c.pdf").write_bytes(build(figure("Figure 3: y.")))
    ingest(FigureEngine(spark), str(tmp_path / "in"), str(tmp_path / "ckpt"), sink).awaitTermination(120)
    assert seen == ["Figure 1: x.", "Figure 3: y."]


def test_cli(spark, save, tmp_path):
    path = save("a.pdf", build(figure("Figure 1: x.")))
    assert main([path, "-o", str(tmp_path / "out"), "--name", "p"], spark) == 0 and (tmp_path / "out/p/index.json").exists()
    assert main([path + "x"], spark) == 2
    assert main([save("bad.pdf", b"%PDF-1.4"), "-o", str(tmp_path / "out")], spark) == 1
    with pytest.raises(ValueError):
        main([path, "--dpi", "50"], spark)
    ship(spark)
