import random

import pytest
from pyspark.sql import functions as F

from figlake.config import ExtractionConfig, layout_enabled
from figlake.functions import geometry as G
from figlake.operators import captions, layout, regions, render, resolve

BOX = "struct<x0:double,top:double,x1:double,bottom:double>"


def page():
    return G.box(0.0, 0.0, 612.0, 792.0)


def some_pages(seed, n=25):
    rng = random.Random(seed)
    lines, graphics = [], []
    for page in range(n):
        y = 30.0
        for k in range(rng.randint(1, 14)):
            y += rng.choice([2, 11, 14, 60, 120])
            x = rng.choice([72.0, 340.0])
            t = rng.choice(["Figure %d: a" % rng.randint(1, 4), "Fig. 2 shows", "plain words", "more words of a paragraph"])
            lines.append(("d%d" % (page % 4), page, k, t, (x, y, x + rng.choice([20.0, 100.0, 250.0, 400.0]), y + rng.choice([8.0, 10.0]))))
        for k in range(rng.randint(0, 8)):
            x, top = rng.uniform(0, 500), rng.uniform(0, 700)
            graphics.append(("d%d" % (page % 4), page, k, rng.choice(["image", "vector"]), (x, top, x + rng.choice([0.0, 50.0, 200.0, 600.0]), top + rng.choice([1.0, 30.0, 200.0]))))
    return lines, graphics


def expected_captions(lines):
    import re

    anchor = re.compile(r"^\s*(?:fig(?:ure)?\.?)\s*(\d{1,3}(?:\.\d{1,2})?[a-z]?)\s*([:.\-–—|])\s*\S", re.I)
    pages, out = {}, []
    for row in sorted(lines, key=lambda r: (r[0], r[1], r[2])):
        pages.setdefault(row[:2], []).append(row)
    for key, rows in pages.items():
        k = 0
        while k < len(rows):
            m = anchor.match(rows[k][3])
            if not m:
                k += 1
                continue
            group, j = [rows[k]], k + 1
            while j < len(rows) and not anchor.match(rows[j][3]):
                last = group[-1][4]
                if rows[j][4][1] - last[3] > 0.8 * max(last[3] - last[1], 6.0):
                    break
                group.append(rows[j])
                j += 1
            b = [r[4] for r in group]
            out.append((*key, rows[k][2], m[1], " ".join(r[3] for r in group), min(x[0] for x in b), min(x[1] for x in b), max(x[2] for x in b), max(x[3] for x in b)))
            k = j
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 5])
def test_captions_and_both_forms_of_regions(spark, partitions):
    lines, graphics = some_pages(3)
    ls = spark.createDataFrame(lines, f"doc_id string, page_number int, line_no int, text string, box {BOX}").repartition(partitions)
    gs = spark.createDataFrame(graphics, f"doc_id string, page_number int, obj_no int, kind string, box {BOX}").repartition(partitions)
    found = captions.find_captions(ls)
    got = sorted((r.doc_id, r.page_number, r.caption_no, r.number, r.text, *r.box) for r in found.collect())
    assert got == expected_captions(lines) and got
    joined = regions.locate_regions(found, ls, gs, page())
    nested = ls.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("line_no", "text", "box")).alias("lines"))
    drawn = gs.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("kind", "box")).alias("graphics"))
    pages = nested.join(drawn, ["doc_id", "page_number"], "left").withColumn("graphics", F.coalesce("graphics", F.array().cast(f"array<struct<kind:string,box:{BOX}>>")))
    on_page = found.join(pages, ["doc_id", "page_number"]).withColumn("at", regions.locate_on_page(F.col("box"), F.col("lines"), F.col("graphics"), page()))
    key = ["doc_id", "page_number", "caption_no"]
    a = {tuple(r[:3]): (tuple(r.region), r.method, r.direction) for r in joined.select(*key, "region", "method", "direction").collect()}
    b = {tuple(r[:3]): (tuple(r["at"].region), r["at"].method, r["at"].direction) for r in on_page.select(*key, "at").collect()}
    assert a == b and {m for _, m, _ in a.values()} == {"embedded-image", "vector-cluster", "caption-fallback"}


def fold(pages):
    seen, out = set(), []
    for number, by_path in sorted(pages.items()):
        for path in ("layout", "heuristic"):
            kept = []
            for cand, fid in sorted(by_path.get(path, ())):
                if fid not in seen:
                    seen.add(fid)
                    kept.append((number, path, fid, cand))
            if kept:
                out += kept
                break
    return out


def test_resolution_is_a_fold(spark):
    rng, docs = random.Random(5), {"counter": {1: {"layout": [(1, "figure-1")]}, 2: {"layout": [(1, "figure-1")], "heuristic": [(1, "figure-2")]}, 3: {"layout": [(1, "figure-2")]}}}
    for d in range(80):
        docs[f"d{d}"] = {p: {path: [(c, f"figure-{rng.randint(1, 4)}") for c in range(rng.randint(0, 3))] for path in ("layout", "heuristic")} for p in range(1, rng.randint(2, 7))}
    rows = [(d, p, path, c, f, True) for d, pages in docs.items() for p, by in pages.items() for path, items in by.items() for c, f in items]
    rows += [("counter", 3, "layout", 0, "figure-9", False)]
    got = {}
    for r in resolve.resolve_documents(spark.createDataFrame(rows, "doc_id string, page_number int, path string, cand_no int, figure_id string, renderable boolean")).collect():
        got.setdefault(r.doc_id, []).append((r.page_number, r.path, r.figure_id, r.cand_no))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(fold(p)) for d, p in docs.items() if fold(p)}
    assert sorted(got["counter"]) == [(1, "layout", "figure-1", 1), (2, "heuristic", "figure-2", 1)]


def test_nearest_caption_ties_go_to_the_first_detected(spark):
    rows = [(0, "figure", (100, 100, 300, 200), 0.9, ""), (2, "figure_caption", (100, 230, 300, 240), 0.1, "second"), (1, "figure_caption", (150, 230, 200, 250), 0.1, "first"), (3, "figure_caption", (400, 205, 500, 210), 0.9, "aside")]
    df = spark.createDataFrame([("d", 1, *r) for r in rows], "doc_id string, page_number int, region_no int, label string, box struct<x0:int,y0:int,x1:int,y1:int>, confidence double, caption_text string")
    r = layout.layout_figures(df, page()).first()
    assert (r.caption, r.figure_id, tuple(r.region)) == ("first", "figure-p1-1", (50.0, 50.0, 150.0, 100.0))


def test_resolution_and_settings(spark):
    got = spark.createDataFrame([(960.0,), (961.0,), (5000.0,)], "x double").select(render.effective_dpi(F.col("x"), ExtractionConfig())).collect()
    assert [r[0] for r in got] == [300, 299, 72]
    assert layout_enabled(None) and layout_enabled("") and layout_enabled("1") and not any(map(layout_enabled, ("0", " OFF ", "false", "No")))
    with pytest.raises(ValueError):
        ExtractionConfig(resolution=71)


def test_geometry(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 20.0), (5.0, 5.0, 3.0, 30.0))], f"a {BOX}, b {BOX}")
    a, b = F.col("a"), F.col("b")
    r = df.select(G.width(b), G.area(b), G.vertical_center(a), G.union(a, b), G.clamped(G.padded(a, 2.0), b), G.horizontal_overlap(a, b)).first()
    assert (r[0], r[1], r[2], tuple(r[3]), tuple(r[4]), r[5]) == (-2.0, 0.0, 10.0, (0.0, 0.0, 10.0, 30.0), (5.0, 5.0, 3.0, 22.0), 0.0)
