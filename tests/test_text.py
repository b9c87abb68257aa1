import pytest
from pyspark.sql import functions as F

from figlake.functions import text as X

# line, number of the anchor, number anywhere
CASES = [
    ("Figure 3: ok", "3", "3"), ("Fig. 12. ok", "12", "12"), ("FIGURE 4 — x", "4", "4"), ("Fig3|x", "3", "3"), ("Figure 4A: x", "4A", "4A"),
    ("Figure 3.2: book", "3.2", "3.2"), ("Figure 3.2 shows the results", "3", "3.2"), ("Figure 3.123: x", "3", "3.12"), ("Figure 1-2: x", "1", "1"),
    ("Figure 1234: x", "", "123"), ("Figure 3 shows", "", "3"), ("Figure 1:", "", "1"), ("Figs. 3: x", "", None), ("Figure S1: x", "", None),
    ("Supplementary Figure 1: x", "", "1"), ("see Fig 2a and", "", "2a"), ("config 3 x", "", None), ("_fig 3 x", "", None),
    ("Figure 3: x", "3", "3"), ("Figure ٣: x", "٣", "٣"), ("Fıgure 3: x", "3", "3"), ("Figure 1:  ", "", "1"), ("éfig 3 x", "", None),
]


def test_caption_patterns(spark):
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, t string")
    got = rows.select("k", X.anchor_number(F.col("t")), X.caption_number(F.col("t"))).orderBy("k").collect()
    assert [(r[1], r[2]) for r in got] == [(c[1], c[2]) for c in CASES]


@pytest.mark.parametrize(
    ("given", "want"),
    [("a  b", "a b"), (" a\x1cb\n", "a b"), ("", ""), (" \t", "")],
)
def test_collapsed(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(X.collapsed(F.col("t"))).first()[0] == want == " ".join(given.split())


def test_safe_names_and_stems(spark):
    names = [("a b/c", "a_b_c"), ("..x..", "x"), ("", "paper"), ("__", "paper"), ("é", "paper"), ("ok-1.2", "ok-1.2")]
    got = spark.createDataFrame(names, "n string, w string").select(X.safe_name(F.col("n")), "w").collect()
    assert all(r[0] == r[1] for r in got)
    stems = [("/x/a.tar.gz", "a.tar"), ("/x/.pdf", ".pdf"), ("b.pdf", "b"), ("x.", "x")]
    got = spark.createDataFrame(stems[:3], "n string, w string").select(X.path_stem(F.col("n")), "w").collect()
    assert all(r[0] == r[1] for r in got)


def test_spacing_repair(spark):
    glued = "x" * 45
    rows = [("short", ["s h o r t"], "short"), (glued, ["xxxx " * 9, "x " * 40], "xxxx " * 9), (glued, ["x " * 40, "", None], glued), (glued, ["a b " + glued, "c d " + glued], "a b " + glued)]
    got = spark.createDataFrame(rows, "t string, v array<string>, w string").select(X.best_spacing(F.col("t"), F.col("v")), "w").collect()
    assert all(r[0] == r[1] for r in got)
