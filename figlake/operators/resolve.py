"""One figure per id and document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CANDIDATE = "struct<figure_id:string,cand_no:int>"


def first_wins(candidates: DataFrame) -> DataFrame:
    """Heuristic path alone: of the renderable candidates of an id in a document the first stays."""
    order = W.partitionBy("doc_id", "figure_id").orderBy("page_number", "cand_no")
    return candidates.where("renderable").withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")


def document_order(figures: DataFrame) -> DataFrame:
    """Adds seq (1, 2, ... per document) and stem (figure_001, ...)."""
    order = W.partitionBy("doc_id").orderBy("page_number", "cand_no")
    out = figures.withColumn("seq", F.row_number().over(order))
    return out.withColumn("stem", F.format_string("figure_%03d", "seq"))


def _fresh(candidates: Column, seen: Column) -> Column:
    """Candidates whose id is neither seen nor earlier in the page, in order."""
    empty = F.array().cast(f"array<{CANDIDATE}>")
    ids = lambda xs: F.transform(xs, lambda x: x["figure_id"])
    return F.aggregate(F.coalesce(candidates, empty), empty, lambda out, x: F.when(F.array_contains(seen, x["figure_id"]) | F.array_contains(ids(out), x["figure_id"]), out).otherwise(F.concat(out, F.array(x))))


def resolve_documents(candidates: DataFrame) -> DataFrame:
    """(doc_id, page_number, path, figure_id, cand_no) of renderable candidates (.., path 'layout' | 'heuristic').

    A page takes its layout figures that are new to the document, or its heuristic ones if none is left. Which it is depends
    on the pages before, so the pages of a document are folded in order; a document's candidates are names only, no pixels.
    """
    item = F.struct("figure_id", F.col("cand_no").cast("int").alias("cand_no"))
    of = lambda path: F.array_sort(F.collect_list(F.when((F.col("path") == path) & F.col("renderable"), item)), lambda a, b: a["cand_no"] - b["cand_no"])
    pages = candidates.groupBy("doc_id", "page_number").agg(of("layout").alias("layout"), of("heuristic").alias("heuristic"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "layout", "heuristic"))).alias("pages"))
    kept = "array<struct<page_number:int,path:string,figure_id:string,cand_no:int>>"
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(kept).alias("out"))

    def page(state: Column, p: Column) -> Column:
        def chosen(layout: Column) -> Column:
            some = F.size(layout) > 0
            new = F.when(some, layout).otherwise(_fresh(p["heuristic"], state["seen"]))
            path = F.when(some, "layout").otherwise("heuristic")

            def merged(new: Column) -> Column:
                rows = F.transform(new, lambda x: F.struct(p["page_number"].cast("int").alias("page_number"), path.alias("path"), x["figure_id"].alias("figure_id"), x["cand_no"].alias("cand_no")))
                return F.struct(F.concat(state["seen"], F.transform(new, lambda x: x["figure_id"])).alias("seen"), F.concat(state["out"], rows).alias("out"))

            return F.transform(F.array(new), merged)[0]

        return F.transform(F.array(_fresh(p["layout"], state["seen"])), chosen)[0]

    folded = docs.select("doc_id", F.explode(F.aggregate("pages", start, page)["out"]).alias("x"))
    return folded.select("doc_id", "x.page_number", "x.path", "x.figure_id", "x.cand_no")
