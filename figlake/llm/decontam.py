"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are the runs of characters that are neither ASCII punctuation, ASCII control nor white space, with A-Z in lower
case. Both sides are fingerprinted: of every ``SPAN`` = 6 consecutive k-grams (k = 5) the least hash is kept, so any 10 words that a
text and an item share yield a common fingerprint. Items of fewer than 10 words are one window each; for those lengths
(found first, at most nine of them) all grams of that length are fingerprints. Fingerprints of texts are joined with
those of the items; a hit is extended to the windows around it, which are then compared word by word.

The items' fingerprints and windows are broadcast if they are few, counted first; else a broadcast bitmap of bounded size sorts out most
fingerprints of texts and the rest is shuffled. Only the ids of texts with a common fingerprint are gathered; these texts are read again where they are (or, if the ids are too many to be
broadcast, shuffled, and no others), and all their grams are looked up, so the work on a text is in proportion to its length.

Defined cases: a null or empty text has no words and is not contaminated; null and empty items have no windows; a null
item id is not listed; repeated rows each get their result (results are joined on the id and a hash of the text);
empty tables give empty or clean results; other columns of the documents are not carried, so none can clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figlake.llm.common import attached, checkpointed, let

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Rows of at most a hundred bytes or so each.
BROADCAST_ROWS = 200_000
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAKS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, _BREAKS), "")


def _grams(hashes: Column, m: int) -> Column:
    """Hashes of all runs of m values; m is hashed too, so that lengths do not mix."""
    span = F.sequence(F.lit(0), F.size(hashes) - m)
    gram = F.transform(span, lambda i: F.xxhash64(F.lit(m), *[hashes[i + j] for j in range(m)]))
    return F.when(F.size(hashes) >= m, gram).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: Column) -> Column:
    """Least gram of every SPAN consecutive ones."""
    least = F.transform(F.sequence(F.lit(0), F.size(grams) - SPAN), lambda i: F.least(*[grams[i + j] for j in range(SPAN)]))
    return F.when(F.size(grams) >= SPAN, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _prints(w: Column, lengths: list[int]) -> Column:
    """Distinct fingerprints of the words w: winnowed grams, and all grams of the given lengths."""

    def of(h: Column) -> Column:
        own = let(_grams(h, GRAM), _winnowed)
        return F.concat(own, *[F.array_distinct(_grams(h, m)) for m in lengths]) if lengths else own

    return let(_hashes(w), of)


def _all_grams(w: Column, lengths: list[int]) -> Column:
    """Every gram of the words w that may be a fingerprint, with the words of the windows it lies in: (f, m: the windows' length, first: where the first of these begins, n: how many there are, context: their words)."""

    def placed(h: Column, gram: int, m: int) -> Column:
        reach, last = m - gram, F.size(h) - m
        first = lambda i: F.greatest(i - reach, F.lit(0))
        many = lambda i: F.least(i, last) - first(i) + 1
        at = lambda g, i: F.struct(g.alias("f"), F.lit(m).alias("m"), first(i).alias("first"), many(i).alias("n"), F.slice(w, first(i) + 1, many(i) + m - 1).alias("context"))
        grams = F.when(last >= 0, _grams(h, gram)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(grams, at)

    return let(_hashes(w), lambda h: F.concat(placed(h, GRAM, WINDOW), *[placed(h, m, m) for m in lengths]))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contamination(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: key, n_words, n_hit (words inside occurring windows), hits (array of (start, length) of the windows found, from 0) and items (the ids as strings, sorted)."""
    tests = items.select(F.col(item).cast("string").alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    classes = tests.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))  # items of equal words are one
    classes = checkpointed(classes.withColumn("class", F.xxhash64("w")).withColumn("m", F.least(F.size("w"), F.lit(WINDOW))))
    lengths = sorted(r.m for r in classes.select("m").where(F.col("m") < WINDOW).distinct().collect())  # at most nine
    prints = checkpointed(classes.select(F.explode(_prints(F.col("w"), lengths)).alias("f")).distinct())
    windows = classes.select("class", "m", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("m"))).alias("s"))
    windows = windows.select("class", "m", F.expr("slice(w, s + 1, m)").alias("window")).distinct()
    windows = checkpointed(windows.withColumn("wh", F.xxhash64("m", "window")))
    n_windows = windows.count()

    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("k"))
    made = docs.select("k", F.explode(_prints(words(F.col("text")), lengths)).alias("f"))
    suspects = checkpointed(attached(made, prints, "f", "left_semi").select("k").distinct())

    near = attached(docs, suspects, "k", "left_semi")
    near = near.select("key", "k", F.explode(let(words(F.col("text")), lambda w: _all_grams(w, lengths))).alias("g")).select("key", "k", "g.*")
    near = attached(near, prints, "f", "left_semi").select("key", "k", "m", "first", "context", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    at = F.struct((F.col("first") + F.col("i")).alias("s"), "m").alias("at")
    near = near.select("key", "k", at, F.expr("slice(context, i + 1, m)").alias("window")).withColumn("wh", F.xxhash64("at.m", "window"))
    hit = near.join(_sized(windows.select("wh", "window", "class"), n_windows), ["wh", "window"]).select("key", "k", "at", "class").distinct()
    hit = checkpointed(hit)

    start = F.struct(F.lit(0).alias("until"), F.lit(0).alias("total"))
    ends = lambda x: x["s"] + x["m"]
    covered = F.aggregate("hits", start, lambda acc, x: F.struct(F.greatest(acc["until"], ends(x)).alias("until"), (acc["total"] + F.greatest(F.lit(0), ends(x) - F.greatest(acc["until"], x["s"]))).alias("total")))
    per_doc = hit.groupBy("key", "k").agg(F.array_sort(F.collect_set("at")).alias("hits")).withColumn("n_hit", covered["total"].cast("long"))
    listed = hit.select("key", "k", "class").distinct().join(_sized(classes.select("class", "items"), n_windows), "class")
    listed = listed.groupBy("key", "k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    listed = listed.withColumnsRenamed({"key": "key2", "k": "k2"})
    both = per_doc.join(listed, (F.col("k") == F.col("k2")) & F.col("key").eqNullSafe(F.col("key2"))).drop("key2", "k2").withColumnsRenamed({"key": "key2", "k": "k2"})
    counted = docs.select("key", "k", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), _BREAKS_ANY_CASE), "")).cast("long").alias("n_words"))
    none = F.array().cast("array<struct<s:int,m:int>>")
    return counted.join(both, (F.col("k") == F.col("k2")) & F.col("key").eqNullSafe(F.col("key2")), "left").select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hits", none).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
