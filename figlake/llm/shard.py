"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

At each level a row draws a straw for every child, the longest wins: draw = ln(u) / weight with u a hash of the row's
key, the node and the child. A child's weight is the sum of what lies below it. A draw depends only on the key and on
that child's weight, so a change of weights moves rows only along the subtrees whose weights changed; rows that draw
the same region and rack as before draw among the same shards as before.

Law ``key``: the key and the tree decide, nothing else. ``grown`` adds a shard as a region of its own, so at every level
only that subtree's weight changes (from none), and rows move only into the new shard. A shard added inside a rack also
raises its region's and rack's weights; then rows may move between shards of that region as well.

``slots`` numbers the rows of each shard from 0 without gaps: rows are dealt to buckets, buckets are counted, and a
running sum of those counts gives where a bucket starts, so no task ever sorts a whole shard.

Defined cases: a null key hashes as a constant; a null text has size ``16`` and checksum 0; equal rows share a shard
and get different slots; an empty table stays empty. New columns must not clash (ValueError).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figlake.llm.common import checkpointed, fresh

#: region -> rack -> shard number -> weight
Tree = dict[str, dict[str, dict[int, float]]]

#: Rows of a bucket that ``slots`` aims at.
BUCKET_ROWS = 20_000


def tree_of(shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
    """Shards 0 .. shards - 1 of weight 1, filled rack by rack and region by region."""
    out: Tree = {}
    for k in range(shards):
        rack, region = k // per_rack, k // (per_rack * racks)
        out.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[k] = 1.0
    return out


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region of its own."""
    return {**tree, f"grown{shard}": {f"grown{shard}": {shard: weight}}}


def _children(weights: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in weights.items() if w > 0])


def _drawn(key: Column, parent: Column, children: Column) -> Column:
    """The name of the child with the longest straw."""

    def straw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, parent, child["name"]), 11).cast("double")
        return F.struct((F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / child["weight"]).alias("straw"), child["name"].alias("name"))

    return F.array_max(F.transform(children, straw))["name"]


def draw(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Adds the shard of every row: one draw among regions, one among the region's racks, one among the rack's shards. Rack names are unique in the tree."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {out} already")
    of_rack = {name: sum(shards.values()) for racks in tree.values() for name, shards in racks.items()}
    of_region = {name: sum(of_rack[r] for r in racks) for name, racks in tree.items()}
    region, rack = fresh(df, "_region"), fresh(df, "_rack")

    def level(chosen: str, groups: dict[str, dict[str, float]]) -> Column:
        lists = F.create_map(*[x for name, weights in groups.items() for x in (F.lit(name), _children(weights))])
        return _drawn(F.col(key), F.col(chosen), F.element_at(lists, F.col(chosen)))

    step = df.withColumn(region, _drawn(F.col(key), F.lit("root"), _children(of_region)))
    step = step.withColumn(rack, level(region, {r: {k: of_rack[k] for k in racks} for r, racks in tree.items()}))
    leaves = {k: {str(s): w for s, w in shards.items()} for racks in tree.values() for k, shards in racks.items()}
    return step.withColumn(out, level(rack, leaves).cast("int")).drop(region, rack)


def slots(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Adds a gapless number from 0 within each shard. df is checkpointed, so give narrow rows."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {out} already")
    bucket, before, count = (fresh(df, n) for n in ("_bucket", "_before", "_count"))
    placed = df.withColumn(bucket, F.monotonically_increasing_id())
    placed = checkpointed(placed)
    buckets = max(8, placed.count() // BUCKET_ROWS)
    placed = placed.withColumn(bucket, F.pmod(F.xxhash64(*[F.col(c) for c in order], F.col(bucket)), F.lit(buckets)).cast("int"))
    counts = placed.groupBy(shard, bucket).agg(F.count("*").alias(count))
    running = W.partitionBy(shard).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(shard, bucket, F.coalesce(F.sum(count).over(running), F.lit(0)).alias(before))
    within = F.row_number().over(W.partitionBy(shard, bucket).orderBy(*order)) - 1
    return placed.withColumn(out, within.cast("long")).join(starts, [shard, bucket]).withColumn(out, F.col(out) + F.col(before)).drop(bucket, before)
