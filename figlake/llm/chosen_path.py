"""Near-duplicate documents by the chosen-path set join on word shingles.

A document is the set of its runs of five words (a document of fewer words is one shingle). Two documents are linked if the Jaccard
similarity of their sets is ``NUM/DEN`` = 0.8 or more.

1. In each run a set of size s samples the shingles whose hash in that run is below ``CHOSEN / s``, so similar sets sample the same
   ones. Runs are repeated until the chance to lose a pair is below 1 - ``TARGET``: ``RUNS`` of them (``lost``), as a pair at the threshold has to share
   ``DEPTH`` of its sampled shingles and shares about 0.8 * RUNS * CHOSEN. Equal sets (by 128 bits) count as one from here on, with their number kept; a step
   samples them once, and the most frequent ones (``HOTTEST``) are sampled only where their first document is.
2. The sets are split by their smallest sampled shingles; a bucket of more than ``LEAF`` sets is split again by a further
   sampled shingle, and so on down the path, at most ``DEPTH`` times (``_split``). A pair goes down the path of its smallest shared ones and is
   compared in one bucket only, the first small one on that path. A bucket whose sets share ``DENSE`` of their further shingles on average (a family of
   near copies, as a rule) would not be told apart by more of them: its sets, and sets at the end of their path, are compared with their whole bucket by blocks and go no further.
3. Blocks hold ``BLOCK`` sets, so no task gets more than two of them. A bucket first tells which sets have a partner there; only
   their shingles are sent there, and every pair is verified by all its shingles.
4. A bucket returns, for each set, the documents linked to it and one link of a spanning forest, never all pairs.
   Links join sets into groups by label propagation with pointer jumping.

Defined cases: null and empty texts have no shingles and no links; very long texts are read whole; documents that repeat an id or have
none are told apart by id and text, in the order of ids, null ones last, then of a hash, and rows that repeat both are one document (sent once);
a group is named by the id of its least document, null if all have none; other columns are kept, and clashes with the new ones raise ValueError; empty tables stay empty.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figlake.llm.common import attached, byte_hashes, checkpointed, fresh, hottest, identified, mix64, packed_groups, plain, posts, ranges, run_hashes, text_chunks, tidy, tidy_group, unpacked_groups, words_of

NUM, DEN, WORDS = 4, 5, 5
CHOSEN, DEPTH, TARGET = 8, 6, 0.999995
LEAF, BLOCK, DENSE, SMALL = 1024, 1024, 0.25, 48
#: About as many sets of a large bucket are asked what they have in common.
ASKED = 64
DOCS_PER_BUCKET = 1000
STEP_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lost(runs: int) -> float:
    """The chance that a pair at the threshold shares fewer than DEPTH chosen shingles."""
    mean = runs * CHOSEN * NUM / DEN
    return math.exp(-mean) * sum(mean**k / math.factorial(k) for k in range(DEPTH))


RUNS = next(r for r in range(1, 64) if lost(r) <= 1 - TARGET)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each set, where it begins, its size, shingles) of the texts that have words; a set's shingles are distinct."""
    starts, ends, owner = words_of(data, offsets, _SPACE)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    words = byte_hashes(data, starts, ends)
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    counts = np.diff(np.r_[heads, len(owner)])
    many = np.maximum(counts - WORDS + 1, 1)
    begin = ranges(heads, many)
    of = np.repeat(np.arange(len(heads)), many)
    hashes = run_hashes(words, begin, begin + np.minimum(counts, WORDS)[of])
    codes, distinct = pd.factorize(hashes)
    keys = np.sort((of << 32) | codes)
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    of = keys >> 32
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return owner[heads], first, np.diff(np.r_[first, len(of)]), distinct[keys & 0xFFFFFFFF]


def _identity(tokens: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set."""
    seeds = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xB492B66FBE98F273))
    return tuple(mix64(np.add.reduceat(mix64(tokens ^ seed), heads) + sizes.astype(np.uint64)).view(np.int64) for seed in seeds)


def _sets(docs: DataFrame) -> DataFrame:
    """(uid, same, same2): the identity of each document's set."""

    def run(batches):
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            for lo, hi, data, offsets in text_chunks(batch.column("text"), STEP_BYTES):
                text, heads, sizes, tokens = shingle_sets(data, offsets)
                if len(heads):
                    yield pa.RecordBatch.from_arrays([pa.array(uids[lo:hi][text]), *map(pa.array, _identity(tokens, heads, sizes))], names=["uid", "same", "same2"])

    return docs.mapInArrow(tidy(run), "uid long, same long, same2 long")


_PACK = (("tok", "<i8"), ("uid", "<i8"), ("same", "<i8"), ("same2", "<i8"), ("size", "<i4"))


def _chosen(docs: DataFrame, buckets: int, hot: list[np.ndarray]) -> DataFrame:
    """(bucket, packed): the shingles that each set samples in all runs; those of a hot set once, where its first document is."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            for lo, hi, data, offsets in text_chunks(batch.column("text"), STEP_BYTES):
                text, heads, sizes, tokens = shingle_sets(data, offsets)
                if not len(heads):
                    continue
                (same, same2), own = _identity(tokens, heads, sizes), uids[lo:hi][text]
                order = np.lexsort((own, same2, same))
                kept = np.zeros(len(same), bool)  # equal sets of a step are sampled once
                kept[order[np.r_[True, (same[order][1:] != same[order][:-1]) | (same2[order][1:] != same2[order][:-1])]]] = True
                kept &= posts(shared.value, same, same2, own)
                if not kept.any():
                    continue
                of = np.repeat(np.arange(len(heads)), sizes)
                bound = (np.minimum(CHOSEN / sizes, 1.0) * float(1 << 53)).astype(np.int64)[of]
                pick = np.zeros(len(tokens), bool)
                for k in range(RUNS):
                    pick |= (mix64(tokens + np.uint64(((k + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.int64) < bound
                pick &= kept[of]
                of, tok = of[pick], tokens[pick]
                if not len(tok):
                    continue
                bucket = (mix64(tok) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                of, tok, bucket = of[order], tok[order], bucket[order]
                columns = [tok.view(np.int64), own[of], same[of], same2[of], sizes[of].astype(np.int32)]
                edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), packed_groups(columns, edges)], names=["bucket", "packed"])

    return docs.mapInArrow(tidy(run), "bucket int, packed binary")


def _shared(chosen: DataFrame) -> DataFrame:
    """(uid, size, tok): sampled shingles that two different sets or more have; an equal set is known by its least uid."""

    def meet(table: pa.Table) -> pa.Table:
        tok, uid, same, same2, size = unpacked_groups(table.column("packed"), [kind for _, kind in _PACK])[0]
        order = np.lexsort((uid, same2, same, tok))
        tok, uid, same, same2, size = tok[order], uid[order], same[order], same2[order], size[order]
        new = np.r_[True, (tok[1:] != tok[:-1]) | (same[1:] != same[:-1]) | (same2[1:] != same2[:-1])]
        tok, uid, size = tok[new], uid[new], size[new]
        _, at, n = np.unique(tok, return_inverse=True, return_counts=True)
        more = n[at] >= 2
        return pa.table({"uid": uid[more], "size": size[more], "tok": (tok[more] >> 32).astype(np.int32)})

    return chosen.groupBy("bucket").applyInArrow(tidy_group(meet), "uid long, size int, tok int")


def _padded(lists: pa.ListArray) -> np.ndarray:
    """Ascending lists of ints as a matrix, filled up with values of which no two are equal across the two uses (see _common)."""
    lengths = lists.value_lengths().to_numpy()
    out = np.full((len(lengths), max(1, int(lengths.max(initial=1)))), np.iinfo(np.int64).max, np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), ranges(np.zeros(len(lengths), np.int64), lengths)] = lists.flatten().to_numpy()
    return out


_SIGNATURE, FIRST = 512, 4


def _signatures(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps of the sampled shingles, how many of each list's share a bit with another)."""
    row, column = np.nonzero(lists != np.iinfo(np.int64).max)
    bit = mix64(lists[row, column].astype(np.uint64)) & np.uint64(_SIGNATURE - 1)
    out = np.zeros((len(lists), _SIGNATURE // 64), np.uint64)
    np.bitwise_or.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out, np.bincount(row, minlength=len(lists)) - np.bitwise_count(out).sum(axis=1)


def _may_share(signatures: np.ndarray, doubled: np.ndarray, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs may share as many sampled shingles as needed: no more than common bits and shingles that share theirs."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1 << 14):
        at = slice(lo, lo + (1 << 14))
        out[at] = np.bitwise_count(signatures[a[at]] & signatures[b[at]]).sum(axis=1) + doubled[a[at]] >= need[at]
    return out


def _later(lists: np.ndarray, last: np.ndarray, depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are seen by the first FIRST shingles of a alone to share more up to the last of the path than the path has: they meet elsewhere."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1 << 14):
        at = slice(lo, lo + (1 << 14))
        x, y = lists[a[at], :FIRST], lists[b[at]]
        out[at] = ((x[:, :, None] == y[:, None, :]).any(axis=2) & (x <= last[a[at]][:, None])).sum(axis=1) > depth[a[at]]
    return out


def _common(lists: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shared sampled shingles of the pairs: how many there are, and how many up to the last of the path."""
    count, passed = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    none = np.iinfo(np.int64).max
    for lo in range(0, len(a), 4096):
        at = slice(lo, lo + 4096)
        x, y = lists[a[at]], lists[b[at]]
        both = (x[:, :, None] == y[:, None, :]).any(axis=2) & (x != none)
        count[at], passed[at] = both.sum(axis=1), (both & (x <= last[a[at]][:, None])).sum(axis=1)
    return count, passed


def _pairs(heads: np.ndarray, sizes: np.ndarray):
    """Yields the pairs within each group, in pieces of bounded size."""
    rows = ranges(heads, sizes)
    before = rows - np.repeat(heads, sizes)
    for k in range(0, len(rows), 1 << 14):
        part, many = rows[k : k + (1 << 14)], before[k : k + (1 << 14)]
        for cut in np.split(np.arange(len(part)), np.flatnonzero(np.diff(np.cumsum(many) >> 18)) + 1):
            yield np.repeat(part[cut], many[cut]), ranges(part[cut] - many[cut], many[cut])


def _bucket_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(heads of groups, their sizes, a, b): of the rows in _ORDER, the pairs to compare in this bucket."""
    path, tok, depth, uid, size, i, j, block, dense = (table.column(c).to_numpy() for c in ("path", "tok", "depth", "uid", "size", "i", "j", "block", "dense"))
    lists = _padded(table.column("toks").combine_chunks())
    signatures, doubled = _signatures(lists)
    new = np.r_[True, (path[1:] != path[:-1]) | (tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    heads = np.flatnonzero(new)
    many = np.diff(np.r_[heads, len(tok)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _pairs(heads, many):
        m, n = size[a].astype(np.int64), size[b].astype(np.int64)
        fit = (DEN * np.minimum(m, n) >= NUM * np.maximum(m, n)) & (uid[a] != uid[b]) & ((i[a] == j[a]) | (block[a] != block[b])) & (dense[a] | dense[b])
        a, b = a[fit], b[fit]
        need = np.minimum(DEPTH, -(-NUM * (size[a].astype(np.int64) + size[b]) // (NUM + DEN)))
        fit = _may_share(signatures, doubled, a, b, need)
        fit[fit] = ~_later(lists, tok, depth, a[fit], b[fit])
        a, b, need = a[fit], b[fit], need[fit]
        count, passed = _common(lists, tok, a, b)
        fit = (count >= need) & (passed == depth[a])  # the path is that of the pair's smallest shared ones
        left.append(a[fit]), right.append(b[fit])
    return heads, many, np.concatenate(left), np.concatenate(right)


_PLACE = "path long, tok int, depth int, i int, j int, block int, dense boolean"
_PLACES = [x.split()[0] for x in _PLACE.split(", ")]
_ORDER = [(c, "ascending") for c in ("path", "tok", "i", "j", "uid")]


def _children(rows: DataFrame, depth: int) -> DataFrame:
    """The rows (uid, size, toks, need, at, path) one shingle further down their paths, where enough of them are left."""
    last = F.size("toks") - F.greatest(F.col("need") - depth, F.lit(0)) - 1
    places = F.when(last > F.col("at"), F.sequence(F.col("at") + 1, last))
    down = rows.select("uid", "size", "toks", "need", "path", F.explode(places).alias("at")).withColumn("tok", F.col("toks")[F.col("at")])
    return down.withColumn("path", F.xxhash64("path", "tok"))


def _split(lists: DataFrame) -> DataFrame:
    """(uid, size, toks, place): where the sets (uid, size, toks, need) meet: small buckets as they are, of large ones those sets, by blocks, that a further split would not tell apart."""
    place = F.struct("path", "tok", F.col("depth").cast("int").alias("depth"), "i", "j", "block", "dense").alias("place")
    none, whole = F.lit(0), F.lit(True)
    rows, out = lists.select("uid", "size", "toks", "need", F.lit(-1).alias("at"), F.lit(0).cast("long").alias("path")), []
    for depth in range(1, DEPTH + 1):
        down = _children(rows, depth)
        large = checkpointed(down.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > LEAF))
        some = large.limit(1).count()
        small = attached(down, large.select("path"), "path", "left_anti") if some else down
        out.append(small.select("uid", "size", "toks", "path", "tok", F.lit(depth).alias("depth"), none.alias("i"), none.alias("j"), none.alias("block"), whole.alias("dense")).select("uid", "size", "toks", place))
        if not some:
            break
        rows = checkpointed(attached(down, large, "path", "inner"))
        # the share of further shingles that two sets of the bucket have in common: an estimate is enough, as it only decides which way is cheaper
        asked = rows.where(F.pmod(F.xxhash64("uid", "path"), F.ceil(F.col("n") / ASKED)) == 0)
        counts = asked.select("path", F.explode(F.slice("toks", F.col("at") + 2, F.size("toks"))).alias("t")).groupBy("path", "t").agg(F.count("*").alias("c"))
        pairs = counts.groupBy("path").agg(F.sum("c").alias("all"), F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))
        share = asked.groupBy("path").agg(F.count("*").alias("m")).join(pairs, "path").where("m > 1").select("path", (F.col("pairs") / F.col("all") / (F.col("m") - 1)).alias("share"))
        rows = attached(rows, checkpointed(share), "path").withColumn("dense", (F.col("need") <= depth) | (F.coalesce("share", F.lit(1.0)) >= DENSE)).drop("n", "share")
        rows = checkpointed(rows)
        blocks = rows.groupBy("path").agg(F.ceil(F.count_if("dense") / BLOCK).cast("int").alias("first"), F.ceil(F.count_if(~F.col("dense")) / BLOCK).cast("int").alias("rest"))
        met = rows.join(blocks.where("first > 0"), "path")  # dense sets have the first blocks and meet all; the others meet only these
        at = F.xxhash64("uid", "path")
        met = met.withColumn("block", F.when(F.col("dense"), F.pmod(at, F.col("first"))).otherwise(F.col("first") + F.pmod(at, F.col("rest"))).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("dense"), F.col("first") + F.col("rest")).otherwise(F.col("first")) - 1)))
        met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "depth": F.lit(depth)})
        out.append(met.select("uid", "size", "toks", place))
        rows = rows.where(~F.col("dense")).select("uid", "size", "toks", "need", "at", "path")
    return reduce(DataFrame.unionByName, out)


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    """df by buckets, over as many tasks as the work is worth: it is more than its bytes tell."""
    return df.repartition(max(8, buckets // 4), "bucket")


def _partners(placed: DataFrame) -> DataFrame:
    """(uid, place): in which buckets a set has a pair to be compared."""

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by(_ORDER)
        _, _, a, b = _bucket_pairs(table)
        return table.take(pa.array(np.unique(np.concatenate([a, b])))).select(["uid", *_PLACES])

    return placed.groupBy("bucket").applyInArrow(tidy_group(meet), f"uid long, {_PLACE}")


_LINKS = "uid long, links long, root long"


def _linked(sent: DataFrame) -> DataFrame:
    """(uid, links, root): per bucket the number of documents that a set is linked to, and the root of its tree of links there."""

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by(_ORDER)
        heads, many, a, b = _bucket_pairs(table)
        uid, copies = table.column("uid").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        length = np.array([len(s) for s in sets], np.int64)
        group = np.searchsorted(heads, a, side="right") - 1
        both = np.zeros(len(a), np.int64)
        big = many[group] > SMALL if len(a) else np.zeros(0, bool)
        for k in np.flatnonzero(~big).tolist():
            both[k] = len(np.intersect1d(sets[a[k]], sets[b[k]], assume_unique=True))
        for g in np.unique(group[big]).tolist():
            own = np.flatnonzero(big & (group == g))
            rows = sets[heads[g] : heads[g] + many[g]]
            common = _counts(rows)
            both[own] = common[a[own] - heads[g], b[own] - heads[g]]
        held = DEN * both >= NUM * (length[a] + length[b] - both) if len(a) else np.zeros(0, bool)
        a, b = a[held], b[held]
        links = np.bincount(a, copies[b], len(uid)) + np.bincount(b, copies[a], len(uid))
        root = np.arange(len(uid))
        while True:  # least row of each tree
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low), np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = links > 0
        return pa.table({"uid": uid[some], "links": links[some].astype(np.int64), "root": uid[root][some]})

    return sent.groupBy("bucket").applyInArrow(tidy_group(meet), _LINKS)


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices of a few thousand shingles at a time."""
    sizes = np.array([len(s) for s in sets])
    codes, distinct = pd.factorize(np.concatenate(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(codes, minlength=len(distinct)) > 1
    turn = np.cumsum(often) - 1
    keep = often[codes]
    codes, owner = turn[codes[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    for lo in range(0, int(often.sum()), 2048):
        at = slice(*np.searchsorted(codes, [lo, lo + 2048]))
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[at], codes[at] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def groups_of(edges: DataFrame) -> DataFrame:
    """(uid, least): the least uid of each connected component of edges (uid, root)."""
    both = checkpointed(edges.select("uid", "root").union(edges.select(F.col("root").alias("uid"), F.col("uid").alias("root"))).where("uid <> root").distinct())
    labels = checkpointed(both.groupBy("uid").agg(F.least(F.min("root"), F.first("uid")).alias("least")))
    while True:
        near = both.join(labels.withColumnsRenamed({"uid": "root", "least": "theirs"}), "root").groupBy("uid").agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, "uid").select("uid", F.least("least", "theirs").alias("least"), F.col("least").alias("old"))
        jump = step.join(step.select(F.col("uid").alias("least"), F.col("least").alias("theirs")), "least").select("uid", F.least("least", "theirs").alias("least"), "old")
        jump = checkpointed(jump)
        changed = jump.where("least <> old").limit(1).count()
        labels = jump.select("uid", "least")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(uid, group, links) of documents (uid, text): the least uid of its group, and the number of documents it is linked to; documents without links are left out."""
    n_docs = docs.count()
    buckets = max(64, n_docs // DOCS_PER_BUCKET)
    same = checkpointed(_sets(docs).distinct())
    classes = checkpointed(same.groupBy("same", "same2").agg(F.min("uid").alias("first"), F.count("*").alias("copies")))
    need = F.least(F.lit(DEPTH), F.ceil(F.col("size") * NUM / DEN)).cast("int")
    lists = _shared(_chosen(docs, buckets, hottest(classes, "copies", ["same", "same2", "first"]))).groupBy("uid", "size").agg(F.array_sort(F.collect_set("tok")).alias("toks")).withColumn("need", need)
    lists = checkpointed(lists.where(F.size("toks") >= F.col("need")))
    spread = F.pmod(F.xxhash64("path", "i", "j"), F.lit(buckets)).cast("int")
    placed = _split(lists).select("uid", "size", "toks", "place.*").withColumn("bucket", spread)
    met = _partners(_dealt(placed, buckets)).groupBy("uid").agg(F.collect_set(F.struct(*_PLACES)).alias("at"))
    side = met.join(lists.select("uid", "size", "toks"), "uid").join(classes.select(F.col("first").alias("uid"), "copies"), "uid")
    asked = attached(docs, checkpointed(side), "uid", "inner")

    def shingles(batches):
        for batch in batches:
            rest = [batch.column(c) for c in ("uid", "size", "toks", "copies", "at")]
            for lo, hi, data, offsets in text_chunks(batch.column("text"), STEP_BYTES):
                _, heads, sizes, tokens = shingle_sets(data, offsets)
                packed = [tokens[h : h + s].tobytes() for h, s in zip(heads.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in rest], pa.array(packed, pa.binary())], names=["uid", "size", "toks", "copies", "at", "shingles"])

    place = f"array<struct<{_PLACE.replace(' ', ':')}>>".replace(",:", ",")
    sent = asked.select("text", "uid", "size", "toks", "copies", "at").mapInArrow(tidy(shingles), f"uid long, size int, toks array<int>, copies long, at {place}, shingles binary")
    sent = sent.select("uid", "size", "toks", "copies", "shingles", F.explode("at").alias("at")).select("uid", "size", "toks", "copies", "shingles", "at.*").withColumn("bucket", spread)
    linked = checkpointed(_linked(_dealt(sent, buckets)))
    links = linked.groupBy("uid").agg(F.sum("links").alias("links"))
    groups = groups_of(linked)
    of_class = classes.join(links.withColumnRenamed("uid", "first"), "first", "left").join(groups.withColumnsRenamed({"uid": "first", "least": "group"}), "first", "left")
    of_class = of_class.select("same", "same2", F.coalesce("group", "first").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")).where("links > 0")
    return same.join(of_class, ["same", "same2"]).select("uid", "group", "links")


def _documents(df: DataFrame, key: str, text: str, uid: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their document's identity, and the documents: of rows that repeat id and text, one."""
    number = fresh(df, "_number")
    rows = identified(df, key, text, number, first=uid)
    return rows.drop(number), rows.where(F.col(number) == F.col(uid)).drop(number)


def with_groups(df: DataFrame, key: str = "doc_id", text: str = "text", group: str = "group_id", links: str = "n_links") -> DataFrame:
    """Adds a document's group (the id of its least document; its own if it has no links) and its number of links."""
    if {group.lower(), links.lower()} & {c.lower() for c in df.columns}:
        raise ValueError("the table has a column of a new column's name already")
    uid, near, many, name = fresh(df, "_uid"), fresh(df, "_group"), fresh(df, "_links"), fresh(df, "_name")
    rows, docs = _documents(df, key, text, uid)
    found = near_duplicates(docs.select(F.col(uid).alias("uid"), F.col(text).alias("text"))).withColumnsRenamed({"uid": uid, "group": near, "links": many})
    if plain(df, key):
        found = found.withColumn(name, F.col(near))
    else:
        found = found.join(docs.select(F.col(uid).alias(near), F.col(key).alias(name)), near)
    joined = attached(rows, checkpointed(found.select(uid, name, many)), uid)
    own = F.when(F.col(many).isNull(), F.col(key)).otherwise(F.col(name))
    return joined.withColumn(group, own).withColumn(links, F.coalesce(F.col(many), F.lit(0).cast("long"))).drop(uid, name, many)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that are the least document of their group; of rows that repeat id and text one stays."""
    uid, near = fresh(df, "_uid"), fresh(df, "_group")
    _, docs = _documents(df, key, text, uid)
    found = near_duplicates(docs.select(F.col(uid).alias("uid"), F.col(text).alias("text"))).where(F.col("group") != F.col("uid"))
    gone = checkpointed(found.select(F.col("uid").alias(uid), F.lit(True).alias(near)))
    return attached(docs, gone, uid).where(F.col(near).isNull()).drop(near, uid)
