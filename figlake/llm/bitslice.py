"""Exact top-k inner products with a bit-sliced index.

Components become integers, floor(1024 x). Rows are dealt to blocks; a block keeps, for every attribute and bit, a bitmap over
its rows. For a query, the slices of the higher bits are added with bitmap arithmetic: a set bit of a query component
puts a slice (or its complement, for a negative component) into the column of its weight, and carry-save adders reduce
each column to one slice of the coarse score. The k-th coarse score is found from the most significant slice downward;
rows whose coarse score reaches it less the error of the bits left out are the boundary rows, which are scored
exactly, ties to the smaller id. Blocks' winners are merged per query.

Rows and queries meet block by block: each (query block, row block) is one bounded group of a cogroup.

Defined cases: vectors that are null or hold null or non-finite components take no part; only vectors of the query's
length are its candidates; repeated rows are candidates each, but none with the query's own id; of queries that repeat
an id the shortest and then least vector counts; rows with a null id take no part; components of any finite size are scored exactly (vectors too
large for sums of 64 bits outside the index), and a score among the best that no long can hold raises OverflowError; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_BLOCK, QUERY_BLOCK = 16_384, 2_048
#: High bits of an attribute that the coarse score adds.
HIGH_BITS = 7
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def floors(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of every component x, as whole doubles."""
    return np.floor(1024.0 * vectors.astype(np.float64))


def narrow(whole: np.ndarray) -> np.ndarray:
    """Which vectors are so small that their inner products, and the sums on the way there, fit into 64 bits."""
    return np.abs(whole).max(axis=1, initial=0) <= 2.0 ** ((60 - whole.shape[1].bit_length()) // 2)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of whole doubles of any size, with integers of any size."""
    other = [int(x) for x in query.tolist()]
    return [sum(int(a) * b for a, b in zip(row, other, strict=True)) for row in rows.tolist()]


class SlicedIndex:
    """Bitmaps of a block of integer vectors, one for each attribute and bit; then the complements."""

    def __init__(self, rows: np.ndarray):
        self.rows, (n, d) = rows, rows.shape
        self.least = rows.min(axis=0)
        shifted = rows - self.least
        self.bits = max(1, int(shifted.max()).bit_length())
        self.dropped = max(0, self.bits - HIGH_BITS)
        self.words = -(-n // 64)
        self.valid = self._bitmap(np.ones(n, bool))
        plain = np.stack([np.stack([self._bitmap((shifted[:, j] >> b) & 1) for b in range(self.dropped, self.bits)]) for j in range(d)])
        self.slices = np.concatenate([plain, ~plain])

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, np.uint8)
        padded[: len(flags)] = flags
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def coarse(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of the coarse score, least significant first; the most that the bits left out can add), both less a constant of the query."""
        size, d = np.abs(query), len(query)
        source = np.arange(d) + d * (query < 0)
        columns: dict[int, list[tuple[np.ndarray, int]]] = {}
        for qb in range(int(size.max()).bit_length()):
            has = source[(size >> qb) & 1 == 1]
            for k in range(self.slices.shape[1]):
                columns.setdefault(qb + k, []).append((has, k))
        out, carried, weight = [], [], 0
        while weight in columns or carried:
            parts = [self.slices[has, k] for has, k in columns.get(weight, ())] + carried
            stack, carried = np.concatenate(parts) if parts else np.zeros((0, self.words), np.uint64), []
            while len(stack) > 1:
                m = len(stack) // 3
                if m:
                    a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                    half = a ^ b
                    carry = a & b
                    carry |= half & c
                    half ^= c
                    stack = np.concatenate([half, stack[3 * m :]])
                else:
                    a, b = stack
                    carry, stack = (a & b)[None], (a ^ b)[None]
                carried.append(carry)
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            weight += 1
        return out, int(size.sum()) * ((1 << self.dropped) - 1)

    def top(self, query: np.ndarray, k: int, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows that are not barred; of equal scores the earlier rows."""
        slices, slack = self.coarse(query)
        allowed = self.valid & ~self._bitmap(barred)
        count = lambda x: int(np.bitwise_count(x).sum())
        sure, equal, bound = np.zeros(self.words, np.uint64), allowed, 0
        need = min(k, count(allowed))
        if not need:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        have = 0  # rows known to be above all of ``equal``
        for weight in range(len(slices) - 1, -1, -1):  # the need-th largest coarse score, from the top slice down
            ones = equal & slices[weight]
            n = count(ones)
            if have + n >= need:
                equal, bound = ones, bound | (1 << weight)
            else:
                sure, equal, have = sure | ones, equal & ~slices[weight], have + n
        bound = max(0, bound - -(-slack >> self.dropped) - 1)
        above, equal = np.zeros(self.words, np.uint64), allowed
        for weight in range(len(slices) - 1, -1, -1):  # rows at or above the lowered bound
            if (bound >> weight) & 1:
                equal = equal & slices[weight]
            else:
                above = above | (equal & slices[weight])
                equal = equal & ~slices[weight]
        rows = np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))
        scores = self.rows[rows] @ query
        order = np.lexsort((rows, -scores))[:k]
        return rows[order], scores[order]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return floors(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1))


class Block:
    """The rows of one block: small vectors in a sliced index, the others (few, as a rule) as they are."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, whole = ids[order], whole[order]
        small = narrow(whole)
        self.ids, self.index = ids[small], SlicedIndex(whole[small].astype(np.int64)) if small.any() else None
        self.whole, self.wide = whole, np.flatnonzero(~small)
        self.all_ids = ids

    def top(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score) of rows with other ids than the query's own, ties to the smaller id."""
        found, rest = [], self.wide
        if narrow(query[None])[0]:
            if self.index is not None:
                at, scores = self.index.top(query.astype(np.int64), k, self.ids == own)
                found = list(zip(self.ids[at].tolist(), scores.tolist(), strict=True))
        else:
            rest = np.arange(len(self.whole))
        rest = rest[self.all_ids[rest] != own]
        if len(rest):
            found += zip(self.all_ids[rest].tolist(), exact_scores(self.whole[rest], query), strict=True)
            found.sort(key=lambda x: (-x[1], x[0]))
        return found[:k]


def top_k(df: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", every: int = 100) -> DataFrame:
    """Queries are the rows whose key is divisible by ``every``; returns query_id, rank (from 1), the key and score."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & sound)
    least = F.min(F.struct(F.size("v").alias("d"), "v")).alias("least")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(least).select("id", "least.d", "least.v")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    row_blocks, query_blocks = max(1, -(-counts.n // ROW_BLOCK)), max(1, -(-counts.q // QUERY_BLOCK))

    def dealt(side: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        side = side.withColumn(own, F.pmod(F.xxhash64("id", "v"), F.lit(own_blocks)).cast("int"))
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))

    left = dealt(rows.withColumn("d", F.size("v")), "rb", row_blocks, "qb", query_blocks)
    right = dealt(queries, "qb", query_blocks, "rb", row_blocks)
    schema = "query_id long, id long, score long"

    def meet(table: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if table.num_rows and asked.num_rows:
            block = Block(table.column("id").to_numpy(), _matrix(table.column("v")))
            for own, query in zip(asked.column("id").to_pylist(), _matrix(asked.column("v")), strict=True):
                found += [(own, at, score) for at, score in block.top(own, query, k)]
        if any(abs(score) >= 1 << 63 for _, _, score in found):
            raise OverflowError("an inner product does not fit into a long")
        return pa.table([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["query_id", "id", "score"])

    best = left.groupBy("rb", "qb", "d").cogroup(right.groupBy("rb", "qb", "d")).applyInArrow(meet, schema)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
