"""Helpers shared by the corpus operators: text chunks, vectorised hashes, checkpoints."""

from __future__ import annotations

import contextlib
import ctypes
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figlake.sources.store import checkpoint_folder as checkpoint_folder
from figlake.sources.store import materialised as checkpointed

#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_SEEDS = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_LEFT, _RIGHT, _LENGTH = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0xA24BAED4963EE407)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x *= _MIX1
    x ^= x >> U64(27)
    x *= _MIX2
    x ^= x >> U64(31)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def _chunks(wide: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each start, zeros where fewer than eight are left."""
    part = wide[starts]
    few = np.flatnonzero(left < 8)
    part[few] &= (U64(1) << (U64(8) * left[few].astype(U64))) - U64(1)
    return part


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, in one of two independent ways: eight bytes at a time are mixed into the state; BLAKE2 for long spans."""
    wide, length, seed = _eights(data), ends - starts, _SEEDS[which]
    out = mix64(length.astype(U64) * _LENGTH + seed)
    for k in np.flatnonzero(length > LONG_SPAN).tolist():
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    rows = np.flatnonzero((length > 0) & (length <= LONG_SPAN))
    at, left = starts[rows], length[rows]
    while len(rows):
        out[rows] = mix64((out[rows] ^ _chunks(wide, at, left)) * _LEFT + seed)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span data[start:end] is equal, byte by byte, to the span with the number ``other``."""
    length = ends - starts
    rows = np.flatnonzero(other != np.arange(len(other)))
    if (length[rows] != length[other[rows]]).any():
        return False
    wide, at, own, left = _eights(data), starts[rows], starts[other[rows]], length[rows]
    for k in np.flatnonzero(left > LONG_SPAN).tolist():
        if not np.array_equal(data[at[k] : at[k] + left[k]], data[own[k] : own[k] + left[k]]):
            return False
    at, own, left = (x[left <= LONG_SPAN] for x in (at, own, left))
    while len(left):
        if (_chunks(wide, at, left) != _chunks(wide, own, left)).any():
            return False
        more = left > 8
        at, own, left = at[more] + 8, own[more] + 8, left[more] - 8
    return True


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] (not empty) for each span: of its first and last 2**k values, whose hashes are built by doubling; nothing in it is a polynomial."""
    length, seed = ends - starts, _SEEDS[which]
    power = np.frexp(length.astype(np.float64))[1] - 1
    out, table = np.empty(len(starts), U64), mix64(values.astype(U64) + seed)
    for k in range(int(power.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            table = mix64(table[:-half] * _LEFT + (table[half:] ^ seed) * _RIGHT)
        rows = np.flatnonzero(power == k)
        if len(rows):
            first, last = table[starts[rows]], table[ends[rows] - (1 << k)]
            out[rows] = mix64(mix64(first + length[rows].astype(U64) * _LENGTH) * _LEFT + last)
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off.astype(np.int64), raw


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES):
    """Yields (first row, last row + 1, bytes, offsets from 0) with at most ``most`` bytes, or one row."""
    off, raw = string_buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the maximal runs of bytes that ``space`` (a table of 256 booleans) leaves, within each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(space[data], out=inside[:-1])
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    bounds = offsets[1:-1][offsets[1:-1] < len(data)]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds] = True
    first |= cut[:-1] & inside[:-1]
    last = inside[:-1] & (~inside[1:] | cut[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total, dtype=np.int64)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added, so that no column of df has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: written plainly, the optimiser would put it into the lambdas that use it."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and array elements, taken together, of a side that may be broadcast; of some ten bytes each, and counted before.
BROADCAST_ELEMENTS = 1_500_000


def plain(df: DataFrame, key: str) -> bool:
    """Whether keys are integers, never null and never repeated, so that they are the rows' identities as they are."""
    whole = df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    return whole and not _unclear(df, key).limit(1).count()


def _unclear(df: DataFrame, key: str) -> DataFrame:
    """(key, n): the keys that are null or that n > 1 rows have."""
    return df.groupBy(F.col(key)).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def identified(df: DataFrame, key: str, text: str, out: str, first: str | None = None) -> DataFrame:
    """Adds a number of each row's own, in the order of keys, null ones last, then of the texts' hashes; and in ``first`` the least number of the rows that repeat its key and text.

    The number is the key itself where keys are plain. Else rows whose key is not repeated get their number from the key alone; the others (all, if keys are no
    integers or would not fit) are written to a checkpoint, as numbers of equal rows must not change from one reading to the next.
    """
    if plain(df, key):
        numbered = df.withColumn(out, F.col(key).cast("long"))
        return numbered.withColumn(first, F.col(out)) if first else numbered
    at, group, place, begin, head, hashed = (fresh(df, c) for c in ("_at", "_group", "_place", "_begin", "_head", "_hash"))
    base = most = None
    if df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte"):
        found = df.agg(F.min(key), F.max(key), F.count_if(F.col(key).isNull())).first()
        unclear = checkpointed(_unclear(df, key).where(F.col(key).isNotNull()))
        low, high = (found[0], found[1]) if found[0] is not None else (0, 0)
        most = max(unclear.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0], found[2], 1)
        if (high - low + 2) * most < 1 << 63:
            base = lambda k: (F.coalesce(k.cast("decimal(20,0)"), F.lit(high + 1).cast("decimal(20,0)")) - F.lit(low).cast("decimal(20,0)")).cast("long") * F.lit(most)
    some, clear = df, None
    if base:
        keyed = df.where(F.col(key).isNotNull())
        clear = attached(keyed, unclear.select(key), key, "left_anti").withColumn(out, base(F.col(key)))
        some = attached(keyed, unclear.select(key), key, "left_semi").unionByName(df.where(F.col(key).isNull()))
    some = checkpointed(some.withColumn(at, F.monotonically_increasing_id()))
    ordered = some.select(F.col(key).alias(group), F.xxhash64(text).alias(hashed), at).orderBy(F.col(group).asc_nulls_last(), hashed, at)
    ordered = checkpointed(ordered.withColumn(place, F.monotonically_increasing_id()))  # ascending, but with gaps between partitions
    part = F.shiftrightunsigned(place, 33)
    sizes = {r.part: r.n for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    begins, total = [], 0
    for k in sorted(sizes):
        begins.append((k, total))
        total += sizes[k]
    begins = df.sparkSession.createDataFrame(begins, f"{head} long, {begin} long")
    ordered = ordered.join(F.broadcast(begins), part == F.col(head)).withColumn(place, F.col(begin) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).drop(begin, head)

    def least(by: list[str], name: str) -> DataFrame:
        """Adds the least place of the rows that are equal in ``by``; a join, as one value may have very many rows."""
        heads = ordered.groupBy(*by).agg(F.min(place).alias(name)).withColumnsRenamed({c: f"{c}2" for c in by})
        alike = [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in by]
        return ordered.join(heads, alike).drop(*[f"{c}2" for c in by])

    if base:
        ordered = least([group], begin)
        shift = base(F.col(group)) - F.col(begin)
    else:
        shift = F.lit(0)
    ordered = least([group, hashed], head)
    numbers = checkpointed(ordered.select(at, (F.col(place) + shift).alias(out), (F.col(head) + shift).alias(first or head)))
    some = checkpointed(attached(some, numbers if first else numbers.drop(head), at, "inner").drop(at))
    if clear is None:
        return some
    return (clear.withColumn(first, F.col(out)) if first else clear).unionByName(some)


#: Bits of the bitmap that says which rows may have a partner: at most 32 MB, and as good as useless from a third as many partners on.
FILTER_BITS = 28


def _marked(df: DataFrame, side: DataFrame, on: str, mark: str, n: int) -> DataFrame:
    """Adds whether a row's key may be one of side's n: by a broadcast bitmap of hashed keys, of about eight bits a key and FILTER_BITS at most."""
    bucket, bits = fresh(df, "_bucket"), fresh(df, "_bits")
    place = F.pmod(F.xxhash64(on), F.lit(1 << min(FILTER_BITS, (8 * n).bit_length())))
    maps = side.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col(bucket), "left")
    return found.withColumn(mark, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(bucket, bits)


def attached(df: DataFrame, side: DataFrame, on: str, how: str = "left", small: bool = True) -> DataFrame:
    """Joins side, which has one row for each value of ``on``: broadcast if that may be (``small``) and its rows and array elements are few by count.

    Else by a shuffle that hashes side and does not sort df, of the rows of df only that may have a partner (see _marked); the others (left and anti joins) are read a second time and stay where they are.
    """
    arrays = [F.coalesce(F.size(f.name), F.lit(0)) for f in side.schema.fields if f.dataType.typeName() == "array"]
    weight, n = side.agg(F.coalesce(F.sum(sum(arrays, F.lit(4))), F.lit(0)), F.count("*")).first()
    if small and weight <= BROADCAST_ELEMENTS:
        return df.join(F.broadcast(side), on, how)
    hashed = side.hint("shuffle_hash")
    if n > (1 << FILTER_BITS) // 3:
        return df.join(hashed, on, how)
    mark = fresh(df, "_mark")
    marked = _marked(df, side, on, mark, n)
    met = marked.where(F.col(mark)).drop(mark).join(hashed, on, how)
    if how in ("inner", "left_semi"):
        return met
    rest = marked.where(~F.col(mark)).drop(mark)
    if how == "left":
        rest = rest.withColumns({f.name: F.lit(None).cast(f.dataType) for f in side.schema.fields if f.name != on})
    return met.unionByName(rest.select(*met.columns))


#: Buckets of words that tasks' counts are summed up in.
COUNT_BUCKETS = 64


class Heavy:
    """Counts of hashed words with bounded memory: after each overflow only the most frequent are kept."""

    def __init__(self, limit: int):
        self.limit, self.parts, self.held = limit, [], 0

    def add(self, distinct: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((distinct, counts))
        self.held += len(distinct)
        if self.held > 8 * self.limit:
            self.parts = [self._most(4 * self.limit)]
            self.held = len(self.parts[0][0])

    def _most(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        distinct, counts = self.parts[0]
        if len(self.parts) > 1:
            codes, distinct = pd.factorize(np.concatenate([p[0] for p in self.parts]))
            counts = np.bincount(codes, np.concatenate([p[1] for p in self.parts])).astype(np.int64)
        if len(counts) > n:
            keep = np.argpartition(-counts, n)[:n]
            distinct, counts = distinct[keep], counts[keep]
        return distinct, counts

    def packed(self) -> tuple[pa.Array, pa.Array]:
        """(bucket, words and their counts) of the most frequent words, for most_common."""
        words, counts = self._most(self.limit)
        bucket = (mix64(words) % U64(COUNT_BUCKETS)).astype(np.uint8)
        order = np.argsort(bucket, kind="stable")
        words, counts, edges = words[order], counts[order].astype(np.int64), np.searchsorted(bucket[order], np.arange(COUNT_BUCKETS + 1))
        packed = [words[a:b].tobytes() + counts[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.array(np.arange(COUNT_BUCKETS, dtype=np.int32)), pa.array(packed, pa.binary())


#: Tasks' results that are folded into one at a time.
FAN = 64


def task_number() -> int:
    return TaskContext.get().partitionId()


def folded(parts: DataFrame, fold) -> list[tuple[int, bytes]]:
    """(key, packed) on the driver: parts (key int, task long, packed binary), which has a row for each key and task, is folded by fold(list of packed, whether this is the last round).

    Rounds fold at most FAN rows at a time, so that no group grows with the number of tasks. parts is read more than once, so give a checkpoint.
    """
    n, schema = (parts.agg(F.max("task")).first()[0] or 0) + 1, "key int, task long, packed binary"
    while True:
        last = n <= FAN

        def meet(table: pa.Table, last: bool = last) -> pa.Table:
            group = pa.array([table.column("task")[0].as_py() // FAN], pa.int64())
            return pa.table({"key": table.column("key").slice(0, 1), "task": group, "packed": pa.array([fold([x.as_py() for x in table.column("packed")], last)], pa.binary())})

        parts = parts.groupBy("key", F.floor(F.col("task") / FAN)).applyInArrow(tidy_group(meet), schema)
        if last:
            return [(r.key, r.packed) for r in parts.collect()]
        n = -(-n // FAN)


def most_common(parts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, counts) of about the ``limit`` most frequent words of parts (key: bucket, task, packed), limit / COUNT_BUCKETS of each bucket: on the driver, 16 bytes each."""

    def fold(packed: list[bytes], last: bool) -> bytes:
        blobs = [np.frombuffer(x, U64) for x in packed]
        words = np.concatenate([x[: len(x) // 2] for x in blobs])
        codes, distinct = pd.factorize(words)
        total = np.bincount(codes, np.concatenate([x[len(x) // 2 :] for x in blobs]).astype(np.int64), len(distinct)).astype(np.int64)
        most = np.lexsort((distinct, -total))[: (1 if last else 4) * limit // COUNT_BUCKETS]
        return distinct[most].tobytes() + total[most].tobytes()

    blobs = [np.frombuffer(packed, U64) for _, packed in folded(parts, fold)] or [np.zeros(0, U64)]
    hashes = np.concatenate([x[: len(x) // 2] for x in blobs])
    counts = np.concatenate([x[len(x) // 2 :] for x in blobs]).astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


#: Sets that stand at least HOT times, the HOTTEST most frequent of them, are known to all tasks: some forty bytes each.
HOT, HOTTEST = 16, 100_000


def hottest(found: DataFrame, count: str, columns: list[str]) -> list[np.ndarray]:
    """The columns (longs; the first two are the hashes of a set) of the most frequent rows of found, in the order of the first."""
    rows = found.where(F.col(count) >= HOT).orderBy(F.desc(count), *columns[:2]).limit(HOTTEST).select(*columns).toArrow()
    out = [rows.column(c).to_numpy() for c in columns]
    order = np.argsort(out[0], kind="stable")
    return [x[order] for x in out]


def posts(hot: list[np.ndarray], first: np.ndarray, second: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which sets (by their two hashes) are to be posted from this place: all that are not among the hot ones, and those that stand here first of all. So a set that is everywhere is posted once."""
    out = np.ones(len(first), bool)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], first), len(hot[0]) - 1)
        known = (hot[0][at] == first) & (hot[1][at] == second)
        out = ~known | np.logical_and.reduce([known, *[own[at] == x for own, x in zip(hot[2:], place, strict=True)]])
    return out


def planes(column: np.ndarray) -> bytes:
    """The first bytes of all values, then the second bytes, and so on: bytes that hardly vary compress away."""
    return column.view(np.uint8).reshape(len(column), column.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n)


def packed_groups(columns: list[np.ndarray], edges: np.ndarray, words: np.ndarray | None = None, counts: np.ndarray | None = None) -> pa.Array:
    """One binary value for each group of rows edges[k]:edges[k + 1] of the columns: their number, the first bytes of all values, the second bytes, and so on (see planes), and their extra words (``counts`` for each row).

    Groups may be very many and small, so nothing is done group by group.
    """
    many = np.diff(edges)
    wide = sum(c.itemsize for c in columns)
    own = np.repeat(np.arange(len(many)), many)
    extra = np.bincount(own, counts, len(many)).astype(np.int64) if words is not None else np.zeros(len(many), np.int64)
    padded = -(-many * wide // 8) * 8
    ends = np.cumsum(8 + padded + 8 * extra)
    begin = ends - (8 + padded + 8 * extra)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out.view(np.int64)[begin // 8] = many
    at, step = begin[own] + 8 + np.arange(len(own)) - edges[own], many[own]
    for c in columns:
        for plane in np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T:
            out[at] = plane
            at = at + step
    if words is not None:
        out.view(np.uint64)[ranges((begin + 8 + padded) // 8, extra)] = words
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(out)])


def unpacked_groups(packed: pa.Array, kinds: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, extra words) of all groups of packed_groups, one after the other."""
    offsets, raw = string_buffers(packed)
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    words, begin = raw.view(np.uint64), offsets[:-1]
    many = words[begin // 8].astype(np.int64)
    wide = sum(np.dtype(kind).itemsize for kind in kinds)
    step = np.repeat(many, many)
    at = ranges(begin + 8, many)
    out = []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        rows = np.empty((len(at), size), np.uint8)
        for k in range(size):
            rows[:, k] = raw[at]
            at = at + step
        out.append(rows.view(kind).ravel())
    first = begin + 8 + -(-many * wide // 8) * 8
    return out, words[ranges(first // 8, (offsets[1:] - first) // 8)]


def _release() -> None:
    """Gives free memory back to the system: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of an Arrow batch: ten thousand long texts, held by Spark and by the worker, would be too much for small executors.
BATCH_ROWS = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidy(run):
    """For mapInArrow: run, with memory given back at the end of the task. Lowers the session's rows of a batch to BATCH_ROWS if they are more."""
    session = SparkSession.getActiveSession()
    if session is not None and not 0 < int(session.conf.get(_ROWS_SETTING, "10000")) <= BATCH_ROWS:
        session.conf.set(_ROWS_SETTING, BATCH_ROWS)

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def tidy_group(meet):
    """For applyInArrow: meet, with memory given back after large groups."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = meet(table)
        if table.nbytes > 1 << 22:
            _release()
        return out

    return wrapped
