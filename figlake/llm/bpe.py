"""Byte-level BPE: encode texts to ids with offsets, and decode ids.

Pre-tokenisation is vectorised. Every code point gets a class from an array; every code point also is a function on the
four states of a small automaton, and the functions are composed by a prefix scan (composition is associative, so
blocks are scanned side by side). The states say whether a contraction is being read; with the classes of the
neighbours they fix where each pre-token starts, without a regular expression. The slices are then looked up in a
bounded cache; what the cache lacks is merged pair by pair, many slices at once.

``encode`` keeps all columns and adds ``ids`` (binary: little-endian unsigned 32-bit ids) and ``id_offsets`` (binary: the
byte at which each token starts, same packing). ``decode`` puts each token's bytes at its offset.

Defined cases: a null or empty text gives no ids; texts of any length are encoded whole; rows that repeat are encoded
alike; an empty table gives an empty table. New columns replace nothing: clashing names raise ValueError.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from figlake.llm.common import byte_hashes, ranges, same_bytes, string_buffers, text_chunks, tidy

LETTER, NUMBER, OTHER, BLANK, SPACE, EDGE = range(6)
#: White space as the pattern's \s has it, besides U+0020.
_WHITE = (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Pre-tokens above this many bytes are merged with a heap, one by one.
LONG_PIECE = 96
#: Bytes of text (or of ids) that one step handles.
STEP_BYTES = 1 << 19
#: Entries after which the cache of merged pre-tokens starts anew.
CACHE_ENTRIES = 150_000


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(_WHITE)] = SPACE
    table[0x20] = BLANK
    return table


def _function(*image: int) -> int:
    return sum(v << (2 * k) for k, v in enumerate(image))


@lru_cache(1)
def _composition() -> np.ndarray:
    """[f, g]: first f, then g; a function on four states is a byte with two bits a state."""
    codes = np.arange(256)
    images = np.stack([(codes >> (2 * k)) & 3 for k in range(4)])
    table = np.zeros((256, 256), dtype=np.uint8)
    for k in range(4):
        middle = images[k]
        for m in range(4):
            rows = middle == m
            table[rows] |= (images[m][None, :] << (2 * k)).astype(np.uint8)
    return table


def _scan(functions: np.ndarray, width: int = 128) -> np.ndarray:
    """States after each symbol, from state 0: an inclusive scan by blocks, then over the blocks' compositions."""
    n, compose = len(functions), _composition()
    if n <= width:
        out, state = np.empty(n, np.uint8), 0
        for i, f in enumerate(functions.tolist()):
            state = (f >> (2 * state)) & 3
            out[i] = state
        return out
    rows = -(-n // width)
    padded = np.full(rows * width, _function(0, 1, 2, 3), np.uint8)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)
    for k in range(1, width):
        grid[k] = compose[grid[k - 1], grid[k]]
    entry = np.zeros(rows, np.uint8)
    entry[1:] = _scan(grid[-1], width)[:-1]
    return ((grid >> (2 * entry)[None, :]) & 3).T.reshape(-1)[:n]


#: Functions on (0 outside, 1 one character of a contraction to come, 2 two to come, 3 a contraction just ended).
_PLAIN, _SHORT, _LONG = _function(0, 3, 1, 0), _function(1, 3, 1, 1), _function(2, 3, 1, 2)
_OPEN = {_PLAIN: _function(0, 0, 0, 0), _SHORT: _function(1, 1, 1, 1), _LONG: _function(2, 2, 2, 2)}


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indexes of the code points that start a pre-token; ``first`` marks the first code point of each text."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = EDGE, kind[:-1]
    before[first] = EDGE
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = EDGE, kind[1:]
    after[:-1][first[1:]] = EDGE
    white, white_before, white_after = kind >= BLANK, (before == BLANK) | (before == SPACE), (after == BLANK) | (after == SPACE)
    local = np.where(white, ~white_before | (~white_after & (after != EDGE)), (before != BLANK) & (kind != before))
    functions = np.full(n, _PLAIN, np.uint8)
    at = np.flatnonzero((points == 0x27) & local & (after == LETTER))
    if len(at):
        one = points[at + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n - 1)], points[np.minimum(at + 2, n - 1)], 0)
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        functions[at[short]], functions[at[long]] = _SHORT, _LONG
    for f, opened in _OPEN.items():
        functions[first & (functions == f)] = opened
    state = np.zeros(n, np.uint8)
    state[1:] = _scan(functions)[:-1]
    state[first] = 0
    return np.flatnonzero((state == 3) | ((state == 0) & local))


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each token, where it begins, the bytes of all tokens)."""
    tokens = {rank: token for token, rank in _ranks(path).items()}
    ordered = [tokens.get(k, b"") for k in range(max(tokens) + 1)]
    lengths = np.array([len(t) for t in ordered], np.int64)
    return lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(ordered), np.uint8)


class Vocabulary:
    """The pairs of a byte-level BPE that merge, and a bounded cache of merged pre-tokens."""

    def __init__(self, path: str):
        ranks = _ranks(path)
        self.lengths = token_bytes(path)[0]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(a << 32) | b: r for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None}
        self.pair_rank = pairs
        keys = np.array(sorted(pairs), np.int64)
        bits = 19
        self._shift = np.uint64(64 - bits)
        self._slots = np.full(1 << bits, -1, np.int64)
        self._values = np.full(1 << bits, np.iinfo(np.int64).max, np.int64)
        self._probes = 1
        slots = self._slot(keys)
        values = np.array([pairs[k] for k in keys.tolist()], np.int64)
        left = np.arange(len(keys))
        while len(left):  # linear probing, all keys of a step at once
            where = (slots[left] + self._probes - 1) & ((1 << bits) - 1)
            free = self._slots[where] < 0
            _, pick = np.unique(where[free], return_index=True)
            put = left[free][pick]
            self._slots[where[free][pick]] = keys[put]
            self._values[where[free][pick]] = values[put]
            left = np.setdiff1d(left, put)
            if len(left):
                self._probes += 1
        self._reset()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _reset(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.at, self.many = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        slots, found = self._slot(keys), np.full(len(keys), np.iinfo(np.int64).max, np.int64)
        for k in range(self._probes):
            where = (slots + k) & (len(self._slots) - 1)
            hit = self._slots[where] == keys
            found[hit] = self._values[where[hit]]
        return found

    def _merge_long(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, with a heap over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, pairs = [*range(1, n), -1], [*range(-1, n - 1)], self.pair_rank
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := pairs.get((rank << 32) | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if (k := before[i]) >= 0 and (r := pairs.get((ids[k] << 32) | rank)) is not None:
                heapq.heappush(heap, (r, k, ids[k], rank))
        return [x for x in ids if x >= 0]

    def _merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, count of each piece): a round merges the lowest pair of every piece that has one."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done_owner, done_order, done_ids = [], [], []
        order = np.arange(len(ids))
        never = np.iinfo(np.int64).max
        rank = np.full(len(ids), never, np.int64)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        rank[same] = self.rank_of(ids[same], ids[same + 1])
        while len(ids):
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(ids)])
            spread = np.repeat(least, sizes)
            over = spread == never
            if over.any():
                done_owner.append(owner[over]), done_order.append(order[over]), done_ids.append(ids[over])
                ids, owner, order, rank, spread = (x[~over] for x in (ids, owner, order, rank, spread))
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == spread)
            at = hits[np.r_[True, owner[hits][1:] != owner[hits][:-1]]]  # the leftmost of each piece
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, owner, order, rank = ids[keep], owner[keep], order[keep], rank[keep]
            for i in (moved, moved[moved > 0] - 1):
                inner = i[i + 1 < len(ids)]
                rank[i] = never
                inner = inner[owner[inner] == owner[inner + 1]]
                rank[inner] = self.rank_of(ids[inner], ids[inner + 1])
            edge = moved[moved > 0] - 1
            cross = edge[owner[edge] != owner[edge + 1]]
            rank[cross] = never
        place = np.lexsort((np.concatenate(done_order), np.concatenate(done_owner)))
        out = np.concatenate(done_ids)[place]
        return out, np.bincount(np.concatenate(done_owner), minlength=len(pieces))

    def _store(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        first, need = len(self.cache), len(ids)
        while self.used + need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + len(pieces) > len(self.at):
            self.at, self.many = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.many))
        self.flat[self.used : self.used + need] = ids
        self.at[first : first + len(pieces)] = self.used + np.cumsum(counts) - counts
        self.many[first : first + len(pieces)] = counts
        self.used += need
        self.cache.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def lookup(self, pieces: list[bytes]) -> np.ndarray:
        """Cache entries of the pieces, which are distinct; merges those that the cache lacks."""
        if len(self.cache) > CACHE_ENTRIES:
            self._reset()
        missing = [p for p in pieces if p not in self.cache]
        short, long = [p for p in missing if len(p) <= LONG_PIECE], [p for p in missing if len(p) > LONG_PIECE]
        if short:
            self._store(short, *self._merge_many(short))
        for p in long:
            got = self._merge_long(p)
            self._store([p], np.array(got, np.uint32), np.array([len(got)]))
        return np.fromiter((self.cache[p] for p in pieces), np.int64, len(pieces))

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte offset of each within its text, count of each text) of texts that stand one after the other."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[np.searchsorted(lead, begins)] = True
        starts = lead[piece_starts(points, first)]
        ends = np.r_[starts[1:], len(data)]
        codes, _ = pd.factorize(byte_hashes(data, starts, ends))
        first_of = np.empty(int(codes.max()) + 1, np.int64)
        first_of[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if not same_bytes(data, starts, ends, first_of[codes]):  # two slices share a hash
            codes, distinct = pd.factorize(np.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object))
            pieces = list(distinct)
        else:
            pieces = [raw[a:b] for a, b in zip(starts[first_of].tolist(), ends[first_of].tolist(), strict=True)]
        entry = self.lookup(pieces)[codes]
        counts = self.many[entry]
        ids = self.flat[ranges(self.at[entry], counts)]
        till = np.cumsum(counts)
        piece_of = np.searchsorted(starts, offsets)
        total = np.r_[0, till][piece_of]
        per_text = np.diff(total)
        lengths = self.lengths[ids]
        at = np.cumsum(lengths) - lengths - np.repeat(offsets[:-1], per_text)
        return ids, at.astype(np.uint32), per_text


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(counts)] * 4
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values.astype("<u4")))])


def encode_steps(texts: pa.Array, path: str):
    """Yields (first row, last row + 1, packed ids, packed offsets) step by step."""
    own = vocabulary(path)
    for lo, hi, data, offsets in text_chunks(texts, STEP_BYTES):
        ids, where, counts = own.encode_chunk(data, offsets)
        yield lo, hi, _packed(ids, counts), _packed(where, counts)


def decode_steps(ids: pa.Array, at: pa.Array, path: str):
    """Yields (first row, last row + 1, bytes) step by step: each token's bytes are put at its offset."""
    lengths_of, begins, flat = token_bytes(path)
    places, place_data = string_buffers(at)
    for lo, hi, data, offsets in text_chunks(ids, STEP_BYTES):
        tokens = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
        where = np.frombuffer(place_data[places[lo] : places[hi]].tobytes(), "<u4").astype(np.int64)
        lengths, counts = lengths_of[tokens], (offsets[1:] - offsets[:-1]) // 4
        till, last = np.cumsum(lengths), np.cumsum(counts)
        total = np.r_[0, till][np.r_[0, last]]
        target = np.repeat(where + np.repeat(total[:-1], counts), lengths) + (np.arange(int(total[-1])) - np.repeat(till - lengths, lengths))
        text = np.empty(int(total[-1]), np.uint8)
        text[target] = flat[ranges(begins[tokens], lengths)]
        yield lo, hi, pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(text)])


def _added(df: DataFrame, *fields: T.StructField) -> T.StructType:
    clash = {f.name.lower() for f in fields} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)} already")
    return T.StructType([*df.schema.fields, *fields])


def encode(df: DataFrame, text: str, path: str, ids: str = "ids", offsets: str = "id_offsets") -> DataFrame:
    """Adds the packed ids and byte offsets of every whole text; no shuffle."""
    schema = _added(df, T.StructField(ids, T.BinaryType()), T.StructField(offsets, T.BinaryType()))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for lo, hi, a, b in encode_steps(batch.column(text), path):
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, a, b], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", offsets: str = "id_offsets", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the packed ids stand for; no shuffle."""
    schema = _added(df, T.StructField(out, T.BinaryType()))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for lo, hi, a in decode_steps(batch.column(ids), batch.column(offsets), path):
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, a], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def round_trip(df: DataFrame, text: str, path: str, ids: str = "ids", offsets: str = "id_offsets", out: str = "decoded") -> DataFrame:
    """What encode and then decode add, in one pass of one worker: the bytes are decoded from the packed ids."""
    schema = _added(df, T.StructField(ids, T.BinaryType()), T.StructField(offsets, T.BinaryType()), T.StructField(out, T.BinaryType()))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for lo, hi, a, b in encode_steps(batch.column(text), path):
                    for x, y, c in decode_steps(a, b, path):
                        yield pa.RecordBatch.from_arrays([*batch.slice(lo + x, y - x).columns, a.slice(x, y - x), b.slice(x, y - x), c], names=schema.names)

    return df.mapInArrow(tidy(run), schema)
