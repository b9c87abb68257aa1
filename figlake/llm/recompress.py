"""Removal of long repeated passages by recompression.

Every run of ``WINDOW`` = 35 words that occurs anywhere else too is removed, exactly. The words of a document are
rewritten in rounds. A round gives each maximal run of one symbol a name, and then each pair of a left and a right symbol;
a bit of a symbol's name says which side it is. Names are hashes of what they stand for, so all tasks and documents agree on
them without being asked. Equal windows get equal symbols in their interior: what a window can be sure of, whatever stands around it, is
computed from the window alone. Of the sure symbols of the highest round each window takes the longest (ties by hash, then the first) as its anchor.

1. The windows of one anchor are neighbours. A record is their anchor's name, the fingerprint of the words they span, and the
   place. Records travel packed, by buckets of names; records that repeat within a step travel once.
2. A name that stands once anywhere has no repeated window. Records of one name and one span repeat as a whole.
3. If a name has several spans, windows at the edge of a repeat may still be equal: the windows of one record of each span are fetched
   and compared one by one.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: null and empty texts have no words and stay as they are; very long texts are
read whole; rows are told apart though they repeat an id or have none; rows that repeat id and text have each other's passages, so
they count as repeats; other columns are kept, clashes with new ones raise ValueError; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figlake.llm.common import attached, byte_hashes, checkpointed, fresh, identified, mix64, packed_groups, ranges, run_hashes, text_chunks, tidy, tidy_group, unpacked_groups, words_of

WINDOW, ROUNDS = 35, 3
DOCS_PER_BUCKET, LEAST_BUCKETS = 4000, 16
STEP_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)]
_PAIR, _RUN = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


class Rounds:
    """Symbols of each round, where they begin, and the sure ones of every window."""

    def __init__(self, words: np.ndarray, text: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
        n = len(words)
        first = np.arange(max(0, n - window + 1))
        first = first[text[first] == text[first + window - 1]] if len(first) else first
        self.windows = first
        self.symbols, self.begins = [words], [np.arange(n)]
        self.low, self.high = [first], [first + window - 1]
        of = text
        for k in range(rounds):
            if not len(first):
                break
            of = self._round(of, _SEEDS[k])

    def _round(self, text: np.ndarray, seed: np.uint64) -> np.ndarray:
        symbols, begins, low, high = self.symbols[-1], self.begins[-1], self.low[-1], self.high[-1]
        new = np.r_[True, (symbols[1:] != symbols[:-1]) | (text[1:] != text[:-1])]
        run, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        length = np.diff(np.r_[heads, len(symbols)])
        symbols, begins, text = symbols[heads], begins[heads], text[heads]
        symbols = np.where(length > 1, mix64(symbols * _RUN + length.astype(np.uint64)), symbols)
        left = (mix64(symbols + seed) >> np.uint64(63)).astype(bool)
        pair = np.r_[left[:-1] & ~left[1:] & (text[1:] == text[:-1]), False]
        kept = ~np.r_[False, pair[:-1]]
        turn = np.r_[np.cumsum(kept) - 1, int(kept.sum())]
        names = symbols.copy()
        at = np.flatnonzero(pair)
        names[at] = mix64(symbols[at] * _PAIR + mix64(symbols[at + 1] + seed))
        # the first run may go on to the left of a window, a right symbol after it may be paired with one there; and so on the right
        a = np.minimum(run[np.clip(low, 0, len(run) - 1)] + 1, len(symbols))
        a = np.where(low >= len(run), len(symbols), a)
        a = a + np.r_[~left, False][a]
        b = run[np.clip(high, 0, len(run) - 1)] - 1
        b = np.where(high < 0, -1, b)
        b = b - np.r_[left, False][b]
        self.low.append(turn[np.minimum(a, len(symbols))])
        self.high.append(np.where(b < 0, -1, turn[b]))
        self.symbols.append(names[kept])
        self.begins.append(begins[kept])
        return text[kept]

    def anchors(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(round, symbol) of each window's anchor."""
        level = np.zeros(len(self.windows), np.int64)
        for k in range(1, len(self.symbols)):
            level[self.low[k] <= self.high[k]] = k
        out = np.empty(len(self.windows), np.int64)
        for k in range(len(self.symbols)):
            rows = np.flatnonzero(level == k)
            if not len(rows):
                continue
            length = np.minimum(np.diff(np.r_[self.begins[k], end]), 63).astype(np.uint64)
            rank = ((np.uint64(63) - length) << np.uint64(58)) | (mix64(self.symbols[k]) >> np.uint64(6))
            out[rows] = _least(rank, self.low[k][rows], self.high[k][rows])
        return level, out


def _least(rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First place of the least rank in each [low, high], with a sparse table."""
    power = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out, table = np.empty(len(low), np.int64), np.arange(len(rank))
    for k in range(int(power.max()) + 1):
        if k:
            half = 1 << (k - 1)
            a, b = table[:-half], table[half:]
            table = np.where(rank[a] <= rank[b], a, b)
        rows = np.flatnonzero(power == k)
        if len(rows):
            a, b = table[low[rows]], table[high[rows] - (1 << k) + 1]
            out[rows] = np.where((rank[a] < rank[b]) | ((rank[a] == rank[b]) & (a <= b)), a, b)
    return out


_PACK = (("name", "<i8"), ("span", "<i8"), ("uid", "<i8"), ("at", "<i4"), ("n", "<i4"))
#: Added to n of records that are known to repeat: within a step another one is like them.
_SURE = 1 << 30


def _packed(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), packed_groups(columns, edges)], names=["bucket", "packed"])


def _unpacked(packed: pa.Array, pack: tuple[tuple[str, str], ...]) -> list[np.ndarray]:
    return unpacked_groups(packed, [kind for _, kind in pack])[0]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, a second hash, text, place in the text) of every word."""
    starts, ends, text = words_of(data, offsets, _SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), text, text
    return byte_hashes(data, starts, ends), byte_hashes(data, starts, ends, 1), text, np.arange(len(text)) - np.searchsorted(text, text)


def _records(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            for lo, hi, data, offsets in text_chunks(batch.column("text"), STEP_BYTES):
                words, others, text, place = _words(data, offsets)
                rounds = Rounds(words, text)
                first = rounds.windows
                if not len(first):
                    continue
                level, anchor = rounds.anchors(len(words))
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (level[1:] != level[:-1]) | (first[1:] != first[:-1] + 1)]
                heads = np.flatnonzero(new)
                many = np.diff(np.r_[heads, len(first)])
                level, anchor, start = level[heads], anchor[heads], first[heads]
                name, begin = np.empty(len(heads), np.uint64), np.empty(len(heads), np.int64)
                for k in range(len(rounds.symbols)):
                    rows = level == k
                    name[rows] = mix64(rounds.symbols[k][anchor[rows]] + _SEEDS[k])
                    begin[rows] = rounds.begins[k][anchor[rows]]
                span = run_hashes(others, start, start + many + WINDOW - 1, 1)
                span = mix64(span + ((begin - start) * 4096 + many).astype(np.uint64))
                uid, at = uids[lo:hi][text[start]], place[start]
                order = np.lexsort((span, name))
                same = np.r_[False, (name[order][1:] == name[order][:-1]) & (span[order][1:] == span[order][:-1])]
                repeated = same | np.r_[same[1:], False]
                sure, head = np.zeros(len(heads), bool), np.zeros(len(heads), bool)
                sure[order], head[order] = repeated, ~same
                bucket = np.where(head, (name % np.uint64(buckets)).astype(np.int64), mix64(uid.view(np.uint64) + at.astype(np.uint64)) .astype(np.int64) % buckets)
                yield _packed(bucket, [np.where(head, name.view(np.int64), 0), np.where(head, span.view(np.int64), 0), uid, at.astype(np.int32), (many + np.where(sure, _SURE, 0)).astype(np.int32)])

    return docs.mapInArrow(tidy(run), "bucket int, packed binary")


_FOUND = "uid long, at int, n int, sure boolean, open boolean"


def _found(records: DataFrame) -> DataFrame:
    """(uid, at, n, sure, open): sure ones repeat as a whole; the windows of open ones are to be compared."""

    def meet(table: pa.Table) -> pa.Table:
        name, span, uid, at, n = _unpacked(table.column("packed"), _PACK)
        known, n = n >= _SURE, n & (_SURE - 1)
        only = known & (name == 0) & (span == 0)  # the others of a step, sure already
        order = np.lexsort((at, uid, span, name))
        order = order[~only[order]]
        a, b = name[order], span[order]
        head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)]
        group = np.cumsum(head) - 1
        size, is_known = np.bincount(group), np.bincount(group, known[order]) > 0
        names = np.cumsum(np.r_[True, a[1:] != a[:-1]][: len(order)]) - 1
        spans = np.bincount(names, head)
        sure = (size[group] > 1) | is_known[group]
        open_ = head & (spans[names] > 1)
        rows = sure | open_
        out = [np.concatenate([x[order][rows], x[only]]) for x in (uid, at, n)]
        flags = [np.concatenate([sure[rows], np.ones(int(only.sum()), bool)]), np.concatenate([open_[rows], np.zeros(int(only.sum()), bool)])]
        return pa.table([*map(pa.array, out), *map(pa.array, flags)], names=["uid", "at", "n", "sure", "open"])

    return records.groupBy("bucket").applyInArrow(tidy_group(meet), _FOUND)


_WINDOWS = (("one", "<u8"), ("two", "<u4"), ("uid", "<i8"), ("at", "<i4"))


def _equal_windows(docs: DataFrame, open_: DataFrame, buckets: int) -> DataFrame:
    """(uid, at, n): of the open records' windows those that occur at two places or more."""
    asked = checkpointed(open_.groupBy("uid").agg(F.collect_set(F.struct("at", "n")).alias("asked")).select("uid", F.col("asked.at").alias("ats"), F.col("asked.n").alias("ns")))
    joined = attached(docs, asked, "uid", "inner", small=False).select("uid", "text", "ats", "ns")

    def run(batches):
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            for lo, hi, data, offsets in text_chunks(batch.column("text"), STEP_BYTES):
                words, others, text, _ = _words(data, offsets)
                ats, ns = batch.column("ats").slice(lo, hi - lo), batch.column("ns").slice(lo, hi - lo)
                begin = np.searchsorted(text, np.arange(hi - lo))
                of = np.repeat(np.arange(hi - lo), ats.value_lengths().to_numpy())
                many = ns.flatten().to_numpy().astype(np.int64)
                at = ranges(ats.flatten().to_numpy().astype(np.int64), many)
                of = np.repeat(of, many)
                start = begin[of] + at
                one, two = run_hashes(words, start, start + WINDOW), run_hashes(others, start, start + WINDOW, 1)
                yield _packed((one % np.uint64(buckets)).astype(np.int64), [one, (two >> np.uint64(32)).astype(np.uint32), uids[lo:hi][of], at.astype(np.int32)])

    def meet(table: pa.Table) -> pa.Table:
        one, two, uid, at = _unpacked(table.column("packed"), _WINDOWS)
        order = np.lexsort((at, uid, two, one))
        one, two, uid, at = one[order], two[order], uid[order], at[order]
        alike = np.r_[False, (one[1:] == one[:-1]) & (two[1:] == two[:-1])][: len(one)]
        other = alike & np.r_[False, (uid[1:] != uid[:-1]) | (at[1:] != at[:-1])][: len(one)]
        group = np.cumsum(~alike) - 1
        held = (np.bincount(group, other) > 0)[group] if len(one) else other
        return pa.table({"uid": uid[held], "at": at[held], "n": np.ones(int(held.sum()), np.int32)})

    return joined.mapInArrow(tidy(run), "bucket int, packed binary").groupBy("bucket").applyInArrow(tidy_group(meet), "uid long, at int, n int")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(uid, ats, ns) of documents (uid, text): places (in words, from 0) and numbers of consecutive windows that occur elsewhere too."""
    buckets = max(LEAST_BUCKETS, docs.count() // DOCS_PER_BUCKET)
    found = checkpointed(_found(_records(docs, buckets)))
    edges = _equal_windows(docs, found.where("open").select("uid", "at", "n"), buckets)
    whole = found.where("sure").select("uid", "at", "n").union(edges)
    both = whole.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("all"))
    return both.select("uid", F.col("all.at").alias("ats"), F.col("all.n").alias("ns"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", words_out: str = "n_words", removed_out: str = "n_removed") -> DataFrame:
    """The rows with repeated passages taken from the text (the words left are joined by one blank; a text without repeats stays as it is), its words and the words removed.

    Rows that repeat id and text repeat each other, so they lose every window of 35 words.
    """
    if {words_out.lower(), removed_out.lower()} & {c.lower() for c in df.columns}:
        raise ValueError("the table has a column of a new column's name already")
    uid, ats, ns = fresh(df, "_uid"), fresh(df, "_ats"), fresh(df, "_ns")
    rows = identified(df, key, text, uid)
    found = checkpointed(repeated_windows(rows.select(F.col(uid).alias("uid"), F.col(text).alias("text"))).withColumnsRenamed({"uid": uid, "ats": ats, "ns": ns}))
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(words_out, T.LongType()), T.StructField(removed_out, T.LongType())])

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(text), STEP_BYTES):
                starts, ends, owner = words_of(data, offsets, _SPACE)
                begin = np.searchsorted(owner, np.arange(hi - lo + 1))
                at, many = (batch.column(c).slice(lo, hi - lo) for c in (ats, ns))
                counts = at.fill_null([]).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                first = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(begin[:-1], counts)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, first, 1), np.add.at(edge, first + many.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + WINDOW - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.r_[0, np.cumsum(gone)]
                removed = removed[begin[1:]] - removed[begin[:-1]]
                raw, texts, own = data.tobytes(), [], batch.column(text).slice(lo, hi - lo)
                for k in range(hi - lo):
                    if not removed[k]:
                        texts.append(own[k].as_py())
                        continue
                    left = np.flatnonzero(~gone[begin[k] : begin[k + 1]]) + begin[k]
                    texts.append(b" ".join([raw[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist(), strict=True)]).decode())
                kept = [pa.array(texts, pa.string()) if name == text else batch.column(name).slice(lo, hi - lo) for name in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(begin), pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    return attached(rows, found, uid, small=False).mapInArrow(tidy(run), schema)
