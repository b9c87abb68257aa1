"""Line dedup: an exact set-similarity join of the lines of all documents.

A line is the set of its words. A line goes if an earlier line, by document identity and line number, has a Jaccard
similarity of ``NUM/DEN`` = 0.8 or more with it. Steps:

1. One pass counts words (each task sums up with a bounded heavy-hitter list) and finds each set's first line. Later lines with an equal set (by 128 bits of two independent hashes) go.
2. Tokens are ordered by rarity: those outside the ``COMMON`` most frequent by hash, then the common ones by count. A set of m
   tokens posts its first m - ceil(0.8 m) + 1 tokens, once in a step; the most frequent sets (``HOTTEST``) once in all, where their first line is. Postings travel packed, by buckets of tokens.
3. In a token's group the sets are taken in line order, equal sets once, and later sets are matched with earlier ones through the length,
   positional and bitmap filters (all exact: they drop only what cannot match).
   Only whether an earlier match exists matters, so of many candidates the nearest by bitmap are proposed.
4. Both lines of a proposal are fetched and the Jaccard similarity of their words is verified. If a set had more candidates
   than were proposed and none held, all its candidates are verified, from the groups that were kept for that.

Defined cases: lines without words stay and match nothing; null texts stay null, empty ones empty; very long texts and
lines are read whole; documents come in the order of their ids, null ones last; those that repeat an id or have none in the order of a hash of their text, and rows that
repeat both one after the other, so that later copies lose their lines; other columns are kept under their names; an empty table stays empty.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figlake.llm.common import Heavy, attached, byte_hashes, checkpointed, fresh, hottest, identified, let, mix64, most_common, packed_groups, posts, ranges, task_number, text_chunks, tidy, tidy_group, unpacked_groups, words_of

NUM, DEN = 4, 5
COMMON = 1 << 18
#: Candidates of a set that a token's group proposes at first, and how many more if the nearest is doubtful; groups of more sets than SMALL are compared block by block.
PROPOSED, DOUBTFUL, SMALL = 1, 2, 256
DOCS_PER_BUCKET, LEAST_BUCKETS = 4000, 16
STEP_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Sets:
    """Sets of the lines of some texts that have words: tokens in the given order, line by line, and two hashes of each set; and all distinct words with their counts."""

    text: np.ndarray
    line: np.ndarray
    heads: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    hashes: np.ndarray
    others: np.ndarray
    distinct: np.ndarray
    counts: np.ndarray


def line_sets(data: np.ndarray, offsets: np.ndarray, rank=None) -> Sets:
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    at = np.concatenate([breaks + 1, offsets[:-1]])
    text = np.concatenate([owner, np.arange(len(offsets) - 1)])
    order = np.lexsort((text, at))
    at, text = at[order], text[order]
    number = np.arange(len(text)) - np.searchsorted(text, np.arange(len(offsets) - 1))[text]
    starts, ends, line = words_of(data, np.append(at, len(data)), _SPACE)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Sets(none, none, none, none, *[none.astype(np.uint64)] * 4, none)
    codes, distinct = pd.factorize(byte_hashes(data, starts, ends))
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    places = np.argsort(distinct)
    if rank is not None:
        places = places[np.argsort(rank(distinct[places]), kind="stable")]
    ordered, second = distinct[places], byte_hashes(data, starts[first], ends[first], 1)[places]
    turn = np.empty(len(places), np.int64)
    turn[places] = np.arange(len(places))
    keys = np.sort((line << 32) | turn[codes])
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    own, tokens, second = keys >> 32, ordered[keys & 0xFFFFFFFF], second[keys & 0xFFFFFFFF]
    heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    sizes = np.diff(np.r_[heads, len(own)])
    hashes, others = (mix64(np.add.reduceat(mix64(x ^ np.uint64(0x5851F42D4C957F2D)), heads) + sizes.astype(np.uint64)) for x in (tokens, second))
    return Sets(text[own[heads]], number[own[heads]], heads, sizes, tokens, hashes, others, distinct, np.bincount(codes, minlength=len(distinct)))


_LINES = "bucket int, h long, h2 long, uid long, line int, packed binary"


def _lines(docs: DataFrame) -> DataFrame:
    """Set hashes, document and line of every line (bucket null); and packed counts of the task's tokens, by buckets of tokens, with the task in uid."""

    def run(batches):
        heavy = Heavy(COMMON)
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            for lo, hi, data, offsets in text_chunks(batch.column("text"), STEP_BYTES):
                sets = line_sets(data, offsets)
                if len(n := sets.heads):
                    heavy.add(sets.distinct, sets.counts)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int32()), pa.array(sets.hashes.view(np.int64)), pa.array(sets.others.view(np.int64)), pa.array(uids[lo:hi][sets.text]), pa.array(sets.line.astype(np.int32)), pa.nulls(len(n), pa.binary())], names=[f.split()[0] for f in _LINES.split(", ")])
        bucket, packed = heavy.packed()
        none, task = pa.nulls(len(bucket), pa.int64()), pa.array([task_number()] * len(bucket), pa.int64())
        yield pa.RecordBatch.from_arrays([bucket, none, none, task, pa.nulls(len(bucket), pa.int32()), packed], names=[f.split()[0] for f in _LINES.split(", ")])

    return docs.mapInArrow(tidy(run), _LINES)


_PACK = (("tok", "<u4"), ("sid", "<u8"), ("uid", "<i8"), ("line", "<i4"), ("size", "<i4"), ("turn", "<i4"))
#: Words of 64 bits that the signature of a set has: by its size, so that unlike sets differ in more bits than like ones may.
SIGNATURES = ((48, 1), (96, 2), (224, 4), (1 << 62, 16))


def _width(sizes: np.ndarray) -> np.ndarray:
    return np.array([w for _, w in SIGNATURES])[np.searchsorted([m for m, _ in SIGNATURES[:-1]], sizes)]


def signatures(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """(words, where each set's begin): the parities of the tokens that fall on each bit. The bits in which two sets differ are no more than their tokens that differ."""
    width = _width(sets.sizes)
    begin = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    bit = (sets.tokens >> np.uint64(48)) & np.repeat(64 * width - 1, sets.sizes).astype(np.uint64)
    np.bitwise_xor.at(words, np.repeat(begin, sets.sizes) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return words, begin


def _packed(columns: dict[str, np.ndarray], edges: np.ndarray, sigs: np.ndarray, width: np.ndarray) -> pa.Array:
    return packed_groups([np.ascontiguousarray(columns[name]) for name, _ in _PACK], edges, sigs, width)


def _postings(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], hot: list[np.ndarray], buckets: int) -> DataFrame:
    """(bucket, packed postings): a row for each bucket and step; hot sets are posted once, where their first line is."""
    shared = docs.sparkSession.sparkContext.broadcast((common, hot))

    def rank(distinct: np.ndarray) -> np.ndarray:
        hashes, ranks = shared.value[0]
        if not len(hashes):
            return np.zeros(len(distinct), np.int64)
        at = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
        return np.where(hashes[at] == distinct, ranks[at], 0)

    def run(batches):
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            for lo, hi, data, offsets in text_chunks(batch.column("text"), STEP_BYTES):
                sets = line_sets(data, offsets, rank)
                if not len(sets.heads):
                    continue
                # equal sets of a step post once, by their first line in the step's identities
                of_uid = uids[lo:hi][sets.text]
                order = np.lexsort((sets.line, of_uid, sets.hashes))
                kept = order[np.r_[True, sets.hashes[order][1:] != sets.hashes[order][:-1]]]
                kept = kept[posts(shared.value[1], sets.hashes[kept].view(np.int64), sets.others[kept].view(np.int64), of_uid[kept], sets.line[kept])]
                if not len(kept):
                    continue
                words, begin = signatures(sets)
                prefix = (sets.sizes - (NUM * sets.sizes + DEN - 1) // DEN + 1)[kept]
                of = np.repeat(kept, prefix)
                turn = ranges(np.zeros(len(kept), np.int64), prefix)
                tokens = sets.tokens[sets.heads[of] + turn]
                bucket = (mix64(tokens) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                of, turn, tokens, bucket = of[order], turn[order], tokens[order], bucket[order]
                columns = {"tok": tokens >> np.uint64(20), "sid": sets.hashes[of], "uid": of_uid[of], "line": sets.line[of], "size": sets.sizes[of], "turn": turn}
                columns = {name: columns[name].astype(kind) for name, kind in _PACK}
                edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                width = _width(sets.sizes)[of]
                packed = _packed(columns, edges, words[ranges(begin[of], width)], width)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), packed], names=["bucket", "packed"])

    return docs.mapInArrow(tidy(run), "bucket int, packed binary")


def _unpacked(packed: pa.Array) -> dict[str, np.ndarray]:
    """The columns of all postings; sat is where a posting's signature begins in sigs."""
    columns, sigs = unpacked_groups(packed, [kind for _, kind in _PACK])
    out = dict(zip([name for name, _ in _PACK], columns, strict=True)) | {"sigs": sigs}
    width = _width(out["size"])
    return out | {"sat": np.cumsum(width) - width}


def _folded(p: dict[str, np.ndarray], rows: np.ndarray, width: int, to: int) -> np.ndarray:
    words = p["sigs"][p["sat"][rows][:, None] + np.arange(width)]
    return words if width == to else np.bitwise_xor.reduce(words.reshape(len(rows), width // to, to), axis=1)


def _differ(p: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the signatures of the pairs differ, the longer one folded to the shorter."""
    out, left, right = np.zeros(len(a), np.int32), _width(p["size"][a]), _width(p["size"][b])
    both = left * 64 + right
    for code in np.unique(both).tolist():
        rows, (x, y) = np.flatnonzero(both == code), divmod(code, 64)
        out[rows] = np.bitwise_count(_folded(p, a[rows], x, min(x, y)) ^ _folded(p, b[rows], y, min(x, y))).sum(axis=1)
    return out


def _passing(p: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs a, b those that pass the filters, the bits in which they differ, and whether these are so few that the pair will hold. The cheapest filter goes first."""
    m, n = p["size"][a], p["size"][b]
    fits = np.flatnonzero(DEN * np.minimum(m, n) >= NUM * np.maximum(m, n))
    a, b, m, n = a[fits], b[fits], m[fits], n[fits]
    need = -(-NUM * (m + n) // (NUM + DEN))
    fits = np.flatnonzero((1 + np.minimum(m - p["turn"][a] - 1, n - p["turn"][b] - 1) >= need) & ~((need == m) & (need == n)))
    a, b, most = a[fits], b[fits], (m + n - 2 * need)[fits]
    differ = _differ(p, a, b)
    fits = np.flatnonzero(differ <= most)
    return a[fits], b[fits], differ[fits], (2 * differ <= most)[fits]


def _nearest(a: np.ndarray, b: np.ndarray, differ: np.ndarray, likely: np.ndarray, proposed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each a the ``proposed`` b (more, by DOUBTFUL, if the nearest is doubtful) that differ least, the earliest among equals; and whether there are more."""
    order = np.lexsort((b, differ, a))
    a, b, likely = a[order], b[order], likely[order]
    first = np.searchsorted(a, a)
    place, many = np.arange(len(a)) - first, np.searchsorted(a, a, side="right") - first
    most = np.where(likely[first], proposed, proposed + DOUBTFUL)
    keep = place < most
    return a[keep], b[keep], (many > most)[keep]


#: A pair; or, with uid null, the postings of the group more = bucket << 32 | tok. more of a pair: null, or that group, if it holds more candidates of the set than were proposed.
_PAIRS = "uid long, line int, uid2 long, line2 int, more long, packed binary"


def candidates(p: dict[str, np.ndarray], proposed: int) -> tuple[np.ndarray, ...]:
    """(later, earlier, whether more could be proposed), the first two as row numbers of p, which gets ordered."""
    place = np.empty(len(p["tok"]), np.int64)
    place[np.lexsort((p["line"], p["uid"]))] = np.arange(len(place))
    tok = p["tok"].astype(np.uint64) << np.uint64(32)
    key = tok | (p["sid"] >> np.uint64(32))
    order = np.argsort(key)
    key, sid = key[order], p["sid"][order]
    same = key[1:] == key[:-1]
    if (same & (sid[1:] != sid[:-1])).any():  # different sets that begin alike in their hashes
        order = np.lexsort((p["sid"], p["tok"]))
        same = np.all([p[k][order][1:] == p[k][order][:-1] for k in ("tok", "sid")], axis=0)
    heads = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(place[order], heads) if len(order) else place
    at = np.empty(len(place), np.int64)
    at[place] = np.arange(len(place))
    kept = at[least]
    order = kept[np.argsort(tok[kept] | least.astype(np.uint64))]
    for k in p.keys() - {"sigs"}:
        p[k] = p[k][order]
    heads = np.flatnonzero(np.r_[True, p["tok"][1:] != p["tok"][:-1]])
    sizes = np.diff(np.r_[heads, len(p["tok"])])
    later, earlier, more = [], [], []
    little = sizes <= SMALL
    rows = ranges(heads[little], sizes[little])
    before = rows - np.repeat(heads[little], sizes[little])
    step = 1 << 19
    for cut in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(before) // step)) + 1) if len(rows) else []:
        a = np.repeat(rows[cut], before[cut])
        b = ranges(rows[cut] - before[cut], before[cut])
        a, b, left = _nearest(*_passing(p, a, b), proposed)
        later.append(a), earlier.append(b), more.append(left)
    for head, size in zip(heads[~little].tolist(), sizes[~little].tolist(), strict=True):
        for first in range(head, head + size, 256):
            own = np.arange(first, min(first + 256, head + size))
            for begin in range(head, int(own[-1]), 4096):  # earlier sets, the earliest first, until each has candidates
                others = np.arange(begin, min(begin + 4096, int(own[-1])))
                a, b = np.repeat(own, len(others)), np.tile(others, len(own))
                a, b, left = _nearest(*_passing(p, a[b < a], b[b < a]), proposed)
                later.append(a), earlier.append(b), more.append(left | (begin + 4096 < a))
                own = np.setdiff1d(own, a)
                if not len(own):
                    break
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((later, np.int64), (earlier, np.int64), (more, bool)))


def _pairs(postings: DataFrame, proposed: int) -> DataFrame:
    """Proposed pairs; and the groups of tokens that hold more candidates of some set than were proposed."""

    def meet(table: pa.Table) -> pa.Table:
        p = _unpacked(table.column("packed"))
        a, b, more = candidates(p, proposed)
        group = (table.column("bucket")[0].as_py() << 32) | p["tok"].astype(np.int64)
        kept = np.unique(group[a[more]])
        begin, end = np.searchsorted(group, kept), np.searchsorted(group, kept, side="right")
        rows = ranges(begin, end - begin)
        width = _width(p["size"][rows])
        packed = _packed({name: p[name][rows] for name, _ in _PACK}, np.r_[0, np.cumsum(end - begin)], p["sigs"][ranges(p["sat"][rows], width)], width)
        n, m = len(a), len(kept)
        columns = [p["uid"][a], p["line"][a].astype(np.int32), p["uid"][b], p["line"][b].astype(np.int32)]
        out = [pa.concat_arrays([pa.array(c), pa.nulls(m, pa.array(c).type)]) for c in columns]
        out += [pa.concat_arrays([pa.array(group[a], pa.int64(), mask=~more), pa.array(kept, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.binary()), packed])]
        return pa.table(out, names=[f.split()[0] for f in _PAIRS.split(", ")])

    return postings.groupBy("bucket").applyInArrow(tidy_group(meet), _PAIRS)


def _rest(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """All candidates of the asked (uid, line, more) in the groups (more, packed)."""
    sets = asked.groupBy("more").agg(F.collect_set(F.struct("uid", "line")).alias("asked"))
    joined = groups.join(sets, "more").select("packed", F.col("asked.uid").alias("uids"), F.col("asked.line").alias("lines"))

    def run(batches):
        for batch in batches:
            for k, uids, lines in zip(range(batch.num_rows), batch.column("uids").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                p = _unpacked(batch.column("packed").slice(k, 1))  # in order of lines already, equal sets once
                wanted = set(zip(uids, lines, strict=True))
                for a in [k for k, x in enumerate(zip(p["uid"].tolist(), p["line"].tolist(), strict=True)) if x in wanted]:
                    _, b, _, _ = _passing(p, np.full(a, a), np.arange(a))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), p["uid"][a])), pa.array(np.full(len(b), p["line"][a], np.int32)), pa.array(p["uid"][b]), pa.array(p["line"][b].astype(np.int32))], names=["uid", "line", "uid2", "line2"])

    return joined.mapInArrow(tidy(run), "uid long, line int, uid2 long, line2 int").distinct()


#: Lines of fewer bytes travel as they are.
LEAST_PACKED = 160


def _short(line: bytes) -> bytes:
    """The line, or, after a line feed, its compressed form."""
    return line if len(line) < LEAST_PACKED else b"\n" + zlib.compress(line, 1)


def _split_words(packed: bytes) -> set[bytes]:
    return set((zlib.decompress(packed[1:]) if packed[:1] == b"\n" else packed).split())


def _texts_of(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(uid, line, packed): the compressed text of the lines asked for."""
    asked = checkpointed(lines.groupBy("uid").agg(F.array_sort(F.collect_set("line")).alias("asked")))
    joined = attached(docs, asked, "uid", "inner").select("uid", "text", "asked")

    def run(batches):
        for batch in batches:
            uids, lines, out = [], [], []
            for uid, text, asked in zip(batch.column("uid").to_pylist(), batch.column("text"), batch.column("asked").to_pylist(), strict=True):
                own = text.as_py().encode().split(b"\n")
                uids += [uid] * len(asked)
                lines += asked
                out += [_short(own[k]) for k in asked]
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(lines, pa.int32()), pa.array(out, pa.binary())], names=["uid", "line", "packed"])

    return joined.mapInArrow(tidy(run), "uid long, line int, packed binary")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, line, held): whether any of a line's proposed earlier lines has the similarity, by their words."""
    both = pairs.select("uid", "line").union(pairs.select("uid2", "line2"))
    texts = checkpointed(_texts_of(docs, both)).hint("shuffle_hash")
    known = pairs.join(texts.withColumnsRenamed({"uid": "uid2", "line": "line2", "packed": "packed2"}).hint("shuffle_hash"), ["uid2", "line2"]).join(texts, ["uid", "line"])

    def run(batches):
        for batch in batches:
            held = []
            for x, y in zip(batch.column("packed").to_pylist(), batch.column("packed2").to_pylist(), strict=True):
                own, other = _split_words(x), _split_words(y)
                common = len(own & other)
                held.append(DEN * common >= NUM * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("line"), pa.array(held, pa.bool_())], names=["uid", "line", "held"])

    return known.select("uid", "line", "packed", "packed2").mapInArrow(tidy(run), "uid long, line int, held boolean").groupBy("uid", "line").agg(F.max("held").alias("held"))


def repeated_lines(docs: DataFrame, proposed: int = PROPOSED) -> DataFrame:
    """(uid, gone): the numbers of the lines that go, of documents (uid, text)."""
    lines = checkpointed(_lines(docs))
    hashes, counts = most_common(lines.where("bucket is not null").select(F.col("bucket").alias("key"), F.col("uid").alias("task"), "packed"), COMMON)
    ranks = np.empty(len(hashes), np.int64)
    ranks[np.lexsort((hashes, counts))] = np.arange(1, len(hashes) + 1)
    common = (hashes, ranks)
    sets = lines.where("bucket is null").select("h", "h2", "uid", "line")
    # of sets with several lines only, and cut off, so that the join below can be split where a line is very frequent
    first = sets.groupBy("h", "h2").agg(F.min(F.struct("uid", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = checkpointed(first.select("h", "h2", "first", "n"))
    hot = hottest(first.select("h", "h2", "n", "first.uid", F.col("first.line").cast("long").alias("line")), "n", ["h", "h2", "uid", "line"])
    same = sets.join(first.drop("n").hint("shuffle_hash"), ["h", "h2"]).where((F.col("first.uid") != F.col("uid")) | (F.col("first.line") != F.col("line"))).select("uid", "line")
    buckets = max(LEAST_BUCKETS, docs.count() // DOCS_PER_BUCKET)
    found = checkpointed(_pairs(_postings(docs, common, hot, buckets), proposed))
    pairs = found.where("uid is not null")
    near = checkpointed(_verified(docs, pairs.select("uid", "line", "uid2", "line2").distinct())).where("held").select("uid", "line")
    # sets whose proposals all failed and that had more candidates: all of these
    capped = pairs.where("more is not null").select("uid", "line", "more").distinct()
    asked = checkpointed(capped.join(near, ["uid", "line"], "left_anti"))
    if asked.limit(1).count():
        rest = checkpointed(_rest(found.where("uid is null").select("more", "packed"), asked))
        near = near.unionByName(_verified(docs, rest).where("held").select("uid", "line"))
    # a set's first line is the one that was matched; its later lines went with ``same``
    return same.unionByName(near).groupBy("uid").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "removed_lines") -> DataFrame:
    """The rows with the lines that go taken from the text, and their numbers (from 0) in ``out``."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {out} already")
    uid, gone = fresh(df, "_uid"), fresh(df, "_gone")
    rows = identified(df, key, text, uid)
    found = checkpointed(repeated_lines(rows.select(F.col(uid).alias("uid"), F.col(text).alias("text"))).select(F.col("uid").alias(uid), F.col("gone").alias(gone)))
    joined = attached(rows, found, uid)

    def left(lines: Column) -> Column:
        """By hashed difference of the numbers: a search for every line would be quadratic."""
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda k: lines[k]), "\n")

    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(let(F.split(F.col(text), "\n"), left))
    return joined.withColumn(text, kept).withColumn(out, F.coalesce(F.col(gone), F.array().cast("array<int>"))).drop(uid, gone)
