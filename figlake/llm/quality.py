"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Fitting. Every word has a sparse random index vector fixed by its hash, and a word's context vector is the sum of the
index vectors of the words up to ``REACH`` places away, over all documents. The ``VOCABULARY`` most frequent words of all documents have
one; a task sums up its own before they are shuffled. The look of a word (case, length, symbols, equal to the word before) is a second kind of word with index vectors of its own,
so words that were never seen still count. A document is the mean of both kinds of vectors over all its words. On the
document vectors of a bounded sample of labelled documents (``FIT_ROWS``, in the order of a hash of the id) a network with one hidden layer is trained, and its temperature is chosen on a part kept
from the training. Only bounded things reach the driver: the vocabulary's vectors and the sample's document vectors.

Scoring reads every whole text. Defined cases: null and empty texts have the zero vector and get a score as well;
without labels of both kinds every score is 0.5 or the one label seen; an empty table stays empty; repeated rows score alike; labels that
repeat an id count once (the greater); other columns are kept, and a clash with the score's name raises ValueError.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figlake.llm.common import Heavy, byte_hashes, checkpointed, folded, from_planes, mix64, most_common, planes, ranges, task_number, text_chunks, tidy, words_of

FIT_ROWS, VOCABULARY = 6_000, 16_384
DIMENSIONS, LOOKS, ENTRIES, REACH = 64, 128, 4, 2
#: Words whose sums travel together.
PIECE = 512
#: Vectors are whole multiples of 1 / SCALE, so that sums are exact.
SCALE = 4096
PARTS = "key int, task long, packed binary"
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 1600, 128, 3e-3, 1e-4
#: Vectors of texts of few words are drawn towards the centre; standardised components end at FAR.
FEW, FAR = 3, 6.0
STEP_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER, _LOWER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LOWER[97:123] = True
_LOWER[0xC0:] = True  # the first byte of a character beyond ASCII
_DIGIT[48:58] = True
_SYMBOL[33:127] = ~(_UPPER | _LOWER | _DIGIT)[33:127]


def index_entries(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the ENTRIES non-zeros of each hash's index vector."""
    at = np.stack([mix64(hashes + np.uint64(((k + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) for k in range(ENTRIES)], axis=1)
    return (at % np.uint64(size)).astype(np.int64), np.where((at >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).astype(np.float32)


def _looks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The look of each word but for its lowest bit, which says whether the word before is the same."""
    at = ranges(starts, ends - starts)
    heads = np.cumsum(ends - starts) - (ends - starts)
    count = lambda kind: np.add.reduceat(kind[data[at]].astype(np.int64), heads)
    upper, lower, digit, symbol = (count(kind) for kind in (_UPPER, _LOWER, _DIGIT, _SYMBOL))
    length = np.digitize(ends - starts, (2, 4, 8, 13, 20))
    last = data[ends - 1]
    last = np.where(_SYMBOL[last], last, 0)
    cased = np.where(upper == 0, 0, np.where(lower == 0, np.where(upper > 1, 3, 2), 1))
    return 2 * cased + 8 * np.minimum(symbol, 4) + 64 * (digit > 0) + 128 * length + 1024 * last.astype(np.int64)


def _summed(table: np.ndarray, codes: np.ndarray, owner: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of the whole-numbered rows table[codes] of each document, whose words begin at heads: exact, so a document's sum does not depend on what stands beside it.

    Few documents of many repeated words are summed as a product of the counts with the table, others word by word.
    """
    docs, kinds = len(heads), len(table)
    if docs * kinds <= 8 * len(codes):
        turn = np.cumsum(np.r_[False, owner[1:] != owner[:-1]])
        return np.bincount(turn * kinds + codes, minlength=docs * kinds).reshape(docs, kinds).astype(np.float64) @ table.astype(np.float64)
    columns = np.take(np.ascontiguousarray(table.T), codes, axis=1)
    return np.add.reduceat(columns, heads, axis=1).T.astype(np.float64)  # of 32 bits: a step of several documents has less than 2**18 words


def _unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    return from_planes(raw, "<i8", len(raw) // 8, 0)


def vocabulary(docs: DataFrame, text: str) -> np.ndarray:
    """Hashes, in ascending order, of about the VOCABULARY most frequent words of all texts, seen three times or more."""

    def count(batches):
        heavy = Heavy(VOCABULARY)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), STEP_BYTES):
                starts, ends, _ = words_of(data, offsets, _SPACE)
                codes, distinct = pd.factorize(byte_hashes(data, starts, ends))
                heavy.add(distinct, np.bincount(codes, minlength=len(distinct)))
        bucket, packed = heavy.packed()
        yield pa.RecordBatch.from_arrays([bucket, pa.array([task_number()] * len(bucket), pa.int64()), packed], names=["key", "task", "packed"])

    hashes, counts = most_common(checkpointed(docs.select(text).mapInArrow(tidy(count), PARTS)), VOCABULARY)
    return hashes[counts >= 3]


def context_vectors(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, context vectors of length 1, less their mean, in whole SCALE-ths; last, zeros for other words) of the vocabulary, from all occurrences in all texts. Sums are of whole numbers, so they do not depend on how the texts are dealt out."""
    known = vocabulary(docs, text)
    if not len(known):
        return known, np.zeros((1, DIMENSIONS), np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    pieces = -(-len(known) // PIECE)

    def collect(batches):
        hashes = shared.value
        sums = np.zeros(len(hashes) * DIMENSIONS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), STEP_BYTES):
                starts, ends, owner = words_of(data, offsets, _SPACE)
                codes, distinct = pd.factorize(byte_hashes(data, starts, ends))
                places, signs = index_entries(distinct, DIMENSIONS)
                at = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
                at = np.where(hashes[at] == distinct, at * DIMENSIONS, -1)
                places, signs = places.astype(np.int32), signs.astype(np.int64)
                for gap in range(1, REACH + 1):
                    near = owner[gap:] == owner[:-gap]
                    a, b = codes[:-gap][near], codes[gap:][near]
                    for x, y in ((a, b), (b, a)):
                        own = at[x]
                        y, own = y[own >= 0], own[own >= 0]
                        np.add.at(sums, (own[:, None] + places[y]).ravel(), signs[y].ravel())
        sums = sums.reshape(len(hashes), DIMENSIONS)
        packed = [zlib.compress(planes(np.ascontiguousarray(sums[k * PIECE : (k + 1) * PIECE].ravel())), 1) for k in range(pieces)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces, dtype=np.int32)), pa.array([task_number()] * pieces, pa.int64()), pa.array(packed, pa.binary())], names=["key", "task", "packed"])

    def add(packed: list[bytes], last: bool) -> bytes:
        return zlib.compress(planes(sum(map(_unpacked, packed))), 1)

    parts = checkpointed(docs.select(text).mapInArrow(tidy(collect), PARTS))
    vectors = np.concatenate([_unpacked(x) for _, x in sorted(folded(parts, add))]).reshape(len(known), DIMENSIONS).astype(np.float64)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return known, np.rint(SCALE * np.concatenate([vectors - vectors.mean(axis=0), np.zeros((1, DIMENSIONS))])).astype(np.int32)


#: (shift, mask) of a look's parts: repeated, case, symbols, digits, length, last symbol; then the look as a whole. Each has an index vector.
_LOOK_PARTS = ((0, 1), (1, 3), (3, 7), (6, 1), (7, 7), (10, 255), (0, (1 << 18) - 1))


def pooled(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean context vector, share of unknown words and mean look vector of each text; last, how far they are to be trusted: n / (n + FEW) for n words."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS + 1 + LOOKS + 1), np.float32)
    starts, ends, owner = words_of(data, offsets, _SPACE)
    if not len(starts):
        return out
    codes, distinct = pd.factorize(byte_hashes(data, starts, ends))
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    at = np.minimum(np.searchsorted(hashes, distinct), max(0, len(hashes) - 1))
    at = np.where(hashes[at] == distinct, at, len(hashes)) if len(hashes) else np.zeros(len(distinct), np.int64)
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    docs, counts = owner[heads], np.diff(np.r_[heads, len(owner)])
    known = np.concatenate([vectors[at], (at == len(hashes))[:, None].astype(np.int32)], axis=1)
    out[docs, : DIMENSIONS + 1] = _summed(known, codes, owner, heads) / counts[:, None] / np.r_[np.full(DIMENSIONS, SCALE), 1.0]
    same = np.r_[False, (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])]
    looks, look_of = np.unique(_looks(data, starts[first], ends[first]), return_inverse=True)
    looks = (looks[:, None] + np.arange(2)).ravel().astype(np.uint64)
    table = np.zeros((len(looks), LOOKS), np.int32)
    for k, (shift, mask) in enumerate(_LOOK_PARTS):
        part = ((looks >> np.uint64(shift)) & np.uint64(mask)) + np.uint64((k + 1) << 32)
        places, signs = index_entries(mix64(part), LOOKS)
        np.add.at(table, (np.arange(len(looks))[:, None], places), signs.astype(np.int32))
    out[docs, DIMENSIONS + 1 : -1] = _summed(table, 2 * look_of[codes] + same, owner, heads) / counts[:, None]
    out[docs, -1] = counts / (counts + FEW)
    return out


def standardised(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x[:, :-1] - centre) / scale, -FAR, FAR) * x[:, -1:]


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(standardised(x, self.centre, self.scale) @ self.w1 + self.b1)
        return (hidden @ self.w2 + self.b2).astype(np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hashes: np.ndarray, vectors: np.ndarray, seed: int = 11) -> Model:
    """Adam on the log loss of four fifths of the rows; the temperature from the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    kept = max(1, len(x) // 5) if len(x) >= 10 else 0
    rest, fit = order[:kept], order[kept:]
    centre, scale = x[fit, :-1].mean(axis=0), x[fit, :-1].std(axis=0) + 1e-3
    z = standardised(x[fit], centre, scale)
    t = y[fit].astype(np.float32)
    params = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    parts = max(1, len(z) // BATCH)
    for _ in range(-(-STEPS // parts)):
        for batch in np.array_split(rng.permutation(len(z)), parts):
            w1, b1, w2, b2 = params
            a, target = z[batch], t[batch]
            h = np.tanh(a @ w1 + b1)
            g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30))) - target) / len(batch)
            back = g[:, None] * w2 * (1 - h * h)
            grads = [a.T @ back + DECAY * w1, back.sum(axis=0), h.T @ g + DECAY * w2, np.array([g.sum()], np.float32)]
            step += 1
            for p, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = params
    model = Model(hashes, vectors, centre, scale, w1, b1, w2, float(b2[0]), 1.0)
    if not kept or len(set(y[rest].tolist())) < 2:
        return model
    logits, truth = model.logits(x[rest]), y[rest]

    def loss(temperature: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(logits / temperature, -40, 40))), 1e-7, 1 - 1e-7)
        return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

    best = min(np.geomspace(0.25, 8, 61), key=loss)
    return Model(hashes, vectors, centre, scale, w1, b1, w2, float(b2[0]), float(best))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", usable=None) -> Model | float:
    """A model from labelled rows of which ``usable`` (a function of the key column) holds; a constant score if the labels are all alike, 0.5 if there are none."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where(F.col("key").isNotNull() & F.col("y").isin(0, 1))
    marked = marked.where(usable(F.col("key"))) if usable is not None else marked
    marked = marked.groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS)
    sample = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(marked), "key").groupBy("key").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
    sample = checkpointed(sample)
    seen = {r.y for r in sample.select("y").distinct().collect()}
    if len(seen) < 2:
        return float(seen.pop()) if seen else 0.5
    hashes, vectors = context_vectors(documents, text)

    def vectors_of(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(0), STEP_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in pooled(data, offsets, hashes, vectors)], pa.binary()), batch.column(2).slice(lo, hi - lo)], names=["key", "x", "y"])

    rows = sample.select("text", F.col("key").cast("string").alias("key"), "y").mapInArrow(tidy(vectors_of), "key string, x binary, y int").orderBy("key").collect()
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    return train(x, np.array([r.y for r in rows]), hashes, vectors)


def score(df: DataFrame, model: Model | float, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every row."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {out} already")
    if isinstance(model, float):
        return df.withColumn(out, F.lit(model))
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few MB, by FIT_ROWS and VOCABULARY
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        for batch in batches:
            own = shared.value
            for lo, hi, data, offsets in text_chunks(batch.column(text), STEP_BYTES):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(own.score(pooled(data, offsets, own.hashes, own.vectors)))], names=schema.names)

    return df.mapInArrow(tidy(run), schema)
