"""Token counts of whole texts by a sentencepiece or tokenizers file, with only lengths returned.

Texts are encoded in batches of about equal bytes. A long text is split at safe boundaries: before a blank (U+0020)
that follows a character other than a blank or U+2581. That is safe for a sentencepiece model whose pieces hold the word
mark only at their start and which neither normalises nor squeezes white space (checked when the model is loaded; other
models get whole texts): no piece spans such a boundary, and the mark put before the rest stands for the blank taken
away. Texts for a ``.json`` tokenizer are never split, as its pre-tokeniser may look further.

Defined cases: null and empty texts count 0 bytes and 0 tokens; very long texts are counted whole; an empty table
stays empty; other columns are kept, and a clash with a new column raises ValueError.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from figlake.llm.common import string_buffers, tidy

#: Bytes of a batch, and of a part of a long text, at about which they end.
BATCH_BYTES, PART_BYTES = 1 << 20, 1 << 16
_MARK = "▁"


class _Pieces:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        self.safe = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and not any(_MARK in p.piece.lstrip(_MARK) or " " in p.piece for p in spec.pieces)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class _Json:
    safe = False

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


@lru_cache(2)
def _loaded(path: str):
    return _Json(path) if path.endswith(".json") else _Pieces(path)


def parts(text: str, most: int = PART_BYTES) -> list[str]:
    """The text cut before safe blanks, which are dropped, about every ``most`` characters."""
    out, begin, n = [], 0, len(text)
    while n - begin > most:
        at = begin + most
        while True:
            at = text.find(" ", at)
            if at < 0 or at == n - 1:
                at = -1
                break
            if text[at - 1] not in (" ", _MARK):
                break
            at += 1
        if at < 0:
            break
        out.append(text[begin:at])
        begin = at + 1
    return [*out, text[begin:]]


def counts_of(texts: list[str], sizes: np.ndarray, path: str) -> np.ndarray:
    """Token counts of texts, in calls of about BATCH_BYTES each."""
    model = _loaded(path)
    total = np.zeros(len(texts), np.int64)
    held, owners, size = [], [], 0

    def flush():
        if held:
            np.add.at(total, owners, model.counts(held))

    for k, text in enumerate(texts):
        for part in parts(text) if model.safe and sizes[k] > PART_BYTES else [text]:
            held.append(part)
            owners.append(k)
            size += len(part) if sizes[k] > PART_BYTES else int(sizes[k])
            if size >= BATCH_BYTES:
                flush()
                held, owners, size = [], [], 0
    flush()
    return total


def count_tokens(df: DataFrame, text: str, path: str, bytes_out: str = "n_bytes", tokens_out: str = "n_tokens") -> DataFrame:
    """Replaces the text by its UTF-8 length and its token count; only lengths go back to the JVM."""
    kept = [f for f in df.schema.fields if f.name != text]
    if {bytes_out.lower(), tokens_out.lower()} & {f.name.lower() for f in kept}:
        raise ValueError("the table has a column of a new column's name already")
    schema = T.StructType([*kept, T.StructField(bytes_out, T.LongType()), T.StructField(tokens_out, T.LongType())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(text)
            offsets, _ = string_buffers(column)
            sizes = np.diff(offsets)
            cuts = np.unique(np.searchsorted(offsets, np.arange(offsets[0], offsets[-1], 8 * BATCH_BYTES)[1:]))
            edges = [0, *[int(c) for c in cuts if 0 < c < len(sizes)], len(sizes)]
            tokens = np.concatenate([counts_of([t or "" for t in column.slice(a, b - a).to_pylist()], sizes[a:b], path) for a, b in zip(edges, edges[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(sizes), pa.array(tokens)], names=schema.names)

    return df.mapInArrow(tidy(run), schema)
