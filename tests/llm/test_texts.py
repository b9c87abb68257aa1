"""Tokens, shards, lines, passages, near duplicates and decontamination against plain Python."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from figlake.llm import bpe, chosen_path, common, decontam, line_dedup, recompress, shard, token_count

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(public):
    """text -> ids, by the public library."""
    tiktoken = pytest.importorskip("tiktoken")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: own.encode_ordinary(text or "")


def encoded(texts):
    steps = list(bpe.encode_steps(pa.array(texts, pa.string()), P.path("byte_bpe_50k.tiktoken")))
    return [np.frombuffer(x.as_py(), "<u4").tolist() for _, _, ids, _ in steps for x in ids], steps


def test_bpe_on_hard_strings(reference):
    rng = random.Random(1)
    alphabet = list("aabcestrvlmd'''   \n\t09.!é½%漢😀") + ["'ll", " 's", "　", "́"]
    texts = [None, "", "don't", "'s's 're''s  x", "x  y\n\n z\n", "'", "'r", "''re", "<|endoftext|>", "aaaa" * 500, " " * 300 + "x", "x" + " " * 300, "\n \n x"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    ids, steps = encoded(texts)
    assert ids == [reference.encode_ordinary(t or "") for t in texts]
    back = [x for _, _, i, at in steps for s in bpe.decode_steps(i, at, P.path("byte_bpe_50k.tiktoken")) for x in s[2].to_pylist()]
    assert back == [(t or "").encode() for t in texts]


def test_bpe_scan_equals_a_walk():
    rng = np.random.default_rng(0)
    functions = rng.integers(0, 256, 5000).astype(np.uint8)
    state, want = 0, []
    for f in functions.tolist():
        state = (f >> (2 * state)) & 3
        want.append(state)
    assert bpe._scan(functions).tolist() == want


def test_bpe_round_trip(spark, documents, empty, reference):
    df, texts = documents
    path = P.path("byte_bpe_50k.tiktoken")
    for r in bpe.decode(bpe.encode(df, "text", path), path).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode() and r._uid == "x"
    both = {r.doc_id: (bytes(r.ids), bytes(r.id_offsets), bytes(r.decoded)) for r in bpe.round_trip(df, "text", path).collect()}
    assert both == {r.doc_id: (bytes(r.ids), bytes(r.id_offsets), bytes(r.decoded)) for r in bpe.decode(bpe.encode(df, "text", path), path).collect()}
    assert bpe.encode(empty, "text", path).count() == bpe.round_trip(empty, "text", path).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df.withColumnRenamed("_uid", "IDS"), "text", path)


def test_token_counts(spark, documents, empty, monkeypatch):
    df, texts = documents
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in token_count.count_tokens(df, "text", P.path("piece_bpe_32k.model")).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(model.encode(t)))
    assert token_count.count_tokens(empty, "text", P.path("piece_bpe_32k.model")).count() == 0
    rng = random.Random(2)
    hard = ["".join(rng.choice(["a", "b", " ", "  ", "▁", "\n", "é", "the", "<s>"]) for _ in range(40)) for _ in range(400)] + ["", " ", "a ", " a"]
    assert all("".join(token_count.parts(t, 3)).replace(" ", "") == t.replace(" ", "") for t in hard)
    assert max(len(token_count.parts(t, 3)) for t in hard) > 5
    assert [sum(len(model.encode(p)) for p in token_count.parts(t, 3)) for t in hard] == [len(model.encode(t)) for t in hard]
    monkeypatch.setattr(token_count, "BATCH_BYTES", 50)
    assert token_count.counts_of(hard, np.array([len(t.encode()) for t in hard]), P.path("piece_bpe_32k.model")).tolist() == [len(model.encode(t)) for t in hard]


def test_json_tokenizer(documents):
    tokenizers = pytest.importorskip("tokenizers")
    df, texts = documents
    own = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in token_count.count_tokens(df, "text", P.path("byte_bpe_50k.json")).collect():
        assert r.n_tokens == len(own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)


def test_shards(spark, empty):
    rows = [(k if k % 3 else 7, f"t{k % 50}") for k in range(600)] + [(None, None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tree = shard.tree_of(12)
    placed = shard.draw(shard.draw(df, "doc_id", tree, "a"), "doc_id", shard.grown(tree, 12), "b")
    out = shard.slots(placed, "a", ["doc_id", "text"]).collect()
    assert len(out) == len(rows)
    slots, of = defaultdict(list), {}
    for r in out:
        slots[r.a].append(r.slot)
        assert r.b in (r.a, 12) and of.setdefault(r.doc_id, (r.a, r.b)) == (r.a, r.b)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and any(b == 12 for _, b in of.values())
    assert shard.slots(shard.draw(empty, "doc_id", tree, "a"), "a", ["doc_id", "text"]).count() == 0


def test_shard_weights(spark):
    df = spark.range(40000).withColumnRenamed("id", "doc_id")
    tree = {"r": {"k": {0: 1.0, 1: 3.0}, "l": {2: 2.0}}, "s": {"m": {3: 2.0, 4: 0.0}}}
    before = {r.doc_id: r.a for r in shard.draw(df, "doc_id", tree, "a").collect()}
    share = Counter(before.values())
    assert 4 not in share and all(abs(share[s] / 40000 - w / 8) < 0.01 for s, w in {0: 1, 1: 3, 2: 2, 3: 2}.items())
    # more weight for shard 3: rows move only into its region, and within the other region nothing moves
    heavier = {r.doc_id: r.a for r in shard.draw(df, "doc_id", {**tree, "s": {"m": {3: 4.0, 4: 0.0}}}, "a").collect()}
    assert {(before[d], heavier[d]) for d in before if before[d] != heavier[d]} <= {(0, 3), (1, 3), (2, 3)}


def line_numbers(texts):
    seen, gone = [], defaultdict(list)
    for d in sorted(texts):
        for k, line in enumerate((texts[d] or "").split("\n")):
            s = set(WORD.findall(line))
            if s:
                if any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                    gone[d].append(k)
                seen.append(s)
    return gone


@pytest.mark.parametrize("settings", [(1, 2, 256), (1, 0, 3)])
def test_line_dedup(documents, empty, monkeypatch, settings):
    df, texts = documents
    for name, v in zip(("PROPOSED", "DOUBTFUL", "SMALL"), settings, strict=True):
        monkeypatch.setattr(line_dedup, name, v)
    want = line_numbers(texts)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got.keys() == texts.keys() and {d for d in want if want[d]}
    for d, r in got.items():
        assert r.removed_lines == want[d] and r._uid == "x"
        assert r.text == (texts[d] if texts[d] is None else "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in want[d]))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_documents_without_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e"), (1, "x y"), (2, None)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5 and sum(bool(r.text) for r in out) in (2, 3)  # rows that repeat id and text share a result


def repeats(texts):
    words = {d: WORD.findall(t or "") for d, t in texts.items()}
    count = Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if count[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = [True] * 35
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_recompression(documents, empty):
    df, texts = documents
    want = repeats(texts)
    assert sum(n > 0 for _, n, _ in want.values()) > 10
    for r in recompress.remove_repeats(df).collect():
        n, removed, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, removed)
        assert r.text == (kept if removed else texts[r.doc_id])
    assert recompress.remove_repeats(empty).count() == 0


def test_rounds_agree_inside_equal_windows():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 30, 60).astype(np.uint64)
    words = np.concatenate([rng.integers(0, 30, 50).astype(np.uint64), shared, rng.integers(0, 30, 41).astype(np.uint64), shared, shared[:40]])
    rounds = recompress.Rounds(words, np.zeros(len(words), np.int64))
    level, anchor = rounds.anchors(len(words))
    for s in range(50, 50 + 26):
        t = s + 101
        a, b = (int(rounds.begins[level[x]][anchor[x]]) - x for x in (s, t))
        assert level[s] == level[t] and a == b and rounds.symbols[level[s]][anchor[s]] == rounds.symbols[level[t]][anchor[t]]


def linked(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(t or "")
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {d: {e for e in sets if e != d and sets[d] and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])} for d in sets}
    group = {}
    for d in sorted(sets):
        if d not in group:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = d
                    todo += links[x]
    return {d: (group[d], len(links[d])) for d in sets}


@pytest.mark.parametrize(("leaf", "block", "dense"), [(1024, 1024, 0.25), (2, 3, 0.25), (2, 2, 2.0)])
def test_near_duplicates(documents, empty, monkeypatch, leaf, block, dense):
    """As a whole; by blocks; and with every large bucket split down to the end of the paths."""
    df, texts = documents
    for name, v in (("LEAF", leaf), ("BLOCK", block), ("DENSE", dense)):
        monkeypatch.setattr(chosen_path, name, v)
    want = linked(texts)
    assert sum(n > 0 for _, n in want.values()) > 8
    assert {r.doc_id: (r.group_id, r.n_links) for r in chosen_path.with_groups(df).collect()} == want
    assert sorted(r.doc_id for r in chosen_path.one_of_each(df).collect()) == sorted({g for g, _ in want.values()})
    assert chosen_path.with_groups(empty).count() == 0


@pytest.mark.parametrize("leaf", [1024, 20])
def test_near_duplicates_of_a_large_family(spark, monkeypatch, leaf):
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    monkeypatch.setattr(chosen_path, "BLOCK", leaf)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{k}"
        rows.append((k, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(40))  # shared, but not enough for a link
    rows += [(k, " ".join([f"x{rng.randrange(9000)}" for _ in range(60)] + [passage])) for k in range(200, 300)]
    got = chosen_path.with_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.group_id, r.n_links) for r in got} == linked(dict(rows))


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    assert chosen_path.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def item_windows(items):
    """text -> (number of words, places hit, ids of items hit), by all windows of the items."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(len(w) - min(10, len(w)) + 1):
            if w:
                windows[tuple(w[s : s + 10])].add(i)

    def of(text):
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit.update(range(s, s + m))
                    found |= {str(i) for i in windows[tuple(w[s : s + m])] if i is not None}
        return len(w), hit, sorted(found)

    return of


@pytest.mark.parametrize("few", [None, 0])
def test_decontamination(spark, documents, empty, monkeypatch, few):
    if few is not None:  # fingerprints, windows and suspects are shuffled
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", few)
        monkeypatch.setattr(common, "BROADCAST_ELEMENTS", few)
    df, texts = documents
    some = [t for t in texts.values() if t and len(t.split()) > 40]
    items = [(1, " ".join(some[0].split()[5:30])), (2, some[1].split()[3].upper() + " " + some[1].split()[4]), (3, None), (4, "  "), (5, " ".join(some[2].split()[2:15])), (50, " ".join(some[2].split()[2:15])), (6, "never seen words"), (None, " ".join(some[3].split()[:11])), (7, " ".join(some[4].split()[1:8]))]
    plain = item_windows(items)
    got = {r.doc_id: r for r in decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    hits = 0
    for d, t in texts.items():
        n, hit, found = plain(t)
        hits += bool(hit)
        assert (got[d].n_words, got[d].n_hit, got[d]["items"]) == (n, len(hit), found), d
    assert hits > 5
    assert decontam.contamination(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.contamination(df, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_digests_of_queries(spark, tmp_path):
    from figlake.llm import queries

    rows = [(0, "a  b"), (1, None), (2, ""), (3, "é x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op2_byte_bpe(spark, str(tmp_path)).collect():
        assert r.decoded_sha256 == hashlib.sha256((dict(rows)[r.doc_id] or "").encode()).hexdigest()
    for r in queries.op3_hash_tree_shards(spark, str(tmp_path)).collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    for r in queries.op5_recompression(spark, str(tmp_path)).collect():
        assert r.kept_sha256 == hashlib.sha256(" ".join((dict(rows)[r.doc_id] or "").split()).encode()).hexdigest()


def untidy_rows():
    """Repeated rows, repeated ids and null ids beside documents with good ones."""
    rng = random.Random(6)
    line = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(14))
    near = lambda t: t.replace(t.split()[-1], "changed")
    texts = [f"{line()}\n{line()}\n{line()}" for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(-3, near(texts[0])), (40, near(texts[1])), (41, texts[1] + " tail")]
    return rows + [(5, texts[5])] * 4 + [(7, near(texts[3]))] + [(None, line())] * 3 + [(None, texts[2]), (None, None), (None, None), (9, None)]


@pytest.mark.parametrize("scale", [1, 1 << 58])
def test_untidy_ids_keep_their_order(spark, scale):
    rows = [(None if k is None else k * scale, t) for k, t in untidy_rows() if scale == 1 or k is None or abs(k) < 20]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    removed = defaultdict(list)
    for r in line_dedup.dedup_lines(df).collect():
        removed[r.doc_id].append(tuple(r.removed_lines))
    none, whole = (), (0, 1, 2)
    want = {k * scale: [none] for k in [-3, 1, 2, 3, 4, 6, 8, 10, 11]} | {0: [whole], 5 * scale: [none, *[whole] * 4], 7 * scale: [none, whole], 9 * scale: [none, none]}
    if scale == 1:
        want |= {40: [whole], 41: [whole]}
    want[None] = [none, none, none, (0,), (0,), whole]  # null texts, and three rows of one line
    assert {k: sorted(v) for k, v in removed.items()} == want

    groups = defaultdict(set)
    for r in chosen_path.with_groups(df).collect():
        groups[r.doc_id].add((r.group_id, r.n_links))
    documents = list(dict.fromkeys(rows))
    documents.sort(key=lambda x: (x[0] is None, x[0] or 0))
    want = defaultdict(set)
    for n, (g, links) in linked(dict(enumerate(t for _, t in documents))).items():
        want[documents[n][0]].add((documents[g][0], links))
    assert groups == want
    left = chosen_path.one_of_each(df).collect()
    assert Counter(r.doc_id for r in left) == Counter(documents[n][0] for n, (g, _) in linked(dict(enumerate(t for _, t in documents))).items() if g == n)
