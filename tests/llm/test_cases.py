"""Queries against plain versions, and the awkward cases of every operator: clashes, repeated rows, hostile texts, joins beyond a broadcast."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_texts import encoding, item_windows, line_numbers, linked, repeats

from figlake.llm import bitslice, bpe, chosen_path, common, decontam, html_extract, line_dedup, quality, queries, recompress, shard, token_count

P = pytest.importorskip("public_tokenizers")
BPE, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, documents, tmp_path_factory):
    """A folder with documents and benchmark, and their texts."""
    folder = tmp_path_factory.mktemp("tables")
    df, texts = documents
    df.write.parquet(str(folder / "documents.parquet"))
    some = [t for t in texts.values() if t and len(t.split()) > 40]
    items = [(1, " ".join(some[0].split()[5:30])), (12, " ".join(some[2].split()[2:15])), (2, None), (5, some[1].split()[3].upper() + " " + some[1].split()[4])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), texts, items


def rows_of(spark, query, folder):
    out = query(spark, folder).collect()
    assert len({r.doc_id for r in out}) == len(out)
    return {r.doc_id: r for r in out}


def test_query_of_byte_bpe(spark, tables):
    folder, texts, _ = tables
    ids = encoding(P)
    for d, r in rows_of(spark, queries.op2_byte_bpe, folder).items():
        own = ids(texts[d])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), sha(np.array(own, "<u4").tobytes()), sha(texts[d] or ""))


def test_query_of_token_counts(spark, tables, monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    folder, texts, _ = tables
    monkeypatch.setattr(queries, "LIMIT", 200)
    want = {d: len(model.encode(t or "")) for d, t in texts.items()}
    assert {n > 200 for n in want.values()} == {False, True}
    for d, r in rows_of(spark, queries.op6_token_counts, folder).items():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[d] or "").encode()), want[d], want[d] > 200)


def test_query_of_shards_is_the_draw_down_the_tree(spark, tables):
    folder, texts, _ = tables
    tree = shard.tree_of(queries.SHARDS)
    names = [("root", r) for r in [*tree, "grown40"]] + [(r, k) for r, racks in tree.items() for k in racks] + [(k, str(s)) for racks in tree.values() for k, shards in racks.items() for s in shards]
    drawn = spark.createDataFrame([(d, p, c) for d in texts for p, c in names], "d long, p string, c string").selectExpr("d", "p", "c", "xxhash64(d, p, c) AS h").collect()
    bits = {(r.d, r.p, r.c): (r.h & (2**64 - 1)) >> 11 for r in drawn}
    straw = lambda d, p, c, w: math.log((bits[d, p, c] + 0.5) / 2**53) / w

    def place(d, grown):
        regions = {r: sum(map(len, racks.values())) for r, racks in tree.items()} | ({"grown40": 1} if grown else {})
        region = max(regions, key=lambda r: straw(d, "root", r, regions[r]))
        if region == "grown40":
            return 40
        rack = max(tree[region], key=lambda k: straw(d, region, k, len(tree[region][k])))
        return max(tree[region][rack], key=lambda s: straw(d, rack, str(s), 1.0))

    got, slots = rows_of(spark, queries.op3_hash_tree_shards, folder), defaultdict(list)
    for d, r in got.items():
        raw = (texts[d] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "key", place(d, False), place(d, True))
        slots[r.shard].append(r.slot)
    assert got.keys() == texts.keys() and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_queries_of_lines_passages_copies_and_leaks(spark, tables):
    folder, texts, items = tables
    gone = line_numbers(texts)
    for d, r in rows_of(spark, queries.op10_line_dedup, folder).items():
        kept = "\n".join(x for k, x in enumerate((texts[d] or "").split("\n")) if k not in gone[d])
        assert (r.n_removed, r.removed_lines, r.kept_sha256) == (len(gone[d]), ",".join(map(str, gone[d])), sha(kept))
    want = repeats(texts)
    for d, r in rows_of(spark, queries.op5_recompression, folder).items():
        assert (r.n_words, r.n_removed, r.kept_sha256) == (*want[d][:2], sha(want[d][2]))
    windows = item_windows(items)
    for d, r in rows_of(spark, queries.op8_winnowing, folder).items():
        n, hit, found = windows(texts[d])
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(found), sha(",".join(found)), bool(hit))


def test_query_of_quality(spark, tmp_path):
    from test_others import corpus

    docs, labels = corpus(700, 5)
    spark.createDataFrame([*docs, (700, None), (0, docs[0][1])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    # labels of held-out documents are turned round: were they learnt from, the scores would show it
    spark.createDataFrame([(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op7_random_indexing(spark, str(tmp_path)).collect()
    assert len(got) == 702 and len({r.score for r in got if r.doc_id == 0}) == 1
    truth = dict(labels)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_word_vectors_count_all_texts(spark):
    """Context vectors against a plain sum over all texts, however they are dealt out."""
    texts = ["a b a c", "c a", "b b a", None, "", "zz a b"] * 2
    words = sorted({w for t in texts if t for w in t.split()})
    raw = {w: int(common.byte_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words}
    index = {}
    for w, h in raw.items():
        places, signs = quality.index_entries(np.array([h], np.uint64), quality.DIMENSIONS)
        index[w] = np.zeros(quality.DIMENSIONS)
        np.add.at(index[w], places[0], signs[0])
    counts, sums = Counter(), defaultdict(lambda: np.zeros(quality.DIMENSIONS))
    for t in texts:
        w = (t or "").split()
        counts.update(w)
        for i, x in enumerate(w):
            for j in range(max(0, i - quality.REACH), min(len(w), i + quality.REACH + 1)):
                if j != i:
                    sums[x] += index[w[j]]
    known = sorted((raw[w], w) for w in words if counts[w] >= 3)
    want = np.stack([sums[w] / np.linalg.norm(sums[w]) for _, w in known])
    for parts in (1, 5):
        hashes, vectors = quality.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts), "text")
        assert hashes.tolist() == [h for h, _ in known]
        assert np.allclose(vectors[:-1] / quality.SCALE, want - want.mean(axis=0), atol=1 / quality.SCALE) and not vectors[-1].any()


def test_pooling_does_not_depend_on_the_neighbours():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "B!", "cc9", "Dd", "e" * 30, "é"], rng.integers(0, 40))) for _ in range(60)] + ["", "only"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    hashes = np.sort(common.byte_hashes(raw[-1], np.array([0]), np.array([4])))
    vectors = rng.integers(-4096, 4096, (2, quality.DIMENSIONS)).astype(np.int32)
    vectors[-1] = 0
    together = quality.pooled(np.concatenate(raw), np.cumsum([0, *map(len, raw)]), hashes, vectors)
    for x, row in zip(raw, together, strict=True):
        assert (quality.pooled(x, np.array([0, len(x)]), hashes, vectors)[0] == row).all()


def test_folding_is_a_tree(spark, monkeypatch):
    monkeypatch.setattr(common, "FAN", 3)
    parts = spark.createDataFrame([(k, t, np.array([t], np.int64).tobytes()) for k in range(2) for t in range(20)], "key int, task long, packed binary")
    got = common.folded(parts, lambda packed, last: np.array([sum(int(np.frombuffer(x, np.int64)[0]) for x in packed)], np.int64).tobytes())
    assert {k: int(np.frombuffer(x, np.int64)[0]) for k, x in got} == {0: 190, 1: 190}


def test_top_k_of_large_components_and_repeated_ids(spark):
    big = 3.0e8
    rows = [(0, [200000.0, big]), (1, [200000.0, 1.0]), (2, [150000.0, 0.0]), (3, [-0.5, 0.25]), (100, [1.0, 2.0]), (100, [5.0]), (200, [0.5, 0.5]), (200, [-1.0, 0.0]), (4, [0.5, 0.5])]
    got = defaultdict(list)
    for r in bitslice.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    asked = {0: rows[0][1], 100: [5.0], 200: [-1.0, 0.0]}  # the shortest, then the least of an id
    for q, v in asked.items():
        whole = lambda x: [math.floor(1024 * c) for c in x]
        scores = [(k, sum(a * b for a, b in zip(whole(v), whole(x), strict=True))) for k, x in rows if k != q and len(x) == len(v)]
        assert got[q] == sorted(scores, key=lambda s: (-s[1], s[0]))[:10]
    with pytest.raises(Exception, match="does not fit"):
        bitslice.top_k(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")).collect()


def thue_morse(n):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return out


def test_texts_that_polynomials_cannot_tell_apart(spark):
    one, two = ("".join("ab"[x ^ y] for x in thue_morse(2048)) for y in (0, 1))
    df = spark.createDataFrame([(1, f"{one}\n{two}"), (2, f"{one} one two"), (3, f"{two} one two"), (4, " ".join("ab"[x] for x in thue_morse(2048))), (5, " ".join("ab"[1 - x] for x in thue_morse(2048)))], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in df.collect()}
    ids = encoding(P)
    for r in bpe.round_trip(df, "text", BPE).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == ids(r.text) and bytes(r.decoded).decode() == r.text
    assert {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(df).collect()} == {d: line_numbers(texts)[d] for d in texts}
    assert {r.doc_id: (r.group_id, r.n_links) for r in chosen_path.with_groups(df).collect()} == linked(texts)
    want = repeats(texts)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in recompress.remove_repeats(df).collect()} == {d: want[d][:2] for d in texts}


def test_hashes_of_spans():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 400)
    ends = starts + np.where(rng.random(400) < 0.9, rng.integers(0, 12, 400), rng.integers(0, 900, 400))
    raw = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    hashes = [common.byte_hashes(data, starts, ends, k).tolist() for k in (0, 1)]
    assert len(set(raw)) == len(set(hashes[0])) == len(set(hashes[1])) == len(set(zip(raw, *hashes, strict=True)))
    first = np.array([raw.index(x) for x in raw])
    assert common.same_bytes(data, starts, ends, first)
    other = np.array([next((j for j, y in enumerate(raw) if y != x and len(y) == len(x)), i) for i, x in enumerate(raw)])
    assert not common.same_bytes(data, starts, ends, other)
    values = rng.integers(0, 3, 3000).astype(np.uint64)
    starts = rng.integers(0, 2000, 600)
    ends = starts + rng.integers(1, 80, 600)
    runs = [values[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    got = common.run_hashes(values, starts, ends).tolist()
    assert len(set(runs)) == len(set(got)) == len(set(zip(runs, got, strict=True)))


def test_joins_beyond_a_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ELEMENTS", 0)
    df, texts = documents
    gone, groups = line_numbers(texts), linked(texts)
    assert {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(df).collect()} == {d: gone[d] for d in texts}
    assert {r.doc_id: (r.group_id, r.n_links) for r in chosen_path.with_groups(df).collect()} == groups
    for bits in (28, 0):  # with a bitmap of those that may match, and without one
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        left, right = spark.range(300).selectExpr("id", "'x' AS a"), spark.range(0, 900, 7).selectExpr("id", "array(id) AS b")
        for how in ("inner", "left", "left_semi", "left_anti"):
            got, want = common.attached(left, right, "id", how), left.join(right, "id", how)
            assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_templates_beyond_a_broadcast(spark, monkeypatch):
    rows = [(k, f"http://h{k % 2}/{k}", f"<body><div>Seen often on {k % 2}</div><p>Own {k}</p></body>") for k in range(12)] + [(12, None, "<p>No host</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: f"Own {k}" for k in range(12)} | {12: "No host"}
    for most in (html_extract.BROADCAST_SUBTREES, 0):
        monkeypatch.setattr(html_extract, "BROADCAST_SUBTREES", most)
        assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


def test_query_of_pages(spark, tmp_path):
    long_page = "<article>" + "".join(f"<p>é {k} &amp; more</p>" for k in range(60_000)) + "</article>"
    rows = [(1, "http://a/1", long_page), (2, "http://a/2", "<article><p>Twice</p></article>"), (2, "http://a/2", "<article><p>Twice</p></article>"), (3, None, None), (4, "", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op1_site_templates(spark, str(tmp_path)).collect()
    want = {1: "\n".join(f"é {k} & more" for k in range(60_000)), 2: "Twice", 3: "", 4: ""}
    assert Counter(r.page_id for r in got) == Counter(k for k, _, _ in rows)
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_repeated_rows_have_a_result_each(spark):
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (2, "short"), (None, text), (None, None)], "doc_id long, text string")
    item = spark.createDataFrame([(9, " ".join(f"w{k}" for k in range(12)))], "item_id long, text string")
    assert Counter((r.doc_id, r.n_hit) for r in decontam.contamination(df, item).collect()) == Counter([(1, 12), (1, 12), (2, 0), (None, 12), (None, 0)])
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in recompress.remove_repeats(df).collect()) == Counter([(1, 50, 50), (1, 50, 50), (2, 1, 0), (None, 50, 50), (None, 0, 0)])
    assert Counter((r.doc_id, r.n_tokens > 1) for r in token_count.count_tokens(df, "text", PIECES).collect()) == Counter([(1, True), (1, True), (2, False), (None, True), (None, False)])
    assert Counter((r.doc_id, len(r.ids) > 0) for r in bpe.encode(df, "text", BPE).collect()) == Counter([(1, True), (1, True), (2, True), (None, True), (None, False)])
    # of equal lines the first document's stays, then the first of its rows; documents without ids come last
    assert Counter((r.doc_id, tuple(r.removed_lines)) for r in line_dedup.dedup_lines(df).collect()) == Counter([(1, ()), (1, (0,)), (2, ()), (None, (0,)), (None, ())])


def test_one_bad_row_changes_nothing_for_others(spark):
    rows = [(k, "alpha beta gamma delta epsilon\n" + " ".join(f"d{k}x{j}" for j in range(12))) for k in range(1, 7)]
    for more in ([], [(None, "a row without an id")], [(3, "a row with an id that is taken")]):
        df = spark.createDataFrame(rows + more, "doc_id long, text string")
        kept = sorted(r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.text.startswith("alpha"))
        assert kept == [1]
        assert {(r.doc_id, r.group_id, r.n_links) for r in chosen_path.with_groups(df).collect()} >= {(k, k, 0) for k in range(1, 7)}


def test_clashing_names_raise(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    more = lambda name: df.selectExpr("*", f"1 AS {name}")
    model = quality.train(np.zeros((12, quality.DIMENSIONS + quality.LOOKS + 2), np.float32), np.arange(12) % 2, np.zeros(0, np.uint64), np.zeros((1, quality.DIMENSIONS), np.int32))
    for call in (
        lambda: bpe.decode(more("Decoded"), BPE),
        lambda: bpe.round_trip(more("IDS"), "text", BPE),
        lambda: shard.draw(more("Shard"), "doc_id", shard.tree_of(4), "shard"),
        lambda: shard.slots(more("SLOT"), "doc_id", ["text"]),
        lambda: recompress.remove_repeats(more("N_words")),
        lambda: token_count.count_tokens(more("n_TOKENS"), "text", PIECES),
        lambda: quality.score(more("Score"), model),
        lambda: chosen_path.with_groups(more("N_LINKS")),
        lambda: line_dedup.dedup_lines(more("Removed_Lines")),
    ):
        with pytest.raises(ValueError, match="already"):
            call()


@pytest.mark.parametrize("hottest", [100_000, 3])
def test_hot_sets_are_posted_once(spark, monkeypatch, hottest):
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "HOTTEST", hottest)
    line, near = "one line of eleven words that stands in very many documents", "one line of eleven words that stands in very many papers"
    own = lambda k: " ".join(f"d{k}w{j}" for j in range(9))
    rows = [(k, f"{own(k)}\n{line if k % 3 else near}\nfoot of the page") for k in range(40)] + [(k, own(k % 4) + " tail " + own(90)) for k in range(40, 60)]
    rows += [(100, own(3) + " tail"), (101, own(3) + " tail"), (102, own(3) + " tail")]  # of one of these there is a partition that posts nothing
    df, texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(20), dict(rows)
    assert {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(df).collect()} == {d: line_numbers(texts)[d] for d in texts}
    assert {r.doc_id: (r.group_id, r.n_links) for r in chosen_path.with_groups(df).collect()} == linked(texts)


def test_packed_groups_come_back():
    rng = np.random.default_rng(4)
    many = rng.integers(1, 9, 300)
    edges = np.r_[0, np.cumsum(many)]
    n = int(edges[-1])
    columns = [rng.integers(0, 1 << 31, n).astype("<u4"), rng.integers(0, 1 << 62, n), rng.integers(-9, 9, n).astype("<i4"), rng.integers(0, 99, n).astype("<i4")]
    counts = rng.integers(0, 4, n)
    words = rng.integers(0, 1 << 62, int(counts.sum())).astype(np.uint64)
    kinds = [c.dtype.str for c in columns]
    packed = common.packed_groups(columns, edges, words, counts)
    assert len(packed) == 300
    for part, a, b in ((packed, 0, 300), (packed.slice(7, 50), 7, 57), (packed.slice(299, 1), 299, 300)):
        got, extra = common.unpacked_groups(part, kinds)
        assert all((x == c[edges[a] : edges[b]]).all() and x.dtype == c.dtype for x, c in zip(got, columns, strict=True))
        assert (extra == words[counts[: edges[a]].sum() : counts[: edges[b]].sum()]).all()
    none = common.packed_groups([c[:0] for c in columns], np.zeros(1, np.int64), words[:0], counts[:0])
    assert len(none) == 0 and not any(len(x) for x in common.unpacked_groups(none, kinds)[0])
    got, extra = common.unpacked_groups(common.packed_groups(columns, edges), kinds)
    assert all((x == c).all() for x, c in zip(got, columns, strict=True)) and not len(extra)
