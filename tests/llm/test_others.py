"""HTML extraction, exact top-k, the quality classifier and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest

from figlake.llm import bitslice, html_extract, quality
from figlake.llm.html_extract import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- note --><div class="cookie-notice">Cookies</div>
<article><h1>Head &amp; more</h1><p>One <b>bold
 text.<br><p>Two&nbsp;three &#233;<p></p><ul><li>item<li>other &lt;b&gt;</ul><form><p>mail</p></form></article>
<aside>Side</aside><section id="comments"><p>First!</section><footer>End</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head & more\nOne bold text.\nTwo three é\nitem\nother <b>"
    assert main_text(None) == main_text("") == ""
    assert main_text(PAGE[: PAGE.index("three") + 3]) == "Head & more\nOne bold text.\nTwo thr"
    assert main_text("<p>a < b &am") == "a < b &am"
    assert main_text('<div>x</div><p class="y" <b>"z') .startswith("x")
    assert main_text("plain &amp;amp; words") == "plain &amp; words"
    assert main_text("<article>" * 400 + "deep" + "</article>" * 10) == "deep"


def test_dropped_elements_end_where_others_do():
    assert main_text('<article><p class="ad">Buy<p>Real text</article>') == "Real text"
    assert main_text('<article><ul><li class="x ad">Share<li>Real</ul>More</article>') == "Real\nMore"
    assert main_text('<article><div><span class="sponsored">Buy</div><p>Real</p></article>') == "Real"
    assert main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object>y</object>.</p><dialog>Hello</dialog></article>") == "Let x=1 and y."
    assert main_text('<article><p>One<svg width="1"/> two<math/></p><p>Three</p><svg><text>x</text></svg></article>') == "One two\nThree"
    assert main_text("<article><nav><ul><li>a<li>b<p>c</ul></nav><p>One <button><div>x</div></button>two</p></article>") == "One two"
    assert main_text("<article><p>One</p><aside><p>x<article><p>y</article>z</article><p>Two") == "One"


def test_names_are_whole():
    assert main_text('<article><section id="related-work"><h2 id="login-flow">Login</h2><p>Flow</p></section><section id="social-science">Social</section></article>') == "Login\nFlow\nSocial"
    assert main_text('<article><section id="menu">Menu</section><div class="ad-hoc">Year</div><div class="x sidebar">R</div><div id="comments">C</div></article>') == "Menu\nYear"
    assert main_text('<article><p class="related">Related</p><p class="social">Social</p></article>') == "Related\nSocial"
    assert main_text('<main><p>Own</p><article class="comment"><p>First!</p></article><article><p>More</p></article></main>') == "Own\nMore"
    assert main_text('<article class="post ad"><p>Own</p></article><article class="comment"><p>First!</p></article>') == "Own"
    assert main_text('<body><div class="cookie-notice">Cookies</div><div id="sidebar">Side</div><p>Own</p></body>') == "Own"


def tree(rng, pool, depth=0):
    """A random element: (tag, children), children being elements or texts."""
    if depth == 3 or rng.random() < 0.3:
        return ("p", [rng.choice(pool)])
    return (rng.choice(["div", "section"]), [tree(rng, pool, depth + 1) for _ in range(rng.randint(1, 3))])


def test_templates_against_brute_force(spark):
    rng = random.Random(21)
    pool = [f"text {k} of many" for k in range(60)]
    forest = {(k, f"h{k % 3}"): [tree(rng, pool) for _ in range(rng.randint(1, 6))] for k in range(90)}

    def html(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(html, x[1]))}</{x[0]}>"

    def subtrees(x):
        return set() if isinstance(x, str) else {html(x)}.union(*map(subtrees, x[1]))

    pages = Counter((host, s) for (k, host), xs in forest.items() for _ in range(1 + (k == 5)) for s in set().union(*map(subtrees, xs)))

    def texts(x, host):
        if isinstance(x, str):
            return [x]
        return [] if pages[host, html(x)] >= html_extract.MIN_PAGES else [t for c in x[1] for t in texts(c, host)]

    want = {k: "\n".join(t for x in xs for t in texts(x, host)) for (k, host), xs in forest.items()}
    df = spark.createDataFrame([(k, f"http://{host}/{k}", f"<body>{''.join(map(html, xs))}</body>") for (k, host), xs in forest.items()], "page_id long, url string, html string")
    df = df.union(df.where("page_id = 5"))  # a repeated page counts twice, and has its row
    got = html_extract.extract(df.repartition(4)).collect()
    assert 20 < sum(bool(t) for t in want.values()) and sum(len(t) for t in want.values()) < 0.9 * sum(len("\n".join(texts(x, None))) for (_, _), xs in forest.items() for x in xs)
    assert len(got) == 91 and all(r.text == want[r.page_id] for r in got)


def test_templates_are_deleted_outside_articles(spark):
    share = '<div><ul><li><a href="/a">Share this</a></li></ul></div>'
    rows = []
    for k in range(8):
        body = f"<div><p>Own words of page {k}.</p></div><div><p>Recurring words.</p></div>"
        rows.append((k, f"https://Host.example/{k}", f"<body>{body}</body>"))
        rows.append((100 + k, f"https://host.example:80/a{k}", f"<body><article><p>Recurring words.</p>{share}<p>Own {k}</p></article><div>Recurring words.</div></body>"))
    rows += [(200, "https://other.example/", "<body><p>Recurring words.</p></body>"), (201, None, None), (202, "https://other.example/", "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, _host string").repartition(3)
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert all(got[k].text == f"Own words of page {k}." for k in range(8))
    assert all(got[100 + k].text == f"Recurring words.\nOwn {k}" for k in range(8))
    assert (got[200].text, got[201].text, got[202].text, got[200]._host) == ("Recurring words.", "", "", "k")
    assert html_extract.extract(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        html_extract.extract(df.withColumnRenamed("_host", "text"))


def test_templates_are_deleted_inside_articles(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    box, long_box, copied = "<div><h2>About us</h2><p>We write on many things. Sign up.</p></div>", f"<section><p>{say(70)}</p></section>", [say(30) for _ in range(4)]
    rows, want = [], {}
    for k in range(200):  # few pages of many: an absolute count
        own = [say(20), say(60), say(60)]
        with_box = k < 6
        rows.append((k, f"https://big.example/{k}", f"<body><main><h2>Notes</h2><p>{own[0]}</p>{box + long_box if with_box else ''}<p>{own[1]}</p><p>{own[2]}</p><table><tr><td>0</td><td>{k}</td></tr></table></main></body>"))
        want[k] = f"Notes\n{own[0]}\n{own[1]}\n{own[2]}\n0\n{k}"
    for k in range(200, 212):  # copies of an article, some with a date of their own
        date = f"<p>Day {k}</p>" if k % 2 else ""
        rows.append((k, f"https://big.example/{k}", f"<body><article>{date}{''.join(f'<p>{t}</p>' for t in copied)}{box}</article></body>"))
        want[k] = "\n".join(([f"Day {k}"] if date else []) + copied)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "ROW_BLOCK", 150)
    monkeypatch.setattr(bitslice, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 12)).astype(np.float32)
    v[100:300] = v[5]  # many equal vectors
    rows = [(k, [float(x) for x in v[k]]) for k in range(700)] + [(700, None), (800, [float("nan")] * 12), (900, [1.0, None] * 6), (1000, [1.0, 2.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    q = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    got = {}
    for r in bitslice.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 100))
    for k, found in got.items():
        s = q @ q[k]
        assert found == [(i, s[i]) for i in np.lexsort((np.arange(700), -s)) if i != k][:10]
    assert bitslice.top_k(df.limit(0)).count() == 0
    assert [r.vec_id for r in bitslice.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()] == [1]


@pytest.mark.parametrize("shape", [(1, 3), (64, 4), (65, 1), (300, 6)])
def test_sliced_sums(shape):
    rng = np.random.default_rng(2)
    for _ in range(20):
        rows = rng.integers(-5000, 5000, size=shape)
        index, query, barred = bitslice.SlicedIndex(rows), rng.integers(-900, 900, size=shape[1]), rng.random(shape[0]) < 0.2
        at, scores = index.top(query, 3, barred)
        s = rows @ query
        assert at.tolist() == [k for k in np.lexsort((np.arange(shape[0]), -s)) if not barred[k]][:3] and scores.tolist() == s[at].tolist()


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        good = rng.random() < 0.7
        if not good:
            words = [[w.upper() + "!!" for w in words], [w + rng.choice(["***", "%%%"]) for w in words], [words[0]] * len(words), " | ".join(words).split(" ")][k % 4]
        docs.append((k, " ".join(words)))
        labels.append((k, int(good)))
    return docs, labels


def test_quality(spark):
    docs, labels = corpus(900, 1)
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "The.")], "doc_id long, text string")
    ls = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(df, ls, usable=lambda key: key % 3 != 0)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    held = [(got[d], y) for d, y in labels if d % 3 == 0]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.97 and all(0 <= s <= 1 for s in got.values())
    again = {r.doc_id: r.score for r in quality.score(df.repartition(7), quality.fit(df.repartition(5), ls, usable=lambda key: key % 3 != 0)).collect()}
    assert max(abs(got[d] - again[d]) for d in got) < 0.05
    assert quality.fit(df, ls.limit(0)) == 0.5 and quality.fit(df, ls.where("quality = 1")) == 1.0
    assert quality.score(df.limit(0), model).count() == 0


def reflowed(text, n):
    words = text.split()
    return "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))


def test_pipeline_stages(spark, tmp_path):
    """Every stage against a plain version on its own input: ids, texts and counts."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    public = pytest.importorskip("public_tokenizers")
    from test_texts import encoding, item_windows, line_numbers, linked

    from figlake.llm import queries

    docs, labels = corpus(400, 3)
    good = [d for d, y in labels if y]
    texts = dict(docs)
    item = " ".join(texts[good[0]].split()[3:20])
    longest = max((texts[d] for d in good[3:40]), key=lambda t: len(t.split()))
    near = longest.split()
    near[7] = "changed"
    rows = [*docs, (400, texts[good[1]]), (401, " ".join(texts[good[2]].split()[:-1]) + "\nfresh words that are new to all"), (402, "some words before " + item + " and after"), (403, None), (404, "")]
    rows += [(405, reflowed(longest, 7)), (406, reflowed(" ".join(near), 5)), (407, texts[good[1]])]
    rows += [(400, texts[good[1]]), (None, "words of a document without an id, of which there are some more here")]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], shape).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, y, 0) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    order = lambda x: (x[0] is None, x[0] or 0)
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(((r.doc_id, r.text) for r in now.collect()), key=order)
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            model = quality.fit(now, spark.read.parquet(str(tmp_path / "labels.parquet")), usable=lambda key: queries._remainder(key) != 0)
            score = lambda t: float(model.score(quality.pooled(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]), model.hashes, model.vectors))[0])
            want = [(d, t) for d, t in before if score(t) >= corpus_pipeline.LEAST_SCORE]
        elif name == "line_dedup":
            gone = line_numbers({n: t for n, (_, t) in enumerate(before)})
            left = [(d, t if n not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[n]), n in gone) for n, (d, t) in enumerate(before)]
            want = [(d, t) for d, t, cut in left if not cut or t.split()]
        elif name == "near_duplicates":
            distinct = list(dict.fromkeys(before))
            groups = linked({n: t for n, (_, t) in enumerate(distinct)})
            want = [x for n, x in enumerate(distinct) if groups[n][0] == n]
        elif name == "decontamination":
            windows = item_windows([(1, item)])
            want = [(d, t) for d, t in before if not windows(t)[1]]
        else:
            own = encoding(public)
            got = sorted(((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.round_trip) for r in after.collect()), key=order)
            assert got == [(d, len(own(t)), own(t), True) for d, t in before]
            break
        assert sorted(((r.doc_id, r.text) for r in after.collect()), key=order) == want, name
        assert after.columns == corpus_pipeline.COLUMNS
        assert all(r.text is None or r.n_chars == len(r.text) for r in after.collect())
        seen[name], now = {d for d, _ in want}, after
    assert {400, 407}.isdisjoint(seen["line_dedup"]) and {401, 403, 404, 405, 406} <= seen["line_dedup"] | {403, 404}
    assert seen["line_dedup"] - seen["near_duplicates"] >= {405, 406}
    assert seen["near_duplicates"] - seen["decontamination"] == {good[0], 402}
    bad = {d for d, y in labels if not y}
    assert len(bad & seen["quality"]) <= 3 and len(set(good) - seen["quality"]) <= 5
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(d for d, *_ in got if d is not None)


def test_pipeline_of_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, shape in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], shape).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
