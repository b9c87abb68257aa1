"""Main text of HTML pages: boilerplate elements and site templates are removed.

Pages are read by a small tolerant parser (unclosed and misnested tags, raw-text elements, truncated pages). Elements
that say themselves that they are boilerplate are dropped: by their tag (menus, headers and footers of the page, sidebars, forms, dialogues, scripts, styles),
their role, or a class that is one of a few whole names (adverts, notices, menus, sidebars, comments). They end as others do: with their own end, an implied one, or that of a parent.
Everything else is for the count of site templates: block subtrees are hashed, counted per host in Spark, and
deleted from ``MIN_PAGES`` on, however large the host is. Outside the article, and for link lists anywhere, pages are counted. Inside the article (``article``,
``main`` or role=main; pages that have one keep nothing else) all copies of an article recur with all they hold, so there the different surroundings are counted:
the longest block of text elsewhere in the article. Hosts where that finds templates are read again without these, until no more are found. Subtrees that are more than half of
their article, one or all together, are spared, as edited copies differ everywhere, and so are headings and the parts of lists and tables, which recur by nature; a whole list or table is a subtree like others.

Text is kept by blocks: character references decoded, white space turned into one blank, blocks joined by a newline.

Defined cases: null and empty pages give an empty text; a page without an article keeps its body; a null url counts as
a host of its own name (""); repeated pages each get their row; very long pages are read whole; other columns are kept,
and a clash with the new columns raises ValueError; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figlake.llm.common import attached, checkpointed, fresh, tidy

MIN_PAGES = 4
#: Subtrees to be deleted that may be broadcast, of eight bytes each.
BROADCAST_SUBTREES = 1_000_000

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg noembed noframes".split())
_DROPPED = frozenset("nav footer aside form select button dialog head menu".split()) | _RAW
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead tfoot caption figcaption legend optgroup option summary".split())
_WHOLE = frozenset("html body article main".split())
_INSIDE = 0x5DEECE66D1CE4E5B
_SCOPES = frozenset("table ul ol dl td th body html article main section div blockquote".split())
#: Whole class names (and ids) that say outright what an element is: adverts, notices, menus, sidebars, comments. All else is for the count to find.
_NAMED = frozenset("ad ads advert adverts advertisement sponsored notice cookie-notice cookie-banner menu navbar breadcrumbs sidebar comment comments".split())
_TITLED = frozenset("section h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _boilerplate(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is boilerplate by its tag, its role, being hidden, or its name."""
    if tag in _DROPPED or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    classes, name = attributes.get("class", "").lower().split(), attributes.get("id", "").lower()
    if tag == "article" and not inside:  # the page's text, unless a reader's
        return not {"comment", "comments"}.isdisjoint(classes)
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in _ROLES or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    # ids of sections and headings come from what the text is about
    return not _NAMED.isdisjoint(classes) or name in _NAMED and (tag not in _TITLED or name == "comments")


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


class _Open:
    __slots__ = ("tag", "inside", "digest", "has_text", "linked", "length", "start", "dropped")

    def __init__(self, tag: str, inside: bool, start: int, dropped: bool = False):
        self.tag, self.inside, self.start, self.dropped = tag, inside, start, dropped
        self.digest, self.has_text = blake2b(tag.encode(), digest_size=8), False
        self.linked = self.length = 0


class Page:
    """Blocks of text of one page, and the hashes of the subtrees subject to template removal with their surroundings (None where pages count); with ``deleted``, subtrees of those hashes are left out."""

    def __init__(self, html: str, deleted: frozenset[int] = frozenset()):
        self.deleted, self.hashes = deleted, {}
        self.has_article = False
        self.stack = [_Open("#page", False, 0)]
        self.run: list[str] = []
        self.anchors = self.run_linked = 0
        self.all: list[tuple[bool, str, bool]] = []  # whether inside, text, whether mostly links
        self.inner: list[tuple[int, int, int, int]] = []  # subtrees of the article that is open: hash, first and last block, length
        self.gone: list[tuple[int, int]] = []
        self._read(html)
        while len(self.stack) > 1:
            self._close()
        self._break()
        edge = [0] * (len(self.all) + 1)
        for start, end in self.gone:
            edge[start] += 1
            edge[end] -= 1
        self.blocks = [text for (inside, text, _), n in zip(self.all, accumulate(edge), strict=False) if not n and (inside or not self.has_article)]

    def _break(self) -> None:
        """Ends the block of text that is being read."""
        if self.run:
            raw = "".join(self.run)
            text = " ".join(unescape(raw).split())
            if text:
                self.all.append((self.stack[-1].inside, text, 2 * self.run_linked > len(raw)))
            self.run, self.run_linked = [], 0

    def _text(self, text: str) -> None:
        self.run.append(text)
        if self.anchors:
            self.run_linked += len(text)
        if not text.isspace():
            top = self.stack[-1]
            top.has_text = True
            top.length += len(text)
            top.digest.update(" ".join(text.split()).encode("utf-8", "surrogatepass"))

    def _close(self) -> None:
        node = self.stack[-1]
        if node.tag in _BLOCKS and not node.dropped:
            self._break()
        self.stack.pop()
        self.anchors -= node.tag == "a"
        if node.dropped:
            return
        above = self.stack[-1]
        digest = node.digest.digest()
        above.digest.update(digest)
        above.has_text |= node.has_text
        above.length += node.length
        above.linked += node.length if node.tag == "a" else node.linked
        if node.has_text and node.tag in _BLOCKS and node.tag not in _WHOLE:
            value = int.from_bytes(digest, "little", signed=True)
            if not node.inside or 2 * node.linked > node.length:
                self.hashes[value] = None
                if value in self.deleted:
                    self.gone.append((node.start, len(self.all)))
            elif node.tag not in _PARTS:
                self.inner.append((value ^ _INSIDE, node.start, len(self.all), node.length))
        if node.inside and not above.inside:
            self._break()
            self._surround(node)

    def _surround(self, article: _Open) -> None:
        """The subtrees of an article that has been read, each with the longest block elsewhere in it."""
        first, inner = article.start, [x for x in self.inner if 2 * x[3] <= article.length]
        self.inner = []
        if not inner:
            return
        sizes = [0 if linked else len(text) for _, text, linked in self.all[first:]]
        spans = [(start, end) for value, start, end, _ in inner if value in self.deleted]
        if spans:
            left = list(sizes)
            for start, end in spans:
                left[start - first : end - first] = [0] * (end - start)
            if 2 * sum(left) >= sum(sizes):
                self.gone += spans
                sizes = left
        longer = lambda a, b: b if sizes[b] > sizes[a] else a
        before = list(accumulate(range(len(sizes)), longer))
        after = list(accumulate(range(len(sizes) - 1, -1, -1), longer))[::-1]
        for value, start, end, _ in inner:
            others = [before[start - first - 1]] if start > first else []
            others += [after[end - first]] if end - first < len(sizes) else []
            longest = max(others, key=lambda k: sizes[k], default=None)
            if longest is not None and sizes[longest]:
                self.hashes.setdefault(value, _hash(self.all[first + longest][1].encode("utf-8", "surrogatepass")))

    def _imply(self, tag: str) -> None:
        """Closes what the start of a block ends."""
        if tag in _BLOCKS:
            if not self.stack[-1].dropped:
                self._break()
            closes = _CLOSES.get(tag)
            for at in range(len(self.stack) - 1, 0, -1):
                name = self.stack[at].tag
                if name == "p" or closes and name in closes:
                    while len(self.stack) > at:
                        self._close()
                    break
                if name in _DROPPED or name in _SCOPES and name != "td" and name != "th" or name in ("td", "th") and not closes:
                    break

    def _open(self, tag: str, inside: bool, dropped: bool) -> None:
        if tag == "a":
            self.anchors += 1
        if inside and not self.stack[-1].inside:
            self._break()
        self.stack.append(_Open(tag, inside, len(self.all), dropped))

    def _read(self, html: str) -> None:
        at = 0
        for token in _TOKEN.finditer(html):
            if token.start() < at:
                continue
            if token.start() > at and not self.stack[-1].dropped:
                self._text(html[at : token.start()])
            at = token.end()
            tag = (token[2] or token[5] or "").lower()
            if not tag:
                continue
            if token[1] or token[4]:
                if tag == "br" and not self.stack[-1].dropped:
                    self.run.append(" ")
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.stack[k].tag == tag:
                        while len(self.stack) > k:
                            self._close()
                        break
                continue
            raw = token[3] if token[2] else token[6]
            if tag in _VOID:
                if not self.stack[-1].dropped:
                    self.run.append(" ") if tag == "br" else self._break() if tag == "hr" else None
                continue
            empty = raw.rstrip().endswith("/")
            if empty and tag in ("svg", "math"):
                continue
            if tag in _RAW:
                at = self._raw_end(html, tag, at)
                continue
            self._imply(tag)
            above = self.stack[-1]
            if above.dropped:  # inside a dropped element tags matter only for where it ends
                self._open(tag, above.inside, True)
                continue
            attributes = _attributes(raw)
            main = tag in ("article", "main") or attributes.get("role", "").lower() == "main"
            if _boilerplate(tag, attributes, above.inside):
                if not empty or tag in _BLOCKS:
                    self._open(tag, above.inside, True)
                continue
            self.has_article |= main
            self._open(tag, main or above.inside, False)
        if at < len(html) and not self.stack[-1].dropped:
            self._text(html[at:])

    @staticmethod
    def _raw_end(html: str, tag: str, at: int) -> int:
        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
        return end.end() if end else len(html)


def main_text(html: str | None, deleted: frozenset[int] = frozenset()) -> str:
    return "\n".join(Page(html, deleted).blocks) if html else ""


def _known(pages: DataFrame, found: DataFrame | None, host: str):
    """The pages, and a function that gives, for each page of a batch, the hashes to be deleted: of found (host, subtrees)."""
    if found is None:
        return pages, lambda batch: [frozenset()] * batch.num_rows
    if found.agg(F.coalesce(F.sum(F.size("subtrees")), F.lit(0))).first()[0] <= BROADCAST_SUBTREES:
        few = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.subtrees) for r in found.collect()})
        return pages, lambda batch: [few.value.get(at, frozenset()) for at in batch.column(host).to_pylist()]
    gone = fresh(pages, "_gone")  # a page's row carries the subtrees of its host
    known = fresh(pages, "_known")
    joined = pages.join(found.select(F.col("host").alias(known), F.col("subtrees").alias(gone)), F.col(host) == F.col(known), "left").drop(known)

    def of(batch):
        sets: dict[str, frozenset[int]] = {}
        hosts = batch.column(host).to_pylist()
        for at, drop in zip(hosts, batch.column(gone), strict=True):
            if at not in sets:
                sets[at] = frozenset(drop.as_py() or ())
        return [sets[at] for at in hosts]

    return joined, of


def _subtrees(pages: DataFrame, found: DataFrame | None, host: str, html: str) -> DataFrame:
    """(host, subtree, around, n): in how many of a batch's pages a subtree is with these surroundings."""
    joined, deleted = _known(pages.select(host, html), found, host)

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for at, text, drop in zip(batch.column(host).to_pylist(), batch.column(html), deleted(batch), strict=True):
                seen.update((at, *h) for h in Page(text.as_py() or "", drop).hashes.items())
            columns = [pa.array([k[0] for k in seen], pa.string()), *[pa.array([k[c] for k in seen], pa.int64()) for c in (1, 2)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["host", "subtree", "around", "n"])

    return joined.mapInArrow(tidy(run), "host string, subtree long, around long, n long")


def templates(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(host, subtrees): the hashes of the subtrees that recur on the host."""
    found, asked = None, pages
    while True:
        counted = _subtrees(asked, found, host, html).groupBy("host", "subtree", "around").agg(F.sum("n").alias("n"))
        inside = F.col("around").isNotNull()
        counted = counted.groupBy("host", "subtree").agg(F.sum(F.when(inside, 1).otherwise(F.col("n"))).alias("n"), F.max(inside).alias("inside")).where(F.col("n") >= MIN_PAGES)
        new = counted.select("host", "subtree", "inside")
        if found is not None:  # all that was found before, and what is new
            old = found.select("host", F.explode("subtrees").alias("subtree"), F.lit(False).alias("inside"))
            new = new.union(old).groupBy("host", "subtree").agg(F.min("inside").alias("inside"))
        found = checkpointed(new.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("subtrees"), F.max("inside").alias("more")))
        more = found.where("more").select(F.col("host").alias(host))
        found = found.select("host", "subtrees")
        if not more.limit(1).count():
            return found
        asked = attached(pages, more, host, "left_semi")


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """Replaces the html by the main text."""
    if out.lower() in {c.lower() for c in pages.columns if c != html}:
        raise ValueError(f"the table has a column {out} already")
    host = fresh(pages, "_host")
    hosted = pages.withColumn(host, F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)))
    joined, deleted = _known(hosted, templates(hosted, host, html), host)
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(text.as_py(), drop) for text, drop in zip(batch.column(html), deleted(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(texts, pa.string())], names=schema.names)

    return joined.mapInArrow(tidy(run), schema)
