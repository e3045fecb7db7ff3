"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged into one tree: a node stands for the elements with the same path of labels (tag,
id and class). Its presentation importance is the entropy, to the base of its pages, of the child sequences it occurs
with; the content importance of its texts is 1 less the mean entropy of a text over the pages that have it. A node's
composite importance is (1 - 0.9^l) * presentation + 0.9^l * mean importance of what is below it, l being its child
sequences. Branches below a threshold are cut from each page, and so are branches whose tag, role or class says that
they are no content. Inside an article or main element its paragraphs belong to one text, also where other pages of the
host repeat some of them: there a name has to say that a branch is no content, and where it says so only in part
('related-work', 'ad-hoc'), the importance decides.
"""

from __future__ import annotations

import html
import math
from collections import Counter
from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, written

#: Branches of nodes that at least this many pages have are cut below this importance.
LEAST_PAGES = 3
THRESHOLD = 0.3
DECAY = 0.9
#: Rows of noisy nodes (two longs and a host) that are broadcast at most; beyond it the same join shuffles.
SMALL_ROWS = 200_000

# HTML's element kinds, and names that mark what is no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CHROME_TAGS = frozenset("head title script style noscript template nav footer aside form button select textarea input option iframe svg canvas object menu dialog".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer header masthead "
    "breadcrumb breadcrumbs comment comments disqus cookie cookies consent gdpr notice alert share sharing social related recommended newsletter subscribe signup login popup modal widget pagination pager".split()
)
CHROME_NAMES = regex.compile(rf"(?<![a-z])(?:{'|'.join(sorted(CHROME_WORDS))})(?![a-z])")
#: Words beside which a chrome word keeps its meaning: 'ad-slot' is an advert, 'ad-hoc' need not be.
PLAIN_WORDS = frozenset("area articles bar block bottom box button buttons close container content form frame global google holder icons inline inner item items label left link links list main media native outer overlay page panel posts primary right secondary section site slot space stories text top unit wrap wrapper zone".split())
TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|"
    r"<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)/?>|(?P<text>[^<]+|<)",
    regex.DOTALL | regex.IGNORECASE,
)
ATTRIBUTE = regex.compile(r"\b(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", regex.IGNORECASE)
DIGITS = regex.compile(r"\d+")
#: Inside an article: the names of its own head, which is content.
OWN_HEADER = regex.compile(r"(?<![a-z])(?:article|entry|post|story|content)[-_]+header(?![a-z])")


def child_id(parent: int, label: str) -> int:
    x = xxhash.xxh3_64_intdigest(label, parent & (2**64 - 1))
    return x - 2**64 if x >= 2**63 else x


class Element:
    __slots__ = ("id", "tag", "chrome", "article", "doubtful", "children")

    def __init__(self, id: int, tag: str, chrome: bool, article: bool, doubtful: bool = False):
        self.id, self.tag, self.chrome, self.article, self.doubtful = id, tag, chrome, article, doubtful
        self.children: list[str] = []


def says(names: str) -> str:
    """'chrome' if one of the ``names`` is made of chrome words, and plain ones, only; 'doubtful' if one has a chrome word
    beside others; else ''."""
    found = ""
    for name in names.split():
        parts = [x for x in regex.split(r"[^a-z]+", name) if x]
        if not CHROME_WORDS.isdisjoint(parts):
            if all(x in CHROME_WORDS or x in PLAIN_WORDS for x in parts):
                return "chrome"
            found = "doubtful"
    return found


def element(parent: Element, tag: str, attrs: str) -> Element:
    """A node below ``parent``; chrome and article hold for what is inside, too. Inside an article a name that is chrome
    only in part leaves the node in doubt, for its importance to tell."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attrs)} if attrs else {}
    names = f"{found.get('id', '')} {found.get('class', '')}".strip()
    role = found.get("role", "")
    main = tag in ("article", "main") or role == "main"
    chrome = parent.chrome or tag in CHROME_TAGS or role in CHROME_ROLES or (tag == "header" and not parent.article)
    named = OWN_HEADER.sub("", names) if parent.article else names
    doubtful = False
    if named and not chrome and not main and tag not in ("html", "body") and CHROME_NAMES.search(named):
        doubtful = parent.article and says(named) == "doubtful"
        chrome = not doubtful
    label = f"{tag} {DIGITS.sub('0', names)}".strip()
    parent.children.append(label)
    return Element(child_id(parent.id, label), tag, chrome, parent.article or main, doubtful)


def blocks(page: str, closed=None) -> Iterator[tuple[list[Element], str]]:
    """(open elements, raw text) of each block in page order. ``closed`` is called with (element, parent) at its end."""
    stack = [Element(0, "", False, False)]
    text: list[str] = []
    muted: list | None = None  # an open inline element that is no content: tag, depth, and blocks open inside

    def pop() -> None:
        e = stack.pop()
        if closed:
            closed(e, stack[-1])

    for m in TOKEN.finditer(page):
        if m.group("text") is not None:
            if not muted:
                text.append(m.group("text"))
            continue
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif muted:
                if tag == muted[0] and tag not in VOID:
                    muted[1] += -1 if m.group("end") else 1
                    muted = muted if muted[1] else None
            elif not m.group("end") and tag not in VOID:
                names = m.group("attrs")
                if names and ("class" in (low := names.lower()) or "role" in low) and element(Element(0, "", False, True), tag, names).chrome:
                    muted = [tag, 1, 0]  # the text around it stays one block
            continue
        if muted:
            if not m.group("end"):
                muted[2] += tag not in VOID
                continue
            if muted[2]:
                muted[2] -= 1
                continue
            if all(e.tag != tag for e in stack[1:]):
                continue
            muted = None  # what it was in ends
        if text:
            yield stack, "".join(text)
            text = []
        if m.group("end"):
            if any(e.tag == tag for e in stack[1:]):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if any(e.tag == "p" for e in stack[1:]) and not any(e.tag in ("td", "th", "li") for e in stack[[e.tag for e in stack].index("p") :]):
            while stack[-1].tag != "p":  # a block ends an open paragraph
                pop()
            pop()
        if tag == stack[-1].tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
            pop()
        e = element(stack[-1], tag, m.group("attrs"))
        if tag not in VOID:
            stack.append(e)
    if text:
        yield stack, "".join(text)
    while len(stack) > 1:
        pop()


def clean(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def site(url: Column) -> Column:
    """The lower-case host of a URL; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def tree_counts(pages: DataFrame) -> DataFrame:
    """(host, id, parent, kind, mark, pages) from (host, html): how many pages have a node, a node with a child
    sequence, a node with a text. Counted for each batch, to be summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for host, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen: set = set()

                def closed(e: Element, parent: Element, seen=seen) -> None:
                    seen.add((e.id, parent.id, "n", 0))
                    style = [x for i, x in enumerate(e.children) if i == 0 or x != e.children[i - 1]]
                    seen.add((e.id, parent.id, "s", child_id(1, "\n".join(style))))

                for stack, raw in blocks(page or "", closed):
                    if text := clean(raw):
                        seen.add((stack[-1].id, stack[-2].id if len(stack) > 1 else 0, "t", child_id(2, text)))
                counts.update((host, *x) for x in seen)
            rows = [(*k, n) for k, n in counts.items()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "id", "parent", "kind", "mark", "pages"])

    return pages.mapInArrow(run, "host string, id long, parent long, kind string, mark long, pages long")


def noisy_nodes(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, id) of the nodes whose composite importance is below ``threshold``."""
    counts = tree_counts(pages).groupBy("host", "id", "parent", "kind", "mark").agg(F.sum("pages").alias("n"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0)).alias
    n = F.col("n")
    nodes = counts.groupBy("host", "id", "parent").agg(of("n", n)("m"), of("s", F.lit(1))("styles"), of("s", n)("shown"), of("s", n * F.log(n))("shown_log"), of("t", F.lit(1))("texts"), of("t", F.log(n))("text_log"))

    def importance(t: pa.Table) -> pa.Table:
        rows = {r["id"]: SimpleNamespace(**r) for r in t.to_pylist()}
        below: dict[int, list[int]] = {}
        for r in rows.values():
            below.setdefault(r.parent, []).append(r.id)
        value: dict[int, float] = {}
        todo = [(i, False) for i in rows if rows[i].parent not in rows]
        while todo:
            i, ready = todo.pop()
            r, kids = rows[i], [k for k in below.get(i, []) if k != i]
            if not ready:
                todo += [(i, True), *((k, False) for k in kids)]
                continue
            base = math.log(r.m) if r.m > 1 else 0
            parts = [value[k] for k in kids if k in value]
            if r.texts:
                parts.append(1 - r.text_log / r.texts / base if base else 1.0)
            shape = min(1.0, (math.log(r.shown) - r.shown_log / r.shown) / base) if base and r.shown else 1.0
            fade = DECAY ** max(1, r.styles)
            value[i] = (1 - fade) * shape + fade * sum(parts) / len(parts) if parts else 1.0
        bad = [i for i, v in value.items() if v < threshold and rows[i].m >= least_pages]
        return pa.table({"host": pa.array([t["host"][0].as_py()] * len(bad), pa.string()), "id": pa.array(bad, pa.int64())})

    return nodes.groupBy("host").applyInArrow(importance, "host string, id long")


def extract(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text", threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with ``out``, the main text of the whole page: its blocks joined by \\n, empty if there is none.

    White space inside a block becomes one space, character references are decoded. A null page is empty; pages
    without a host in their URL are cut by tags, roles and classes only; repeated rows stay, very long pages are read
    whole, an empty table gives an empty result. A column named like ``out`` is replaced, others stay.
    """
    small_batches(pages.sparkSession, 500)
    given = pages.drop(out)
    host_, noisy_ = fresh(given, "_host"), fresh(given, "_noisy")
    rows = given.withColumn(host_, site(F.col(url)))
    noisy = noisy_nodes(rows.where(F.col(host_) != "").select(host_, page), threshold, least_pages).groupBy("host").agg(F.collect_list("id").alias(noisy_))
    noisy = written(noisy.withColumnRenamed("host", host_), "noisy")
    n_nodes = noisy.agg(F.sum(F.size(noisy_) + 1)).first()[0]
    if n_nodes is None:
        joined = rows.withColumn(noisy_, F.lit(None).cast("array<long>"))
    else:
        joined = rows.join(F.broadcast(noisy) if n_nodes <= SMALL_ROWS else noisy, host_, "left").select(*rows.columns, noisy_)
    names = given.columns
    at, last = joined.columns.index(page), len(joined.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x, cut in zip(b.column(at).to_pylist(), b.column(last).to_pylist(), strict=True):
                gone = set(cut or ())
                found = []
                for stack, raw in blocks(x or ""):
                    judged = (e.id for e in stack if e.doubtful or not stack[-1].article)
                    if not stack[-1].chrome and gone.isdisjoint(judged) and (text := clean(raw)):
                        found.append(text)
                texts.append("\n".join(found))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i, c in enumerate(b.schema.names) if c in names), pa.array(texts, pa.string())], [*names, out])

    return joined.mapInArrow(run, given.withColumn(out, F.lit("")).schema)
