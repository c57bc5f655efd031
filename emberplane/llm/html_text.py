"""Main text of HTML pages by a tree-structured graphical model.

The nodes are a page's block elements; each has a hidden state, content or not. Parent and child
are tied by a potential (one for parents that only frame a page, one for others), and each node's
features (tag, class and id names, length of its own text, share of it in links) give it evidence.
Evidence of text that stands beside other text in one parent is shared out among these, as such
neighbours are no independent witnesses. Sum-product messages, first from the leaves to the root,
then back, yield every node's exact marginal; the text blocks of nodes above one half are the result.

Potentials and evidence are counted on labelled pages. A page labels itself if it marks its
article (`article`, `main`, role main): what lies in there is content, apart from elements whose tag
or whole class name says something else (BOILERPLATE); elements that have such a word as a part
of a name (`related-work`, `share-buttons`) are left uncounted, and the model decides. The same list
is a prior: NAMED for a tag or whole name, HINT for a part of a name. Pages without a mark are judged
by what was learned. At most `fit_pages` pages (in expectation, by a hash of the id) are counted.

Scripts, styles, form fields, drawings, comments and markup never are text; character references are
decoded, white space within a block becomes one space, blocks are joined by a line feed in page
order. A null page is empty and gives an empty text. Rows that share an id are each extracted; a very
long page takes memory in proportion in one task; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Elements that make a block, elements without content, elements whose content is no text.
BLOCKS = frozenset(
    "html body head main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th "
    "thead tbody tfoot caption blockquote pre figure figcaption form fieldset address details summary dialog menu center hr title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg textarea select button".split())
#: Of these, those that hold code, and those of which one does not lie in another.
CODE, SINGLE = frozenset("script style".split()), frozenset("button select textarea iframe".split())
# Tags and class words of what is not the article.
BOILERPLATE = frozenset(
    "nav aside footer header form head title menu dialog ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disclaimer disqus footer header login masthead menu nav navbar navigation newsletter notice "
    "pagination popup promo related respond search share sharing sidebar signup social sponsor sponsored subscribe widget".split()
)
FRAME = frozenset(["#root", "html", "body", "main", "article"])
#: Elements that group others and say nothing by their tag.
PLAIN = frozenset("div section #root".split())
#: Prior log odds against content, and pairs of parent and child without and with content not to be seen.
NAMED, HINT, PRIOR = 9.0, 2.5, 1e6
CLOSES_P = BLOCKS - {"title"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("html body article section div ul ol dl table form main td th".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|[^<]+|<", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
ROW = ["name", "n0", "n1"]


def raw_end(source: str, at: int, name: str) -> int:
    """Where an element whose content is no text ends, from the end of its start tag on.

    Scripts and styles end at their end tag or with the page. Others, too, if it comes before the end of the block
    that they lie in and before another start tag of their kind; else they were not closed, and end at the next block."""
    if name in CODE:
        stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
        return stop.end() if stop else len(source)
    inner: list[str] = []
    block, here = None, at
    while here < len(source):
        m = TOKEN.match(source, here)
        tag = (m[2] or "").lower()
        if tag == name:
            if m[1]:
                return m.end()
            if name in SINGLE:
                break
        elif tag in CODE and not m[1]:
            here = raw_end(source, m.end(), tag)
            continue
        elif tag in BLOCKS:
            block = here if block is None else block
            if not m[1]:
                inner += [tag] * (tag not in VOID)
            elif tag in inner:
                del inner[len(inner) - 1 - inner[::-1].index(tag) :]
            else:
                break
        here = m.end()
    return block if block is not None else here if here < len(source) else len(source)


class Page:
    """Block nodes (parent, tag, names in class, id and role) and text blocks (node, text, characters in links)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words, self.blocks = [-1], ["#root"], [()], []
        stack, text, links, link = [0], [], 0, 0

        def flush():
            nonlocal links
            if text:
                whole = " ".join(html.unescape("".join(text)).split())
                if whole:
                    self.blocks.append((stack[-1], whole, min(links, len(whole))))
                text.clear()
                links = 0

        def close(names, stop=frozenset()):
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in names:
                    del stack[k:]
                    return
                if self.tag[stack[k]] in stop:
                    return

        at, end = 0, len(source)
        while at < end:
            m = TOKEN.match(source, at)
            at = m.end()
            name = m[2]
            if name is None:
                piece = m[0]
                if piece[0] != "<" or piece == "<":
                    text.append(piece)
                    links += len(piece) * (link > 0)
                continue
            name = name.lower()
            if name in RAW:
                if not m[1] and not m[3].endswith("/"):
                    at = raw_end(source, at, name)
                    text.append(" ")
                continue
            if name == "xmp" and not m[1]:
                stop = re.compile(r"</xmp\b[^>]*>", re.I).search(source, at)
                flush()
                text.append(html.escape(source[at : stop.start() if stop else end], quote=False))
                flush()
                at = stop.end() if stop else end
                continue
            if name == "a":
                link = 0 if m[1] else 1
            elif name == "br":
                text.append("\n")
            if name not in BLOCKS:
                continue
            flush()
            if m[1]:
                close({name})
                continue
            if name in CLOSES_P:
                close({"p"}, SCOPE)
            if name in SAME:
                close(SAME[name], SCOPE - SAME[name])
            if name == "body":
                close({"head"})
            found = NAMES.findall(m[3]) if m[3] else ()
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.words.append(tuple(dict.fromkeys(w for f in found for w in "".join(f).lower().split())))
            if name not in VOID:
                stack.append(len(self.tag) - 1)
        flush()

    def features(self) -> list[tuple[list[str], list[str]]]:
        """Per node: features of its tag and names, and features of its own text."""
        size, linked = [0] * len(self.tag), [0] * len(self.tag)
        for node, text, links in self.blocks:
            size[node] += len(text)
            linked[node] += links
        out = []
        for k, (tag, words) in enumerate(zip(self.tag, self.words, strict=True)):
            named = [] if tag in PLAIN else ["t " + tag]
            for w in words if tag not in FRAME else ():
                parts = WORDS.findall(w)
                named += ["w " + w, *("p " + x for x in parts if len(parts) > 1)]
            out.append((named, [f"s {min(size[k].bit_length(), 10)}", f"l {4 * linked[k] // size[k]}"] if size[k] else []))
        return out

    def labels(self) -> list[int] | None:
        """1 for content nodes, -1 for those in doubt, if the page marks its article."""
        out = [0] * len(self.tag)
        marked = False
        for k in range(1, len(out)):
            tag, words = self.tag[k], self.words[k]
            if tag in ("article", "main") or "main" in words:
                out[k] = marked = 1
            elif out[self.parent[k]] == 1 and (tag in BOILERPLATE or not BOILERPLATE.isdisjoint(words)):
                out[k] = 0
            elif out[self.parent[k]] == 1 and any(x in BOILERPLATE for w in words for x in WORDS.findall(w)):
                out[k] = -1
            else:
                out[k] = out[self.parent[k]]
        return out if marked else None


class Tree:
    """Learned potentials. counts: feature to its number of nodes by state; tied: per state of parent and child."""

    def __init__(self, counts: dict[str, tuple[float, float]], tied: np.ndarray):
        n0, n1 = (float(n) + 1.0 for n in tied.sum(0))
        odds = {name: log((c1 + 1 + 0.002 * n1) / n1) - log((c0 + 1 + 0.002 * n0) / n0) for name, (c0, c1) in counts.items()}
        # What was never seen in either state says nothing, apart from the prior.
        self.odds = odds | {f"{kind} {x}": min(odds.get(f"{kind} {x}", 0.0), 0.0) - weight for kind, weight in (("t", NAMED), ("w", NAMED), ("p", HINT)) for x in BOILERPLATE}
        tied = tied + 1.0
        tied[0, 0] += PRIOR  # nothing within an element that isn't content is
        self.tie = np.log(tied / tied.sum(1, keepdims=True))

    def evidence(self, page: Page) -> list[float]:
        """Log odds of content of each node by its own features."""
        found, beside = page.features(), [0] * len(page.tag)
        for k, (_, text) in enumerate(found):
            beside[page.parent[k]] += bool(text) and k > 0
        get = self.odds.get
        out = []
        for k, (named, text) in enumerate(found):
            share = beside[page.parent[k]] if text and k else 1
            # A tag that only holds text (p, li) is as little a witness of its own as that text.
            plain = sum(get(x, 0.0) for x in named if x[0] == "t")
            out.append(sum(get(x, 0.0) for x in named if x[0] != "t") + (plain if page.tag[k] in BOILERPLATE else plain / share) + sum(get(x, 0.0) for x in text) / share)
        return out

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of each node; nodes come after their parents."""
        n, parent = len(page.tag), page.parent
        ties = self.tie.tolist()
        up0, up1 = [0.0] * n, self.evidence(page)
        to0, to1 = [0.0] * n, [0.0] * n
        over = [2 * (page.tag[p] in FRAME) for p in parent]
        for k in range(n - 1, 0, -1):
            (t00, t01), (t10, t11) = ties[over[k]], ties[over[k] + 1]
            to0[k], to1[k] = add(t00 + up0[k], t01 + up1[k]), add(t10 + up0[k], t11 + up1[k])
            up0[parent[k]] += to0[k]
            up1[parent[k]] += to1[k]
        up1[0] -= 50.0  # the root itself is no content
        out = [0.0] * n
        for k in range(1, n):
            # what the parent believes without this child
            (t00, t01), (t10, t11) = ties[over[k]], ties[over[k] + 1]
            p0, p1 = up0[parent[k]] - to0[k], up1[parent[k]] - to1[k]
            up0[k], up1[k] = up0[k] + add(p0 + t00, p1 + t10), up1[k] + add(p0 + t01, p1 + t11)
            shift = max(up0[k], up1[k])
            up0[k], up1[k] = up0[k] - shift, up1[k] - shift
            out[k] = 1 / (1 + np.exp(min(up0[k] - up1[k], 700.0)))
        return out


def add(a: float, b: float) -> float:
    """log(exp a + exp b)"""
    high, low = (a, b) if a > b else (b, a)
    return high + log(1 + np.exp(low - high)) if high - low < 40 else high


def fit(pages: DataFrame, fit_pages: int) -> Tree:
    def count(batches):
        total: dict[str, list[int]] = {}
        for batch in batches:
            for source in batch.column(0).to_pylist():
                page = Page(source or "")
                labels = page.labels()
                if labels is None:
                    continue
                for k, (named, text) in enumerate(page.features()):
                    if labels[k] < 0:
                        continue
                    above = page.parent[k]
                    tie = [f"tie {2 * (page.tag[above] in FRAME) + labels[above]}"] if k and labels[above] >= 0 else []
                    for name in (*named, *text, *tie):
                        total.setdefault(name, [0, 0])[labels[k]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(total), pa.array([float(x) for x, _ in total.values()]), pa.array([float(x) for _, x in total.values()])], ROW) if total else pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.float64())], ROW)

    rows = max(1, pages.count())
    some = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < min(1_000_000, 1 + 1_000_000 * fit_pages // rows))
    got = some.select("html").mapInArrow(count, "name string, n0 double, n1 double").groupBy("name").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()
    counts = {r.name: (r.n0, r.n1) for r in got}
    return Tree({k: v for k, v in counts.items() if not k.startswith("tie ")}, np.array([counts.get(f"tie {k}", (0.0, 0.0)) for k in range(4)]))


def main_text(pages: DataFrame, fit_pages: int = 4000) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text, n_chars."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    tree = pages.sparkSession.sparkContext.broadcast(fit(pages, fit_pages))

    def extract(batches):
        for batch in batches:
            for part in slices(batch, 2):
                texts = []
                for source in part.column(2).to_pylist():
                    page = Page(source or "")
                    keep = tree.value.marginals(page)
                    texts.append("\n".join(text for node, text, _ in page.blocks if keep[node] > 0.5))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
