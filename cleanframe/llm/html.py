"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of elements and text blocks. Each node is described by its subtree's text
density, link share, depth, place among its siblings and the tokens of its attributes. Nodes of a
bounded sample of pages get labels from unambiguous mark-up (article elements, navigation, class
names of known meaning). Every sample node is used twice, once with tag and attribute features
blanked, so that the trees also learn to decide by shape alone; and every sample page once more
with passages of its own repeated in and around the article under names of other parts, so that
they learn to trust such names there. Spark ML fits the trees.

Decoding is hierarchical: a node can be in only if its parent is in, and a node that is out takes
its whole subtree with it. Of all such choices the most likely one is taken, so an ancestor and a
descendant never contradict each other.

Defined results: a null or empty page, or one without text, gives an empty text. Truncated pages
are read as far as they go. A table without named articles is read by ``plain_trees``. Repeated rows are extracted alike; other columns stay.
"""

from __future__ import annotations

import html as html_names
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.schema import quoted
from cleanframe.session import ship_package, write_table

SAMPLE_PAGES = 400
TREES = 16
DEPTH = 5

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(r"[A-Za-z][a-z]*")

# Fixed values of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSHOWN = {"head", "script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "title", "noembed", "noframes"}
PHRASING = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SAME_CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

# Words in class, id, role and itemprop that name a part of a page.
MAIN_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text"}
OTHER_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "cookie", "cookies", "consent", "discussion",
    "footer", "form", "header", "login", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related",
    "replies", "reply", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
OTHER_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset"}
FEATURES = 26
_BLANKED = slice(0, 10)
# Own and surrounding names and tags of other parts, page header, share of links.
_PLAIN_OUT = (1, 5, 3, 7, 9, 13)


class Page:
    """Nodes of a page in page order, as parallel lists; node 0 is the page."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.text, self.link = ["#page"], [-1], [frozenset()], [""], [0]
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, size = [0], 0, len(source)
        hidden, links, pieces, linked = 0, 0, [], 0
        opened: Counter[str] = Counter()  # tags on the stack, so that a search that finds nothing isn't begun

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(html_names.unescape("".join(pieces)).split())
                if text:
                    self._add("#text", stack[-1], frozenset(), text, min(linked, len(text)))
                pieces.clear()
            linked = 0

        def close(depth: int) -> None:
            nonlocal hidden
            flush()
            for node in stack[depth:]:
                hidden -= self.tag[node] in UNSHOWN
                opened[self.tag[node]] -= 1
            del stack[depth:]

        phrasing: list[str] = []
        while at < size:
            cut = source.find("<", at)
            if cut < 0:
                cut = size
            if cut > at and not hidden:
                pieces.append(source[at:cut])
                linked += (cut - at) if links else 0
            if cut == size:
                break
            m = _TAG.match(source, cut) or _BROKEN.match(source, cut)
            if not m:
                if not hidden:
                    pieces.append("<")
                at = cut + 1
                continue
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                if name in PHRASING:
                    links -= name == "a" and links > 0
                    continue
                if not opened[name]:
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] == name:
                        close(depth)
                        links = 0
                        break
                continue
            if name in PHRASING:
                links += name == "a"
                continue
            if name == "br" or name == "wbr" or name == "img":
                if name == "br" and not hidden:
                    pieces.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name in CLOSES_P and opened["p"] or name in SAME_CLOSES and opened[name]:
                limit = SAME_CLOSES.get(name)
                for depth in range(len(stack) - 1, 0, -1):
                    open_tag = self.tag[stack[depth]]
                    if open_tag == name and limit is not None or open_tag == "p" and name in CLOSES_P:
                        close(depth)
                        links = 0
                        break
                    if limit is not None and open_tag in limit or limit is None and open_tag not in ("p",):
                        break
            flush()
            words = frozenset()
            if m.group(3) and "=" in m.group(3):
                words = frozenset(w.lower() for v in _NAMED.findall(m.group(3)) for w in _TOKEN.findall(v))
            node = self._add(name, stack[-1], words, "", 0)
            if m.group(3).endswith("/") and name in ("svg", "math", "iframe"):
                continue
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(source, at)
                if name == "textarea" and not hidden and end:
                    self._add("#text", node, frozenset(), " ".join(source[at:end.start()].split()), 0)
                at = size if end is None else end.start()
                close_at = source.find(">", at)
                at = size if close_at < 0 else close_at + 1
                continue
            stack.append(node)
            opened[name] += 1
            hidden += name in UNSHOWN
        del phrasing
        close(0)

    def _add(self, tag: str, parent: int, words: frozenset, text: str, link: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.text.append(text)
        self.link.append(link)
        return len(self.tag) - 1

    def features(self) -> np.ndarray:
        """One row of ``FEATURES`` numbers per node; the first ten read tags and attributes."""
        n = len(self.tag)
        parent = np.array(self.parent)
        chars = np.array([len(t) for t in self.text], dtype=float)
        link = np.array(self.link, dtype=float)
        marks = np.array([t.count(".") + t.count(",") for t in self.text], dtype=float)
        words = np.array([t.count(" ") + 1 if t else 0 for t in self.text], dtype=float)
        good = np.array([len(w & MAIN_WORDS) for w in self.words], dtype=float)
        bad = np.array([len(w & OTHER_WORDS) for w in self.words], dtype=float)
        article = np.array([t in ("article", "main") for t in self.tag], dtype=float)
        other = np.array([t in OTHER_TAGS for t in self.tag], dtype=float)
        total = np.stack([chars, link, marks, words, np.ones(n), np.array([t in ("p", "#text") for t in self.tag], dtype=float), np.array([t == "li" for t in self.tag], dtype=float)])
        for k in range(n - 1, 0, -1):
            total[:, parent[k]] += total[:, k]
        before = np.concatenate([[0], np.cumsum(chars)[:-1]])
        depth, over_good, over_bad, over_article, over_other = (np.zeros(n) for _ in range(5))
        place, siblings = np.zeros(n), np.zeros(n)
        for k in range(1, n):
            p = parent[k]
            depth[k] = depth[p] + 1
            over_good[k] = over_good[p] + good[p]
            over_bad[k] = over_bad[p] + bad[p]
            over_article[k] = over_article[p] + article[p]
            over_other[k] = over_other[p] + other[p]
            place[k] = siblings[p]
            siblings[p] += 1
        up = np.maximum(parent, 0)
        whole = max(1.0, total[0, 0])
        size = np.maximum(total[0], 1)
        heading = np.array([t in ("h1", "h2", "h3", "h4", "h5", "h6") for t in self.tag], dtype=float)
        header = np.array([t == "header" for t in self.tag], dtype=float)
        return np.stack([
            good, bad, article, other, np.minimum(over_good, 3), np.minimum(over_bad, 3), np.minimum(over_article, 3), np.minimum(over_other, 3), heading, header,
            np.minimum(depth, 30), np.log1p(total[0]), total[0] / whole, total[1] / size, total[2] / np.maximum(total[3], 1), total[4] / size,
            np.log1p(total[5]), total[6] / total[4], place, place / np.maximum(siblings[up], 1), siblings[up], siblings,
            before / whole, total[3] / np.maximum(total[2], 1), (total[1] / size)[up], total[0] / size[up],
        ], axis=1)

    def labels(self) -> np.ndarray:
        """1 for nodes in or around main text, 0 for others, -1 where mark-up does not say."""
        n = len(self.tag)
        inside, out = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        named_article = any(t in ("article", "main") for t in self.tag)
        for k in range(1, n):
            p = self.parent[k]
            region = self.tag[k] in ("article", "main") or not named_article and len(self.words[k] & MAIN_WORDS) > 0
            out[k] = out[p] or self.tag[k] in OTHER_TAGS or self.tag[k] in UNSHOWN or len(self.words[k] & OTHER_WORDS) > 0 or self.tag[k] == "header" and not inside[p]
            inside[k] = inside[p] or region and not out[k]
        label = (inside & ~out).astype(int)
        if not label.any():
            return np.full(n, -1)
        for k in range(n - 1, 0, -1):
            if label[k]:
                label[self.parent[k]] = 1
        return label

    def main_text(self, chance: np.ndarray) -> str:
        """Text of the most likely consistent choice of nodes."""
        n = len(self.tag)
        chance = np.clip(chance, 1e-4, 1 - 1e-4)
        taken, left = np.log(chance).tolist(), np.log(1 - chance).tolist()
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            taken[p] += max(taken[k], left[k])
            left[p] += left[k]
        kept, blocks = [True] + [False] * (n - 1), []
        for k in range(1, n):
            kept[k] = kept[self.parent[k]] and taken[k] > left[k] and self.tag[k] not in UNSHOWN
            if kept[k] and self.text[k]:
                blocks.append(self.text[k])
        return "\n".join(blocks)


def _varied(source: str) -> str:
    """The page with passages under names of other parts, and its article under another name."""
    start, end = source.find("<article"), source.find("</article>")
    passages = [x for x in re.findall(r"<p>([^<]+)", source) if x.strip()]
    if start < 0 or end < 0 or not passages:
        return source
    turn = sum(map(ord, source[:200])) + len(source)

    def part(k: int) -> str:
        other = [f'<div class="{w}">' for w in sorted(OTHER_WORDS)] + [f"<{t}>" for t in sorted(OTHER_TAGS - {"button", "select"})]
        opening = other[(turn + 13 * k) % len(other)]
        text = passages[(turn + k) % len(passages)]
        return f"{opening}<p>{text}</p></{re.match('<([a-z]+)', opening).group(1)}>"

    body = source[source.find(">", start) + 1:end] + part(1)
    names = sorted(MAIN_WORDS)
    opening, closing = ("<article>", "</article>") if turn % 2 else (f'<div class="{names[turn % len(names)]}">', "</div>")
    return source[:start] + part(2) + opening + body + closing + part(3) + part(4) + source[end + 10:]


class Trees:
    """Fitted boosted trees as arrays."""

    def __init__(self, trees: list[tuple], weights: list[float]):
        self.trees, self.weights = trees, weights

    def chance(self, features: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(features))
        rows = np.arange(len(features))
        for (feature, threshold, low, high, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(features), dtype=np.int64)
            for _ in range(DEPTH):
                at = np.where(features[rows, feature[at]] <= threshold[at], low[at], high[at])
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def _flatten(node) -> tuple:
    """A Spark ML tree as arrays: feature, threshold, children (a leaf is its own), value."""
    rows: list[list] = []

    def walk(x) -> int:
        me = len(rows)
        rows.append([0, 0.0, me, me, float(x.prediction())])
        if "Internal" in x.getClass().getSimpleName():
            split = x.split()
            rows[me][:2] = [int(split.featureIndex()), float(split.threshold())]
            rows[me][2] = walk(x.leftChild())
            rows[me][3] = walk(x.rightChild())
        return me

    walk(node)
    return tuple(np.array(c) for c in zip(*rows))


def plain_trees() -> Trees:
    """Stated defaults for tables whose mark-up names no article, or nothing else.

    A node is in unless it or an element around it is named as another part, it is a page
    header, or more than half of its text is links.
    """
    def leaf(value: float) -> tuple:
        return np.array([0]), np.array([0.0]), np.array([0]), np.array([0]), np.array([value])

    def above_half(feature: int, value: float) -> tuple:
        return np.array([feature, 0, 0]), np.array([0.5, 0, 0]), np.array([1, 1, 2]), np.array([2, 1, 2]), np.array([0, 0, value])

    return Trees([leaf(1.0), *(above_half(k, -4.0) for k in _PLAIN_OUT)], [1.0] * (1 + len(_PLAIN_OUT)))


def fit(pages: DataFrame, html_column: str = "html", sample_pages: int = SAMPLE_PAGES) -> Trees:
    """Trees from about ``sample_pages`` pages, chosen by a hash of the page."""
    ship_package(pages.sparkSession)
    total = max(1, pages.count())
    share = min(1.0, sample_pages / total)
    source = F.coalesce(quoted(html_column).cast("string"), F.lit(""))
    picked = pages.select(source.alias("html")).where(F.pmod(F.xxhash64("html"), F.lit(1_000_003)) < int(1_000_003 * share) + 1)
    # Each page once: all copies of a page are picked together, and may be a third of all rows.
    picked = picked.groupBy(F.xxhash64("html").alias("key")).agg(F.min("html").alias("html")).select("html")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks = [np.empty((0, FEATURES))], [np.empty(0)]
            for source in batch.column(0).to_pylist():
                for page, blanked in ((Page(source), True), (Page(_varied(source)), False)):
                    label = page.labels()
                    known = label >= 0
                    own = page.features()[known]
                    rows.append(own)
                    marks.append(label[known])
                    if blanked:
                        blank = own.copy()
                        blank[:, _BLANKED] = 0
                        rows.append(blank)
                        marks.append(label[known])
            flat = np.concatenate(rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * FEATURES), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(np.concatenate(marks).astype(float))], ["x", "label"])

    sample = write_table(picked.mapInArrow(nodes, "x array<double>, label double"), "nodes")
    kinds = {r[0] for r in sample.select("label").distinct().collect()}
    if len(kinds) < 2:
        return plain_trees()
    trained = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(sample.select(array_to_vector("x").alias("features"), "label"))
    return Trees([_flatten(t._call_java("rootNode")) for t in trained.trees], list(trained.treeWeights))


def extracted(pages: DataFrame, trees: Trees, html_column: str = "html", into: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each page."""
    ship_package(pages.sparkSession)
    place = pages.columns.index(html_column)
    schema = T.StructType([*pages.schema.fields, T.StructField(into, T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            for at in range(0, batch.num_rows, 100):
                read = [Page(source or "") for source in batch.column(place).slice(at, 100).to_pylist()]
                features = [page.features() for page in read]
                chance = trees.chance(np.concatenate(features))
                ends = np.cumsum([len(f) for f in features])
                out += [page.main_text(chance[e - len(f):e]) for page, f, e in zip(read, features, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, into])

    return pages.mapInArrow(apply, schema)
