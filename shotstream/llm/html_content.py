"""Main text of web pages by a graphical model on the page tree.

A page becomes a tree of block elements and of the pieces of text directly inside them. Every node is
content or not. Node potentials weigh its tag, words in its class, id and role, its length, links and
punctuation; one table of parent-child potentials makes a child likely to be what its parent is. Upward
and downward sum-product messages give the exact marginals; text whose marginal is above one half is
kept. Weights are fitted by stochastic gradient ascent on the likelihood of labelled pages, starting
from and drawn towards prior weights, so that markup absent from the labelled pages still counts.

Labelled pages are pages of the table whose markup says what is content: text inside an article or main
element and outside menus, asides, forms, adverts and comments. About ``PAGES`` of them are used.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.llm.common import batched_texts, map_batches

PAGES = 300
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style", "template", "noscript", "title", "textarea", "select", "option", "svg", "iframe", "object", "canvas", "head", "button")
RAW = ("script", "style", "textarea", "title")  # these alone run to the end of the page without an end tag
# What ends a hidden element whose end tag may be missing: these cannot lie in each other.
ENDS_HIDDEN = {
    "option": re.compile(r"</option(?=[\s/>])[^>]*>|(?=<(?:option|optgroup|/select|/datalist|/optgroup)(?=[\s/>]))", re.IGNORECASE),
    **{tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|(?=<{tag}(?=[\s/>]))", re.IGNORECASE) for tag in ("button", "select")},
}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr"
    " main nav ol p pre section table ul".split()
)
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(\Z))|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)",
    re.DOTALL,
)
NAMES = re.compile(r"""(?:^|[\s/"'])(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
SPACE = re.compile(r"\s+")

# Prior weights: log odds for being content.
TAGS = {
    "article": 3.0, "main": 2.0, "p": 0.5, "h1": 0.3, "h2": 0.2, "h3": 0.2, "blockquote": 0.5, "pre": 0.5,
    "nav": -5.0, "footer": -5.0, "header": -4.0, "aside": -5.0, "form": -5.0, "li": -0.3, "menu": -5.0, "dialog": -5.0,
}
CLASSES = {  # words within longer ones (football, shareholders, correspondent) say nothing
    "advert": (-5.0, r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*)(?:[^a-z]|$)"),
    "menu": (-5.0, r"nav(?:bar|igation|s)?(?![a-z])|menu(?:s|bar|items?)?(?![a-z])|breadcrumb|pagination|pager(?![a-z])|toolbar|skip-?link"),
    "comments": (-5.0, r"comment(?!ar|at)|(?<![a-z])repl(?:y|ies)(?![a-z])|disqus|discussion|(?<![a-z])respond(?![a-z])"),
    "side": (-5.0, r"side-?bar|(?<![a-z])related|recommend|widget|(?<![a-z])shar(?:e|ing)(?:bar|box|buttons?|links?|tools)?(?![a-z])"
        r"|social(?:bar|icons?|links?|media|share)?(?![a-z])|subscribe(?!r)|newsletter|signup|sign-up|login"),
    "foot": (-5.0, r"foot(?:er\w*)?(?![a-z])|copyright|(?:^|\s)legal(?:\s|$)|legal-?(?:info|links|notice|terms|text)|disclaimer"),
    "head": (-3.0, r"(?:site|page|top|global)-?(?:head|header|bar)|masthead|(?:(?<![a-z])|site|brand|page)logos?(?![a-z])"),
    "notice": (-5.0, r"cookie|consent(?![a-z])|notices?(?![a-z])|popup|pop-up|modal(?!i)|gdpr|alert(?:s|bar|box)?(?![a-z])|overlay|paywall"),
    "body": (1.5, r"article|content|(?:^|[^a-z])post(?:[^a-z]|$)|entry|story|main|body"),
}
COMPILED = {name: re.compile(pattern) for name, (_, pattern) in CLASSES.items()}
LEAF = {"leaf": 0.0, "words": 0.3, "links": -2.0, "sentence": 0.4, "mark": -1.0}
PRIOR = {"bias": -0.5, **{f"<{t}>": w for t, w in TAGS.items()}, **{n: w for n, (w, _) in CLASSES.items()}, **LEAF}
FEATURES = {name: i for i, name in enumerate(PRIOR)}
PRIOR_PAIR = ((1.0, -1.5), (-1.5, 1.0))  # [parent][child]
EXCLUDED = ("nav", "footer", "header", "aside", "form", "menu", "dialog")
NEGATIVE = tuple(name for name, (weight, _) in CLASSES.items() if weight < 0)


def _element_features(tag: str, attributes: str) -> tuple[tuple[int, float], ...]:
    found = ["bias"]
    if f"<{tag}>" in FEATURES:
        found.append(f"<{tag}>")
    names = " ".join(m.strip("\"'") for m in NAMES.findall(attributes)).lower()
    if names:
        found += [name for name, pattern in COMPILED.items() if pattern.search(names)]
    return tuple((FEATURES[name], 1.0) for name in found)


def _leaf_features(text: str, linked: int) -> tuple[tuple[int, float], ...]:
    found = [(FEATURES["bias"], 1.0), (FEATURES["leaf"], 1.0), (FEATURES["words"], math.log1p(text.count(" ")))]
    if linked:
        found.append((FEATURES["links"], min(1.0, linked / max(1, len(text)))))
    if text[-1] in ".!?…\"”»":
        found.append((FEATURES["sentence"], 1.0))
    if "©" in text or " | " in text:
        found.append((FEATURES["mark"], 1.0))
    return tuple(found)


class Page:
    """Nodes in document order, parents before children: parent index, features, text (None for elements)."""

    def __init__(self, source: str, remembered: dict):
        self.parent: list[int] = [-1]
        self.features: list[tuple] = [_element_features("#root", "")]
        self.text: list[str | None] = [None]
        self.tag: list[str] = ["#root"]
        self._read(source, remembered)

    def _add(self, parent: int, tag: str, features: tuple, text: str | None) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.tag.append(tag)
        return len(self.parent) - 1

    def _read(self, source: str, remembered: dict) -> None:
        stack = [(0, "#root")]
        parts: list[str] = []
        links, linked, at = 0, 0, 0

        def close_text():
            nonlocal linked
            if parts:
                text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
                if text:
                    self._add(stack[-1][0], "#text", _leaf_features(text, linked), text)
                parts.clear()
            linked = 0

        def say(piece: str):
            nonlocal linked
            if piece:
                parts.append(piece)
                if links:
                    linked += len(piece)

        while True:
            m = TAG.search(source, at)
            say(source[at : m.start()] if m else source[at:])
            if not m:
                break
            at = m.end()
            if m.group(1) is not None:
                say(m.group(1).replace("&", "&amp;"))
                continue
            tag = m.group(3)
            if tag is None:
                continue
            tag, closing = tag.lower(), bool(m.group(2))
            if m.group(5) is not None:  # the page ends inside a tag
                break
            if tag in HIDDEN:
                if not closing and not m.group(4).endswith("/"):
                    pattern = ENDS_HIDDEN.get(tag) or re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE)
                    end = pattern.search(source, at)
                    if end and (end.group() or tag == "option"):  # a second button tells that the first is not closed
                        at = end.end()
                    elif tag in RAW:
                        at = len(source)
                continue
            if tag == "a":
                links = 0 if closing else 1
            if tag in INLINE:
                continue
            close_text()
            if tag in VOID:
                continue
            if closing:
                # Close up to the open element of this name; a stray end tag closes nothing.
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] == tag:
                        del stack[i:]
                        break
                continue
            if tag in ENDS_PARAGRAPH and stack[-1][1] == "p":
                stack.pop()
            for other in (ENDS_SAME.get(tag) or ()):
                if stack[-1][1] == other:
                    stack.pop()
            key = (tag, m.group(4))
            features = remembered.get(key)
            if features is None:
                if len(remembered) > 20_000:
                    remembered.clear()
                features = remembered[key] = _element_features(*key)
            if not m.group(4).endswith("/"):
                stack.append((self._add(stack[-1][0], tag, features, None), tag))
        close_text()

    def labels(self) -> list[int] | None:
        """What the markup says about every node; None when it has no article or main element."""
        out, sure = [0] * len(self.parent), False
        for i in range(1, len(out)):
            tag, names = self.tag[i], {f for f, _ in self.features[i]}
            out[i] = out[self.parent[i]]
            if tag in ("article", "main"):
                out[i], sure = 1, True
            if tag in EXCLUDED or any(FEATURES[n] in names for n in NEGATIVE):
                out[i] = -1
            if out[self.parent[i]] < 0:
                out[i] = -1
        return [max(0, x) for x in out] if sure else None


def _unary(page: Page, weights: list[float]) -> list[float]:
    return [sum(weights[f] * v for f, v in features) for features in page.features]


def marginals(page: Page, weights: list[float], pair) -> tuple[list[float], list[float], list[float]]:
    """Log odds of being content for every node by upward and downward messages; also, per node, the
    belief from below and the belief of its parent without it."""
    (p00, p01), (p10, p11) = [[math.exp(x) for x in row] for row in pair]
    parent, below = page.parent, _unary(page, weights)
    n = len(parent)
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        e = math.exp(max(-50.0, min(50.0, below[i])))
        up[i] = math.log((p10 + p11 * e) / (p00 + p01 * e))
        below[parent[i]] += up[i]
    odds, outside = below[:], [0.0] * n
    for i in range(1, n):
        rest = odds[parent[i]] - up[i]
        outside[i] = rest
        e = math.exp(max(-50.0, min(50.0, rest)))
        odds[i] = below[i] + math.log((p01 + p11 * e) / (p00 + p10 * e))
    return odds, below, outside


def fit(pages: list[str], epochs: int = 6, rate: float = 0.05, pull: float = 0.0002):
    """(weights, pair potentials) from the pages that have labels."""
    weights = list(PRIOR.values())
    pair = [list(row) for row in PRIOR_PAIR]
    remembered: dict = {}
    labelled = [(p, y) for p, y in ((p, p.labels()) for p in (Page(s, remembered) for s in pages)) if y]
    prior = list(PRIOR.values())
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for k in np.random.default_rng(epoch).permutation(len(labelled)):
            page, labels = labelled[k]
            odds, below, outside = marginals(page, weights, pair)
            scale = step / math.sqrt(len(labels))
            for i, (y, o) in enumerate(zip(labels, odds)):
                error = y - sigmoid(o)
                if abs(error) > 1e-4:
                    for f, v in page.features[i]:
                        weights[f] += scale * error * v
            potentials = [[math.exp(x) for x in row] for row in pair]
            for i in range(1, len(labels)):
                a, b = math.exp(max(-50, min(50, outside[i]))), math.exp(max(-50, min(50, below[i])))
                joint = [[potentials[0][0], potentials[0][1] * b], [potentials[1][0] * a, potentials[1][1] * a * b]]
                total = sum(map(sum, joint))
                for x in (0, 1):
                    for y in (0, 1):
                        truth = float(labels[page.parent[i]] == x and labels[i] == y)
                        pair[x][y] += scale * (truth - joint[x][y] / total)
            weights = [w + pull * (p - w) for w, p in zip(weights, prior)]
    return weights, pair


def main_text(source: str, weights, pair, remembered: dict) -> str:
    """Blocks of content in page order, one per line."""
    if not source:
        return ""
    page = Page(source, remembered)
    odds, _, _ = marginals(page, weights, pair)
    return "\n".join(t for t, o in zip(page.text, odds) if t is not None and o > 0)


def _extractor(handle):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pair = handle.value
        remembered: dict = {}
        for batch in batches:
            for part, sources in batched_texts(iter([batch.rename_columns([{"html": "text"}.get(n, n) for n in batch.schema.names])])):
                texts = [main_text(s.decode("utf-8", "replace"), weights, pair, remembered) for s in sources]
                yield pa.record_batch(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return extract


def extract_text(pages: DataFrame, labelled_pages: int = PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    The text holds the blocks of content: character references decoded, white space inside a block one
    space, blocks joined by \\n. Null and empty pages give an empty text, as do pages without content;
    repeated rows are extracted each. Without labelled pages the prior weights serve.
    """
    n = pages.count()
    # Drawn by id and text, each different page once: null or repeated ids are drawn no more often than others.
    drawn = pages.filter(F.pmod(F.xxhash64("page_id", "html"), F.lit(max(1, n))) < labelled_pages)
    drawn = drawn.filter("html IS NOT NULL").select("page_id", "html").distinct()
    sources = [row[0] for row in drawn.orderBy("page_id", "html").select("html").collect()]
    model = pages.sparkSession.sparkContext.broadcast(fit(sources))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return map_batches(
        pages.select("page_id", "url", "html"), _extractor(model),
        f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint",
    )
