"""Main-text extraction by a tree-structured graphical model over the elements of a page.

Every element that lays out a block (or an inline one with attributes of its own) is a node with a hidden label, content or not.
Features of the node give its own potential, and every parent and child share a potential that depends on both labels.
Sum-product messages, first upward and then downward, give each node's marginal; text whose nearest node is more likely content
than not is kept.  The weights are fitted on labelled pages (``html_pages``) by gradient ascent on the exact likelihood, whose
expectations come from the same messages.  Pages of a batch form one forest, and messages run depth by depth in numpy.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.langid import slices
from corpusloom.llm.workspace import fresh

#: A tag: quoted values end with their quote, which one with "<" inside must have white space, a slash or the tag's end behind.
_TAG_TOKEN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"(?:[^\"<]*\"|[^\"]*\"(?=[\s/>]))|'(?:[^'<]*'|[^']*'(?=[\s/>])))*+)>", re.S)
#: A broken tag: it ends at the next angle bracket, whatever quotes are open.
_BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*+)(?:>|(?=<)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v\x85\xa0  -     　]+")
_SHOWN = re.compile(r"[^ \t\n\r\f]")

#: Fixed by the HTML standard: elements without content, with raw text, and laid out within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph, and which open elements an opening tag ends (up to the given borders).
ENDS_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
#: Elements that may stand in a head; any other ends an open one.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements of which nothing is ever shown as text.
SILENT = frozenset("head script style textarea title noscript iframe noembed noframes template select button option svg math canvas object audio video datalist xmp".split())

#: Words of class, id and role attributes, by what they tell about an element.
HINTS = {
    "ad": "ad ads adv advert advertisement adbox adslot banner sponsor sponsored promo promotion outbrain taboola dfp doubleclick",
    "menu": "nav navbar navigation menu menubar topnav subnav breadcrumb breadcrumbs pagination pager toc tabs skip sitemap",
    "head": "header masthead topbar logo branding site",
    "foot": "footer bottom copyright colophon contentinfo legal credits imprint",
    "side": "sidebar side aside rail widget widgets complementary column secondary related recommended recommendations popular trending more archive tags categories",
    "notice": "cookie cookies consent gdpr notice modal popup overlay alert dialog newsletter subscribe subscription signup login paywall disclaimer toast",
    "share": "share sharing social follow buttons toolbar tools print rating likes",
    "talk": "comment comments commentlist disqus discussion reply replies respond reader readers feedback review reviews",
    "form": "form search searchbox field input contact",
    "meta": "meta byline author date time published info caption credit",
    "main": "article content main post entry story body text page prose",
}
_HINT = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
_TAGS = "p div section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody caption form fieldset blockquote pre figure figcaption address details summary body html span a label small hr menu dialog search center".split()
_TAG = {t: k for k, t in enumerate(_TAGS)}
_N_TAG, _N_HINT = len(_TAGS) + 1, len(HINTS)
N_FEATURES = 1 + _N_TAG + 2 * _N_HINT + 13


@dataclass
class Page:
    """Elements of one page in document order, and what they say."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    hints: list[set] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    #: (node, text, whether in a link), and (None, "", False) where a block begins or ends.
    run: list[tuple] = field(default_factory=list)


def parse(source: str | None) -> Page:
    """A page's tree, whatever tags are missing or left open.

    A tag with an open quote or without an end, and a comment without one, end at the next angle bracket, so that the text behind them is kept.
    """
    page = Page()
    parent, tags, hints, hidden, run = page.parent, page.tag, page.hints, page.hidden, page.run
    parent.append(-1)
    tags.append("html")
    hints.append(set())
    hidden.append(False)
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, each with the node that its text belongs to
    link = silent = 0
    at, text = 0, source or ""
    without: set[str] = set()  # ends of comments that don't come any more
    border = (None, "", False)

    def say(raw: str) -> None:
        if stack[-1][0] == "head" and _SHOWN.search(raw):  # text ends a head
            pop_to(len(stack) - 1)
        if raw and not silent and (_SHOWN.search(raw) or run and run[-1][0] is not None):  # white space counts within a block only
            run.append((stack[-1][1], entities.unescape(raw) if "&" in raw else raw, link > 0))

    def pop_to(depth: int) -> None:
        nonlocal link, silent
        while len(stack) > depth:
            name, _ = stack.pop()
            link -= name == "a"
            silent -= name in SILENT
            if name not in INLINE:
                run.append(border)

    while at < len(text):
        begin = text.find("<", at)
        if begin < 0:
            say(text[at:])
            break
        say(text[at:begin])
        if text[begin + 1 : begin + 2] in ("!", "?"):
            if text.startswith("<!--", begin):
                closing, opened = "-->", begin + 4
            elif text.startswith("<![CDATA[", begin):
                closing, opened = "]]>", begin + 9
            else:
                closing, opened = ">", begin
            stop = -1 if closing in without else text.find(closing, opened)
            if stop < 0:
                without.add(closing)
                closing, stop = ">", text.find(">", begin)
            at = len(text) if stop < 0 else stop + len(closing)
            continue
        m = _TAG_TOKEN.match(text, begin) or _BROKEN_TAG.match(text, begin)
        if not m:
            if text[begin + 1 : begin + 2] == "/" and begin + 2 < len(text):  # a bogus comment
                stop = text.find(">", begin)
                at = len(text) if stop < 0 else stop + 1
            else:
                say("<")
                at = begin + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            else:
                if name == "p":
                    run.append(border)
            continue
        if name in ("html", "head", "body") and len(stack) > 1 and any(x == name for x, _ in stack):
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            pop_to(len(stack) - 1)
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in ("p",):
                    break
        if name in ENDS:
            closed, limits = ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in limits:
                    break
                if stack[k][0] in closed:
                    pop_to(k)
                    if name in ("li", "option", "dt", "dd", "td", "th"):
                        break
        if name == "br":
            say(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                run.append(border)
            continue
        attributes = m[3].strip()
        inline = name in INLINE
        if not inline:
            run.append(border)
        node = stack[-1][1]
        given: set = set()
        away = False
        if attributes and name != "a":
            for key, x, y, z in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), (x or y or z).lower()
                if key in ("class", "id", "role", "itemprop", "aria-label"):
                    given |= {_HINT[w] for w in _WORD.findall(value) if w in _HINT}
                elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or key == "aria-hidden" and value == "true":
                    away = True
        if not inline or given or away:
            parent.append(node)
            tags.append(name)
            hints.append(given)
            hidden.append(away)
            node = len(parent) - 1
        if m[3].endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(text, at)
            raw_end = stop.start() if stop else len(text)
            at = raw_end
            if stop:
                close = text.find(">", raw_end)
                at = len(text) if close < 0 else close + 1
            run.append(border)
            continue
        stack.append((name, node))
        link += name == "a"
        silent += name in SILENT
    return page


def _node_features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(parents, nodes x features) of a page."""
    n = len(page.parent)
    x = np.zeros((n, N_FEATURES), dtype=np.float32)
    own, linked, marks = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text, in_link in page.run:
        if node is not None:
            size = len(text)
            own[node] += size
            if in_link:
                linked[node] += size
            else:
                marks[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
    whole, whole_linked = own.copy(), linked.copy()
    parent = np.array(page.parent)
    for k in range(n - 1, 0, -1):
        whole[parent[k]] += whole[k]
        whole_linked[parent[k]] += whole_linked[k]
    x[:, 0] = 1
    above: list[set] = []
    tagged_above: list[set] = []
    for k in range(n):
        x[k, 1 + _TAG.get(page.tag[k], _N_TAG - 1)] = 1
        up = above[parent[k]] if k else set()
        above.append(up | page.hints[k])
        up_tags = tagged_above[parent[k]] if k else set()
        tagged_above.append(up_tags | {page.tag[k]} if page.tag[k] in ("article", "main", "nav", "aside", "footer", "header", "form") else up_tags)
        for h in page.hints[k]:
            x[k, 1 + _N_TAG + h] = 1
        for h in up:
            x[k, 1 + _N_TAG + _N_HINT + h] = 1
    base = 1 + _N_TAG + 2 * _N_HINT
    share = whole_linked / np.maximum(whole, 1)
    x[:, base] = share
    x[:, base + 1] = share > 0.6
    x[:, base + 2] = np.minimum(1, np.log1p(own) / 7)
    x[:, base + 3] = own - linked > 80
    x[:, base + 4] = np.minimum(1, marks / 5)
    x[:, base + 5] = np.minimum(1, np.log1p(whole) / 9)
    x[:, base + 6] = whole == 0
    for j, tag in enumerate(("article", "main")):
        x[:, base + 7 + j] = [tag in t for t in tagged_above]
    x[:, base + 9] = [bool(t & {"nav", "aside", "footer", "form"}) for t in tagged_above]
    x[:, base + 10] = page.hidden
    x[:, base + 11] = ["header" in t for t in tagged_above]
    x[:, base + 12] = (own > linked) & np.array([t in ("html", "body") for t in page.tag])
    return parent, x


@dataclass
class TreeField:
    weights: np.ndarray  # features, for content
    pair: np.ndarray  # 2 x 2 log-potentials, [parent's label, child's label]


def marginals(parent: np.ndarray, scores: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of content of each node of a forest, and the expected counts of (parent, child) labels.  Parents come before children."""
    n = len(parent)
    depth = np.zeros(n, dtype=np.int64)
    frontier, level = np.flatnonzero(parent < 0), 0
    order = np.argsort(parent, kind="stable")
    ranked = parent[order]
    levels = []
    while len(frontier):
        depth[frontier] = level
        levels.append(frontier)
        lo, hi = np.searchsorted(ranked, frontier, "left"), np.searchsorted(ranked, frontier, "right")
        count = hi - lo
        total = int(count.sum())
        frontier = order[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)] if total else np.zeros(0, dtype=np.int64)
        level += 1
    belief = np.stack([np.zeros(n), scores.astype(np.float64)], axis=1)
    message = np.zeros((n, 2))
    for nodes in levels[:0:-1]:  # upward
        b = belief[nodes]
        message[nodes] = np.logaddexp(pair[:, 0] + b[:, :1], pair[:, 1] + b[:, 1:])
        np.add.at(belief, parent[nodes], message[nodes])
    expected = np.zeros((2, 2))
    for nodes in levels:  # downward
        if level and parent[nodes[0]] >= 0:
            up = belief[parent[nodes]] - message[nodes]
            joint = up[:, :, None] + pair[None] + belief[nodes][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            p = np.exp(joint)
            p /= p.sum(axis=(1, 2), keepdims=True)
            expected += p.sum(axis=0)
            belief[nodes] += np.logaddexp(up[:, :1] + pair[0], up[:, 1:] + pair[1])
        belief[nodes] -= np.logaddexp(belief[nodes, :1], belief[nodes, 1:])
    return np.exp(belief[:, 1]), expected


def fit(pages: list[tuple[Page, list[int]]], steps: int = 200, rate: float = 0.15, ridge: float = 1e-4) -> TreeField:
    """From pages and a 0/1 label of each of their nodes."""
    parents, xs, labels, base = [], [], [], 0
    for page, y in pages:
        parent, x = _node_features(page)
        parents.append(np.where(parent < 0, -1, parent + base))
        xs.append(x)
        labels.append(y)
        base += len(y)
    parent, x, y = np.concatenate(parents), np.concatenate(xs), np.concatenate(labels).astype(np.float64)
    child = parent >= 0
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[parent[child]].astype(int), y[child].astype(int)), 1)
    theta = np.zeros(N_FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        chance, expected = marginals(parent, x @ theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
        gradient = np.concatenate([x.T @ (y - chance), (observed - expected).ravel()]) / len(y) - ridge * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return TreeField(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def spoken(page: Page, chance: np.ndarray) -> str:
    """The text of content nodes, a line for each block."""
    out: list[str] = []
    held: list[str] = []
    keep = chance >= 0.5
    for node, text, _ in page.run:
        if node is None:
            if held:
                line = _SPACE.sub(" ", "".join(held)).strip(" ")
                if line:
                    out.append(line)
                held = []
        elif keep[node]:
            held.append(text)
    line = _SPACE.sub(" ", "".join(held)).strip(" ")
    return "\n".join([*out, line] if line else out)


def extract_texts(sources: list, model: TreeField) -> list[str]:
    pages = [parse(s) for s in sources]
    parents, xs, base = [], [], 0
    for page in pages:
        parent, x = _node_features(page)
        parents.append(np.where(parent < 0, -1, parent + base))
        xs.append(x)
        base += len(parent)
    if not pages:
        return []
    chance, _ = marginals(np.concatenate(parents), np.concatenate(xs) @ model.weights, model.pair)
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parents])])
    return [spoken(page, chance[a:b]) for page, a, b in zip(pages, edges[:-1], edges[1:])]


@lru_cache(1)
def default_model() -> TreeField:
    """Fitted on the labelled pages that ``html_pages`` writes; the same in every process."""
    from corpusloom.llm.html_pages import labelled_pages

    return fit(labelled_pages())


def extract_main_text(df: DataFrame, html: str = "html", model: TreeField | None = None) -> DataFrame:
    """``df`` with ``text string`` in place of the markup column (an existing ``text`` is replaced).

    A null or empty page gives an empty text.  Character references are decoded, white space inside a block becomes one blank, blocks
    are joined by a newline in page order.  Pages of any length are read whole, in batches of bounded size.  Repeated rows
    give repeated rows, an empty table an empty one; other columns are kept, whatever their names.
    """
    model = model or default_model()
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c.lower() not in (html.lower(), "text")]
    kept = df.select(*[F.col(f"`{c}`") for c in names])
    markup = fresh("markup", names)
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{html}`").cast("string").alias(markup))
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_ = shared.value
        for batch in batches:
            for part, sources in slices(batch, markup):
                texts = extract_texts(sources, field_)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*names, "text"])

    return source.mapInArrow(run, schema)
