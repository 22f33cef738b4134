"""Main text of web pages by gradient-boosted trees over the nodes of the document tree.

A page becomes a tree of block elements and runs of text. Every node has features: its tag and the
tokens of its attributes, its own and its ancestors'; text, link, tag and punctuation density of its
subtree; depth and place; and how it compares with its siblings. What a token of an attribute says is
learnt: from half of the made-up pages comes the log-odds, by the hash of the token and of its
beginnings, that a node that bears it is of the article; unknown tokens say nothing. Trees trained on the
other half give the odds that a node belongs to the article. Decoding is over the whole tree at once: a node that
is out takes all below it out, and of all such choices the likeliest is taken, so no kept node has a
dropped ancestor. All of it is array work over the pages of a batch; only parsing goes node by node, in
time that follows the length of the page, however its tags are nested, left open or quoted.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm import gbt
from marginalia.llm.base import cleared, row_schema, sliced, with_columns
from marginalia.llm.webpages import Page

#: Elements that begin and end blocks, in groups that share a feature. Fixed values.
GROUPS = (
    "#text", "nav", "header", "footer", "aside", "form fieldset legend label", "button select option optgroup", "article", "main", "section search", "div center", "p", "h1", "h2 h3 h4 h5 h6 hgroup",
    "ul ol menu dir dl", "li dt dd", "table thead tbody tfoot caption", "tr td th", "blockquote pre address", "figure figcaption details summary dialog", "html body",
)
_GROUP = {t: k for k, g in enumerate(GROUPS) for t in g.split()}
#: Elements whose text is no text of the page: data, form fields, and what browsers do not show. Fixed values.
_RAW = ("script", "style", "title", "template", "textarea", "iframe", "noframes")
_EDGE = ("hr",)
#: A start tag ends open elements of the first kind, up to one of the second.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"optgroup", "option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_COMMENT_END = re.compile(r"--!?>")
_STOP = re.compile(r"[>\"']")
_LONG_NUMBER = re.compile(r"&#(?:0+(?=\d)|([xX])0+(?=[0-9a-fA-F]))")
_TOO_LONG = re.compile(r"&#(?:\d{8,}|[xX][0-9a-fA-F]{7,});?")
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def unescaped(text: str) -> str:
    """text with its character references decoded; a number beyond the last code point is U+FFFD."""
    if "&#" in text:
        text = _TOO_LONG.sub("\ufffd", _LONG_NUMBER.sub(lambda m: "&#" + (m[1] or ""), text))
    return html.unescape(text)


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name in lower case, whether it ends, attributes) of the tags; comments and the like have no name.

    Quotes hold a > together with its tag; a tag in which that leads nowhere ends at the next >. An opening
    quote from which no end was found is not tried again, so the time follows the length of the source.
    """
    pos, dead = 0, set()
    last_end, last_stop = source.rfind(">"), max(map(source.rfind, ">\"'"))
    while (at := source.find("<", pos)) >= 0:
        pos = at + 1
        after = source[pos : pos + 1]
        if after in ("!", "?"):
            if source.startswith("<!--", at):
                if source.startswith((">", "->"), at + 4):
                    pos = source.index(">", at) + 1
                else:
                    end = _COMMENT_END.search(source, at + 4)
                    pos = end.end() if end else len(source)
            elif (end := source.find(">", pos) if at < last_end else -1) >= 0:
                pos = end + 1
            else:
                continue
            yield at, pos, "", False, ""
            continue
        ending = after == "/"
        if at > last_end or not (name := _NAME.match(source, pos + ending)):
            continue
        p, opened, end = name.end(), [], -1
        while p <= last_stop and (m := _STOP.search(source, p)):
            if m[0] == ">":
                end = m.start()
                break
            opened.append(m.start())
            close = source.find(m[0], m.end()) if m.start() not in dead else -1
            if close < 0:
                break
            p = close + 1
        if end < 0:
            dead.update(opened)
            end = source.find(">", name.end())
            if end < 0:
                continue
        pos = end + 1
        yield at, pos, name[0].lower(), ending, source[name.end() : end]


@dataclass(frozen=True)
class Model:
    """The trees, and the log-odds of the tokens of attributes by the hash of a token or its beginning."""

    trees: gbt.Trees
    tokens: dict[int, float]


def token_keys(names: str) -> list[list[int]]:
    """Of each token of attribute values the hashes of it and of its beginnings of five letters or more, the longest first."""
    out = []
    for token in {t.lower() for t in _PARTS.findall(names)}:
        out.append([zlib.crc32(token[:n].encode()) for n in range(len(token), min(5, len(token)) - 1, -1)])
    return out


def token_odds(names: list[str], table: dict[int, float]) -> np.ndarray:
    """Of each text of attribute values the least and the greatest log-odds of its tokens, 0 where it has none that is known."""
    seen: dict[str, tuple[float, float]] = {"": (0.0, 0.0)}
    for x in names:
        if x not in seen:
            odds = [table[k] for keys in token_keys(x) if (k := next((k for k in keys if k in table), None)) is not None]
            seen[x] = (min(0.0, *odds), max(0.0, *odds)) if odds else (0.0, 0.0)
    return np.array([seen[x] for x in names], np.float32).reshape(-1, 2)


class Nodes:
    """The trees of some pages, one after another: a node's parent comes before it."""

    def __init__(self):
        self.page, self.parent, self.depth, self.group, self.names, self.prev, self.index = ([] for _ in range(7))
        self.chars, self.link, self.words, self.stops, self.digits, self.text = ([] for _ in range(6))

    def __len__(self) -> int:
        return len(self.page)

    def add(self, page: int, source: str) -> None:
        """Parses a page. Tags that do not match are forgiven as browsers do, roughly."""
        stack: list[tuple[str, int]] = []
        open_at: dict[str, list[int]] = defaultdict(list)  # where in the stack each name is
        last: dict[int, tuple[int, int]] = {}
        run: list[str] = []
        linked, link_at, links = 0, 0, 0
        pos, low = 0, None

        def cut(size: int) -> None:
            while len(stack) > size:
                open_at[stack.pop()[0]].pop()

        def place(names: set[str]) -> int:
            return max((open_at[t][-1] for t in names if open_at[t]), default=-1)

        def node(group: int, names: str) -> int:
            parent = stack[-1][1] if stack else -1
            k = len(self.page)
            before, n = last.get(parent, (-1, 0))
            last[parent] = k, n + 1
            self.page.append(page)
            self.parent.append(parent)
            self.depth.append(len(stack))
            self.group.append(group)
            self.names.append(names)
            self.prev.append(before)
            self.index.append(n)
            return k

        def stat(text: str, link: int) -> None:
            self.chars.append(len(text))
            self.link.append(min(link, len(text)))
            self.words.append(text.count(" ") + 1 if text else 0)
            self.stops.append(text.count(".") + text.count("!") + text.count("?") + text.count(","))
            self.digits.append(sum(map(text.count, "0123456789")))
            self.text.append(text)

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join(unescaped("".join(run)).split())
                if text:
                    node(0, "")
                    stat(text, linked)
                run.clear()
            linked = 0

        def say(text: str) -> None:
            nonlocal linked
            run.append(text)
            if links:
                linked += len(text)

        for start, after, tag, ending, attributes in tags(source):
            if start < pos:
                continue  # inside an element whose text does not count
            if start > pos:
                say(source[pos:start])
            pos = after
            if not tag:
                continue
            if tag == "br":
                say(" ")
            elif tag in _EDGE:
                flush()
            elif tag in _RAW or tag == "xmp":
                if not ending and not attributes.endswith("/"):
                    low = low or source.lower()
                    if len(low) != len(source):  # some letters change length; keep places right
                        low = re.sub("[A-Z]", lambda x: x[0].lower(), source)
                    end = low.find(f"</{tag}", pos)
                    if tag == "xmp":
                        say(source[pos : end if end >= 0 else len(source)].replace("&", "&amp;"))
                    close = source.find(">", end) if end >= 0 else -1
                    pos = close + 1 if close >= 0 else len(source)
            elif tag not in _GROUP:
                if tag == "a":
                    links, link_at = (0, 0) if ending else (1, len(stack))
            elif ending:
                if open_at[tag]:
                    flush()
                    cut(open_at[tag][-1])
                    if links and len(stack) < link_at:
                        links = 0
            else:
                flush()
                if tag in ("html", "body") and open_at[tag]:
                    continue
                if stack and stack[-1][0] == "p":
                    cut(len(stack) - 1)
                if stack and tag[0] == "h" and tag[1:].isdigit() and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
                    cut(len(stack) - 1)
                if tag in _ENDS:
                    ends, until = _ENDS[tag]
                    if (k := place(ends)) > place(until):
                        cut(k)
                names = ""
                if "=" in attributes:
                    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
                k = node(_GROUP[tag], names)
                stat("", 0)
                open_at[tag].append(len(stack))
                stack.append((tag, k))
        if pos < len(source):
            say(source[pos:])
        flush()


def _up(values: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Sums over subtrees."""
    out = values.astype(float).copy()
    for at in reversed(levels[1:]):
        np.add.at(out, parent[at], out[at])
    return out


def _levels(depth: np.ndarray, parent: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth; text beside the root is at depth 0 as well."""
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1))
    levels = np.split(order, cuts)
    assert (parent[levels[0]] == -1).all()
    return levels


def features(n: Nodes, table: dict[int, float]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A row of features for each node, the parents, and the nodes by depth."""
    page, parent, depth, group, prev, index = (np.array(x, np.int64) for x in (n.page, n.parent, n.depth, n.group, n.prev, n.index))
    levels = _levels(depth, parent)
    odds = token_odds(n.names, table)
    tags = np.eye(len(GROUPS), dtype=np.float32)[group]
    chars, link, words, stops, digits = (_up(np.array(x), parent, levels) for x in (n.chars, n.link, n.words, n.stops, n.digits))
    leaf = (group == 0).astype(float)
    blocks, elements = _up(leaf, parent, levels), _up(1 - leaf, parent, levels)
    paras = _up((group == _GROUP["p"]).astype(float), parent, levels)
    has = parent >= 0
    up = np.where(has, parent, 0)
    above = np.zeros((len(page), len(GROUPS) + 2), np.float32)
    own = np.hstack([tags, -odds[:, :1], odds[:, 1:]])
    for at in levels[1:]:
        above[at] = np.maximum(above[parent[at]], own[parent[at]])
    pages = page.max(initial=-1) + 1
    whole = np.bincount(page, np.where(has, 0, chars), pages)[page]
    siblings = np.where(has, np.bincount(up[has], minlength=len(page))[up], 1)
    around = np.where(has, chars[up], chars)
    same = np.bincount((up * len(GROUPS) + group)[has], minlength=len(page) * len(GROUPS))[up * len(GROUPS) + group] if len(page) else np.zeros(0)
    follow = np.full(len(page), -1)
    follow[prev[prev >= 0]] = np.flatnonzero(prev >= 0)
    before = lambda x, at: np.where(at >= 0, x[np.maximum(at, 0)], -1.0)
    start = np.cumsum(np.array(n.chars)) - np.array(n.chars)
    first = np.full(pages, np.inf)
    np.minimum.at(first, page, start)
    share = link / np.maximum(chars, 1)
    x = [
        depth, np.log1p(chars), np.log1p(words), share, stops / np.maximum(words, 1), digits / np.maximum(chars, 1), np.log1p(blocks), np.log1p(elements),
        chars / np.maximum(blocks, 1), elements / np.maximum(words, 1), np.log1p(paras), chars / np.maximum(whole, 1), chars / np.maximum(around, 1), siblings, index / np.maximum(siblings, 1), same / np.maximum(siblings, 1),
        around / np.maximum(siblings, 1), before(chars, prev), before(share, prev), before(chars, follow), before(share, follow), (start - first[page]) / np.maximum(whole, 1), np.where(has, share[up], share),
    ]
    return np.column_stack([tags, odds, above, *[c.astype(np.float32) for c in x]]), parent, levels


def decode(logit: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Which nodes are in: the likeliest choice in which whatever is below a node that is out is out."""
    yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    out = _up(no, parent, levels)
    inside = yes.copy()
    for at in reversed(levels[1:]):
        np.add.at(inside, parent[at], np.maximum(inside[at], out[at]))
    keep = inside > out
    for at in levels[1:]:
        keep[at] &= keep[parent[at]]
    return keep


def _known(pages: list[Page]) -> tuple[Nodes, np.ndarray, np.ndarray]:
    """The trees of pages whose articles are known, the characters below each node, and how many of them are the article's."""
    n = Nodes()
    for k, page in enumerate(pages):
        n.add(k, page.html)
    parent, depth = np.array(n.parent), np.array(n.depth)
    levels = _levels(depth, parent)
    good = np.array([float(c) if t and t in pages[p].kept else 0.0 for c, t, p in zip(n.chars, n.text, n.page, strict=True)])
    return n, _up(np.array(n.chars), parent, levels), _up(good, parent, levels)


def learnt_tokens(pages: list[Page], least: int = 5) -> dict[int, float]:
    """Log-odds that a node is of the article, by the hashes of its attributes' tokens; of those seen so often at least."""
    n, chars, good = _known(pages)
    seen, inside = Counter(), Counter()
    for names, c, g in zip(n.names, chars.tolist(), good.tolist(), strict=True):
        if names and c:
            for k in {k for keys in token_keys(names) for k in keys}:
                seen[k] += 1
                inside[k] += g / c
    return {k: float(np.log((inside[k] + 1) / (seen[k] - inside[k] + 1))) for k in seen if seen[k] >= least}


@cache
def model(pages: int = 1500, seed: int = 11) -> Model:
    """Trained on so many made-up pages; deterministic."""
    made = [Page(seed * 1_000_003 + k) for k in range(pages)]
    tokens = learnt_tokens(made[::2])
    n, chars, good = _known(made[1::2])
    x, _, _ = features(n, tokens)
    some = chars > 0
    return Model(gbt.fit(x[some], (2 * good >= chars)[some].astype(float), np.sqrt(1 + np.log1p(chars[some]))), tokens)


def main_texts(pages: list[str], model: Model) -> list[str]:
    """The main text of each page: its kept blocks in order, joined by newlines."""
    n = Nodes()
    for k, source in enumerate(pages):
        n.add(k, source)
    out: list[list[str]] = [[] for _ in pages]
    if len(n):
        x, parent, levels = features(n, model.tokens)
        keep = decode(model.trees.logits(x), parent, levels)
        for k in np.flatnonzero(keep & (np.array(n.group) == 0)).tolist():
            out[n.page[k]].append(n.text[k])
    return ["\n".join(blocks) for blocks in out]


def extract(pages: DataFrame, html_col: str = "html", train_pages: int = 1500) -> DataFrame:
    """pages with text and n_chars (its code points) instead of html.

    The whole html is parsed; null or empty html has the empty text. Character references are decoded,
    white space inside a block is one space, and nothing is cut. What stands in math, svg, object, noscript
    or xmp counts as text; what stands in script, style, title, template, textarea, iframe or noframes does
    not. The trees are trained on the driver, on train_pages made-up pages, and sent to the tasks (some 200
    kB). Other columns stay; columns of the new names give way. Repeated rows are rows each.
    """
    pages, back = cleared(pages, ("text", "n_chars"), (html_col,))
    sent = pages.sparkSession.sparkContext.broadcast(model(train_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, html_col, 1 << 20):
            texts = main_texts([t or "" for t in batch.column(html_col).to_pylist()], sent.value)
            yield with_columns(batch, (html_col,), text=pa.array(texts, pa.string()), n_chars=pa.array(list(map(len, texts)), pa.int64()))

    return back(pages.mapInArrow(run, row_schema(pages.drop(html_col), "text string, n_chars bigint")))
