"""Main text of web pages by a linear-chain conditional random field.

A page is cut into its leaf blocks: runs of text between tags that start or end
a block. Each block has features of its ancestors (tags, words of class and id)
and of its text; the chain over the page's blocks decides jointly which belong
to the article. The field is trained on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternrank.llm.shared import over_slices

# Elements that start and end a block, that hold no text of the
# page, that have no end, and that an opening tag of the same kind closes.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option p pre "
    "section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
SILENT = set("script style noscript template title textarea iframe svg math object canvas select head".split())
RAW = ("script", "style", "textarea", "title", "iframe")
VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
# Parts of class names and ids that tell what a region is for.
STEMS = tuple(
    "ad advert article banner body breadcrumb byline comment consent content cookie disqus entry foot form header "
    "legal login main masthead menu meta nav newsletter notice pagination popup post promo rail related reply respon search "
    "share side signup social sponsor story subscribe tag text thread toolbar widget".split()
)


@dataclass
class Block:
    text: str
    features: list[str]


class _Open:
    """An open element and the features of it and all around it."""

    __slots__ = ("tag", "features", "silent", "link", "block")

    def __init__(self, tag: str, features: frozenset, silent: bool, link: bool, block: int):
        self.tag, self.features, self.silent, self.link = tag, features, silent, link
        self.block = block  # place of the innermost open element that makes blocks


def _names(rest: str) -> set[str]:
    found = set()
    for value in NAMES.findall(rest):
        for word in WORD.findall("".join(value).lower()):
            found.add(f"name:{word}")
            found.update(f"stem:{s}" for s in STEMS if (word == s if len(s) < 4 else s in word))
    return found


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page that have text, in order."""
    out: list[tuple[str, frozenset, int, str]] = []
    stack = [_Open("", frozenset(), False, False, 0)]
    open_tags = Counter()
    parts: list[str] = []
    linked = 0
    page = page or ""

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, stack[-1].features, linked, stack[stack[-1].block].tag))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].silent:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack[-1].link:
                linked += len(text)

    def close(k: int) -> None:
        if stack[-1].block >= k:
            flush()
        open_tags.subtract(e.tag for e in stack[k:])
        del stack[k:]

    at = 0
    for_end = {}
    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        if m["end"] or m["end2"]:
            if open_tags[tag]:
                # All that is passed over on the way goes as well.
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif tag in BLOCK:
                flush()
            continue
        rest = m["rest"] if m["tag"] else m["rest2"]
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            shut = CLOSES.get(tag, set()) | {"p"}
            if stack[k := stack[-1].block].tag in shut:
                close(k)
            if tag == "body" and open_tags["head"]:  # a head without an end
                close(next(k for k, e in enumerate(stack) if e.tag == "head"))
            flush()
        if tag in VOID or (rest.endswith("/") and tag not in BLOCK):
            continue
        above = stack[-1]
        own = {f"in:{tag}"} if tag in BLOCK else set()
        if "=" in rest and tag in BLOCK | {"span", "a"}:
            own |= _names(rest)
        features = above.features | own if own - above.features else above.features
        block = len(stack) if tag in BLOCK else above.block
        stack.append(_Open(tag, features, above.silent or tag in SILENT, above.link or tag == "a", block))
        open_tags[tag] += 1
        if tag in RAW:
            end = for_end.get(tag) or for_end.setdefault(tag, re.compile(rf"</{tag}\b", re.I))
            found = end.search(page, at)
            at = found.start() if found else len(page)
    add(page[at:])
    flush()
    return [Block(text, _features(text, around, links, leaf)) for text, around, links, leaf in out]


def _features(text: str, around: frozenset, links: int, leaf: str) -> list[str]:
    n = len(text)
    words = text.count(" ") + 1
    stops = sum(text.count(c) for c in ".!?")
    return [
        *around,
        "bias",
        f"leaf:{leaf}",
        f"words:{min(6, int(math.log2(words)))}",
        f"links:{min(4, 4 * links // max(n, 1))}",
        f"stops:{min(3, stops)}",
        "ends" if text[-1] in ".!?\"'”»…" else "open",
        f"marks:{min(2, text.count('|') + text.count('·') + text.count('»') + text.count('©'))}",
    ]


class Field:
    """Weights of features for 'article', of the first label and of label pairs."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, moves: np.ndarray):
        self.weights, self.start, self.moves = weights, start, moves

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most probable labels of a page's blocks, by Viterbi."""
        if not blocks:
            return []
        get = self.weights.get
        scores = [sum(get(f, 0.0) for f in b.features) for b in blocks]
        (m00, m01), (m10, m11) = self.moves.tolist()
        no, yes = float(self.start[0]), float(self.start[1]) + scores[0]
        back = []
        for s in scores[1:]:
            back.append((m10 + yes > m00 + no, m11 + yes >= m01 + no))
            no, yes = max(m00 + no, m10 + yes), s + max(m01 + no, m11 + yes)
        labels = [yes >= no]
        for was in reversed(back):
            labels.append(was[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 80, decay: float = 0.02, rate: float = 0.1) -> Field:
    """Weights that maximise the conditional likelihood of the labels, with an L2
    penalty: forward-backward over every page, Adam over the gradient."""
    pages = [(b, y) for b, y in pages if b]
    names = sorted({f for blocks, _ in pages for b in blocks for f in b.features})
    place = {f: k for k, f in enumerate(names)}
    n = len(names)
    rows = [[np.array([place[f] for f in b.features]) for b in blocks] for blocks, _ in pages]
    w, first, second = np.zeros(n + 6), np.zeros(n + 6), np.zeros(n + 6)
    for step in range(1, rounds + 1):
        grad = np.zeros(n + 6)
        start, moves = w[n : n + 2], w[n + 2 :].reshape(2, 2)
        g_start, g_moves = grad[n : n + 2], grad[n + 2 :].reshape(2, 2)
        for ids, (_, labels) in zip(rows, pages, strict=True):
            node = np.zeros((len(ids), 2))
            node[:, 1] = [w[k].sum() for k in ids]
            alpha, beta = np.zeros_like(node), np.zeros_like(node)
            alpha[0] = start + node[0]
            for t in range(1, len(ids)):
                alpha[t] = node[t] + np.logaddexp(alpha[t - 1, 0] + moves[0], alpha[t - 1, 1] + moves[1])
            for t in range(len(ids) - 2, -1, -1):
                ahead = node[t + 1] + beta[t + 1]
                beta[t] = np.logaddexp(moves[:, 0] + ahead[0], moves[:, 1] + ahead[1])
            total = np.logaddexp(*alpha[-1])
            seen = np.array(labels, int)
            p = np.exp(alpha + beta - total)
            for k, q, y in zip(ids, p[:, 1], seen, strict=True):
                grad[k] += y - q
            g_start += np.eye(2)[seen[0]] - p[0]
            for t in range(1, len(ids)):
                pair = np.exp(alpha[t - 1][:, None] + moves + (node[t] + beta[t])[None] - total)
                g_moves[seen[t - 1], seen[t]] += 1
                g_moves -= pair
        grad -= decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(dict(zip(names, w[:n].tolist(), strict=True)), w[n : n + 2], w[n + 2 :].reshape(2, 2))


def extract(page: str | None, field: Field) -> str:
    """The article's blocks in page order, one line each."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)


def main_text(
    pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id, url, text, n_chars`` of every row, from its whole html.

    NULL or empty html, and pages without an article, give an empty text.
    Repeated rows and NULL ids stay; other columns are left out.
    """
    kept = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"))
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h, shared.value) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [id_col, url_col, "text", "n_chars"],
        )

    kinds = [kept.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return over_slices(kept, "_html", work, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
