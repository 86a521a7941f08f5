"""Main text of web pages as a maximum-scoring subsequence.

A page is read into a sequence of tokens: stretches of text and tags. A word scores
the log odds of being main text, a sum of weights over what is around it and how its
block looks: the elements that enclose it and the words of their class, id and role
(names of elements that hold half of the page's unlinked words or more count apart, one by one and as
one, as articles have any name), whether an article or main element holds that much and it lies beside
it, the block's length, share of linked words, sentence end, depth and place in the page,
the same of its neighbours, and the words per tag around. A tag costs a constant. All
weights come from labelled pages by logistic regression; no single feature decides. One
linear scan finds the contiguous region of the largest sum. Inside it, stretches of
negative score (an advert, a form or a notice within the article) are left out, and the
rest is cut into blocks.

Null pages and pages without text give an empty text; broken or missing end tags and
unclosed quotes or comments are tolerated; character references are decoded once;
nothing is cut off. The time is linear in the length of a page, however broken it is.
Rows that repeat an id are rows of their own; an empty table gives an empty result; only
the id, the html and the columns of ``keep`` are read, so that others can have any name.
Of regions with equal sums the first one is taken.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._common import map_batches

# The element names of the HTML standard by role.
SILENT = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "title")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
CLOSED_BY_BLOCK = ("p", "li", "dt", "dd", "option", "tr", "td", "th")
CLOSES_P = ("div", "ul", "ol", "table", "section", "article", "aside", "nav", "header", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "main", "dl", "fieldset", "hr", "address", "details", "dialog", "menu")

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PIECE = re.compile(r"[a-z]+")
SENTENCE = re.compile(r"[.!?…。:;][\"'”’»)\]]*$")
#: The most and the least a word can score in the scan: an advert within an article must not cut it in two.
MOST, LEAST = 3.0, -0.4


def features(name: str, attributes: str) -> tuple[str, ...]:
    """An element's name, unless it only marks words, and the words of its class, id and role; whether it is hidden."""
    found = [] if name in INLINE else [f"<{name}>"]
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "itemprop"):
            found += PIECE.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        elif key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
            found.append("(hidden)")
    return tuple(dict.fromkeys(found))


def marks(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("open" or "close", name, attributes) in page order; comments and silent elements are left out."""
    at, n, missing = 0, len(page), set()

    def find(what: str, begin: int) -> int:
        """As ``str.find``; what was not found once is not looked for again."""
        if what in missing:
            return -1
        i = page.find(what, begin)
        if i < 0:
            missing.add(what)
        return i

    def end_of(name: str, begin: int) -> int:
        """Where the end tag of a silent element stands."""
        if name in missing:
            return -1
        m = re.compile(f"</{name}(?![a-zA-Z0-9:-])", re.I).search(page, begin)
        if not m:
            missing.add(name)
        return m.start() if m else -1

    while at < n:
        begin = find("<", at)
        if begin < 0:
            yield "text", "", page[at:]
            return
        if begin > at:
            yield "text", "", page[at:begin]
        follows = page[begin + 1 : begin + 2]
        closing = follows == "/"
        m = NAME.match(page, begin + 1 + closing)
        if not m:
            if page.startswith("<!--", begin):
                end = find("-->", begin + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", begin):
                end = find("]]>", begin)
                at = n if end < 0 else end + 3
            elif follows in ("!", "?", "/"):
                end = find(">", begin)
                at = n if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = begin + 1
            continue
        # the tag ends at the first > outside of quotes; a quote that is never closed is none
        i = m.end()
        while True:
            stop = STOP.search(page, i)
            if not stop:
                end = -1
                break
            end = stop.start()
            if stop[0] == ">":
                break
            close = find(stop[0], end + 1) if page[max(i, end - 20) : end].rstrip()[-1:] == "=" else -1
            i = (close if close >= 0 else end) + 1
        if end < 0:
            return  # an unfinished tag at the end is no text
        name, attributes, at = m[0].lower(), page[m.end() : end], end + 1
        if name in SILENT:
            if not closing and not attributes.rstrip().endswith("/"):
                close = end_of(name, at)
                if close >= 0:
                    stop = find(">", close)
                    at = n if stop < 0 else stop + 1
            continue
        yield "close" if closing else "open", name, attributes


class Run:
    """A stretch of text: its words, its elements and their features, its block, whether it is linked, the innermost large element."""

    __slots__ = ("text", "words", "elements", "around", "block", "linked", "region")

    def __init__(self, text: str, elements: tuple[int, ...], block: int, linked: bool) -> None:
        self.text, self.elements, self.around, self.block, self.linked = text, elements, (), block, linked
        self.words, self.region = len(text.split()), -1


def tokens(page: str) -> list[Run | str]:
    """Runs of text and names of tags, in page order."""
    stack: list[tuple[str, int]] = []  # name and number of the open elements
    known: list[tuple[str, ...]] = []  # features by number
    out: list[Run | str] = []
    open_, linked, block = (), False, 0
    for kind, name, what in marks(page):
        if kind == "text":
            out.append(Run(what, open_, block, linked))
            continue
        block += name not in INLINE
        out.append(name)
        if name in VOID:
            continue
        if kind == "close":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
        else:
            if name in CLOSED_BY_BLOCK or name in CLOSES_P:
                # a new block ends an open paragraph, and a list item or cell ends its open sibling
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] == name and name in CLOSED_BY_BLOCK:
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            within = name in ("header", "section") and any(tag in ("article", "main") for tag, _ in stack)
            stack.append((name, len(known)))
            known.append(features(name + "-of-main" if within else name, what))
            if len(stack) > 500:  # no page is nested like this: the end tags are missing
                del stack[100:400]
        open_, linked = tuple(e for _, e in stack), any(n == "a" for n, _ in stack[-4:])
    words: Counter[int] = Counter()
    runs = [t for t in out if isinstance(t, Run) and t.words]
    for t in runs:
        words.update(dict.fromkeys(t.elements, t.words * (not t.linked)))
    large = max(1, sum(t.words for t in runs if not t.linked) / 2)
    holders = {e for e, n in words.items() if n >= large and not {"<article>", "<main>"}.isdisjoint(known[e])}
    seen: dict[tuple[int, ...], tuple[str, ...]] = {}
    for t in runs:
        if t.elements not in seen:
            beside = ["(beside)"] if holders and holders.isdisjoint(t.elements) else []
            seen[t.elements] = tuple(dict.fromkeys([x for e in t.elements for f in known[e] for x in ((f"{f}+", "(large)") if f[0] not in "<(" and words[e] >= large else (f,))] + beside))
        t.around = seen[t.elements]
        t.region = max((e for e in t.elements if words[e] >= large), default=-1)
    return out


def look(seen: list[Run | str]) -> dict[int, np.ndarray]:
    """What each block looks like, and its neighbours in the same large element: numbers of the order of 1."""
    words, linked, last, depth, first, region = Counter(), Counter(), {}, {}, {}, {}
    total = 0
    for t in seen:
        if isinstance(t, Run) and t.words:
            words[t.block] += t.words
            linked[t.block] += t.words * t.linked
            last[t.block], depth[t.block], region[t.block] = t.text, len(t.elements), t.region
            first.setdefault(t.block, total)
            total += t.words
    blocks = sorted(words)
    n = len(blocks)
    if not n:
        return {}
    w = np.array([words[b] for b in blocks], float)
    size = np.log1p(w)
    link = np.array([linked[b] / words[b] for b in blocks])
    ends = np.array([bool(SENTENCE.search(last[b].rstrip()[-8:])) for b in blocks], float)
    deep = np.log1p([depth[b] for b in blocks])
    place = np.array([first[b] for b in blocks]) / total
    tags = np.diff(np.array([0, *blocks]))
    near = lambda x, k: np.convolve(x, np.ones(2 * k + 1), "full")[k:-k]
    dense = np.log1p(near(w, 2) / np.maximum(near(tags.astype(float), 2), 1))
    within = np.array([region[b] for b in blocks])

    def other(x: np.ndarray, k: int) -> np.ndarray:
        """``x`` of the block ``k`` places on; 0 where that is not in the same large element."""
        out = np.zeros(n)
        here, there = slice(max(0, -k), n - max(0, k)), slice(max(0, k), n - max(0, -k))
        out[here] = np.where(within[here] == within[there], x[there], 0.0)
        return out

    before, after = (lambda x: other(x, -1)), (lambda x: other(x, 1))
    around = range(-min(3, n - 1), min(3, n - 1) + 1)
    mean = sum(other(link * w, k) for k in around) / sum(other(w, k) for k in around)
    rows = np.stack([np.ones(n), size, np.minimum(size, 1.8), link, ends, ends * size, deep, place < 0.05, place > 0.95, before(size), after(size), before(link), after(link), dense, mean, (n == 1) * np.ones(n)], axis=1)
    return dict(zip(blocks, rows, strict=True))


class Weights:
    """Weights of what encloses a word, of a block's look, and the score of a tag."""

    def __init__(self, word: dict[str, float], shape: np.ndarray, tag: float) -> None:
        self.word, self.shape, self.tag = word, shape, tag

    def to_json(self) -> str:
        """The weights to four digits, one name a line."""
        word = ",\n".join(f"  {json.dumps(f)}: {round(v, 4)}" for f, v in sorted(self.word.items()))
        return f'{{"tag": {round(self.tag, 4)},\n "shape": {json.dumps([round(float(v), 4) for v in self.shape])},\n "word": {{\n{word}\n}}}}\n'

    @classmethod
    def read(cls, path: str | Path) -> Weights:
        """Weights that :meth:`to_json` wrote."""
        saved = json.loads(Path(path).read_text(encoding="utf-8"))
        return cls(saved["word"], np.array(saved["shape"]), saved["tag"])

    def score(self, around: tuple[str, ...], shape: float) -> float:
        """Log odds that a word is main text."""
        return shape + sum(self.word.get(f, 0.0) for f in around)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 15) -> np.ndarray:
    """Logistic regression by Newton steps, with a penalty on the squares of the weights."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-2:
            break
    return beta


def learn(labelled: list[tuple[str, set[str]]], least: int = 5, ridge: float = 0.05) -> Weights:
    """Weights from (page, main blocks). Names that fewer than ``least`` pages have are left out.

    The score of a tag is the log of words per tag of all text against that of main text,
    a quarter of it, between 0.1 and 0.5.
    """
    around, shape, main, pages, tags, words = [], [], [], Counter(), [0, 0], [0, 0]
    for page, blocks in labelled:
        seen = tokens(page)
        rows = look(seen)
        whole: dict[int, list[str]] = {}
        for t in seen:
            if isinstance(t, Run):
                whole.setdefault(t.block, []).append(t.text)
        label = {b: " ".join(entities.unescape("".join(x)).split()) in blocks for b, x in whole.items()}
        for t in seen:
            if isinstance(t, Run) and t.words:
                around.append(t.around)
                shape.append(rows[t.block])
                main.append(label[t.block])
                words[not label[t.block]] += t.words
                tags[not label[t.block]] += 1
        pages.update({f for t in seen if isinstance(t, Run) for f in t.around})
    names = {f: i for i, f in enumerate(sorted(f for f, n in pages.items() if n >= least))}
    shape = np.array(shape, float)
    x = np.zeros((len(main), len(names) + shape.shape[1]))
    for i, fs in enumerate(around):
        x[i, [names[f] for f in fs if f in names]] = 1
    x[:, len(names) :] = shape
    beta = fit(x, np.array(main, float), np.ones(len(main)), ridge)
    tag = math.log((words[0] + 1) / (tags[0] + 1)) - math.log((sum(words) + 1) / (sum(tags) + 1))
    return Weights({f: float(beta[i]) for f, i in names.items()}, beta[len(names) :], -max(0.1, min(0.5, abs(tag) / 4)))


def extract(page: str | None, weights: Weights) -> str:
    """The text of the best contiguous region, one block a line."""
    if not page:
        return ""
    seen = tokens(page)
    shape = {b: float(row @ weights.shape) for b, row in look(seen).items()}
    scores = [weights.score(t.around, shape.get(t.block, 0.0)) if isinstance(t, Run) else None for t in seen]
    best, run, begin, first, last = 0.0, 0.0, 0, 0, -1
    for i, (t, s) in enumerate(zip(seen, scores, strict=True)):
        if run <= 0:
            run, begin = 0.0, i
        run += weights.tag if s is None else max(LEAST, min(MOST, s)) * t.words
        if run > best:
            best, first, last = run, begin, i
    blocks: dict[int, list[str]] = {}
    block = 0
    for i in range(first, last + 1):
        t = seen[i]
        if isinstance(t, Run):
            block = t.block
            if scores[i] > 0 or not t.words:
                blocks.setdefault(block, []).append(t.text)
        elif t == "br":
            blocks.setdefault(block, []).append(" ")
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame, weights: Weights, id_col: str = "page_id", html_col: str = "html", keep: list[str] = ("url",)) -> DataFrame:
    """(page_id, *keep, text, n_chars) of every page."""
    kinds = dict(pages.dtypes)
    names = [id_col, *keep]

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            texts = [extract(h, weights) for h in batch.column(len(names)).to_pylist()]
            out = {n: batch.column(i) for i, n in enumerate(names)}
            return out | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

        return work

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", text string, n_chars long"
    return map_batches(pages.select(*names, html_col), make, schema)
