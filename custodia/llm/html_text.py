"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into blocks of text at block-level tags. The field labels each block as main text or not, from the tags,
classes and ids above it, and from its length, links and punctuation; a transition weight for each pair of neighbouring
labels makes runs of blocks agree. It is trained on labelled pages by the gradient of the exact log likelihood, and pages
are decoded by Viterbi. Pages are independent rows, so nothing is shuffled.

Defined results. Null and empty pages, and pages without main text, give the empty text. Unclosed tags, comments and
quotes end with the page. Drawings (svg) are no text, formulas (math) are inline text; both are empty if their tag ends in
"/". Very long and deeply nested pages are worked on whole, in time linear in their length. Repeated rows are extracted one by one. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.llm.labelled_pages import labelled_pages

# Fixed values of HTML: tags that begin or end a block, tags without content, tags whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LANDMARKS = frozenset("article main nav header footer aside form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF_TAGS = HEADINGS | frozenset("p pre li dt dd blockquote".split())
RAW_TAGS = frozenset("script style title textarea template svg iframe object noembed noframes xmp".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']*+(?:"[^"]*"|'[^']*')?+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S
)
NAMES = re.compile(r"""\b(class|id|role|keep|drop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile(r"[a-z]+")
UNQUOTED = re.compile(r"""=\s*[^\s"'=]+\Z""")
STEPS = 250
PENALTY = 0.02


@dataclass(eq=False)
class Element:
    """An open element with its parent, what it adds to the features of the blocks under it, and what they inherit."""

    tag: str
    names: tuple[str, ...] = ()
    parent: Element | None = None
    features: tuple[str, ...] = ()
    #: Innermost block tag and the one above it, innermost landmark, and elements with names below that landmark.
    own: str = ""
    outer: str = ""
    landmark: str = ""
    inner: int = 0
    mark: bool | None = None


@dataclass
class Block:
    """Text of a leaf block with the element it stands in and the one that holds its paragraph."""

    text: str
    place: Element
    holder: Element
    linked: int

    @property
    def mark(self) -> bool | None:
        return self.place.mark

    @property
    def names(self) -> tuple[str, ...]:
        """Classes, ids and roles of all elements above, outermost first."""
        return tuple(n for e in reversed(above(self.place)) for n in e.names)


def above(element: Element) -> list[Element]:
    """The element and all above it, innermost first."""
    out = [element]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


class _Page:
    """State of the cutter: open elements and the block being read. All steps take constant time, at any depth."""

    def __init__(self, marks: bool):
        self.marks = marks
        self.open: list[Element] = [Element("")]
        self.places: dict[str, list[int]] = {}  # where in ``open`` each tag stands
        self.block_places: list[int] = [0]
        self.names: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            at = self.block_places[-1]
            holder = self.open[at].parent if self.open[at].tag in LEAF_TAGS else self.open[at]
            self.blocks.append(Block(text, self.open[-1], holder, self.linked))
        self.parts, self.linked = [], 0

    def add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if any(e.tag == "a" for e in self.open[-3:]):
            self.linked += len(text)

    def push(self, tag: str, names: tuple[str, ...], mark: bool | None) -> None:
        parent, block = self.open[-1], tag in BLOCK_TAGS
        fresh = [f"name_{w}" for w in dict.fromkeys(names) if not self.names.get(w)]
        if block and not self.places.get(tag):
            fresh.append(f"in_{tag}")
        for w in names:
            self.names[w] = self.names.get(w, 0) + 1
        self.places.setdefault(tag, []).append(len(self.open))
        if block:
            self.block_places.append(len(self.open))
        lands = tag in LANDMARKS
        self.open.append(
            Element(
                tag,
                names,
                parent,
                tuple(fresh),
                tag if block else parent.own,
                parent.own if block else parent.outer,
                tag if lands else parent.landmark,
                0 if lands else parent.inner + bool(names),
                parent.mark if mark is None else mark,
            )
        )

    def pop(self) -> None:
        gone = self.open.pop()
        self.places[gone.tag].pop()
        if gone.tag in BLOCK_TAGS:
            self.block_places.pop()
        for w in gone.names:
            self.names[w] -= 1

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            while len(self.open) > 1 and (self.open[-1].tag not in BLOCK_TAGS or self.open[-1].tag == "p"):
                self.pop()  # inline elements and paragraphs end where a block begins
            if self.open[-1].tag in CLOSES_ITSELF.get(tag, ()):
                self.pop()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        names, mark = (), None
        if attributes:
            found = NAMES.findall(attributes)
            names = tuple(w for key, value in found if key in ("class", "id", "role") for w in WORD.findall(value.lower()))
            if self.marks:
                mark = next((key == "keep" for key, _ in found if key in ("keep", "drop")), None)
        self.push(tag, names, mark)

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        at = self.places.get(tag)
        if not at or (tag not in BLOCK_TAGS and at[-1] < self.block_places[-1]):
            return  # a stray end; an inline one doesn't reach beyond its block
        stop = at[-1]
        while len(self.open) > stop:
            self.pop()


def empty(attributes: str) -> bool:
    """Whether a tag closes itself; a slash at the end of an unquoted value belongs to the value."""
    return attributes.endswith("/") and not UNQUOTED.search(attributes)


def after_svg(source: str, at: int) -> int:
    """Where the svg element ends whose content begins at ``at``; with too few closing tags, behind the last of them."""
    depth, last = 1, len(source)
    for found in TOKEN.finditer(source, at):
        if (found.group(2) or found.group(5) or "").lower() != "svg":
            continue
        if found.group(1) or found.group(4):
            depth, last = depth - 1, found.end()
            if not depth:
                break
        elif not empty(found.group(3) or found.group(6) or ""):
            depth += 1
    return last


def cut(page: str | None, marks: bool = False) -> list[Block]:
    """Blocks of a page, in page order. ``marks`` reads the marks of labelled pages."""
    state, at, source = _Page(marks), 0, page or ""
    while True:
        found = TOKEN.search(source, at)
        if not found:
            break
        if found.start() > at:
            state.add(source[at : found.start()])
        at = found.end()
        tag = (found.group(2) or found.group(5) or "").lower()
        if not tag:
            continue
        attributes = found.group(3) or found.group(6) or ""
        if found.group(1) or found.group(4):
            state.end(tag)
        elif tag in ("svg", "math") and empty(attributes):
            continue
        elif tag == "svg":
            at = after_svg(source, at)
        elif tag in RAW_TAGS:
            close = re.compile(rf"</{re.escape(tag)}(?![\w-])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else len(source)
        else:
            state.start(tag, attributes)
    if at < len(source):
        state.add(source[at:])
    state.flush()
    return state.blocks


def text_features(block: Block, place: int, total: int) -> list[str]:
    text = block.text
    n, words = len(text), text.count(" ") + 1
    return [
        "bias",
        f"words{min(int(math.log2(words)), 7)}",
        f"links{min(int(4 * block.linked / max(n, 1)), 4)}",
        f"ends{text[-1] in '.!?…'}",
        f"stops{min(sum(text.count(c) for c in '.,;'), 3)}",
        f"sign{'©' in text or '|' in text or '·' in text}",
        f"first{place == 0}",
        f"last{place == total - 1}",
    ]


def place_features(place: Element) -> list[str]:
    """What a block's place says beyond the tags and names above it, which its elements hold."""
    return [f"own_{place.own}", f"pair_{place.outer}_{place.own}", f"landmark_{place.landmark}", f"inner{min(place.inner, 2)}_{place.landmark}"]


def page_features(blocks: list[Block]) -> list[list[str]]:
    """How a block stands to its page: whether the page has an article, whether that holds its paragraphs itself or in
    elements with names, and the share of the block's holder in the text, measured by the holder with most of it."""
    held: dict[Element, int] = {}
    direct = named = 0
    for b in blocks:
        held[b.holder] = held.get(b.holder, 0) + len(b.text) - b.linked
        if b.place.landmark in ("article", "main") and b.place.own not in HEADINGS:
            direct, named = direct + len(b.text) * (not b.place.inner), named + len(b.text) * bool(b.place.inner)
    most, flow = max(held.values(), default=0), 3 * direct // (direct + named) if direct + named else "none"
    out = []
    for b in blocks:
        at = f"{min(b.place.inner, 1)}_{b.place.landmark}"
        share = 3 * held[b.holder] // most if most > 0 else 0
        out.append([f"flow{flow}_{at}", f"share{share}_{at}", f"flow{flow}_share{share}_{at}"])
    return out


def local_features(blocks: list[Block]) -> list[list[str]]:
    """All features of each block but those that the elements above it hold."""
    return [text_features(b, i, len(blocks)) + place_features(b.place) + page for i, (b, page) in enumerate(zip(blocks, page_features(blocks)))]


class Field:
    """Weights of the field: for each feature and label, and for each pair of labels."""

    def __init__(self, weights: dict[str, tuple[float, float]], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def points(self, blocks: list[Block]) -> np.ndarray:
        out, known = np.zeros((len(blocks), 2)), {}
        for i, (b, local) in enumerate(zip(blocks, local_features(blocks))):
            chain, at = [], b.place
            while at is not None and at not in known:
                chain.append(at)
                at = at.parent
            for element in reversed(chain):  # each element is summed once
                own, outer = self._sum(element.features), known.get(element.parent, (0.0, 0.0))
                known[element] = own[0] + outer[0], own[1] + outer[1]
            own, outer = self._sum(local), known[b.place]
            out[i] = own[0] + outer[0], own[1] + outer[1]
        return out

    def _sum(self, features: list[str]) -> tuple[float, float]:
        found = [self.weights[f] for f in features if f in self.weights]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi labels; ties fall to 'not main text'."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.pairs.tolist()
        rows, back = self.points(blocks).tolist(), []
        zero, one = rows[0]
        for x, y in rows[1:]:
            back.append((int(one + ba > zero + aa), int(one + bb > zero + ab)))
            zero, one = max(zero + aa, one + ba) + x, max(zero + ab, one + bb) + y
        labels = [int(one > zero)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = cut(page)
        return "\n\n".join(b.text for b, keep in zip(blocks, self.decode(blocks)) if keep)


def likelihood(points: np.ndarray, pairs: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of a page's labels, and its gradients by block points and by pairs (forward and backward sums)."""
    n = len(points)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = points[0]
    for i in range(1, n):
        ahead[i] = points[i] + np.logaddexp(ahead[i - 1, 0] + pairs[0], ahead[i - 1, 1] + pairs[1])
    for i in range(n - 2, -1, -1):
        after = points[i + 1] + behind[i + 1]
        behind[i] = np.logaddexp(pairs[:, 0] + after[0], pairs[:, 1] + after[1])
    total = np.logaddexp(*ahead[-1])
    by_points = -np.exp(ahead + behind - total)
    by_points[np.arange(n), labels] += 1
    by_pairs, score = np.zeros((2, 2)), points[np.arange(n), labels].sum()
    for i in range(1, n):
        by_pairs -= np.exp(ahead[i - 1][:, None] + pairs + points[i] + behind[i] - total)
        by_pairs[labels[i - 1], labels[i]] += 1
        score += pairs[labels[i - 1], labels[i]]
    return float(score - total), by_points, by_pairs


def trained(pages: list[str], steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Field fitted to labelled pages by adaptive gradient steps on the penalised log likelihood."""
    index: dict[str, int] = {}
    data = []
    for page in pages:
        blocks = cut(page, marks=True)
        rows = [
            [index.setdefault(f, len(index)) for f in [*local, *[f for e in above(b.place) for f in e.features]]]
            for b, local in zip(blocks, local_features(blocks))
        ]
        if rows:
            data.append((rows, np.array([int(bool(b.mark)) for b in blocks])))
    weights, pairs = np.zeros((len(index), 2)), np.zeros((2, 2))
    seen_w, seen_p = np.full_like(weights, 1e-6), np.full_like(pairs, 1e-6)
    flat = [(np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), y) for rows, y in data]
    for _ in range(steps):
        by_w, by_p = -penalty * weights * len(flat), -penalty * pairs * len(flat)
        for features, owner, y in flat:
            points = np.zeros((len(y), 2))
            np.add.at(points, owner, weights[features])
            _, g, gp = likelihood(points, pairs, y)
            np.add.at(by_w, features, g[owner])
            by_p += gp
        seen_w, seen_p = seen_w + by_w**2, seen_p + by_p**2
        weights, pairs = weights + 0.5 * by_w / np.sqrt(seen_w), pairs + 0.5 * by_p / np.sqrt(seen_p)
    return Field({f: tuple(weights[i].tolist()) for f, i in index.items()}, pairs)


@lru_cache(maxsize=1)
def default_field() -> Field:
    """Field fitted to the labelled pages of this package, once in a process."""
    return trained(labelled_pages())


def extracted(pages: DataFrame, html_column: str = "html", fitted: Field | None = None) -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars``; columns with these names are replaced."""
    model = fitted or default_field()
    others = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    kept = pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html_column}`"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([model.main_text(page) for page in batch.column(len(others)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(others))], made], names=[*others, "text"])

    return kept.mapInArrow(work, schema).withColumn("n_chars", F.length("text").cast("bigint"))
