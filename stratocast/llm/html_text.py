"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is the text between two block-level tags, with its open tags and
their class and id words. Its features are those of its ancestors and of its
text; the field has two labels, text and other, weights for features and for
neighbouring labels, and is decoded by Viterbi. It is trained in numpy on
labelled pages: a bounded sample in which what stands in an article or main
element, outside of menus, asides, forms and comments, is text; and the same
blocks set again in other LAYOUTS, whose labels are known by construction.

Edge cases: null and empty html, and pages without a text block, give an empty
text; unclosed and stray tags are read as browsers do, roughly, in time linear in
the page; repeated rows are read one by one; columns of the input that carry the name of a result column
are replaced by it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm.names import free_name

# Fixed values of HTML: tags without content, raw-text tags, tags inside a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template title textarea iframe svg object canvas select".split())
INLINE = set(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
# Ancestors and class words that are features.
PLACES = set(
    "article main nav header footer aside form ul ol li table figure figcaption section div p h1 h2 h3 h4 h5 h6 blockquote pre "
    "dl dt dd td th button address details summary menu dialog".split()
)
WORDS = set(
    "ad ads advert advertisement article author banner body breadcrumb breadcrumbs byline comment comments content cookie "
    "consent copyright disqus entry footer form header login main menu meta modal nav navbar navigation newsletter notice "
    "pagination pager popup post promo recommended related replies reply respond search share sharing sidebar signup social "
    "sponsor sponsored story subscribe tags text toolbar widget".split()
)
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_STOP = re.compile(r"[>\"']")
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

# Layouts for training: {title} and {text} are text; {more} is other.
LAYOUTS = (
    '<header><h2>{more}</h2></header><div class="content"><h1>{title}</h1>{text}</div><div class="sidebar"><ul>{items}</ul></div><footer>{more}</footer>',
    '<div class="cookie notice">{more}</div><nav><ul>{items}</ul></nav><article><h1>{title}</h1>{text}<section class="comments"><h3>{more}</h3>{others}</section></article><aside>{others}</aside>',
    '<div id="menu"><ul>{items}</ul></div><main><h1>{title}</h1>{text}</main><form class="newsletter"><p>{more}</p><label>{more}</label></form><div id="comments">{others}</div><footer>{more}</footer>',
    '<nav class="breadcrumb">{more}</nav><div class="ad">{more}</div><div class="post"><h1>{title}</h1>{text}<div class="ad">{more}</div>{text2}</div><div class="comment">{others}</div>',
    '<header><nav><ul>{items}</ul></nav></header><article><h1>{title}</h1>{text}<aside class="related">{others}</aside>{text2}<ul>{bullets}</ul></article><footer><p>{more}</p></footer>',
    '<div class="notice">{more}</div><article><h1>{title}</h1>{text}<div class="comments"><h3>{more}</h3>{others}</div></article><footer>{more}</footer>',
    '<div class="banner"><p>{more}</p></div><article><h1>{title}</h1>{text}<div class="comment"><p>{more}</p>{others}</div><form><p>{more}</p></form></article>',
    '<body><h1>{title}</h1>{text}<div class="share social">{more}</div><div class="widget"><h3>{more}</h3><ul>{items}</ul></div><footer>{more}</footer></body>',
)


@dataclass
class Block:
    text: str
    tags: frozenset
    words: frozenset
    tag: str
    link_share: float


class _Open:
    """The open tags of a page, with what blocks ask of them kept up to date: each tag costs a few steps."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.marks: list[frozenset] = []
        self.places: dict[str, list[int]] = {}  # where each name stands in `names`, ascending
        self.inside: set[str] = set()  # the PLACES among them
        self.words: dict[str, int] = {}  # class words, with the number of open tags that carry them
        self.outer: list[str] = []  # the open tags that are not inside a line

    def push(self, name: str, marks: frozenset) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in PLACES:
            self.inside.add(name)
        self.names.append(name)
        self.marks.append(marks)
        for w in marks:
            self.words[w] = self.words.get(w, 0) + 1
        if name not in INLINE:
            self.outer.append(name)

    def has(self, name: str) -> bool:
        return bool(self.places.get(name))

    def pop(self, name: str) -> None:
        """Close the last open tag of this name and all within it."""
        if not self.has(name):
            return
        for _ in range(len(self.names) - self.places[name][-1]):
            last = self.names.pop()
            self.places[last].pop()
            if not self.places[last]:
                self.inside.discard(last)
            for w in self.marks.pop():
                self.words[w] -= 1
                if not self.words[w]:
                    del self.words[w]
            if last not in INLINE:
                self.outer.pop()


class _Tags:
    """The tags of a page, found going forward; no part of it is searched more than a few times."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in ">\"'"}
        self.astray: set[int] = set()  # quotes from which no end of a tag can be reached

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag, with an empty name for comments and declarations."""
        html, size = self.html, len(self.html)
        while True:
            start = html.find("<", at)
            if start < 0 or start + 1 >= size:
                return None
            if html[start + 1] in "!?":
                close = "-->" if html.startswith("<!--", start) else ">"
                stop = html.find(close, start + (4 if close == "-->" else 2))
                return start, size if stop < 0 else stop + len(close), False, "", ""
            name = _NAME.match(html, start + 1) if start < self.last[">"] else None
            if name:
                stop = self._stop(name.end())
                if stop < 0:  # a quote stays open: the tag ends at the next >
                    stop = html.find(">", name.end())
                return start, stop + 1, name[0][0] == "/", name[0].lstrip("/").lower(), html[name.end() : stop]
            at = start + 1

    def _stop(self, at: int) -> int:
        """Where the tag's > stands, outside of quotes, or -1."""
        passed = []
        while True:
            m = _STOP.search(self.html, at)
            if m and m[0] == ">":
                return m.start()
            if not m or m.start() in self.astray or m.start() == self.last[m[0]]:
                self.astray.update(passed)
                return -1
            passed.append(m.start())
            at = self.html.index(m[0], m.end()) + 1


def blocks_of(html: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    tags = _Open()
    parts: list[str] = []
    linked = at = 0
    html = html or ""
    found = _Tags(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            block = tags.outer[-1] if tags.outer else ""
            out.append(Block(text, frozenset(tags.inside), frozenset(tags.words), block, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if tags.has("a"):
                linked += len(text.strip())

    while tag := found.after(at):
        start, end, closing, name, marks = tag
        add(html[at:start])
        at = end
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif closing:
                tags.pop(name)
            elif name not in VOID:
                tags.push(name, _marks(marks))
            continue
        flush()
        if closing:
            tags.pop(name)
            continue
        if name in RAW and not marks.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at) if at <= found.last[">"] else None
            at = end.end() if end else len(html)
            continue
        if name in VOID:
            continue
        for other in CLOSES.get(name, ()):  # a list item ends the one before, within its own list
            if other in tags.names[-2:]:
                tags.pop(other)
        tags.pop("p")
        tags.push(name, _marks(marks))
    add(html[at:])
    flush()
    return out


def _marks(text: str) -> frozenset:
    if "=" not in text:
        return frozenset()
    found = " ".join(a or b or c for a, b, c in _MARK.findall(text)).lower()
    return frozenset(WORDS.intersection(_WORD.findall(found)))


FEATURES = (
    [f"in {x}" for x in sorted(PLACES)] + [f"is {x}" for x in sorted(PLACES)] + [f"class {x}" for x in sorted(WORDS)]
    + ["short", "middle", "long", "links", "some links", "stop", "mark", "bias"]
)
_INDEX = {f: i for i, f in enumerate(FEATURES)}


def features_of(block: Block) -> list[int]:
    """The indexes of a block's features, all of which are present or absent."""
    n = block.text.count(" ") + 1
    names = [f"in {t}" for t in block.tags] + [f"class {w}" for w in block.words]
    if block.tag in PLACES:
        names.append(f"is {block.tag}")
    names.append("short" if n < 5 else "middle" if n < 25 else "long")
    if block.link_share > 0.5:
        names.append("links")
    elif block.link_share > 0:
        names.append("some links")
    if block.text[-1] in ".!?…":
        names.append("stop")
    if "©" in block.text or "·" in block.text:
        names.append("mark")
    return [_INDEX[x] for x in names] + [_INDEX["bias"]]


@dataclass
class Field:
    """Weights of features in favour of text, and of each pair of neighbouring labels (0 other, 1 text)."""

    weights: np.ndarray
    pairs: np.ndarray

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not blocks:
            return []
        w, t = self.weights.tolist(), self.pairs.tolist()
        best, back = [0.0, sum(w[f] for f in features_of(blocks[0]))], []
        for block in blocks[1:]:
            gain = sum(w[f] for f in features_of(block))
            from_ = [0 if best[0] + t[0][y] >= best[1] + t[1][y] else 1 for y in (0, 1)]
            best = [best[from_[y]] + t[from_[y]][y] + (gain if y else 0.0) for y in (0, 1)]
            back.append(from_)
        y = int(best[1] > best[0])
        out = [y]
        for from_ in reversed(back):
            y = from_[y]
            out.append(y)
        return out[::-1]


def _summed(emit: np.ndarray, t: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log sums of chains of like length, and each chain's total; padding follows the chain."""
    ahead, behind = np.zeros(emit.shape), np.zeros(emit.shape)
    ahead[:, 0] = emit[:, 0]
    for j in range(1, emit.shape[1]):
        moved = np.logaddexp.reduce(ahead[:, j - 1, :, None] + t, axis=1) + emit[:, j]
        ahead[:, j] = np.where(real[:, j, None], moved, ahead[:, j - 1])
    for j in range(emit.shape[1] - 2, -1, -1):
        moved = np.logaddexp.reduce(t + (emit[:, j + 1] + behind[:, j + 1])[:, None, :], axis=2)
        behind[:, j] = np.where(real[:, j + 1, None], moved, 0.0)
    return ahead, behind, np.logaddexp.reduce(ahead[:, -1], axis=1)


def slope(state: np.ndarray, x: np.ndarray, groups: list[tuple]) -> np.ndarray:
    """The gradient of the negative log likelihood; groups hold (row of x, label, whether real) of padded chains."""
    w, t = state[:-4], state[-4:].reshape(2, 2)
    gain, grad, by_row = x @ w, np.zeros_like(state), np.zeros(len(x))
    for kind, y, real in groups:
        emit = np.stack([np.zeros(y.shape), gain[kind]], 2)
        ahead, behind, total = _summed(emit, t, real)
        p = np.exp(ahead + behind - total[:, None, None])[..., 1]
        by_row += np.bincount(kind[real], (p - y)[real], len(x))
        for a in (0, 1):
            for b in (0, 1):
                joint = np.exp(ahead[:, :-1, a] + t[a, b] + emit[:, 1:, b] + behind[:, 1:, b] - total[:, None])
                seen = (y[:, :-1] == a) & (y[:, 1:] == b)
                grad[len(w) + 2 * a + b] += ((joint - seen) * real[:, 1:]).sum()
    grad[:-4] = by_row @ x
    return grad


def padded(pages: list[tuple[list[Block], list[int]]]) -> tuple[np.ndarray, list[tuple]]:
    """The different rows of features, and the pages in groups whose longest has less than twice the blocks of the shortest."""
    rows: dict[tuple, int] = {}
    groups: dict[int, list] = {}
    for blocks, labels in pages:
        kinds = [rows.setdefault(tuple(sorted(features_of(b))), len(rows)) for b in blocks]
        groups.setdefault(len(blocks).bit_length(), []).append((kinds, labels))
    x = np.zeros((len(rows), len(FEATURES)))
    for features, i in rows.items():
        x[i, list(features)] = 1
    out = []
    for _, chains in sorted(groups.items()):
        shape = (len(chains), max(len(k) for k, _ in chains))
        kind, y, real = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
        for i, (kinds, labels) in enumerate(chains):
            kind[i, : len(kinds)], y[i, : len(kinds)], real[i, : len(kinds)] = kinds, labels, True
        out.append((kind, y, real))
    return x, out


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam on whole passes over whole pages."""
    pages = [p for p in pages if p[0]]
    x, groups = padded(pages)
    state = np.zeros(len(FEATURES) + 4)
    m, s = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        grad = slope(state, x, groups) / max(1, len(pages)) + decay * state
        m += 0.1 * (grad - m)
        s += 0.001 * (grad * grad - s)
        state = state - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Field(state[:-4], state[-4:].reshape(2, 2))


OUTSIDE = {"nav", "aside", "footer", "form", "header", "dialog", "menu"}
OUTSIDE_WORDS = WORDS - {"article", "author", "body", "byline", "content", "entry", "header", "main", "meta", "post", "story", "tags", "text"}


def by_markup(block: Block) -> int:
    """Whether the markup says that a block is text."""
    return int(bool(block.tags & {"article", "main"}) and not block.tags & OUTSIDE and not block.words & OUTSIDE_WORDS)


def laid_out(blocks: list[Block], labels: list[int], layout: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page in another layout, with their labels."""
    text = [b.text for b, y in zip(blocks, labels) if y] or ["Text."]
    more = [b.text for b, y in zip(blocks, labels) if not y] or ["More"]
    mark = lambda kind, t: f"{t} \x01{kind}".replace("&", "&amp;").replace("<", "&lt;")
    paragraphs = lambda kind, ts: "".join(f"<p>{mark(kind, t)}</p>" for t in ts)
    middle = (len(text) + 1) // 2
    html = layout.format(
        title=mark(1, text[0]),
        text=paragraphs(1, text[:middle] if "{text2}" in layout else text),
        text2=paragraphs(1, text[middle:]),
        bullets="".join(f"<li>{mark(1, t)}</li>" for t in text[:3]),
        more=mark(0, more[-1]),
        items="".join(f'<li><a href="/x">{mark(0, t)}</a></li>' for t in more[:6]),
        others=paragraphs(0, text[-4:]),
    )
    out = []
    for b in blocks_of(html):
        body, _, kind = b.text.rpartition(" \x01")
        out.append((Block(body or ".", b.tags, b.words, b.tag, b.link_share), int(kind == "1")))
    return [b for b, _ in out], [y for _, y in out]


def fit(pages: DataFrame, html: str = "html", max_pages: int = 60, max_chars: int = 50_000) -> Field:
    """Train on at most `max_pages` pages of at most `max_chars`, chosen by hash, as they are and in every layout."""
    usable = pages.select(F.col(html).alias("_html")).where(F.length("_html").between(1, max_chars))
    hashed = usable.withColumn("_hash", F.xxhash64("_html"))
    cut = hashed.select("_hash").distinct().orderBy("_hash").limit(max_pages).agg(F.max("_hash")).first()[0]
    near = hashed.where(F.lit(False) if cut is None else F.col("_hash") <= cut)  # equal pages count once
    rows = near.dropDuplicates(["_hash"]).orderBy("_hash").limit(max_pages).collect()
    labelled = []
    for r in rows:
        blocks = blocks_of(r["_html"])
        labels = [by_markup(b) for b in blocks]
        if any(labels):
            labelled.append((blocks, labels))
        labelled += [laid_out(blocks, labels, layout) for layout in LAYOUTS]
    return train(labelled)


def main_text(html: str | None, field: Field) -> str:
    """The text blocks of a page, one a line."""
    blocks = blocks_of(html)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(blocks)) if y)


def extract(pages: DataFrame, field: Field, html: str = "html") -> DataFrame:
    """All rows of `pages` but the html, with text and n_chars (its code points)."""
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", html.lower())]
    body = free_name(pages.columns, "html")
    shared = pages.sparkSession.sparkContext.broadcast(field)  # of a fixed size

    def run(batches):
        for batch in batches:
            texts = [main_text(x, shared.value) for x in batch.column(body).to_pylist()]
            columns = [batch.column(c) for c in kept]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), sizes], [*kept, "text", "n_chars"])

    schema = pages.select(*kept, F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema
    return pages.select(*kept, F.col(html).alias(body)).mapInArrow(run, schema)
