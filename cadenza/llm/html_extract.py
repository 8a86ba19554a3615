"""HTML extraction: a bidirectional LSTM labels every text block of a page as main text or not.

A page is cut into blocks (html_blocks). For every block the network gets the hashed names of the elements
around it (with the words of their class, id and role), the mean of all its hashed words, and how long and how linked it is; the two
directions carry what stands before and after, so that each label hangs on the whole page.

Learning: TRAIN_PAGES pages (of those whose mark-up says plainly what their text is, the ones whose ids hash lowest) are
labelled by it: blocks in an article or main element are text, unless they also lie in an element of another kind
(MARGINS). Of a page of more than TRAIN_BYTES characters the blocks nearest to where the label changes are taught, and of a block
the TRAIN_DEPTH innermost elements around it, with TRAIN_WORDS words each. These bounds hold for training alone. So that the network also learns other templates, copies of these pages get other containers around the same
blocks, and margins of kinds that the page lacks. The driver fits the weights, a fixed number, on these pages only.
Where no page of a table says plainly what its text is, the query learns from blocks outside of MARGINS that are not mostly links.

Defined results: a null or empty page, or one without text, gives ''; rows that repeat a page_id are read each; if there
are no weights, every text is ''; an empty table gives an empty result. Of the columns keep those named page_id,
text or n_chars give way to the result's. A task holds one Arrow batch of pages, their blocks with each open element once, and the network's
input of BATCH_BLOCKS places (pages times the longest one's blocks) at once.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import block_lstm
from cadenza.llm.block_lstm import PATH_BUCKETS, WORD_BUCKETS, Paths, Sequence
from cadenza.llm.common import in_arrow, staged, sub_batches
from cadenza.llm.html_blocks import Block, Node, blocks, nested

TRAIN_PAGES = 240
TRAIN_BYTES = 1 << 16
#: What a block costs of TRAIN_BYTES besides its text; how many elements around it, and how many words of each, training reads.
BLOCK_COST = 16
TRAIN_DEPTH = 64
TRAIN_WORDS = 64
BATCH_BLOCKS = 1 << 14

#: Containers that stand for main text, and for what surrounds it (fixed values).
BODIES = (("article",), ("main",), ("div", "content"), ("div", "post"), ("section", "article", "body"), ("div", "entry", "content"), ("div", "main"), ("div", "story", "text"))
MARGINS = (
    ("nav",), ("header",), ("footer",), ("aside",), ("form",), ("head",), ("menu",), ("dialog",), ("div", "menu"), ("div", "nav"), ("div", "navbar"), ("ul", "navigation"), ("div", "header"), ("div", "footer"), ("div", "sidebar"), ("aside", "sidebar"),
    ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("div", "banner"), ("div", "cookie"), ("div", "cookie", "notice"), ("div", "notice"), ("div", "consent"), ("div", "popup"), ("div", "newsletter"), ("div", "subscribe"),
    ("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "comment", "list"), ("li", "comment"), ("div", "share"), ("div", "social"), ("div", "related"), ("section", "related"), ("div", "breadcrumb"), ("div", "login"), ("div", "search"), ("form", "search"), ("div", "copyright"), ("div", "disclaimer"), ("div", "widget"), ("div", "pagination"),
)
_MARGIN_WORDS = frozenset(w for m in MARGINS for w in m[1:]) - {"list", "text"}
_MARGIN_NAMES = frozenset(m[0] for m in MARGINS if len(m) == 1)


@functools.lru_cache(maxsize=1 << 16)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_BUCKETS


def _own(node: Node) -> list[int]:
    return [_bucket(node.name), *(_bucket(f".{w}") for w in node.words)]


def paths(found: list[Block]) -> Paths:
    """The elements around the blocks as a tree of buckets."""
    number: dict[int, int] = {}
    own, sizes, around = [], [], []
    for b in found:
        new, node = [], b.node
        while node is not None and id(node) not in number:
            new.append(node)
            node = node.around
        for node in reversed(new):
            number[id(node)] = len(sizes)
            buckets = _own(node)
            own += buckets
            sizes.append(len(buckets))
            around.append(number[id(node.around)] if node.around is not None else -1)
    at = [number[id(b.node)] if b.node is not None else -1 for b in found]
    last = [_bucket(f"last:{b.node.name}") if b.node is not None else 0 for b in found]
    return Paths(*(np.array(v, dtype=np.int64) for v in (own, sizes, around, at, last)))


def listed(found: list[Block]) -> list[np.ndarray]:
    """For training: the buckets of each block, of at most TRAIN_DEPTH elements."""
    return [np.array([k for x in islice(b.node.upwards(), TRAIN_DEPTH) for k in _own(x)] + [_bucket(f"last:{b.node.name}")] if b.node else [], dtype=np.int64) for b in found]


def sequence(found: list[Block], train: bool = False) -> Sequence:
    words = [np.array([zlib.crc32(w.encode()) % WORD_BUCKETS for w in b.text.lower().split()], dtype=np.int64) for b in found]
    sizes = np.array([len(b.text) for b in found], dtype=np.float32)
    stops = np.array([sum(b.text.count(c) for c in ".!?") for b in found], dtype=np.float32)
    numbers = np.stack([np.log1p(sizes) / 5, np.array([b.linked for b in found], dtype=np.float32), np.minimum(stops, 10) / 10, np.arange(len(found), dtype=np.float32) / max(1, len(found))], axis=1)
    return Sequence(listed(found) if train else paths(found), words, numbers.astype(np.float32))


def within(found: list[Block], test: Callable[[Node], bool]) -> list[bool]:
    """For each block whether an element around it passes the test; each element is tested once."""
    known: dict[int, bool] = {}
    out = []
    for b in found:
        new, node = [], b.node
        while node is not None and id(node) not in known:
            new.append(node)
            node = node.around
        held = node is not None and known[id(node)]
        for node in reversed(new):
            held = held or test(node)
            known[id(node)] = held
        out.append(held)
    return out


def _is_body(node: Node) -> bool:
    return node.name in ("article", "main")


def _is_margin(node: Node) -> bool:
    return node.name in _MARGIN_NAMES or not _MARGIN_WORDS.isdisjoint(node.words)


def taught(found: list[Block]) -> np.ndarray | None:
    """What the mark-up says of each block: 1 main text, 0 not; None if it does not say."""
    body = within(found, _is_body)
    if not any(body):
        return None
    return np.array([float(b and not m) for b, m in zip(body, within(found, _is_margin), strict=True)], dtype=np.float32)


def guessed(found: list[Block]) -> np.ndarray:
    """For pages that do not say: 1 for blocks outside of margins that are not mostly links."""
    return np.array([float(not m and b.linked < 0.5) for b, m in zip(found, within(found, _is_margin), strict=True)], dtype=np.float32)


def trimmed(found: list[Block], labels: np.ndarray, most: int = TRAIN_BYTES) -> tuple[list[Block], np.ndarray]:
    """The page for training: all of it, or of a long one about most characters (a block counts as BLOCK_COST more than it has),
    in the blocks nearest to a change of label."""
    if sum(len(b.text) + BLOCK_COST for b in found) <= most:
        return found, labels
    places = np.arange(len(found))
    turns = np.flatnonzero(np.diff(labels))
    right = np.append(turns, 2 * len(found))[np.searchsorted(turns, places)] - places
    left = places - 1 - np.insert(turns, 0, -2 * len(found))[np.searchsorted(turns, places)]
    kept, used = [], 0
    for i in np.argsort(np.minimum(left, right), kind="stable").tolist():
        if used >= most and len(kept) > 1:
            break
        kept.append(i)
        used += len(found[i].text) + BLOCK_COST
    kept.sort()
    return [Block(found[i].node, found[i].text[:most], found[i].linked) for i in kept], labels[kept]


def varied(found: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page with other containers, and with more margins before, within and after its text."""
    body = BODIES[rng.integers(len(BODIES))]
    wraps = [("html",), ("body",)] + [("div", "wrapper")] * int(rng.integers(0, 3)) + [("div",)] * int(rng.integers(0, 2))
    out: list[tuple[Block, float]] = []
    spare = [b for b in found if b.text]

    def margin(kind: tuple[str, ...], inside: bool) -> None:
        for _ in range(int(rng.integers(1, 6))):
            b = spare[rng.integers(len(spare))]
            said = " ".join(b.text.split()[: int(rng.integers(1, 25))])
            leaf = [("ul",), ("li",)] if rng.random() < 0.4 else [("p",)] if rng.random() < 0.6 else []
            out.append((Block(nested((*wraps, *([body] if inside else []), kind, *leaf)), said, float(rng.random() < 0.4)), 0.0))

    some = lambda most: [MARGINS[i] for i in rng.integers(len(MARGINS), size=int(rng.integers(0, most)))]
    for kind in some(5):
        margin(kind, False)
    leaves = [("p",), ("h2",), ("li",), ("blockquote",), ("pre",), ("td",)]
    for b, y in zip(found, labels, strict=True):
        if y:
            leaf = (b.node.name, *b.node.words[:TRAIN_WORDS]) if b.node and rng.random() < 0.8 else leaves[rng.integers(len(leaves))]
            held = [("section",)] if rng.random() < 0.1 else [("ul",)] if leaf == ("li",) else []
            out.append((Block(nested((*wraps, body, *held, leaf)), b.text, 0.0), 1.0))
            if rng.random() < 0.05:
                margin(MARGINS[rng.integers(len(MARGINS))], True)
    for kind in some(5):
        margin(kind, False)
    return [b for b, _ in out], np.array([y for _, y in out], dtype=np.float32)


def _written(found: list[Block], labels: np.ndarray) -> str:
    """Blocks and labels as JSON: elements (at most TRAIN_DEPTH around a block, TRAIN_WORDS words each) once, then the blocks."""
    number: dict[int, int] = {}
    elements: list[tuple[int, str, list[str]]] = []
    rows = []
    for b, y in zip(found, labels.tolist(), strict=True):
        chain = list(islice(b.node.upwards(), TRAIN_DEPTH)) if b.node else []
        above = -1
        for node in reversed(chain):
            if id(node) not in number:
                number[id(node)] = len(elements)
                elements.append((above, node.name, list(node.words[:TRAIN_WORDS])))
            above = number[id(node)]
        rows.append((above, b.text, b.linked, y))
    return json.dumps((elements, rows))


def _read(said: str) -> tuple[list[Block], np.ndarray]:
    elements, rows = json.loads(said)
    nodes: list[Node] = []
    for above, name, words in elements:
        nodes.append(Node(nodes[above] if above >= 0 else None, name, tuple(words)))
    return [Block(nodes[k] if k >= 0 else None, text, linked) for k, text, linked, _ in rows], np.array([r[3] for r in rows], dtype=np.float32)


def sample(pages: DataFrame, id_column: str, html_column: str, most: int, teach: Callable[[list[Block]], np.ndarray | None]) -> list[tuple[list[Block], np.ndarray]]:
    """The blocks and labels of the pages with text by teach, those (at most most) whose ids hash lowest.

    The share of the ids that is read grows until enough pages are labelled, or all are read.
    """
    low = F.pmod(F.xxhash64("__cz_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = pages.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("__cz_id"), F.col(html_column).alias("__cz_html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "__cz_html"):
            at, said = [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                found = blocks(page) if page else []
                labels = teach(found) if found else None
                if labels is not None and labels.any():
                    at.append(i)
                    said.append(_written(*trimmed(found, labels)))
            yield pa.record_batch({"__cz_id": batch.column(0).take(pa.array(at, pa.int64())), "said": pa.array(said, pa.string())})

    n = rows.count()
    share = (1.5 * most + 50) / max(1, n)
    while True:
        near = rows.where(low <= share).groupBy("__cz_id").agg(F.min("__cz_html").alias("__cz_html"))  # a repeated id once
        labelled = staged(in_arrow(near, read, f"__cz_id {rows.schema['__cz_id'].dataType.simpleString()}, said string"), "page-sample")
        if share >= 1 or labelled.count() >= most:
            break
        share *= 4
    taken = labelled.orderBy(low, "__cz_id").limit(most).collect()  # most rows at most, each trimmed
    return [_read(row.said) for row in taken]


def learn(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", most: int = TRAIN_PAGES, guess: bool = False) -> dict[str, np.ndarray] | None:
    """The network's weights; None if no page says what its text is. With guess it is guessed from margins and links."""
    asked = pages if guess else pages.where(F.col(html_column).rlike(r"(?i)<(article|main)[\s/>]"))
    rows = sample(asked, id_column, html_column, most, guessed if guess else taught)
    taken: list[Sequence] = []
    rng = np.random.default_rng(11)
    copies = max(3, 3 * TRAIN_PAGES // max(1, len(rows)))  # few pages are varied more often
    for found, labels in rows:
        for blocks_now, marks in ((found, labels), *(varied(found, labels, rng) for _ in range(copies))):
            s = sequence(blocks_now, train=True)
            s.labels = marks
            taken.append(s)
    return block_lstm.train(taken) if taken else None


def label(weights: dict[str, np.ndarray], pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page which of its blocks are main text."""
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= BATCH_BLOCKS:
            end += 1
        for i, p in zip(order[at:end], block_lstm.scores(weights, [sequence(pages[i]) for i in order[at:end]]), strict=True):
            out[i] = p > 0.5
        at = end
    return out


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each page: page_id, the columns keep, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "__cz_html"):
            found = [blocks(h) if h else [] for h in batch.column(0).to_pylist()]
            marks = label(weights, found) if weights else [np.zeros(len(b), dtype=bool) for b in found]
            texts = ["\n\n".join(b.text for b, m in zip(page, mark, strict=True) if m) for page, mark in zip(found, marks, strict=True)]
            columns = {batch.schema.names[i]: batch.column(i) for i in range(1, batch.num_columns)}
            yield pa.record_batch(columns | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col(html_column).alias("__cz_html"), F.col(id_column).alias("page_id"), *[c for c in keep if c not in ("page_id", "text", "n_chars")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return in_arrow(rows, run, f"{schema}, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = learn(pages)
    return extract(pages, learn(pages, guess=True) if weights is None else weights, keep=("url",))
