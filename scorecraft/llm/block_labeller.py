"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks.  A bidirectional LSTM in NumPy reads one
vector per block - the hashed names on its tag path, its hashed words, and its
length, links and place - and labels every block as main text or not, so that each
label depends on the whole page.

The weights were trained here (``python -m scorecraft.llm.block_labeller PAGES.parquet``) and come
with the package, so a page's text hangs on no other page and on no table's size.  Their teacher
was the markup of sample pages where that names its part (``article``, ``nav``,
``class="ad"``).  The network learnt from copies that keep the labels but not the
markup: with further parts (sidebars, notices, forms, comments) made of other pages'
words, under varied names; with every paragraph, heading and article a plain ``div``; with names
hidden, so that length, links, words and neighbours have to tell; with very many, very long or very few
blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache
from importlib.resources import files as package_files
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scorecraft.llm.common import ragged_index, segment_sums
from scorecraft.llm.html_blocks import Block, blocks_of
from scorecraft.llm.text_hash import SPACE_CLASSES, words

PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 96, 24, 10, 24
DIM = PATH_DIM + WORD_DIM + SHAPE_DIM
#: Training: so many sample pages, copies of each, and blocks of a page that count at once (a run of a longer page).
TRAIN_PAGES, COPIES, TRAIN_BLOCKS = 400, 6, 300
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 5
WEIGHTS = "block_weights.npz"
#: Names that tell a part that is not main text, and names that tell main text.
ASIDE_NAMES = frozenset("""ad ads advert advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent
cookie cookies copyright disclaimer discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager
pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup social sponsor
sponsored subscribe subscription tags toolbar tracking widget""".split())
STOPS = np.frombuffer(b",.;:!?", np.uint8)
ASIDE_TAGS = frozenset("nav footer aside form header menu dialog search fieldset".split())
MAIN_TAGS = frozenset("article main".split())
#: What stands for article and main in copies.
AROUND = (("div",), ("section",), (), ("div", ".post"), ("div", ".content"), ("section", ".entry"), ("td",), ("div", ".story", ".body"))
#: What becomes a div in copies without telling markup.
PLAIN_TAGS = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote".split())
#: Parts that training copies get: element, names, number of blocks, whether their blocks are links.
PARTS = (
    ("aside", "sidebar", 4, True), ("div", "sidebar widget", 3, False), ("div", "related", 4, True), ("div", "cookie notice", 1, False),
    ("div", "notice", 1, False), ("div", "alert banner", 1, False), ("form", "", 3, False), ("form", "newsletter signup", 2, False),
    ("div", "login form", 2, False), ("section", "comments", 4, False), ("div", "comment", 2, False), ("ol", "comments", 4, False),
    ("div", "ad", 1, False), ("div", "ads sponsored", 2, False), ("div", "promo", 1, False), ("aside", "advert", 1, False), ("header", "", 2, False),
    ("header", "masthead", 3, True), ("div", "header", 2, False), ("nav", "breadcrumb", 3, True), ("ul", "menu", 5, True), ("div", "nav", 5, True),
    ("div", "footer", 2, False), ("footer", "", 2, True), ("div", "social share", 3, True), ("div", "pagination", 3, True),
)


def _slot(token: str, dim: int) -> tuple[int, float]:
    h = crc32(token.encode("utf-8", "replace"))
    return h % dim, 1.0 if h & 0x40000000 else -1.0


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = _PATHS.get(path)
    if out is None:
        out = np.zeros(PATH_DIM, np.float32)
        for name in path:
            k, sign = _slot(name, PATH_DIM)
            out[k] = sign
        if len(_PATHS) < 20_000:
            _PATHS[path] = out
    return out


def features(pages: list[list[Block]]) -> list[np.ndarray]:
    """One row per block, for each page; the words of all pages are hashed together."""
    blocks = [b for page in pages for b in page]
    sizes = [len(page) for page in pages]
    if not blocks:
        return [np.zeros((0, DIM), np.float32) for _ in pages]
    coded = [b.text.encode() for b in blocks]
    data = np.frombuffer(b"".join(coded), np.uint8)
    lengths = np.array([len(c) for c in coded], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    h, n_words = words(data, offsets, SPACE_CLASSES)
    cell = np.repeat(np.arange(len(blocks)), n_words) * WORD_DIM + (h % np.uint64(WORD_DIM)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    bag = np.bincount(cell, weights=sign, minlength=len(blocks) * WORD_DIM).reshape(-1, WORD_DIM)
    stops = segment_sums(np.isin(data, STOPS).astype(np.int64), lengths)
    chars = np.array([len(b.text) for b in blocks])
    size = np.repeat(sizes, sizes)
    place = ragged_index(np.zeros(len(sizes), np.int64), np.array(sizes))
    leaf = [b.path[-1] if b.path else "" for b in blocks]
    shape = np.stack([
        np.log1p(chars) / 8, np.minimum(1.0, np.array([b.link_chars for b in blocks]) / chars), place / size, 1 / (1 + place),
        1 / (size - place), np.minimum(1.0, np.array([len(b.path) for b in blocks]) / 10),
        np.array([b.text[-1] in ".!?" for b in blocks]), stops / lengths * 10, np.array([x == "p" for x in leaf]),
        np.array([x[:1] == "h" and x[1:].isdigit() for x in leaf])], axis=1)
    x = np.concatenate([np.stack([_path_vector(b.path) for b in blocks]), np.clip(bag / np.sqrt(np.maximum(1, n_words))[:, None], -3, 3), shape], axis=1)
    return np.split(x.astype(np.float32), np.cumsum(sizes)[:-1])


def teacher(path: tuple[str, ...]) -> bool:
    """Whether markup that names its parts says main text."""
    for k, name in enumerate(path):
        if name in ASIDE_TAGS or name[:1] == "." and name[1:] in ASIDE_NAMES:
            return False
    return any(n in MAIN_TAGS for n in path) or "p" in path or any(n[:1] == "h" and n[1:].isdigit() for n in path)


class Lstm:
    """One direction; gates in the order input, forget, output, candidate."""

    def __init__(self, rng: np.random.Generator):
        scale = 1 / np.sqrt(DIM + HIDDEN)
        self.w = (rng.standard_normal((DIM + HIDDEN, 4 * HIDDEN)) * scale).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN:2 * HIDDEN] = 1

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: (time, page, DIM); mask: (time, page). States of all times, and what ``backward`` needs."""
        steps, pages, _ = x.shape
        h, c = (np.zeros((pages, HIDDEN), np.float32) for _ in range(2))
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        trace = []
        inner = x @ self.w[:DIM] + self.b
        for t in range(steps):
            z = inner[t] + h @ self.w[DIM:]
            gates = 1 / (1 + np.exp(-np.clip(z[:, :3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c_new = (f * c + i * g) * m
            tanh = np.tanh(c_new)
            h_new = o * tanh * m
            if keep:
                trace.append((h, c, i, f, o, g, tanh, m))
            h, c = h_new, c_new
            out[t] = h
        return out, trace

    def backward(self, x: np.ndarray, trace: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dw, db = np.zeros_like(self.w), np.zeros_like(self.b)
        dh, dc = (np.zeros_like(d_out[0]) for _ in range(2))
        for t in range(len(trace) - 1, -1, -1):
            h, c, i, f, o, g, tanh, m = trace[t]
            dh = (dh + d_out[t]) * m
            dc = (dc + dh * o * (1 - tanh * tanh)) * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dw[:DIM] += x[t].T @ dz
            dw[DIM:] += h.T @ dz
            db += dz.sum(axis=0)
            dh, dc = dz @ self.w[DIM:].T, dc * f
        return dw, db


class Labeller:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng), Lstm(rng)
        self.v = (rng.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def _padded(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        x, mask = np.zeros((steps, len(pages), DIM), np.float32), np.zeros((steps, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[:len(p), k], mask[:len(p), k] = p, 1
        return x, mask

    def scores(self, pages: list[np.ndarray], keep: bool = False):
        x, mask = self._padded(pages)
        a, trace_a = self.ahead.forward(x, mask, keep)
        b, trace_b = self.back.forward(x[::-1], mask[::-1], keep)
        both = np.concatenate([a, b[::-1]], axis=2)
        return both @ self.v + self.c, (x, mask, both, trace_a, trace_b)

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
        """Adam on the mean cross entropy of all blocks."""
        rng = np.random.default_rng(seed)
        params = [self.ahead.w, self.ahead.b, self.back.w, self.back.b, self.v, self.c]
        m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), BATCH):
                pick = sorted(order[at:at + BATCH], key=lambda k: len(pages[k]))
                s, (x, mask, both, trace_a, trace_b) = self.scores([pages[k] for k in pick], True)
                y = np.zeros_like(s)
                for k, j in enumerate(pick):
                    y[:len(labels[j]), k] = labels[j]
                ds = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * mask / mask.sum()
                d = ds[:, :, None] * self.v
                grads = [*self.ahead.backward(x, trace_a, d[:, :, :HIDDEN]),
                         *self.back.backward(x[::-1], trace_b, d[::-1, :, HIDDEN:]),
                         (both * ds[:, :, None]).sum(axis=(0, 1)), np.array([ds.sum()], np.float32)]
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for p, g, a, b in zip(params, grads, m1, m2, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
        return self

    def label(self, pages: list[np.ndarray], budget: int = 20_000) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length run together, about ``budget`` blocks at a time."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            take = max(1, min(len(order), budget // len(pages[order[-1]])))
            pick, order = order[-take:], order[:-take]
            s, _ = self.scores([pages[k] for k in pick])
            for i, k in enumerate(pick):
                out[k] = s[:len(pages[k]), i] > 0
        return out


def _training(samples: list[str], seed: int = SEED) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature rows and labels of the sample pages and of their varied copies."""
    rng = np.random.default_rng(seed)
    texts = [b.text.split() for s in samples for b in blocks_of(s)]
    texts = [t for t in texts if t] or [["text"]]

    def some(n: int) -> str:
        t = texts[rng.integers(len(texts))]
        at = int(rng.integers(max(1, len(t) - n + 1)))
        return " ".join(t[at:at + n])

    def part() -> list[tuple[Block, bool]]:
        tag, names, n, linked = PARTS[rng.integers(len(PARTS))]
        here = ("html", "body", *(("article",) if rng.random() < 0.45 else ()), tag, *(f".{x}" for x in names.split()))
        inner = [("p",), ("ul", "li"), (), ("div",), ("h3",)][rng.integers(5)]
        out = []
        for _ in range(int(rng.integers(1, n + 2))):
            text = some(int(rng.integers(1, 4 if linked else 25)))
            out.append((Block(text, here + inner, len(text) if linked or rng.random() < 0.1 else 0), False))
        return out

    def article(rows: list[tuple[Block, bool]]) -> list[tuple[Block, bool]]:
        """The page with a much longer, or a much shorter, main text."""
        main = [b for b, y in rows if y]
        kind = rng.random()
        if not main or kind < 0.5:
            return rows
        first = next(k for k, (_, y) in enumerate(rows) if y)
        if kind < 0.65:  # a block or two
            keep = {id(b) for b in main[:int(rng.integers(1, 3))]}
            return [(b, y) for b, y in rows if not y or id(b) in keep]
        if kind < 0.85:  # some blocks of up to a hundred sentences
            same = rng.random() < 0.3
            return [(Block(" ".join([b.text, *(b.text if same else some(40) for _ in range(int(rng.integers(1, 100))))]), b.path, b.link_chars)
                     if y and rng.random() < 0.4 else b, y) for b, y in rows]
        more = [(Block(some(int(rng.integers(5, 60))) + ".", main[rng.integers(len(main))].path, 0), True) for _ in range(int(rng.integers(20, 400)))]
        return rows[:first + 1] + more + rows[first + 1:]

    def plain_markup(rows: list[tuple[Block, bool]], tags: frozenset) -> list[tuple[Block, bool]]:
        """Other elements for ``tags``: article and main become one of several, the rest div."""
        around = AROUND[rng.integers(len(AROUND))]
        return [(Block(b.text, tuple(x for n in b.path for x in (around if n in MAIN_TAGS else ("div",) if n in tags else (n,))), b.link_chars), y)
                for b, y in rows]

    xs, ys = [], []
    for sample in samples:
        taught = [(b, teacher(b.path)) for b in blocks_of(sample)]
        for copy in range(1 + COPIES):
            rows = article(taught) if copy else list(taught)
            for _ in range(int(rng.integers(0, 6)) if copy else 0):
                at = int(rng.integers(len(rows) + 1))
                rows = rows[:at] + part() + rows[at:]
            if not rows:
                continue
            way = rng.random() if copy else 1.0
            if way < 0.25:
                rows = plain_markup(rows, MAIN_TAGS)
            elif way < 0.55:
                rows = plain_markup(rows, PLAIN_TAGS)
            x = features([[b for b, _ in rows]])[0]
            if copy and rng.random() < 0.2:  # names hidden
                x[:, :PATH_DIM] = 0
            at = int(rng.integers(max(1, len(rows) - TRAIN_BLOCKS + 1)))
            xs.append(x[at:at + TRAIN_BLOCKS])
            ys.append(np.array([y for _, y in rows[at:at + TRAIN_BLOCKS]], np.float32))
    return xs, ys


def train(samples: list[str]) -> Labeller:
    """A labeller trained on sample pages of any length."""
    xs, ys = _training(samples)
    return Labeller().fit(xs, ys) if xs else Labeller()


def _parameters(labeller: Labeller) -> list[np.ndarray]:
    return [labeller.ahead.w, labeller.ahead.b, labeller.back.w, labeller.back.b, labeller.v, labeller.c]


@cache
def shipped() -> Labeller:
    """The labeller with the weights of the package."""
    out = Labeller()
    with package_files("scorecraft.llm").joinpath(WEIGHTS).open("rb") as f:
        kept = np.load(f)
        for k, p in enumerate(_parameters(out)):
            p[...] = kept[f"p{k}"].astype(np.float32)
    return out


def extract(labeller: Labeller, pages: list[str | None]) -> list[str]:
    """Main text of each page: the blocks labelled so, joined by line ends."""
    blocks = [blocks_of(p) for p in pages]
    marks = labeller.label(features(blocks))
    return ["\n".join(b.text for b, keep in zip(bs, ks, strict=True) if keep) for bs, ks in zip(blocks, marks, strict=True)]


def extract_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per page, no shuffle of pages.

    NULL and empty pages, and pages without main text, give the empty text; a NULL
    page_id or url stays NULL; repeated rows give repeated rows; an empty
    table gives no rows; other columns are not read.  Nothing is cut, however
    long a page is.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller or shipped())  # some 100 KB of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = extract(shared.value, part.column("html").to_pylist())
                yield pa.RecordBatch.from_pydict({
                    "page_id": part.column("page_id").cast(pa.int64()), "url": part.column("url").cast(pa.string()),
                    "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main(path: str) -> None:
    """Train on the first pages of a Parquet file, in hash order of their text, and store the weights beside this module."""
    import pyarrow.parquet as pq

    pages = sorted((p for p in pq.read_table(path, columns=["html"])["html"].to_pylist() if p), key=lambda p: crc32(p.encode()))
    parameters = {f"p{k}": p.astype(np.float16) for k, p in enumerate(_parameters(train(pages[:TRAIN_PAGES])))}
    np.savez_compressed(__file__.rpartition("/")[0] + "/" + WEIGHTS, **parameters)


if __name__ == "__main__":
    main(sys.argv[1])
