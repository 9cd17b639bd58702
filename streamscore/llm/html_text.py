"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: stretches of text between the borders of block
elements, in page order. Each block is described by the elements around it, the
words of their class, id and role attributes, and the shape of its text. The model
scores these features and pairs of neighbouring labels; it is trained on labelled
pages by maximum likelihood, and the Viterbi algorithm finds the labels of a page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamscore.llm.arrow import slices
from streamscore.llm.labelled_pages import MARK, labelled_pages
from streamscore.llm.words import text_of

PER_LAYOUT = 24  # labelled pages per layout
SEED = 3
STEPS = 250
PENALTY = 0.02

VOID = set("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = set("script style title template noscript iframe object svg select textarea".split())
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li "
    "main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# A start tag closes an open element of these names, up to an element that holds it.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
CLOSES |= {x: {"p"} for x in BLOCK - {"br", "label", "button", "option"} - set(CLOSES)}
HOLDERS = set("article aside blockquote body div footer form header main nav section table td th ul ol".split())


class Block:
    """Text of a leaf block, and the elements and attribute words around it."""

    __slots__ = ("parts", "linked", "path", "tokens")

    def __init__(self, path: tuple, tokens: frozenset):
        self.parts: list[str] = []
        self.linked = 0
        self.path, self.tokens = path, tokens


@lru_cache(100_000)
def _tokens(value: str) -> frozenset:
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
    words = re.findall(r"[a-z]{2,}", spaced)
    return frozenset(w[:-1] if w.endswith("s") and len(w) > 2 else w for w in words)


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, frozenset]] = []
        self.skipping: str | None = None
        self.links = 0
        self.current: Block | None = None

    def _close(self, names: set[str], holders: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag in names:
                self.links -= sum(x[0] == "a" for x in self.open[k:])
                del self.open[k:]
                return
            if tag in holders:
                return

    def handle_starttag(self, tag, attrs):
        if self.skipping:
            return
        if tag in SKIPPED:
            self.skipping = tag
            return
        if tag in BLOCK:
            self.current = None
            if tag in CLOSES:
                self._close(CLOSES[tag], HOLDERS - CLOSES[tag])
        if tag in VOID:
            return
        tokens = frozenset()
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                tokens |= _tokens(value)
        self.links += tag == "a"
        self.open.append((tag, tokens))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping:
                self.skipping = None
            return
        if tag in BLOCK:
            self.current = None
        self._close({tag}, set())

    def handle_data(self, data):
        if self.skipping:
            return
        if self.current is None:
            if not data.strip():
                return
            path = tuple(x[0] for x in self.open if x[0] in BLOCK)
            self.current = Block(path, frozenset().union(*(x[1] for x in self.open)))
            self.blocks.append(self.current)
        self.current.parts.append(data)
        if self.links:
            self.current.linked += len(data)


def leaf_blocks(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    return parser.blocks


def block_text(block: Block) -> str:
    """Text with its white space turned into single spaces."""
    return " ".join("".join(block.parts).split())


def features(block: Block, text: str, title_seen: bool) -> list[str]:
    words = text.count(" ") + 1
    share = block.linked / max(1, len(text))
    out = [f"in:{tag}" for tag in set(block.path)]
    out += [f"word:{token}" for token in block.tokens]
    out.append(f"at:{block.path[-1] if block.path else ''}")
    out.append(f"words:{min(words, 64).bit_length()}")
    out.append(f"links:{0 if share == 0 else 1 if share < 0.5 else 2}")
    out.append(f"end:{text[-1] in '.!?:' if text else ''}")
    out.append(f"after title:{title_seen}")
    if "©" in text:
        out.append("copyright")
    return out


def described(html: str) -> tuple[list[str], list[list[str]]]:
    """Texts of the blocks of a page that have any, and their features."""
    texts, rows, title_seen = [], [], False
    for block in leaf_blocks(html):
        text = block_text(block)
        if text:
            plain = text.replace(MARK, "") if text.startswith(MARK) else text
            texts.append(text)
            rows.append(features(block, plain, title_seen))
            title_seen |= "h1" in block.path
    return texts, rows


class ChainModel:
    """Two labels (0 other, 1 main); weights of features and of neighbouring labels."""

    def __init__(self, weights: dict[str, float], turns: np.ndarray):
        self.weights, self.turns = weights, turns  # turns[a][b]: score of b after a

    def labels(self, rows: list[list[str]]) -> list[int]:
        """Best labels by the Viterbi algorithm."""
        get, (t00, t01), (t10, t11) = self.weights.get, *self.turns.tolist()
        no, yes, back = 0.0, 0.0, []
        for k, row in enumerate(rows):
            score = sum(get(f, 0.0) for f in row)
            if k == 0:
                no, yes = 0.0, score
                continue
            from0, from1 = no + t00 < yes + t10, no + t01 < yes + t11
            no, yes = max(no + t00, yes + t10), max(no + t01, yes + t11) + score
            back.append((from0, from1))
        if not rows:
            return []
        out = [int(yes > no)]
        for pair in reversed(back):
            out.append(int(pair[out[-1]]))
        return out[::-1]


def train(pages: list[str], steps: int = STEPS, penalty: float = PENALTY) -> ChainModel:
    """Maximum likelihood with a quadratic penalty, by gradient steps over all pages at once."""
    sequences = []
    for page in pages:
        texts, rows = described(page)
        sequences.append((rows, [int(x.startswith(MARK)) for x in texts]))
    names = {f: k for k, f in enumerate(dict.fromkeys(f for rows, _ in sequences for r in rows for f in r))}
    n, width = len(sequences), max(len(rows) for rows, _ in sequences)
    inside = np.zeros((n, width), bool)
    gold = np.zeros((n, width))
    at, which = [], []
    for i, (rows, labels) in enumerate(sequences):
        inside[i, : len(rows)] = True
        gold[i, : len(rows)] = labels
        for t, row in enumerate(rows):
            at += [i * width + t] * len(row)
            which += [names[f] for f in row]
    at, which = np.array(at), np.array(which)
    step_inside = inside[:, 1:]
    gold_turns = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            gold_turns[a, b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & step_inside).sum()
    weights, turns = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    for step in range(1, steps + 1):
        unary = np.zeros((n, width, 2))
        unary[:, :, 1] = np.bincount(at, weights[which], n * width).reshape(n, width)
        forward, backward = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        forward[:, 0] = unary[:, 0]
        for t in range(1, width):
            moved = np.logaddexp.reduce(forward[:, t - 1, :, None] + turns, axis=1) + unary[:, t]
            forward[:, t] = np.where(inside[:, t, None], moved, forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            moved = np.logaddexp.reduce(turns + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(inside[:, t + 1, None], moved, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        main = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * inside
        slope = np.bincount(which, (gold - main).ravel()[at], len(names)) - penalty * weights
        pair = forward[:, :-1, :, None] + turns + (unary[:, 1:] + backward[:, 1:])[:, :, None, :]
        expected = np.exp(pair - total[:, None, None, None]) * step_inside[:, :, None, None]
        turn_slope = gold_turns - expected.sum(axis=(0, 1)) - penalty * turns
        gradient = np.concatenate([slope, turn_slope.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        change = moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8) * 0.1
        weights += change[:-4]
        turns += change[-4:].reshape(2, 2)
    return ChainModel({f: float(weights[k]) for f, k in names.items()}, turns)


@lru_cache(1)
def default_model() -> ChainModel:
    """Trained on PER_LAYOUT labelled pages of every layout; the same in every run."""
    return train(labelled_pages(PER_LAYOUT, SEED))


def main_text(html: str, model: ChainModel) -> str:
    texts, rows = described(html)
    return " ".join(text for text, label in zip(texts, model.labels(rows)) if label)


def extract(pages: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars.

    `text` joins the blocks of the main text by single spaces. Null or empty html, and
    pages without main text, give an empty text. Ids and urls pass through, null and
    repeated ones too; other columns are not read, whatever their names, and an empty table
    gives no rows. The model has a few hundred
    weights and travels with the function.
    """
    model = model or default_model()
    named = pages.select("page_id", "url", text_of("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x, model) for x in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())]
                columns.append(pa.array(list(map(len, texts)), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    schema = named.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return named.mapInArrow(run, schema)
