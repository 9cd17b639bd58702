"""Licence scans: a paragraph classifier confirmed by template comparison.

Paragraphs are the lines of a text. Their one to three word n-grams, hashed to
`BUCKETS` places, are the sparse features of a multinomial logistic regression over
licence families and `unknown`. It is trained on labelled paragraphs: notices and
template texts with words dropped and surroundings added, and other prose. A
temperature fitted on held-out paragraphs calibrates its probabilities. A family
counts only where it is sure enough and the paragraph shares enough word pairs with
one of the family's texts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamscore.llm.arrow import slices
from streamscore.llm.licence_texts import NAMES, OTHERS, PHRASES, TEMPLATES
from streamscore.llm.substring_dedup import word_hashes
from streamscore.llm.winnow import mixed
from streamscore.llm.words import text_of

BUCKETS = 1 << 16
EXAMPLES = 4000  # labelled paragraphs, a fifth of them held out for calibration
SEED = 5
STEPS = 80
PENALTY = 1e-4
SURE = 0.5
SHARED = 0.6
FAMILIES = ["unknown", *NAMES]
STEP = np.uint64(0x9E3779B97F4A7C15)
# All ASCII characters that are no letters or digits separate words.
TABLE = bytes(
    c if c >= 128 or chr(c).isalnum() or c == 10 else 32 for c in range(256)
)


def words_of_line(line: bytes) -> list[bytes]:
    return line.translate(TABLE).lower().split()


def grams(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lines given by their word hashes, and the line of each."""
    line = np.repeat(np.arange(len(sizes)), sizes)
    buckets, lines = [mixed(flat)], [line]
    hashes = flat
    for n in (2, 3):
        if len(flat) < n:
            break
        hashes = hashes[: len(flat) - n + 1] * STEP + flat[n - 1 :]
        inside = line[: len(flat) - n + 1] == line[n - 1 :]
        buckets.append(mixed(hashes[inside] + np.uint64(n)))
        lines.append(line[: len(flat) - n + 1][inside])
    places = (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return places, np.concatenate(lines)


def _featured(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [words_of_line(x) for x in lines]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return grams(word_hashes([w for part in parts for w in part]), sizes)


_PROSE = (
    "the of and a to in is was it for on are with as that by this be from or at have an which not we "
    "time people year day house water city river music garden road number school night winter story"
).split()


def examples(count: int, seed: int) -> list[tuple[str, str]]:
    """Labelled paragraphs (text, family), half of them no licence at all."""
    rng = random.Random(seed)
    prose = lambda low, high: " ".join(rng.choices(_PROSE, k=rng.randint(low, high)))
    out = []
    for _ in range(count // 2):
        family = rng.choice(list(NAMES))
        if rng.random() < 0.6:
            text = rng.choice(PHRASES).format(rng.choice(NAMES[family]))
        else:
            words = rng.choice(TEMPLATES[family]).split()
            text = " ".join(w for w in words if rng.random() > 0.05)
        if rng.random() < 0.3:
            text = f"{prose(1, 20)} {text}"
        if rng.random() < 0.3:
            text = f"{text} {prose(1, 20)}"
        out.append((text.upper() if rng.random() < 0.1 else text, family))
    for _ in range(count - len(out)):
        kind = rng.random()
        text = prose(1, 60)
        if kind < 0.4:
            text = f"{prose(0, 12)} {rng.choice(OTHERS)} {prose(0, 12)}"
        elif kind < 0.6:
            text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randint(5, 300)))
        out.append((text, "unknown"))
    rng.shuffle(out)
    return out


class Classifier:
    """Weights, temperature, and the word pairs of the families' texts."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature
        self.templates = [[]]
        for family in NAMES:
            texts = TEMPLATES[family] + [p.format(n) for n in NAMES[family] for p in PHRASES]
            self.templates.append([_pairs(t.encode()) for t in texts])

    def scores(self, places: np.ndarray, lines: np.ndarray, count: int) -> np.ndarray:
        out = np.empty((count, len(self.bias)))
        for k in range(len(self.bias)):
            out[:, k] = np.bincount(lines, self.weights[places, k], count)
        n = np.maximum(np.bincount(lines, minlength=count), 1)
        return out / np.sqrt(n)[:, None] + self.bias

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        e = np.exp((scores - scores.max(axis=1, keepdims=True)) / self.temperature)
        return e / e.sum(axis=1, keepdims=True)

    def similarity(self, line: bytes, family: int) -> float:
        """Largest share of a text's word pairs that the paragraph has, or the reverse."""
        own = _pairs(line)
        best = 0.0
        for text in self.templates[family]:
            common = len(own & text)
            best = max(best, common / len(text), common / max(len(own), 6))
        return best


def _pairs(line: bytes) -> frozenset:
    words = words_of_line(line)
    return frozenset(zip(words, words[1:]))


def train(rows: list[tuple[str, str]], steps: int = STEPS, penalty: float = PENALTY) -> Classifier:
    cut = len(rows) * 4 // 5
    labels = np.array([FAMILIES.index(f) for _, f in rows])
    model = Classifier(np.zeros((BUCKETS, len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0)
    places, lines = _featured([t.encode() for t, _ in rows[:cut]])
    used, at = np.unique(places, return_inverse=True)
    small = Classifier(np.zeros((len(used), len(FAMILIES))), model.bias, 1.0)
    scale = 1 / np.sqrt(np.maximum(np.bincount(lines, minlength=cut), 1))
    gold = np.eye(len(FAMILIES))[labels[:cut]]
    squares = np.full_like(small.weights, 1e-8)
    bias_squares = np.full_like(small.bias, 1e-8)
    for _ in range(steps):  # full gradients with a step size per weight
        error = small.probabilities(small.scores(at, lines, cut)) - gold
        gradient = np.empty_like(small.weights)
        for k in range(len(FAMILIES)):
            gradient[:, k] = np.bincount(at, (error[:, k] * scale)[lines], len(used)) / cut
        gradient += penalty * small.weights
        squares += gradient**2
        small.weights -= 0.5 * gradient / np.sqrt(squares)
        slope = error.mean(axis=0)
        bias_squares += slope**2
        small.bias = small.bias - 0.2 * slope / np.sqrt(bias_squares)
    model.weights[used], model.bias = small.weights, small.bias
    places, lines = _featured([t.encode() for t, _ in rows[cut:]])
    scores, truth = model.scores(places, lines, len(rows) - cut), labels[cut:]
    losses = {}
    for temperature in np.geomspace(0.05, 5, 60):
        model.temperature = temperature
        p = model.probabilities(scores)[np.arange(len(truth)), truth]
        losses[temperature] = -np.log(np.maximum(p, 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    return model


@lru_cache(1)
def default_classifier() -> Classifier:
    return train(examples(EXAMPLES, SEED))


def scan_texts(texts: list[str], model: Classifier) -> tuple[list[int], list[list[dict]]]:
    """Paragraph counts, and the licence paragraphs of each text."""
    parts, owners, numbers, counts = [], [], [], []
    for k, text in enumerate(texts):
        lines = [(i, x) for i, x in enumerate(text.encode().split(b"\n")) if x.strip()]
        counts.append(len(lines))
        parts += [x for _, x in lines]
        owners += [k] * len(lines)
        numbers += [i for i, _ in lines]
    found: list[list[dict]] = [[] for _ in texts]
    if not parts:
        return counts, found
    places, lines = _featured(parts)
    p = model.probabilities(model.scores(places, lines, len(parts)))
    best = p.argmax(axis=1)
    for k in np.flatnonzero((best > 0) & (p.max(axis=1) >= SURE)):
        shared = model.similarity(parts[k], best[k])
        if shared >= SHARED:
            row = {"line": numbers[k], "family": FAMILIES[best[k]]}
            row |= {"probability": float(p[k, best[k]]), "similarity": shared}
            found[owners[k]].append(row)
    return counts, found


def licence_scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_paragraphs and the licence paragraphs found.

    `licences` lists line number, family, calibrated probability and similarity to the
    family's texts, in the order of the lines. Paragraphs that are no licence, or of
    an unknown one, are not listed. Null and empty texts have no paragraphs. Repeated
    rows are scanned alike; only doc_id and text are read, whatever other columns are
    called, and an empty table gives no rows. The model has a fixed
    number of weights, sent to the executors once.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(model or default_classifier())
    named = docs.select("doc_id", text_of().alias("text"))
    kind = "array<struct<line:long,family:string,probability:double,similarity:double>>"
    arrow = pa.list_(
        pa.struct([("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                counts, found = scan_texts(part.column("text").to_pylist(), model.value)
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, arrow)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_paragraphs", "licences"])

    schema = named.select(
        "doc_id", F.lit(0).cast("long").alias("n_paragraphs"), F.lit(None).cast(kind).alias("licences")
    ).schema
    return named.mapInArrow(run, schema)
