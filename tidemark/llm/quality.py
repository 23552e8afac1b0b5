"""Quality by a generalised additive model with pairwise interactions.

Shallow trees, boosted one feature after another in cycles, add up to one table of values for each feature's bins, then to small tables for the
pairs that explain most of what is left. A score is a sum of looked-up values, taken for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.toxicity import sample_ids

#: Labelled rows that a model is fitted on at most: those first by a hash of their id.
SAMPLE_ROWS = 30_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAST_IN_LEAF = 48, 8, 8, 150, 60, 0.15, 12

NAMES = ("log_words", "word_length", "upper", "digits", "symbols", "stops", "other", "distinct_words", "repeats", "distinct_lines", "line_words", "longest_word", "bars", "marked", "repeated_pairs")

_CLASS = np.full(256, 6, np.int64)
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[*b" \t\n\r\x0b\x0c"]] = 3
_CLASS[[*b".,;:?'\"()-"]] = 4
_CLASS[[*b"#$%&*@!<>{}[]\\^_~=+/|"]] = 5


def features(text: str) -> tuple[float, ...]:
    """Numbers about the whole text, in the order of NAMES; the empty text has zeros."""
    data = text.encode()
    if not data:
        return (0.0,) * len(NAMES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lower, upper, digits, _, stops, symbols, other = np.bincount(_CLASS, counts, 7)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n, ink = max(1, len(words)), max(1.0, lower + upper + digits + stops + symbols + other)
    return (
        float(np.log1p(len(words))), ink / n, upper / max(1.0, upper + lower), digits / ink, symbols / ink, stops / n, other / ink,
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        float(np.log1p(max(map(len, words), default=0))), counts[124] / n, (counts[33] + counts[35] + counts[36] + counts[37] + counts[38] + counts[42]) / n,
        1 - len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1),
    )


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features."""
        total = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, k], "right")]
        coarse = {}
        for a, b, table in self.pairs:
            for k in (a, b):
                if k not in coarse:
                    coarse[k] = np.searchsorted(self.pair_cuts[k], x[:, k], "right")
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    """Borders between values, so that equal values share a bin."""
    u = np.unique(v)
    if len(u) <= bins:
        return (u[1:] + u[:-1]) / 2
    q = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))
    return q[(q > u[0]) & (q <= u[-1])]


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values for the bins by a tree of up to three leaves on sums of gradients, hessians and rows."""
    borders = [0, len(g)]
    for _ in range(2):
        best = (1e-6, None)
        for a, b in zip(borders, borders[1:], strict=False):
            if b - a < 2:
                continue
            cg, ch, cn = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
            lg, lh, ln = cg[:-1], ch[:-1], cn[:-1]
            rg, rh, rn = cg[-1] - lg, ch[-1] - lh, cn[-1] - ln
            gain = np.where((ln >= LEAST_IN_LEAF) & (rn >= LEAST_IN_LEAF), lg**2 / (lh + 1) + rg**2 / (rh + 1) - cg[-1] ** 2 / (ch[-1] + 1), 0)
            if (top := gain.max()) > best[0]:
                best = (top, a + 1 + int(gain.argmax()))
        if best[1] is None:
            break
        borders = sorted([*borders, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(borders, borders[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best pair of cuts through a table of sums."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    best, out = 0.0, np.zeros(g.shape)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            sums = [(c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]) for c in (cg, ch)]
            gain = sum(a * a / (b + 1) for a, b in zip(*sums, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
            if gain > best:
                best, v = gain, [-a / (b + 1) for a, b in zip(*sums, strict=True)]
                out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Main tables first, in cycles, then tables for the pairs with the most gain on what is left."""
    prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    total = np.full(len(y), float(np.log(prior / (1 - prior))))
    k = x.shape[1]
    if not len(y) or y.min() == y.max():
        return Model(float(np.log(prior / (1 - prior))), [np.zeros(0)] * k, [np.zeros(1)] * k, [np.zeros(0)] * k, [])
    base = total[0]
    cuts, pair_cuts = [_cuts(x[:, i], BINS) for i in range(k)], [_cuts(x[:, i], PAIR_BINS) for i in range(k)]
    at = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    sizes = [np.bincount(a, minlength=len(t)) for a, t in zip(at, tables, strict=True)]
    for _ in range(ROUNDS):
        for a, t, n in zip(at, tables, sizes, strict=True):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree(np.bincount(a, p - y, len(t)), np.bincount(a, p * (1 - p), len(t)), n)
            t += step
            total += step[a]
    coarse = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(pair_cuts)]
    wide = [len(c) + 1 for c in pair_cuts]

    def sums(a: int, b: int):
        p = 1 / (1 + np.exp(-total))
        cell = coarse[a] * wide[b] + coarse[b]
        return (np.bincount(cell, w, wide[a] * wide[b]).reshape(wide[a], wide[b]) for w in (p - y, p * (1 - p)))

    gains = sorted(((_quarters(*sums(a, b))[0], a, b) for a, b in combinations(range(k), 2)), reverse=True)[:PAIRS]
    pairs = [(a, b, np.zeros((wide[a], wide[b]))) for g, a, b in gains if g > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, t in pairs:
            step = RATE * _quarters(*sums(a, b))[1]
            t += step
            total += step[coarse[a], coarse[b]]
    return Model(float(base), cuts, tables, pair_cuts, pairs)


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f) for every document, f being the features of its text."""
    common.shipped(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([features(t) for t in common.texts(b)], pa.list_(pa.float64()))], names=["doc_id", "f"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(made, "doc_id long, f array<double>")


def _train(featured: DataFrame, ids: list[tuple[int, int]]) -> Model:
    """A model from the rows of featured whose ids are in ids."""
    if not ids:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    chosen = F.broadcast(featured.sparkSession.createDataFrame(ids, "doc_id long, y int"))
    rows = featured.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("f").alias("f")).orderBy("doc_id").collect()
    return fit(np.array([r.f for r in rows]).reshape(-1, len(NAMES)), np.array([r.y for r in rows], float))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled documents whose crc32 of the id modulo 5 isn't 0.

    A null label, or a label of a null id, teaches nothing; of several labels of an id the largest counts, of several texts the one with the least features.
    Without usable labels the model gives 0.5 to all.
    """
    ids = sample_ids(labels, label, common.crc_mod(id_col, 5) == 0, rows, id_col)
    if not ids:
        return _train(docs, ids)
    chosen = F.broadcast(docs.sparkSession.createDataFrame([i[:1] for i in ids], "__tm_id long"))
    return _train(with_features(docs.join(chosen, F.col(id_col) == F.col("__tm_id"), "left_semi"), id_col, text_col), ids)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document by a model trained on the labels.

    Null text is the empty text. No usable labels: every score is 0.5. A null id is held in and has no label; ids that repeat are scored each time.
    Equal texts have equal scores. No documents: no rows. Further columns are left out.
    """
    featured = common.checkpointed(with_features(docs, id_col, text_col))
    model = _train(featured, sample_ids(labels, "quality", common.crc_mod(id_col, 5) == 0, SAMPLE_ROWS, id_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(m.score(x))], names=["doc_id", "held_out", "score"])

    marked = featured.select("doc_id", (common.crc_mod("doc_id", 5) == 0).alias("held_out"), "f")
    return marked.mapInArrow(made, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs, all columns as they are, that the model scores at threshold or above.

    Null text is scored as the empty text. Ids aren't looked at, so null and repeated ones, and rows that repeat, stay or go by their texts alone; equal
    texts share their fate. A score equal to the threshold stays. No documents: no rows.
    """
    common.shipped(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in common.slices(batches, text_col):
            yield b.filter(pa.array(m.score(np.array([features(t) for t in common.texts(b, text_col)])) >= threshold))

    return docs.mapInArrow(good, docs.schema)
