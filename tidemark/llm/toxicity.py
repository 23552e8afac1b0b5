"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words and their stems, pairs of neighbours and pairs with one word between, hashed to 2 ** BITS coordinates. Each coordinate has a learning
rate of its own, and L1 leaves few weights, kept as sorted coordinates with values: a compact array that goes to every executor. Executors make the features
of the labelled texts; one task reads them in order, row by row from a spool on its disk, so that neither long texts nor many words take more memory than the coordinates do.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Labelled rows that a model is fitted on at most: those first by a hash of their id. All features of their whole texts count.
SAMPLE_ROWS = 8_000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 6.0, 1.0, 4
#: Coordinates are so many bits of the features' hashes.
BITS = 22
#: Coordinates in one row of what is sent to the task that fits.
PART = 1 << 15
CACHED = 200_000

_WORD = re.compile(r"\w+").findall
_U = np.uint64


#: Letters of the stems that count as words of their own.
STEMS = (5, 7)


class _Words(dict):
    """Rows of hashes: the word's own and its stems', 0 for stems no shorter than the word."""

    def __init__(self) -> None:
        super().__init__()
        self.rows = np.zeros((CACHED, 1 + len(STEMS)), np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        digest = xxhash.xxh64_intdigest
        self.rows[at] = (digest(word, 6), *(digest(word[:k], 6 + k) if len(word) > k else 0 for k in STEMS))
        self[word] = at
        return at


_HASHES: list[_Words] = []


def features(text: str) -> np.ndarray:
    """Hashes of the words, their stems, neighbour pairs and skip pairs, repeats included."""
    if not _HASHES or len(_HASHES[0]) > CACHED:
        _HASHES[:] = [_Words()]
    w = _WORD(text.lower())
    at = np.fromiter(map(_HASHES[0].__getitem__, w), np.int64, len(w))
    rows = _HASHES[0].rows[at]
    h, stems = rows[:, 0], rows[:, 1:].ravel()
    pairs = [_mixed(h[:-d] * _U(0x9E3779B97F4A7C15) + h[d:] * _U(0xC2B2AE3D27D4EB4F) + _U(d)) for d in (1, 2) if len(h) > d]
    return np.concatenate([h, stems[stems > 0], *pairs])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def coordinates(text: str) -> np.ndarray:
    """The distinct coordinates of a text's features, in order."""
    return np.unique((features(text) >> _U(64 - BITS)).astype(np.uint32))


@dataclass
class Model:
    keys: np.ndarray  # coordinates, sorted
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[self.keys] = self.weights

    def __reduce__(self):
        return Model, (self.keys, self.weights, self.bias)

    def score(self, text: str) -> float:
        """Probability that the text is toxic."""
        total = self.bias
        if len(self.keys):
            at = (features(text) >> _U(64 - BITS)).astype(np.int64)
            at = at[self.dense[at] != 0]
            if len(at):
                total += float(self.dense[np.unique(at)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def constant(labels: np.ndarray) -> Model:
    """The model of the labels' prior alone."""
    prior = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.0
    return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999)))))


def fit(rows: Callable[[], Iterable[np.ndarray]], labels: np.ndarray, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over rows of distinct coordinates, read in order once for each epoch. State is two numbers a coordinate, whatever the rows are."""
    if not len(labels) or labels.min() == labels.max():
        return constant(labels)
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = 1 << BITS  # has no L1 of its own
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    z[bias] = -np.log(prior / (1 - prior)) * (beta / alpha + l2)

    def weights(i: np.ndarray) -> np.ndarray:
        zi, lasso = z[i], np.where(i == bias, 0.0, l1)
        return np.where(np.abs(zi) <= lasso, 0.0, -(zi - np.sign(zi) * lasso) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for row, y in zip(rows(), labels, strict=True):
            i = np.append(row.astype(np.int64), bias)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    keys = np.nonzero(np.abs(z[:bias]) > l1)[0]
    return Model(keys.astype(np.uint32), weights(keys), float(weights(np.array([bias]))[0]))


def sample_ids(labels: DataFrame, label: str, held_out, rows: int, id_col: str = "doc_id") -> list[tuple[int, int]]:
    """(id, label) of at most rows labelled rows that aren't held out, first by a hash of the id; the largest label of an id counts."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return [(r.id, r.y) for r in ids.orderBy(F.xxhash64("id"), "id").limit(rows).collect()]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled documents whose crc32 of the id modulo 4 isn't 2.

    Null text is the empty text. A labelled id without a document teaches nothing; one that repeats counts once for each of its documents. The order is
    that of the ids' hashes. One class of labels, or no labels: the prior alone.
    """
    spark = docs.sparkSession
    common.shipped(spark)
    ids = sample_ids(labels, label, common.crc_mod(id_col, 4) == 2, rows, id_col)
    if not ids:
        return constant(np.zeros(0))
    chosen = F.broadcast(spark.createDataFrame([(i, k, y) for k, (i, y) in enumerate(ids)], "__tm_id long, place int, y int"))
    own = docs.select(F.col(id_col).cast("long").alias("__tm_id"), F.col(text_col).alias("text")).join(chosen, "__tm_id").select("place", "y", "text", F.monotonically_increasing_id().alias("row"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            out = []
            for place, y, row, t in zip(b.column("place").to_pylist(), b.column("y").to_pylist(), b.column("row").to_pylist(), common.texts(b), strict=True):
                c = coordinates(t)
                out += [(place, y, row, k, c[k : k + PART].astype("<u4").tobytes()) for k in range(0, max(1, len(c)), PART)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["place", "y", "row", "part", "f"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, got = _from_spool((c for b in batches for c in zip(b.column("row").to_pylist(), b.column("y").to_pylist(), b.column("f").to_pylist(), strict=True)))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([model.keys.astype("<u4").tobytes()], pa.binary()), pa.array([model.weights.astype("<f8").tobytes()], pa.binary()), pa.array([model.bias])], names=["keys", "weights", "bias"])

    parts = own.mapInArrow(made, "place int, y int, row long, part int, f binary").repartition(1).sortWithinPartitions("place", "row", "part")
    found = parts.mapInArrow(fitted, "keys binary, weights binary, bias double").first()
    return constant(np.zeros(0)) if found is None else Model(np.frombuffer(found.keys, "<u4"), np.frombuffer(found.weights, "<f8"), found.bias)


def _from_spool(parts: Iterable[tuple[int, int, bytes]]) -> tuple[Model, int]:
    """A model from (row, label, some of its coordinates), rows together and in order; they go to a file of this task, and are read from it in each epoch."""
    labels, sizes, last = [], [], None
    with tempfile.TemporaryFile() as spool:
        for row, y, f in parts:
            if row != last:
                labels.append(y)
                sizes.append(0)
                last = row
            sizes[-1] += len(f)
            spool.write(f)

        def rows() -> Iterator[np.ndarray]:
            spool.seek(0)
            for n in sizes:
                yield np.frombuffer(spool.read(n), "<u4")

        return fit(rows, np.array(labels, float)), len(labels)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; null text is the empty text, which gets the prior. A null id counts as held in."""
    common.shipped(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([m.score(t) for t in common.texts(b)], pa.float64())], names=["doc_id", "held_out", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), (common.crc_mod(id_col, 4) == 2).alias("held_out"), F.col(text_col).alias("text"))
    return d.mapInArrow(made, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents by a model trained on the labels. No usable labels: the score is the prior. No documents: no rows.

    Ids that repeat are scored each time. Ties don't arise: a score depends on the text alone. Further columns are left out.
    """
    return score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
