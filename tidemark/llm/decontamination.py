"""Benchmark decontamination: short test items found inside long documents by size-partitioned MinHash containment search.

Items are put in classes by their number of distinct shingles. An item's signature is its smallest shingle hashes (a bottom-k MinHash), and the
class decides how many: a document that contains at least the threshold's share of an item lacks so few of its shingles that it
must hold one of that many, whichever they are, so the search loses nothing. A document also skips classes whose items are too large for it.
Candidates are then verified by exact containment of shingles.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

SHINGLE, THRESHOLD = 5, 0.8
#: Items of up to so many characters in all are sent to every executor; beyond, candidates are found by a join.
BROADCAST_CHARS = 32_000_000
#: Words whose hashes a worker keeps.
CACHED = 400_000
#: Bits of the sieve that documents' hashes pass before a join: 8 MB.
SIEVE_BITS = 26

_WORD = re.compile(r"\w+").findall
_U = np.uint64


class _Words(dict):
    def __missing__(self, word: str) -> int:
        self[word] = made = xxhash.xxh64_intdigest(word, 5)
        return made


_HASHES = _Words()


def words(text: str | None) -> list[str]:
    return _WORD((text or "").lower())


def shingles(of: list[str], n: int) -> list[tuple]:
    """Runs of n words; of fewer words, the whole; of none, none."""
    return list(zip(*(of[i:] for i in range(n)), strict=False)) if len(of) >= n else [tuple(of)] if of else []


def shingle_hashes(of: list[str], n: int) -> np.ndarray:
    """64-bit hashes of shingles(of, n)."""
    if len(_HASHES) > CACHED:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, of), np.uint64, len(of))
    width = min(n, len(of))
    if not width:
        return h
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return out


def needed(distinct: int, threshold: float) -> int:
    """Shingles that make up the threshold's share of an item."""
    return max(1, math.ceil(threshold * distinct - 1e-9))


@dataclass
class Class:
    """Items of like size: signatures of this length lose none of them, and fewest is what a document must hold of any."""

    length: int
    fewest: int


def class_of(distinct: int, threshold: float) -> Class:
    """The class of items with from a power of two to under the next as many distinct shingles."""
    low = 1 << (distinct.bit_length() - 1)
    high = 2 * low - 1
    return Class(max(n - needed(n, threshold) + 1 for n in range(low, high + 1)) if high < 4096 else high - needed(high, threshold) + 2, needed(low, threshold))


#: Sets of shingles that a worker keeps of the items it verified last.
HELD = 256


class Index:
    """The items' signatures as one sorted array, and their words as text; shingles for verifying are made when a candidate asks for them."""

    def __init__(self, items: Iterable[tuple[int, str]], n: int, threshold: float):
        self.n, self.threshold, self.ids, self.texts = n, threshold, [], []
        hashes, owners, fewest, sizes = [], [], [], []
        self.short, self.held = False, OrderedDict()
        for item, text in items:
            w = words(text)
            if not w:
                continue
            own = len(set(shingles(w, n)))
            kind = class_of(own, threshold)
            some = np.unique(shingle_hashes(w, n))[: kind.length]
            hashes.append(some)
            owners.append(np.full(len(some), len(self.ids), np.uint32))
            self.ids.append(item)
            self.texts.append(" ".join(w))
            fewest.append(kind.fewest)
            sizes.append(own)
            self.short |= len(w) < n
        self.fewest, self.sizes = np.array(fewest, np.int64), np.array(sizes, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        o = np.concatenate(owners) if owners else np.zeros(0, np.uint32)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners = h[order], o[order]
        self.bits = max(12, min(24, int(len(h)).bit_length() + 6))
        self.seen = self._seen()

    def _seen(self) -> np.ndarray:
        """Whether any signature begins with so many bits; 16 MB at most."""
        seen = np.zeros(1 << self.bits, bool)
        seen[(self.hashes >> _U(64 - self.bits)).astype(np.int64)] = True
        return seen

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("seen", "held")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.held, self.seen = OrderedDict(), self._seen()

    def shingles_of(self, k: int) -> set:
        """The distinct shingles of the k-th item."""
        if k in self.held:
            self.held.move_to_end(k)
        else:
            self.held[k] = set(shingles(self.texts[k].split(" "), self.n))
            if len(self.held) > HELD:
                self.held.popitem(last=False)
        return self.held[k]

    def matches(self, text: str) -> list[tuple[int, float, int]]:
        """(item, share of its shingles that the text has, their number), for shares from the threshold on."""
        w = words(text)
        if not self.ids or not w:
            return []
        found: set[int] = set()
        widths = range(1, self.n + 1) if self.short else (self.n,)
        for k in widths:
            some = shingle_hashes(w, k)
            some = some[self.seen[(some >> _U(64 - self.bits)).astype(np.int64)]]
            if len(some):
                first, last = np.searchsorted(self.hashes, some, "left"), np.searchsorted(self.hashes, some, "right")
                for a, b in set(zip(first[last > first].tolist(), last[last > first].tolist(), strict=True)):
                    found.update(self.owners[a:b].tolist())
        if not found:
            return []
        own = {s for k in widths for s in (shingles(w, k) if len(w) >= k else ())} or set(shingles(w, self.n))
        out = []
        for k in sorted(found):
            n = int(self.sizes[k])
            if len(own) >= self.fewest[k] and (hits := len(self.shingles_of(k) & own)) >= needed(n, self.threshold):
                out.append((self.ids[k], hits / n, n))
        return out


def _small(items: DataFrame, text: str, most: int) -> bool:
    return (items.agg(F.sum(F.length(text) + 32)).first()[0] or 0) <= most


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id, containment, item_shingles) for every document that holds at least threshold of an item's distinct n-word shingles.

    Words are runs of letters, digits and _ in lower case. An item of fewer than n words counts as one shingle of all its words;
    an item without words (or null) is never found; null and empty documents hold nothing. Null ids stay null. A document or item that
    repeats gives rows that repeat. Empty tables give no rows. Further columns are left out.
    """
    spark = docs.sparkSession
    common.shipped(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    i = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    out = "doc_id long, item_id long, containment double, item_shingles long"
    if not _small(i, "text", broadcast_chars):
        return _by_join(d, i, n, threshold, out)
    shared = spark.sparkContext.broadcast(Index([tuple(r) for r in i.collect()], n, threshold))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in common.slices(batches):
            yield _rows([(doc, *m) for doc, t in zip(b.column("doc_id").to_pylist(), common.texts(b), strict=True) for m in index.matches(t)])

    return d.mapInArrow(find, out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, e = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64()), pa.array(e, pa.int64())], names=["doc_id", "item_id", "containment", "item_shingles"])


def _by_join(d: DataFrame, i: DataFrame, n: int, threshold: float, out: str) -> DataFrame:
    """The same where the items are too many to send about: shingle hashes of documents meet signatures in a join.

    A sieve of the signatures, of fixed size, goes to every executor, so that of a document's hashes only those are dealt out that an item may have.
    """
    d = d.withColumn("d_row", F.monotonically_increasing_id())
    i = i.withColumn("i_row", F.monotonically_increasing_id())
    d, i = common.checkpointed(d), common.checkpointed(i)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            for row, t in zip(b.column("i_row").to_pylist(), common.texts(b), strict=True):
                w = words(t)
                h = np.unique(shingle_hashes(w, n))[: class_of(len(set(shingles(w, n))), threshold).length] if w else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row), pa.int64()), pa.array(h.view(np.int64)), pa.array(np.full(len(h), len(w) < n), pa.bool_())], names=["i_row", "h", "short"])

    right = common.checkpointed(i.select("i_row", "text").mapInArrow(signatures, "i_row long, h long, short boolean"))
    word = F.shiftrightunsigned("h", 64 - SIEVE_BITS + 6)
    bits = right.groupBy(word.alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - SIEVE_BITS}) & 63 AS INT))")).alias("bits")).toArrow()
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    sieve[bits.column("w").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    shared = d.sparkSession.sparkContext.broadcast((sieve, bool(right.where("short").limit(1).count())))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, short = shared.value
        for b in common.slices(batches):
            for row, t in zip(b.column("d_row").to_pylist(), common.texts(b), strict=True):
                w = words(t)
                h = np.concatenate([shingle_hashes(w, k) for k in (range(1, n + 1) if short else (n,))]) if w else np.zeros(0, np.uint64)
                at = h >> _U(64 - SIEVE_BITS)
                h = np.unique(h[(sieve[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row), pa.int64()), pa.array(h.view(np.int64))], names=["d_row", "h"])

    left = d.select("d_row", "text").mapInArrow(hashed, "d_row long, h long")
    met = common.checkpointed(left.join(right.select("i_row", "h"), "h").select("d_row", "i_row").distinct())
    both = met.join(d.withColumnRenamed("text", "d_text"), "d_row").join(i.withColumnRenamed("text", "i_text"), "i_row").select("doc_id", "item_id", "d_text", "i_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "d_text"):
            rows = []
            for doc, item, a, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "d_text", "i_text")), strict=True):
                rows += [(doc, item, share, k) for _, share, k in Index([(item, t)], n, threshold).matches(a or "")]
            yield _rows(rows)

    return both.mapInArrow(verify, out)


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """docs, all columns as they are, without the documents that contain an item; nulls and ties as in contaminated()."""
    spark = docs.sparkSession
    common.shipped(spark)
    i = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    if not _small(i, "text", broadcast_chars):
        rows = common.checkpointed(docs.withColumn("__tm_row", F.monotonically_increasing_id()))
        bad = contaminated(rows, items, "__tm_row", text_col, item_col, item_text_col, n, threshold, broadcast_chars)
        return common.without(rows, bad.select(F.col("doc_id").alias("__tm_row")), "__tm_row").drop("__tm_row")
    shared = spark.sparkContext.broadcast(Index([tuple(r) for r in i.collect()], n, threshold))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in common.slices(batches, text_col):
            yield b.filter(pa.array([not index.matches(t) for t in common.texts(b, text_col)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
