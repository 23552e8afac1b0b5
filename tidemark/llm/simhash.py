"""Near copies by SimHash: fingerprints in blocks, joined on blocks, verified by Hamming distance.

A 64-bit fingerprint is cut into 4 blocks of 16 bits. Two fingerprints that differ in at most 2 bits agree in at least 2 blocks, so
each is entered under its 6 pairs of blocks and compared only with those under the same pair. Equal fingerprints are one entry.
A pair of blocks that very many fingerprints share isn't compared pair by pair: there each fingerprint is entered under itself and its
neighbours at one bit (outside the shared blocks). Entries that meet differ in at most 2 bits, any two that differ in at most 2 bits meet,
and linking all that meet to their smallest keeps every component, with links in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import connected_components

WORDS, SEED, BITS, BLOCK_BITS = 3, 42, 64, 16
#: Up to so many fingerprints under one pair of blocks are compared pair by pair.
PAIRWISE = 48
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str) -> int:
    """SimHash of the text's shingles of WORDS words, as an unsigned number; no words: 0."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII space alone
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < WORDS:
        hashes = np.array([digest(join(words), SEED)], "<u8")
    else:
        hashes = np.array([digest(join(w), SEED) for w in zip(*(words[i:] for i in range(WORDS)), strict=False)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "__tm_fp") -> DataFrame:
    """docs with the fingerprint as a signed 64-bit number; all columns stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    common.shipped(docs.sparkSession)
    out = docs.select("*", F.lit(0).cast("long").alias(name)).schema
    kinds = to_arrow_schema(docs.schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, text_col):
            found = np.array([fingerprint(t) for t in common.texts(b, text_col)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=[*kinds.names, name])

    return docs.mapInArrow(add, out)


def block_keys(fp):
    """The 6 pairs of blocks of a fingerprint: the mask of the two blocks, and their bits."""
    masks = [_signed(sum(0xFFFF << (BLOCK_BITS * i) for i in pair)) for pair in combinations(range(BITS // BLOCK_BITS), 2)]
    return F.explode(F.transform(F.lit(masks).cast("array<long>"), lambda m: F.struct(m.alias("mask"), fp.bitwiseAND(m).alias("bits"))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fingerprints: DataFrame) -> DataFrame:
    """Links (u, v), u > v, between distinct fingerprints (column fp) at 2 or fewer bits, enough of them to connect all that are so linked."""
    blocks = fingerprints.select("fp", block_keys(F.col("fp")).alias("b")).select("fp", "b.mask", "b.bits")
    shared = blocks.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = common.checkpointed(blocks.join(shared, ["mask", "bits"]))
    few = met.where(F.col("n") <= PAIRWISE)
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.mask") == F.col("b.mask")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") > F.col("b.fp")))
    pairs = pairs.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    many = met.where(F.col("n") > PAIRWISE).select("fp", "mask", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("i"))
    bit = F.expr("CASE WHEN i < 0 THEN 0L ELSE shiftleft(1L, i) END")
    many = many.where(F.col("mask").bitwiseAND(bit) == 0).select("fp", F.col("fp").bitwiseXOR(bit).alias("centre"))
    hubs = many.groupBy("centre").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub < top").select("centre", "hub")
    stars = many.join(hubs, "centre").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    return pairs.union(stars)


def groups(keyed: DataFrame) -> DataFrame:
    """(fp, label) for all distinct fingerprints of keyed (column fp): equal labels where fingerprints connect."""
    distinct = keyed.select("fp").distinct()
    found = connected_components(links(distinct))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id connected by fingerprints at 2 or fewer bits.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat give rows that repeat. A null doc_id stays null
    and is nobody's component_id unless there's no other in its component. No documents: no rows. Further columns are left out.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = common.checkpointed(with_fingerprint(narrow, name="fp").select("doc_id", "fp"))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = common.checkpointed(classes.join(groups(classes), "fp"))
    least = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    of = labels.join(least, "label").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each group: the one with the smallest id stays (a null id only where there's no other).

    All columns stay as they are. Null and empty texts are one group. Of rows with equal id and fingerprint one stays. No documents: no rows.
    Rows are stored once with their fingerprint and a number of their own; what is decided on is ids, fingerprints and numbers alone, and only rows
    that may go are moved.
    """
    marked = common.written(with_fingerprint(docs, text_col).withColumn("__tm_row", F.monotonically_increasing_id()), "fingerprinted")
    keys = marked.select(F.col(id_col).alias("id"), F.col("__tm_fp").alias("fp"), F.col("__tm_row").alias("row"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("fp").alias("fp"), F.col("row").alias("row"))
    best = common.checkpointed(keys.groupBy("fp").agg(F.min(order).alias("best")))
    chosen = best.join(groups(best), "fp").groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.row").alias("__tm_row"))
    gone = keys.select(F.col("row").alias("__tm_row")).join(chosen, "__tm_row", "left_anti")
    return common.without(marked, gone, "__tm_row").select(*(F.col(f"`{c}`") for c in docs.columns))
